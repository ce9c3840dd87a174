import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from casetide.llm import token_ids as T

FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
ODD = [
    None, "", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a \n b", "a\n\nb", "a\tb", "\ta", "a\r\nb", "a b", "a b c",
    "don't we'll I'M it's", "x'y", "12 345 6th ½ ²", "<|endoftext|> and <|startoftext|>", "Ünï cödé ñandú ç",
    "日本語 テキスト", "é é", "a\x1cb c\x1dd", "😀 a😀b", "ΣΑΣ ΟΔΟΣ", "A.B,C;D!!! ### $$$", "foo\x85bar", "_x_ __y", "İstanbul ẞ",
    "the the The THE " * 50,
]


def whole(file):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, T.END]


def split(texts, file, spaced):
    ids, ends = T.ids_of(texts, file, spaced)
    return [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)]


@pytest.mark.parametrize("file,spaced", FILES)
def test_ids_equal_the_library(file, spaced):
    encode = whole(file)
    assert split(ODD, file, spaced) == [encode(t) for t in ODD]


@pytest.mark.parametrize("file,spaced", FILES)
def test_ids_equal_the_library_on_documents(spark, file, spaced):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    encode = whole(file)
    assert split(texts, file, spaced) == [encode(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sSé \n\t1²½.!_\x1c\xa0日<|>"), max_size=12), max_size=4))
def test_ids_equal_the_library_on_any_text(texts):
    for file, spaced in FILES:
        encode = whole_cached(file)
        assert split(texts, file, spaced) == [encode(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x17F), max_size=30), max_size=3))
def test_ids_equal_the_library_on_latin_text(texts):
    test_ids_equal_the_library_on_any_text.hypothesis.inner_test(texts)


def test_every_plain_character_beside_every_kind(spark):
    """Each character that goes the fast way, before and after a letter, a digit, a mark and a blank."""
    plain = [chr(c) for c in range(256) if T._PLAIN.match(chr(c))]
    texts = [f"{a}{c}{b}{c}{c}" for c in plain for a in ("a", "É", "1", "²", "'", "!", " ", "\n") for b in ("s", "7", "- ", "")]
    encode = whole_cached("byte_bpe_50k.json")
    assert len(plain) > 180 and split(texts, "byte_bpe_50k.json", True) == [encode(t) for t in texts]


CACHED = {}


def whole_cached(file):
    if file not in CACHED:
        CACHED[file] = whole(file)
    return CACHED[file]


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(T, "KEPT_PIECES", 3)
    file, spaced = FILES[1]
    encode = whole_cached(file)
    for turn in range(4):
        texts = [f"one two{turn} three four five", "one two"]
        assert split(texts, file, spaced) == [encode(t) for t in texts]


def test_new_words_are_encoded_together(monkeypatch):
    file, spaced = FILES[1]
    kept = T._pieces(T.public_tokenizers.path(file))
    kept.start_anew()
    texts = ["Fünf neue, Wörter; hier", "and (five) new#words: HERE."]
    wanted = [whole_cached(file)(t) for t in texts]
    one_by_one = []
    missing = type(kept).__missing__
    monkeypatch.setattr(type(kept), "__missing__", lambda self, piece: one_by_one.append(piece) or missing(self, piece))
    assert split(texts, file, spaced) == wanted
    assert not [piece for piece in one_by_one if piece.isalpha()]


def test_every_mark_between_every_kind():
    """Cutting behind letters leaves the library's ids as they are."""
    file, spaced = FILES[1]
    marks = [chr(c) for c in range(128) if not chr(c).isalnum()]
    texts = [f"{a}{m}{b} {a}{m}{m}{b}{m} '{a}{m}'{b}" for m in marks for a in ("a", "É", "1", "'", "!") for b in ("s", "ß", "7", "", "'ll")]
    assert split(texts, file, spaced) == [whole_cached(file)(t) for t in texts]


def test_no_texts():
    ids, ends = T.ids_of([], *FILES[0])
    assert len(ids) == len(ends) == 0
