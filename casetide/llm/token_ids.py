"""Token ids of many texts with one of the public tokenizer files.

The byte-level file: its vocabulary is given as ranks to a second library that takes a third of
the time per text. Both cut texts by the same pattern; where it speaks of letters and numbers
beyond Latin-1, or of white space other than blanks and line feeds, their Unicode tables might
differ, so such texts are encoded by the file's own library.

The word file: a tokenizer cuts a text into pieces and encodes each for itself. Words repeat,
so the ids of a piece are kept and a text becomes a list of looked-up pieces. Where a piece
begins depends on white space alone, except for unusual white space; such texts are encoded
whole. Texts of ASCII and Latin-1 letters are cut, lower-cased and reduced to different pieces
as columns; there marks behind a letter are a piece of their own, as they are for the
tokenizer.

Tests hold the ids of both to those of the tokenizers library's own ``encode``.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Sequence
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

END = 2

#: Pieces and ids that a Python worker keeps; beyond it starts anew.
KEPT_PIECES = 1_000_000
KEPT_IDS = 8_000_000
#: Pieces that are encoded in one call.
TOGETHER = 20_000

# What both libraries surely cut alike: ASCII and Latin-1 letters, blanks and line feeds.
_PLAIN = re.compile(r"[ -~\n\xa1-\xac\xae-\xff]*\Z")
# Separators that Python's split() takes for white space and the tokenizers don't.
_UNUSUAL_WORDS = re.compile(r"[\x1c-\x1f]")
# What is in no text that is cut as a column.
_NOT_COLUMNS = r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]"
# For the tokenizer a mark behind a letter always begins a piece, too, but for the apostrophe.
_MARKS = r"([a-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])"
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")


def _library(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
    return tokenizer


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte.

    Printable Latin-1 stands for itself, but for the soft hyphen; all others follow in order
    from U+0100 on.
    """
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class _Bytes:
    """Ids by the byte-level file, text by text."""

    def __init__(self, path: str):
        self.tokenizer, letters = _library(path), byte_letters()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(letters[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if _PLAIN.match(text):
            return self.fast.encode_to_numpy(text)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


class _Pieces(dict):
    """Number of each piece; a new piece is encoded when it is first asked for."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = _library(path)
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.words = Tokenizer(self.model)  # takes words as they are
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.closing[[i for token, i in vocabulary.items() if token.endswith(self.model.end_of_word_suffix)]] = True
        self.start_anew()

    def start_anew(self) -> None:
        self.clear()
        self.ids, self.ends = array("I", [END]), array("q", [1])  # piece 0 is the end of a text

    def __missing__(self, piece: str) -> int:
        if _LETTERS.match(piece):  # the tokenizer leaves it whole
            number = self.add([t.id for t in self.model.tokenize(self.spelled(piece))])
        else:
            number = self.add(self.encode(piece))
        self[piece] = number
        return number

    def spelled(self, letters: str) -> str:
        """A word as the vocabulary writes its bytes."""
        letters = letters.lower()
        return letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters)

    def take_in(self, pieces: Sequence[str]) -> None:
        """Encode new pieces of letters together."""
        new = [piece for piece in pieces if _LETTERS.match(piece)]
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            words = [self.spelled(piece) for piece in some]
            ids = np.array(self.words.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            ends = np.nonzero(self.closing[ids])[0] + 1
            if len(ends) != len(some):  # some word has no end of its own: left for one by one
                continue
            self.update(zip(some, range(len(self.ends), len(self.ends) + len(some)), strict=True))
            self.ends.frombytes((ends + len(self.ids)).tobytes())
            self.ids.frombytes(ids.tobytes())

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def add(self, ids: list[int]) -> int:
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        return len(self.ends) - 1

    def numbers(self, text: str) -> list[int]:
        if _UNUSUAL_WORDS.search(text):
            return [self.add(self.encode(text))]
        return list(map(self.__getitem__, text.split()))


@cache
def _bytes(path: str) -> _Bytes:
    return _Bytes(path)


@cache
def _pieces(path: str) -> _Pieces:
    return _Pieces(path)


def ids_of(texts: Sequence[str | None], file: str, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, each with the end id, and where each text ends.

    ``spaced``: a byte-level file, where a word's token includes the space before it;
    otherwise white space is dropped. A null text counts as empty.
    """
    path = public_tokenizers.path(file)
    if spaced:
        end = np.array([END], np.uint32)
        found = [x for text in texts for x in (_bytes(path).ids(text or ""), end)]
        stops = np.cumsum([len(x) for x in found], dtype=np.int64)[1::2]
        return np.concatenate([np.zeros(0, np.uint32), *found]), stops
    kept = _pieces(path)
    if len(kept) > KEPT_PIECES or len(kept.ids) > KEPT_IDS:
        kept.start_anew()
    number, counts = _numbers(kept, texts)
    ends = np.concatenate((np.zeros(1, np.int64), np.frombuffer(kept.ends, np.int64)))
    found = pa.LargeListArray.from_arrays(ends, np.frombuffer(kept.ids, np.uint32)).take(pa.array(number))
    return found.flatten().to_numpy(), found.offsets.to_numpy()[counts]


def _numbers(kept: _Pieces, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pieces of all texts, each text with an end, and where each text ends."""
    column = pc.fill_null(pa.array(texts, pa.large_string()), "")
    plain = pc.invert(pc.match_substring_regex(column, _NOT_COLUMNS))
    cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(column.filter(plain)), _MARKS, r"\1 \2"))
    words = cut.flatten().dictionary_encode()  # may have empty words, which have no ids
    pieces = words.dictionary.to_numpy(zero_copy_only=False)
    number = list(map(kept.get, pieces))
    new = [i for i, n in enumerate(number) if n is None]
    unknown = pieces[new].tolist()
    kept.take_in(unknown)
    for i, piece in zip(new, unknown, strict=True):
        number[i] = kept[piece]
    number = np.array(number, np.int64).take(words.indices)
    plain = plain.to_numpy(zero_copy_only=False)
    others = [kept.numbers(texts[i]) for i in np.nonzero(~plain)[0].tolist()]
    count = np.zeros(len(plain), np.int64)
    count[plain], count[~plain] = pc.list_value_length(cut), [len(x) for x in others]
    stops = np.cumsum(count + 1)
    at = np.zeros(stops[-1] if len(stops) else 0, np.int64)
    inside = np.ones(len(at), bool)
    inside[stops - 1] = False
    if others:
        of_plain = np.repeat(plain, count + 1)
        at[inside & ~of_plain] = [x for numbers in others for x in numbers]
        inside &= of_plain
    at[inside] = number
    return at, stops
