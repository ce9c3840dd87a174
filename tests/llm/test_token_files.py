import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from casetide.llm import mixing_coder as M
from casetide.llm import token_files as T

DOCS = "doc_id long, text string, start string, ids string"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, M.IDS - 1)), max_size=300), st.sampled_from([1, 7, 64, 4096]), st.sampled_from([1, 3, 1024]))
def test_round_trip(ids, block, lanes):
    ids = np.array(ids, np.uint32)
    assert (M.decode(M.encode(ids, block, lanes), len(ids), block, lanes) == ids).all()


def test_round_trip_of_long_input():
    rng = np.random.default_rng(0)
    for ids in (rng.zipf(1.3, 30_000) % 49_408, np.zeros(30_000), np.full(9000, M.IDS - 1), np.tile([1, 2, 3, 70], 5000)):
        ids = ids.astype(np.uint32)
        codes = M.encode(ids)
        assert (M.decode(codes, len(ids)) == ids).all()
    assert sum(len(c) for c, _ in codes) < 0.05 * 2 * len(ids)  # a pattern is learned


def test_blocks_are_independent():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 1000) % 40_000).astype(np.uint32)
    codes = M.encode(ids, 100)
    for i, code in enumerate(codes):
        assert (M.decode([code], 100, 100) == ids[100 * i : 100 * i + 100]).all()
        assert M.encode(ids[100 * i : 100 * i + 100], 100) == [code]


def test_blocks_take_little_memory():
    """No table by lane and id: what coding needs goes with the ids that there are."""
    ids = (np.random.default_rng(2).zipf(1.3, 64 * M.BLOCK) % 3000).astype(np.uint32)
    for work, given in ((M.encode, (ids,)), (M.decode, (M.encode(ids), len(ids)))):
        tracemalloc.start()
        work(*given)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 64 * len(ids)


def test_damage_of_a_block_never_gives_other_ids():
    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.3, 1000) % 3000).astype(np.uint32)
    (code, check), *_ = M.encode(ids)
    damaged = [code[:at] + bytes([code[at] ^ 1 << at % 8]) + code[at + 1 :] for at in rng.integers(0, len(code), 40).tolist()]
    found = 0
    for raw in [*damaged, code[:50], b""]:
        try:
            assert (M.decode([(raw, check)], len(ids)) == ids).all()  # the last bits don't all count
        except ValueError:
            found += 1
    assert found > 35


def test_mixing_beats_plain_deflate(spark):
    ids, _ = T.ids_of([r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()], T.FILE, False)
    assert sum(len(c) for c, _ in M.encode(ids)) < len(zlib.compress(ids.astype("<u2").tobytes(), 6))


def test_damage_is_an_error():
    ids = np.arange(500, dtype=np.uint32)
    (code, check), *_ = M.encode(ids)
    with pytest.raises(ValueError):
        M.decode([(code[:40] + bytes([code[40] ^ 1]) + code[41:], check)], 500)
    with pytest.raises(ValueError):
        M.encode(np.array([M.IDS], np.uint32))
    raw = T.encode_segment([1, None], ids, np.array([200, 500]))
    keys, back, ends = T.decode_segment(raw)
    assert keys == [1, None] and (back == ids).all() and ends.tolist() == [200, 500]
    for at in (0, 10, 40, len(raw) - 20):
        with pytest.raises(ValueError):
            T.decode_segment(raw[:at] + bytes([raw[at] ^ 255]) + raw[at + 1 :])


@pytest.mark.parametrize("chars", [T.SEGMENT_CHARS, 50])
def test_odd_rows(spark, chars):
    docs = [(5, "five words are here now", "", ""), (1, None, "", ""), (3, "", "", ""), (5, "again five", "", ""), (None, "no id", "", ""), (9, "word " * 4000, "", "")]
    df = spark.createDataFrame(docs, DOCS)
    rows = sorted(T.stored(df, segment_chars=chars).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 3, 5, 5, 9]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(T.FILE))
    at = 0
    for r, (_, text) in zip(rows, [(None, "no id"), (1, ""), (3, ""), (5, "again five"), (5, "five words are here now"), (9, "word " * 4000)], strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert r["ids"] == ids and (r["start"], r["n_tokens"]) == (at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert T.stored(df.limit(0)).count() == 0


def test_query_against_the_library(spark):
    from casetide.llm.catalog import op10_mixing_coder

    sf = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted, at = [], 0
    for doc_id, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        wanted.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    out = op10_mixing_coder(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, out.collect())) == wanted
