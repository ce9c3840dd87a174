import zlib
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from casetide.llm import packing as P

SCHEMA = "doc_id long, text string, length string"


def fewest(lengths, capacity):
    """Fewest bins, by trying every order with first fit."""
    best = len(lengths)
    for order in set(permutations(lengths)):
        rooms = []
        for size in order:
            for i, room in enumerate(rooms):
                if room >= size:
                    rooms[i] -= size
                    break
            else:
                rooms.append(capacity - size)
        best = min(best, len(rooms))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=6))
def test_bound_is_below_the_fewest_bins(lengths):
    sizes = np.array(lengths)
    bound, least = P.lower_bound(sizes, 12), fewest(lengths, 12)
    bins, offsets = P.best_fit(sizes, 12)
    assert bound <= least <= bins.max() + 1
    for b in range(bins.max() + 1):
        spans = sorted((o, o + n) for o, n in zip(offsets[bins == b], sizes[bins == b], strict=True))
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False)) and spans[-1][1] <= 12


def test_bound_sees_more_than_the_sum():
    assert P.lower_bound(np.array([7] * 5), 12) == 5  # two don't fit
    assert P.lower_bound(np.array([5] * 9), 12) == 5  # three don't fit
    assert P.lower_bound(np.array([], int), 12) == 0


@pytest.mark.parametrize("length,wanted", [(1, [(0, 1)]), (10, [(0, 10)]), (11, [(0, 1), (1, 11)]), (20, [(0, 10), (10, 20)]), (25, [(0, 5), (5, 15), (15, 25)])])
def test_only_the_first_piece_is_shorter(length, wanted):
    assert [tuple(map(int, p)) for p in zip(*P.cut(length, 10), strict=True)] == wanted


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("part_pieces", [1_000_000, 50, 7])
def test_rows_are_packed_whole(spark, part_pieces):
    rng = np.random.default_rng(5)
    lengths = [int(x) for x in rng.integers(1, 33, 400)]
    df = spark.createDataFrame([(i % 350, n, "x") for i, n in enumerate(lengths)], "k long, length long, bins string")
    out = P.pack(df, 32, part_pieces)
    rows = out.collect()
    assert out.columns == ["k", "length", "bins", "sequence_id", "offset"]
    assert sorted((r["k"], r["length"]) for r in rows) == sorted((i % 350, n) for i, n in enumerate(lengths))
    bins = check(rows, 32)
    bound = P.lower_bound(np.array(lengths), 32)
    assert bound <= bins <= bound + 1 + 400 // part_pieces  # less than a sequence for each partition


def test_exchange_saves_sequences(spark):
    lengths = [17] * 30 + [15] * 30 + [5] * 40
    df = spark.createDataFrame([(n,) for n in lengths], "length long")
    alone = check(P.pack(df, 32, 10, rounds=1).collect(), 32)
    assert check(P.pack(df, 32, 10).collect(), 32) < alone


def test_equal_rows_and_clashes(spark):
    df = spark.createDataFrame([(1, 8)] * 50, "k long, length long")
    assert check(P.pack(df, 32, 6).collect(), 32) in (13, 14)
    with pytest.raises(ValueError):
        P.pack(df.withColumnRenamed("k", "item"))


def test_documents_with_odd_rows(spark):
    docs = [(3, "a b", "x"), (3, "a b", "x"), (None, "c", None), (1, None, "x"), (2, "", "x"), (9, "word " * 3000, "x")]
    out = P.packed_documents(spark.createDataFrame(docs, SCHEMA))
    rows = out.collect()
    check(rows, P.CAPACITY)
    assert sorted((r["doc_id"] or 0, r["piece"]) for r in rows) == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 0), (9, 0), (9, 1), (9, 2)]
    assert [r["ids"] for r in rows if r["doc_id"] in (1, 2)] == [[2], [2]]
    long = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == 9)
    assert long[1][0] == long[0][1] and long[1][1] == long[2][1] == P.CAPACITY
    assert P.packed_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_the_library(spark):
    from casetide.llm.catalog import op8_certified_packing

    sf = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = set()
    sizes = []
    for doc_id, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            wanted.add((doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
            sizes.append(b - a)
    out = op8_certified_packing(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = out.collect()
    assert len(rows) == len(wanted) and {tuple(r)[:5] for r in rows} == wanted
    assert check(rows, 1024) <= P.lower_bound(np.array(sizes)) + 1
