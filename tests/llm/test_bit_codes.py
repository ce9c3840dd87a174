import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casetide.llm import bit_codes as B

SF = "/root/testdata/sf0.01"
ROWS = "vec_id long, embedding array<double>, label long, row string, q string, score string, block string"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    """``rows``: id, vector, label."""
    rows = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and usable(v)]
    out = []
    for n, (i, v, y) in enumerate(rows):
        if not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for m, (j, w, z) in enumerate(rows) if m != n and len(w) == len(v)]
        for p, j, _ in sorted(x for x in scored if x[2] == y)[:positives]:
            fit = sorted(x for x in scored if x[2] != y and low * -p <= 100 * -x[0] <= high * -p)
            out += [(i, j, rank, x[1], -p, -x[0]) for rank, x in enumerate(fit[:negatives], 1)]
    return sorted(out)


def test_query_equals_brute_force(spark):
    from casetide.llm.catalog import op13_bit_codes

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rows = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows]
    wanted = brute(rows, lambda i: i % 50 == 0)
    assert wanted
    assert sorted(map(tuple, op13_bit_codes(spark, SF).collect())) == wanted


@pytest.mark.parametrize("size", [1, 3, 64, 70, 130])
def test_intervals_hold(size):
    rng = np.random.default_rng(size)
    q = np.floor(rng.standard_normal((300, size)) * rng.choice([0, 1, 1e3, 1e6], (300, 1))).astype(np.int64)
    code, length, align = B.encode(q)
    lower, upper = B.Anchors(q[:40]).interval(code, length, align)
    exact = q[:40] @ q.T
    assert (lower <= exact).all() and (exact <= upper).all()


def test_most_rows_are_not_scored():
    """Groups around centres: what an anchor is not near to is dropped by its code."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 64))
    q = np.floor(256 * (centres[rng.integers(0, 40, 8000)] + 0.2 * rng.standard_normal((8000, 64)))).astype(np.int64)
    best = B._Best(q[:200], np.full((200, 1), -(2**62)), np.full((200, 1), 2**62), 5)
    code, length, align = B.encode(q)
    ids, scored, at, many = np.arange(8000), 0, 0, 64
    while at < 8000:
        s = slice(at, at + many)
        scored += best.take(q[s], code[s], length[s], align[s], ids[s], ids[s], lambda a, s=s: ids[a, None] != ids[s])
        at, many = at + many, many * 2
    assert scored < 0.25 * 200 * 8000
    wanted = q[:200] @ q.T
    wanted[np.arange(200), np.arange(200)] = -(2**62)
    found = {(a, s) for a, s, _, _ in best.found.tolist()}
    assert found == {(a, s) for a in range(200) for s in np.sort(wanted[a])[-5:].tolist()}


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(9)
    rows = []
    for i in range(160):
        base = [math.cos(j * (i % 5 + 1)) for j in range(6)]
        # A third of all rows has one label.
        rows.append((i - 20, [b + rng.gauss(0, 0.3) for b in base], 1 if i % 3 == 0 else rng.randint(0, 4)))
    same = [0.5, 0.25, -0.5, 0.5, 0.25, -0.5]
    rows += [(200, same, 1)] * 12 + [(201, [x * 0.9 for x in same], 2)] * 5 + [(200, same, 3)]
    rows += [(210, [0.0] * 6, 1), (211, [0.0] * 6, 2), (220, [], 1), (221, [], 1), (222, [], 2), (230, [1.0, 2.0], 1), (231, [1.0, 2.5], 1), (232, [0.7, 1.5], 2)]
    rows += [(None, same, 1), (240, None, 1), (241, same, None), (242, [None] * 6, 1), (243, [float("nan")] * 6, 1), (244, [float("inf")] * 6, 2)]
    return rows


@pytest.mark.parametrize("block", [(B.ANCHORS, B.ROWS), (7, 20)])
def test_odd_rows(spark, odd, block):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in odd], ROWS).repartition(3)
    out = sorted(map(tuple, B.mined(df, F.expr("vec_id % 10 = 0"), block=block).collect()))
    assert out == brute(odd, lambda i: i % 10 == 0)
    out = sorted(map(tuple, B.mined(df, F.expr("vec_id % 10 = 0"), positives=2, negatives=1, low=-100, high=200, block=block).collect()))
    assert out == brute(odd, lambda i: i % 10 == 0, 2, 1, -100, 200)


def test_empty_and_too_large(spark):
    df = spark.createDataFrame([], ROWS)
    assert B.mined(df, F.lit(True)).count() == 0
    df = spark.createDataFrame([(0, [1e30], 1, "", "", "", "")], ROWS)
    with pytest.raises(Exception, match="too large"):
        B.mined(df, F.lit(True)).count()
