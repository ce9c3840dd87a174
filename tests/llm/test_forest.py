import numpy as np
import pytest

from casetide.llm import forest as T

VECTORS = "vec_id long, embedding array<float>, label int, n_links string, v string"


def brute(rows):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[i] = x / np.linalg.norm(x)
    ids = sorted(good)
    x = np.array([good[i] for i in ids])
    near = x @ x.T >= 0.95
    root = {i: i for i, *_ in rows if i is not None}
    for _ in ids:
        before = dict(root)
        for a, i in enumerate(ids):
            for b in np.nonzero(near[a])[0]:
                root[i] = min(root[i], root[ids[b]])
        if root == before:
            break
    links = {i: 0 for i in root} | {i: int(near[a].sum()) - 1 for a, i in enumerate(ids)}
    return {(i, links[i], root[i], root[i] == i) for i in root}


def cloud(n, size=16, groups=12, seed=0, noise=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, size))
    made = [centres[i % groups] / np.linalg.norm(centres[i % groups]) + noise * rng.standard_normal(size) for i in range(n)]
    return [(i, [float(np.float32(x)) for x in v], i % 3, "", "") for i, v in enumerate(made)]


@pytest.mark.parametrize("how", [{}, {"leaf_rows": 40, "levels": 2, "sample": 50}, {"leaf_rows": 16, "levels": 1, "rounds": 2}])
def test_links_equal_brute_force(spark, how):
    rows = cloud(300)
    out = {tuple(r) for r in T.near_duplicates(spark.createDataFrame(rows, VECTORS), trees=6, **how).collect()}
    wanted = brute(rows)
    found, there = sum(r[1] for r in out), sum(r[1] for r in wanted)
    assert len(out) == len(wanted) and 0.97 * there <= found <= there
    if not how:
        assert out == wanted


def test_blocks_of_a_large_leaf_are_exact(spark):
    rows = cloud(200, groups=1)
    # No round of splits at all: one leaf per tree, compared in blocks.
    out = {tuple(r) for r in T.near_duplicates(spark.createDataFrame(rows, VECTORS), trees=2, leaf_rows=30, rounds=0).collect()}
    assert out == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0, "", ""), (2, [2.0, 0.0], 0, "", ""), (3, [1.0, 0.01], 1, "", ""), (4, None, 0, "", ""), (5, [], 0, "", ""),
            (6, [0.0, 0.0], 0, "", ""), (7, [nan, 1.0], 0, "", ""), (8, [inf, 0.0], 0, "", ""), (9, [None, 1.0], 0, "", ""),
            (10, [1.0, 0.0], 0, "", ""), (11, [-1.0, 0.0], 0, "", ""), (12, [1.0, 0.0, 0.0], 0, "", ""), (13, [1e38, 1e38], 0, "", ""), (14, [1e-30, 1e-30], 0, "", "")]
    df = spark.createDataFrame([*rows, (None, [1.0, 0.0], 0, "", ""), (None, None, 0, "", "")], VECTORS)
    out = T.near_duplicates(df).collect()
    assert len(out) == 16
    assert {tuple(r) for r in out if r["vec_id"] is not None} == {
        (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (10, 3, 1, False), (13, 1, 13, True), (14, 1, 13, False),
        *((i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 11, 12)),
    }
    assert {tuple(r)[1:3] for r in out if r["vec_id"] is None} == {(0, None)}
    assert T.near_duplicates(df.limit(0)).count() == 0


def test_many_copies_are_one_class(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0, "", "") for i in range(3000)] + [(3000, [1.0, 2.0, 3.1], 0, "", "")]
    out = T.near_duplicates(spark.createDataFrame(rows, VECTORS), leaf_rows=16).collect()
    assert all(r["n_links"] == 3000 and r["component_id"] == 0 for r in out) and len(out) == 3001


def test_recall_of_the_query(spark):
    from casetide.llm.catalog import op3_projection_forest

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = {tuple(r) for r in op3_projection_forest(spark, sf).collect()}
    wanted = brute(rows)
    assert len(out) == len(wanted)
    assert sum(r[1] for r in out) >= 0.98 * sum(r[1] for r in wanted)


def test_a_large_tight_group_keeps_its_links(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    tight = centre / np.linalg.norm(centre) + 0.022 * rng.standard_normal((800, 64))
    x = np.concatenate((tight, rng.standard_normal((1600, 64))))
    unit = tight / np.linalg.norm(tight, axis=1, keepdims=True)
    wanted = int((unit @ unit.T >= 0.95).sum()) - len(tight)
    assert wanted > 0.9 * 800 * 799
    rows = [(i, v, 0, "", "") for i, v in enumerate(x.tolist())]
    out = T.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string, v string"), leaf_rows=32, sample=256).collect()
    assert 0.999 * wanted <= sum(r["n_links"] for r in out) <= wanted


def test_rows_of_a_cell_go_down_its_splits_together(spark):
    """In parts of some rows, however they lay in the table, and with the same leaves as all at once."""
    distinct = T.classes(spark.createDataFrame(cloud(1500, groups=400), VECTORS)).repartition(8)
    whole, parts = ({tuple(r) for r in T.leaves(distinct, trees=1, leaf_rows=200, rounds=1, part_rows=n).collect()} for n in (1500, 300))
    assert whole == parts and len({cls for cls, _ in whole}) == 1500 and len({cell for _, cell in whole}) > 4
