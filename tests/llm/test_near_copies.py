import corpus_pipeline as C
import numpy as np
import pytest

from casetide.llm import components
from casetide.llm import near_copies as N

DOCS = "doc_id long, text string"


def grams(text):
    words = (text or "").encode().lower().split()
    size = min(5, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def brute(rows):
    """Smallest id of every document's group, by the definition."""
    sets = [grams(t) for _, t in rows]
    group = {i: i for i, _ in rows}
    pairs = []
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] == sets[y] or both and both / len(sets[x] | sets[y]) >= 0.8:
                pairs.append((rows[x][0], rows[y][0]))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    return group


def near(n=120, seed=4):
    rng = np.random.default_rng(seed)
    say = lambda k: [f"w{i}" for i in rng.integers(0, 5000, k)]
    common, rows = say(40), []
    for base in range(n // 6):
        words = say(int(rng.integers(3, 150)))
        for _ in range(6):
            copy = list(words)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 1 + len(copy) // 30))):
                copy[at] = "changed" if rng.random() < 0.5 else f"w{rng.integers(5000)}"
            rows.append(" ".join(copy + common if base % 3 == 0 else copy[: len(copy) - int(rng.integers(0, 3))]))
    rows += [None, "", " \n", "ONE two", "one\tTWO", "three"]
    return list(enumerate(rows))


@pytest.mark.parametrize("limits", [{}, {"one_in": 0, "rounds": 0}, {"one_in": 1, "rounds": 2}, {"one_in": 2, "rounds": 0}])
def test_groups_equal_brute_force(spark, limits):
    rows = near()
    out = {r["doc_id"]: r["component_id"] for r in N.near_copies(spark.createDataFrame(rows, DOCS), **limits).collect()}
    assert out == brute(rows)


def test_stage_finds_near_copies_of_the_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    group = brute(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    out = C.near_duplicates(spark, docs, "").collect()
    assert {r["doc_id"] for r in out} == {i for i, g in group.items() if i == g}


def test_odd_rows_of_the_stage(spark):
    rows = [(None, "a b c d e f", "p"), (None, "a b c d e f", "p"), (1, "a b c d e f", "q"), (2, "A b  c d e f", "r"), (2, "a b c d e f", "s"), (3, None, ""), (4, "", "t"), (5, "x " * 30_000, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _nth string")
    out = N.one_of_each(df)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"] or 0, r["_nth"]) for r in out.collect())) == [(0, "p"), (0, "p"), (1, "q"), (3, ""), (5, "u")]
    groups = N.near_copies(df).collect()
    assert {(r["doc_id"], r["component_id"]) for r in groups} == {(None, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 5)}
    assert N.one_of_each(df.limit(0)).count() == 0


def far_group(n=400, seed=7):
    """Variants of one text, each with so many words changed that few are similar to any other."""
    rng = np.random.default_rng(seed)
    base, rows = [f"b{i}" for i in range(150)], []
    for _ in range(n):
        copy = list(base)
        for at in rng.choice(150, int(rng.integers(0, 12)), replace=False):
            copy[at] = f"w{rng.integers(10**9)}"
        rows.append(" ".join(copy))
    return list(enumerate(rows))


def test_large_group_of_texts_below_the_limit_is_not_compared_in_full(spark, monkeypatch):
    rows, seen = far_group(), []
    possible = N._possible
    monkeypatch.setattr(N, "_possible", lambda both: (seen.append(both.count()), possible(both))[1])
    out = {r["doc_id"]: r["component_id"] for r in N.near_copies(spark.createDataFrame(rows, DOCS), rounds=1).collect()}
    assert out == brute(rows)
    assert len(set(out.values())) > 100
    # Fewer rows are joined than there are pairs of texts, though the prefixes of many share several shingles.
    assert seen[-1] < 400 * 399 // 2


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    sets = [N.shingles_of(N.words_of(t)) for _, t in near(60) + far_group(40)]
    drawn = [np.unpackbits(N.sketch(s).view(np.uint8)) for s in sets]
    assert all((drawn[x] != drawn[y]).sum() <= len(np.setxor1d(sets[x], sets[y])) for x in range(len(sets)) for y in range(x))
    # Sets of 3,000 shingles each, none in common, differ in about half of the 512 bits.
    x, y = (N.sketch(N.shingles_of([b"%s%d" % (c, i) for i in range(3004)])) for c in (b"x", b"y"))
    assert 180 < (np.unpackbits(x.view(np.uint8)) != np.unpackbits(y.view(np.uint8))).sum() < 330


@pytest.mark.parametrize("rows_per_task", [1, 300, 20_000])
def test_components_in_few_tasks_are_the_same(spark, rows_per_task):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 1500, (800, 2))] + [(i, i + 1) for i in range(5000, 5200)]
    df = spark.createDataFrame(links, "a long, b long")
    plain = sorted(map(tuple, components.connected(df).collect()))
    assert sorted(map(tuple, components.connected(df, rows_per_task=rows_per_task).collect())) == plain
    edges = df.where("a != b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v")
    assert components._small_star(edges, 1).rdd.getNumPartitions() == 1
