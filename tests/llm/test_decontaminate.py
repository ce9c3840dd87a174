from collections import Counter

import numpy as np
import pytest

from casetide.llm import decontaminate as D

DOCS = "doc_id long, text string, item_id string, similarity int"
ITEMS = "item_id long, text string, doc_id string"


def brute(docs, items):
    out = {}
    for doc_id, text in docs:
        words = D.words_of(text)
        for item_id, body in items:
            want = D.words_of(body)
            n = len(want)
            if not n or n > len(words):
                continue
            target, fp = Counter(D.shingles_of(want)), D.fingerprint(D.shingles_of(want))
            for at in range(len(words) - n + 1):
                window = D.shingles_of(words[at : at + n])
                alike = D.similarity(Counter(window), target)
                apart = (D.fingerprint(window) ^ fp).bit_count()
                if alike >= 0.8 and apart <= D.RADIUS and alike > out.get((doc_id, item_id), (0, 0, 0))[0]:
                    out[doc_id, item_id] = (alike, at, apart)
    return {(*k, at, apart, round(a, 9)) for k, (a, at, apart) in out.items()}


def mine(df):
    return {(r["doc_id"], r["item_id"], r["start_word"], r["hamming"], round(r["similarity"], 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: [str(w) for w in rng.choice(vocabulary, n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([14, 20, 20, 40, 60, 60, 3, 1, 4])]
    items[2] = (2, items[1][1])  # a repeated text
    docs = []
    for i in range(40):
        words = say(int(rng.integers(1, 200)))
        leak = items[i % len(items)][1].split()
        for _ in range(i % 4):
            leak[int(rng.integers(len(leak)))] = "changed"
        cut = int(rng.integers(len(words)))
        docs.append((i, " ".join(words[:cut] + leak + words[cut:]) if i % 5 else " ".join(words)))
    return docs, items


def test_equals_brute_force(spark, corpus):
    docs, items = corpus
    wanted = brute(docs, items)
    assert len(wanted) > 20 and any(w[4] < 1 for w in wanted)
    d = spark.createDataFrame([(*x, "no", 1) for x in docs], DOCS)
    b = spark.createDataFrame([(*x, "no") for x in items], ITEMS)
    assert mine(D.leaks(d, b)) == wanted
    assert mine(D.leaks(d, b, item_chars=100)) == wanted  # several blocks of items
    clean = D.clean(d, b)
    assert clean.columns == d.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {w[0] for w in wanted}


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    index = D.Index([(i, " ".join(f"x{j}" for j in rng.integers(0, 50, 30))) for i in range(300)])
    prints = [item.fp for item in index.items]
    for p in prints[:20] + [int(x) for x in rng.integers(0, 1 << 63, 50)]:
        for flip in (0, 5, 20):
            q = p ^ sum(1 << int(b) for b in set(rng.integers(0, 64, flip)))
            near = {i: (x ^ q).bit_count() for i, x in enumerate(prints) if (x ^ q).bit_count() <= D.RADIUS}
            assert dict(index.near(30, q)) == near


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, None), (2, ""), (3, "... !!!"), (None, "x " + item), (5, "One, TWO three! four five six seven eight nine ten."),
            (5, item), (6, "alpha " * 30_000 + item), (7, "one two three")]
    d = spark.createDataFrame([(*x, "no", 1) for x in docs], DOCS)
    b = spark.createDataFrame([(1, item, ""), (2, None, ""), (3, "", ""), (None, item, ""), (4, "?!", "")], ITEMS)
    found = [(r["doc_id"], r["item_id"], r["start_word"]) for r in D.leaks(d, b).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(found, key=key) == sorted(
        [(i, j, at) for i, at in ((None, 1), (5, 0), (5, 0), (6, 30_000)) for j in (None, 1)], key=key
    )
    assert D.leaks(d, b.limit(0)).count() == 0 == D.leaks(d.limit(0), b).count()
    assert D.clean(d, b.limit(0)).count() == len(docs)


def test_query_equals_brute_force(spark):
    from casetide.llm.catalog import op1_decontaminate

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    # Only windows that share a shingle can be alike; that keeps the brute force short.
    shared = set().union(*(D.shingles_of(D.words_of(t)) for _, t in items))
    some = [d for d in docs if not shared.isdisjoint(D.shingles_of(D.words_of(d[1])))]
    wanted = brute([(i, t) for i, t in some if len(t) < 6000], items)
    found = mine(op1_decontaminate(spark, sf))
    long = {i for i, t in some if len(t) >= 6000}
    assert {f for f in found if f[0] not in long} == wanted and wanted


def test_document_shorter_than_the_item(spark):
    words = [f"w{i}" for i in range(50)]
    docs = [(1, " ".join(words[:48])), (2, " ".join(words[2:])), (3, " ".join(words[:30])), (4, " ".join(words))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    out = {(r["doc_id"], r["start_word"], r["n_words"], round(r["similarity"], 9)) for r in D.leaks(d, b).collect()}
    assert out == {(1, 0, 48, round(44 / 46, 9)), (2, 0, 48, round(44 / 46, 9)), (4, 0, 50, 1.0)}
    assert [r["doc_id"] for r in D.clean(d, b).collect()] == [3]
