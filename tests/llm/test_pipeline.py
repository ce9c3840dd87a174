from collections import Counter

import corpus_pipeline as C
import pytest

from casetide.llm import decontaminate, quality_gam, simhash_trie
from test_near_copies import brute

SF = "/root/testdata/sf0.01"


def test_stages():
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "decontamination", "packing"]
    assert C.ORACLE_SQL is None


def test_run_equals_the_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = quality_gam.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    scores = model.score(quality_gam.features([t for _, t in rows]))
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]
    group = brute(rows)
    rows = [r for r in rows if group[r[0]] == r[0]]
    index = decontaminate.Index(items)
    rows = [r for r in rows if not index.hits(r[1])]
    out = C.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == {i for i, _ in rows}
    first = Counter(r["doc_id"] for r in out if r["piece"] == 0)
    assert set(first.values()) == {1}
    used = Counter()
    for r in out:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024


@pytest.mark.parametrize("nth", [0, 1, 2])
def test_stages_keep_the_columns(spark, nth):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).selectExpr("*", "1 AS fingerprint", "2 AS component_id")
    out = C.STAGES[nth][1](spark, docs, SF)
    assert out.columns == docs.columns and 0 < out.count() <= 60
    assert C.STAGES[nth][1](spark, docs.limit(0), SF).count() == 0


def test_stages_with_odd_rows(spark, tmp_path):
    docs = [(1, None, None, None, None), (None, "a b c d", "en", "s", 7), (3, "", "en", "s", 0), (3, "", "en", "s", 0), (4, "x " * 50_000, "en", "s", 100_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"] or 0) for r in simhash_trie.one_of_each(df).collect()) == [0, 1, 4]
    for _, stage in C.STAGES:
        assert stage(spark, df, SF).count() >= 0
