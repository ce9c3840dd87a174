import numpy as np

from casetide.llm import quality_gam as Q

DOCS = "doc_id long, text string, quality string, score string"


def test_features_of_odd_texts():
    x = Q.features([None, "", " \n ", "A", "é", "word " * 50_000, "\n".join(["same line"] * 9)])
    assert x.shape == (7, len(Q.FEATURES)) and np.isfinite(x).all()
    assert (x[0] == 0).all() and (x[1] == 0).all()
    assert x[6, Q.FEATURES.index("repeated_lines")] == 8 / 9


def test_tables_learn_curves_and_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no effect of either alone
    model = Q.fit(x, y, rounds=60)
    assert (1, 0) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    y = (np.abs(x[:, 2] - 0.5) < 0.2).astype(float)
    assert ((Q.fit(x, y, rounds=60).score(x) > 0.5) == y).mean() > 0.97


def test_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(1)
    x, y = rng.random((500, 3)), rng.integers(0, 2, 500).astype(float)
    model = Q.fit(x, y, rounds=5)
    row = x[7]
    total = model.base + sum(t[np.searchsorted(c, v, "right")] for c, t, v in zip(model.cuts, model.tables, row, strict=True))
    total += sum(
        g[np.searchsorted(model.coarse[j], row[j], "right"), np.searchsorted(model.coarse[k], row[k], "right")]
        for (j, k), g in zip(model.pairs, model.grids, strict=True)
    )
    assert abs(model.score(x)[7] - 1 / (1 + np.exp(-total))) < 1e-12


def test_without_labels_or_with_one_kind(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y"), (1, "a b", "x", "y"), (None, None, None, None), (3, "", "", "")], DOCS)
    none = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    rows = Q.judge(docs, none).collect()
    assert len(rows) == 4 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in rows)
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert all(r["score"] > 0.5 for r in Q.judge(docs, ones).collect())
    assert Q.judge(docs.limit(0), ones).count() == 0
    kept = Q.accepted(docs, none)
    assert kept.columns == docs.columns and kept.count() == 4


def test_held_out_fold_is_never_learned(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", (Q.held_out("doc_id").cast("int") + labels["quality"]) % 2)
    first, second = (sorted(map(tuple, Q.judge(docs, x).collect())) for x in (labels, turned))
    assert first == second
    # Other columns have no say.
    plain = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'s' AS source", "0L AS n_chars")
    assert sorted(map(tuple, Q.judge(plain, labels).collect())) == first


def test_accuracy_on_the_held_out_fold(spark):
    from casetide.llm.catalog import op4_quality_gam

    sf = "/root/testdata/sf0.01"
    out = op4_quality_gam(spark, sf)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = out.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    right = [r["predicted"] == r["quality"] for r in held]
    assert len(right) > 50 and np.mean(right) > 0.97
    bad = [r["score"] for r in held if r["quality"] == 0]
    good = [r["score"] for r in held if r["quality"] == 1]
    assert np.mean([b < g for b in bad for g in good]) > 0.98
