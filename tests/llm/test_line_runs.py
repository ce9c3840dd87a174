import hashlib

from pyspark.sql import functions as F

from casetide.llm import line_runs as R

DOCS = "doc_id long, text string, h1 string, gone string, batch string"
SF = "/root/testdata/sf0.01"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs, min_chars):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    keys = [[lower(line.strip(" \t\n\x0b\x0c\r")) for line in ls] for _, ls in split]
    docs = {}
    for own in keys:
        for k in set(own):
            docs[k] = docs.get(k, 0) + 1
    common = {k for k, n in docs.items() if n >= min_docs and len(k) >= min_chars}
    out = []
    for (i, ls), own in zip(split, keys, strict=True):
        kept = [line for line, k in zip(ls, own, strict=True) if k not in common]
        out.append((i, "\n".join(kept), len(ls), len(ls) - len(kept)))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark):
    from casetide.llm.catalog import op12_line_runs

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    wanted = [(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, g in brute(docs, 10, 1)]
    assert any(g for _, _, g, _ in wanted)
    assert sorted(map(tuple, op12_line_runs(spark, SF).collect()), key=repr) == sorted(wanted, key=repr)


ODD = [
    (1, "Same \nown\n\n\tSAME\x0b"), (2, " same\r\nÄ"), (3, "same\nä\n"), (None, "same\n\n"), (None, None),
    (4, ""), (4, ""), (5, "a\n" * 3000 + "b"), (5, "a\n" * 3000 + "b"), (6, "\n".join(map(str, range(4000)))),
]


def test_odd_rows(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in ODD], DOCS)
    for limits in ({"min_docs": 2}, {"min_docs": 1, "min_chars": 4}, {"min_docs": 3, "min_chars": 0, "batches": 7, "fanout": 2}):
        wanted = brute(ODD, limits["min_docs"], limits.get("min_chars", 1))
        assert rows(R.without_common_lines(df, **limits)) == wanted
    assert R.without_common_lines(df.limit(0)).count() == 0


def test_one_line_in_a_third_of_all_documents(spark, rows):
    docs = [(i, f"Menu\n{i}\n" + ("often" if i % 3 == 0 else str(-i))) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    assert rows(R.without_common_lines(df, min_docs=1000)) == brute(docs, 1000, 1)


def test_levels(spark):
    """Batches of counts: runs are merged level by level, and settled hashes are not counted on."""
    runs = R.LineRuns(spark, min_docs=3, fanout=2)
    for batch in range(7):
        runs.add(spark.createDataFrame([(1, 1, 1), (2, 2, 1), (10 + batch, 0, 1)], "h1 long, h2 long, docs long"))
        assert [len(level) for level in runs.levels] == [(batch + 1) >> i & 1 for i in range(len(runs.levels))]
    assert {tuple(r) for r in runs.common().collect()} == {(1, 1), (2, 2)}
    batch = spark.createDataFrame([(1, 1, 1), (10, 0, 1), (99, 0, 1)], "h1 long, h2 long, docs long")
    assert {r["h1"] for r in runs.new(batch).collect()} == {10, 99}
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_lines_seen_before(spark):
    """With one document as the limit the index is that of an incremental line deduplication."""
    runs = R.LineRuns(spark, min_docs=1)
    first, second = ([(1, 0, 1), (2, 0, 1)], [(2, 0, 1), (3, 0, 1)])
    runs.add(spark.createDataFrame(first, "h1 long, h2 long, docs long"))
    later = spark.createDataFrame(second, "h1 long, h2 long, docs long")
    assert [r["h1"] for r in runs.new(later).collect()] == [3]
    runs.close()


def test_runs_are_not_moved(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = R.LineRuns(spark, min_docs=2, fanout=9)
        some = spark.range(100).select(F.col("id").alias("h1"), F.col("id").alias("h2"), F.lit(2).alias("docs"))
        runs.add(some)
        runs.add(some.withColumn("h1", F.col("h1") + 50))
        counts = some.groupBy(*R.HASH).agg(F.sum("docs").alias("docs"))
        plan = runs.new(counts)._jdf.queryExecution().executedPlan().toString()
        # One exchange: the batch by its own counting.
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        runs.close()


def test_plan_has_no_python(spark):
    from casetide.llm.catalog import op12_line_runs

    plan = op12_line_runs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "SinglePartition"))
