from pyspark.sql import functions as F

from casetide.operators import cases


def demo(spark, data):
    return spark.createDataFrame(
        data, "report_id long, caseid long, caseversion int, quarter string, sex string"
    )


def test_versions(spark, rows):
    given = demo(
        spark,
        [
            (10, 1, 1, "2024q1", "Male"),
            (11, 1, 2, "2024q1", "Male"),
            (12, 1, 2, "2024q1", "Female"),  # shares the highest version: stays
            (13, 1, 1, "2024q2", "Male"),  # highest in its own quarter
            (20, 2, None, "2024q1", "Male"),  # missing version counts as 0
            (21, 2, 1, "2024q1", "Male"),
            (30, 3, None, "2024q1", "Male"),
            (40, None, 5, "2024q1", "Male"),  # no case: goes
            (50, 5, 1, "2024q1", "Male"),
            (50, 5, 1, "2024q1", "Female"),  # same report twice: one stays
        ],
    )
    kept = cases.dedup_versions(given)
    assert kept.columns == given.columns
    assert rows(kept, "report_id", "caseversion", "quarter", "sex") == [
        (11, 2, "2024q1", "Male"),
        (12, 2, "2024q1", "Female"),
        (13, 1, "2024q2", "Male"),
        (21, 1, "2024q1", "Male"),
        (30, 0, "2024q1", "Male"),
        (50, 1, "2024q1", "Female"),
    ]


def test_versions_of_a_hot_case(spark, rows):
    given = spark.range(600).select(
        F.col("id").alias("report_id"),
        F.when(F.col("id") < 300, 1).otherwise(F.col("id")).cast("long").alias("caseid"),
        (F.col("id") % 4).cast("int").alias("caseversion"),
        F.lit("2024q1").alias("quarter"),
        F.lit("Male").alias("sex"),
    )
    wanted = [(i,) for i in range(600) if i >= 300 or i % 4 == 3]
    assert rows(cases.dedup_versions(given), "report_id") == sorted(wanted, key=repr)


def test_latest_and_children(spark, rows):
    given = demo(
        spark,
        [
            (10, 1, 1, "2024q1", "Male"),
            (14, 1, 2, "2024q3", "Male"),
            (12, 2, 1, "2024q1", "Male"),
            (8, None, 1, "2024q1", "Male"),
            (9, None, 1, "2024q2", "Male"),
        ],
    )
    latest = cases.latest_cases(given)
    assert rows(latest) == sorted([(1, 14), (2, 12), (None, 9)], key=repr)
    child = spark.createDataFrame(
        [(10, "a"), (14, "b"), (14, "b"), (99, "c"), (None, "d")], "report_id long, name string"
    )
    assert rows(cases.latest_only(child, latest)) == [(14, "b"), (14, "b")]
    assert rows(cases.enforce_parent(child, given)) == [(10, "a"), (14, "b"), (14, "b")]
    assert rows(cases.orphan_children(child, given)) == [(99, "c"), (None, "d")]
