"""Cut joins give the rows of plain joins, with and without hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from casetide.operators import joins
from casetide.plans.skew import LEFT_PART, RIGHT_PART, Grid
from casetide.plans.views import Pairing, per_report


@pytest.fixture(scope="module")
def sides(spark):
    pick = random.Random(3)
    # Key 7 holds a third of the left rows; null keys never meet.
    keys = [7] * 200 + [pick.randrange(40) for _ in range(400)] + [None] * 20
    left = [(k, i % 50, f"l{i}") for i, k in enumerate(keys)]
    right = [(k, f"r{k}-{j}") for k in [7, 7, 7, *range(0, 40, 3), None] for j in range(2)]
    return (
        spark.createDataFrame(left, "k int, v int, s string"),
        spark.createDataFrame(right, "k int, w string"),
    )


def test_both_sides_cut(sides, rows):
    left, right = sides
    many = right.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(30))))
    renamed = left.withColumnRenamed("k", "report_id"), many.withColumnRenamed("k", "report_id")
    cut = joins.many_to_many(*renamed, rows_per_task=25)
    assert rows(cut) == rows(renamed[0].join(renamed[1], "report_id"))


def test_hot_key_is_spread_and_cold_ones_are_not(sides):
    left, right = sides
    grid = Grid(["k"], left, right, rows_per_task=30)
    assert grid.keys == ["k", LEFT_PART, RIGHT_PART]
    placed = grid.left(left, left.columns)
    parts = {r.k: r.n for r in placed.groupBy("k").agg(F.count_distinct(LEFT_PART).alias("n")).collect()}
    assert parts[7] == 8
    assert all(n == 1 for k, n in parts.items() if k != 7)
    largest = placed.groupBy("k", LEFT_PART).count().agg(F.max("count")).collect()[0][0]
    assert largest < 100


def test_plain_plan_without_hot_keys(sides):
    left, right = sides
    grid = Grid(["k"], left, right)
    assert grid.keys == ["k"]
    assert grid.left(left, left.columns) is left
    assert grid.copies(right) is right


def test_equal_rows_of_a_hot_report_are_spread(spark):
    rows = spark.range(4000).select(F.lit(1).alias("report_id"), F.lit("a").alias("name"))
    rows = rows.union(spark.range(300).select(F.lit(1), F.concat(F.lit("b"), F.col("id")))).repartition(8)
    reports = spark.createDataFrame([(1,)], "report_id int")
    out = per_report(rows, reports, ["name"], rows_per_task=100)
    counts = {r["name"]: r["rows"] for r in out.collect()}
    assert counts["a"] == 4000 and len(counts) == 301
    pairing = Pairing(rows, rows.select("report_id", F.col("name").alias("other")), None, 100)
    for side, part in ((pairing._drugs, LEFT_PART), (pairing._others, RIGHT_PART)):
        assert side.groupBy(part).count().agg(F.max("count")).first()[0] <= 100 * 300
        assert side.filter(F.col(side.columns[1]) == "a").select(*side.columns[:2], part).distinct().count() == 1
    assert pairing.count(["name", "other"], "n").count() == 301 * 301


def test_no_cap_on_hot_keys_or_parts(spark):
    rows = spark.range(9000).select((F.col("id") % 3000).alias("k"), F.col("id").alias("v"))
    grid = Grid(["k"], rows, rows_per_task=2)
    parts = grid.left(rows, ["v"])
    assert parts.filter(F.col(LEFT_PART) > 0).select("k").distinct().count() > 2000
    one = rows.withColumn("k", F.lit(1))
    assert Grid(["k"], one, rows_per_task=2).left(one, ["v"]).agg(F.max(LEFT_PART)).first()[0] > 2000
