"""Counts from bitmaps equal distinct counts over the rows."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from casetide.plans import bitmaps as B
from casetide.sources.mapped import bed


@pytest.fixture(scope="module")
def tables(spark):
    return bed(spark, "/root/testdata/sf0.001").tables()


def some(tables, where):
    return {n: tables[n].filter(where) for n in ("demo", "drug", "reac", "outc")}


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    """In three arrivals, one of them into quarters that are there already."""
    root = str(tmp_path_factory.mktemp("bitmaps") / "store")
    for where in ("quarter < '1998q1' AND report_id % 2 = 0", "quarter < '1998q1'", "true"):
        B.update(spark, some(tables, where), root)
    return root


def test_numbers_have_no_gap_and_stay(spark, tables, stored):
    numbers = B.stored(spark, B.snapshots.current(spark, stored), B.NUMBERS)
    rows = sorted((r.number, r.report_id) for r in numbers.collect())
    assert [n for n, _ in rows] == list(range(1, tables["demo"].count() + 1))
    assert len({r for _, r in rows}) == len(rows)
    early = tables["demo"].filter("quarter < '1998q1' AND report_id % 2 = 0").count()
    assert all(r % 2 == 0 for _, r in rows[:early])
    first = B.stored(spark, B.snapshots.current(spark, stored, 1), B.NUMBERS)
    assert sorted((r.number, r.report_id) for r in first.collect()) == rows[:early]


@pytest.mark.parametrize("quarters", [None, ["1996q2"], ["1997q3", "1997q4", "1998q1", "2000q2"]])
def test_counts_by_value(spark, tables, stored, quarters):
    held = B.Bitmaps(spark, stored, quarters)
    for name, rows in B.dimensions(tables).items():
        if quarters:
            rows = rows.filter(F.col("quarter").isin(*quarters))
        wanted = rows.groupBy("value").agg(F.count_distinct("report_id")).collect()
        assert sorted(map(tuple, held.by_value(name).collect())) == sorted(map(tuple, wanted))


def test_conditions(spark, tables, stored):
    held = B.Bitmaps(spark, stored)
    ids = {n: {(r.value, r.report_id) for r in rows.collect()} for n, rows in B.dimensions(tables).items()}
    having = lambda n, *vs: {r for v, r in ids[n] if v in vs}
    drugs = sorted({v for v, _ in ids["drug"]})[:3]
    for (a, b), code in product([(drugs[0], drugs[1]), (drugs[2], "no such drug")], ["DE", "HO"]):
        x, y, z = held.having("drug", a), held.having("drug", b), held.having("outcome", code)
        p, q, o = having("drug", a), having("drug", b), having("outcome", code)
        for found, wanted in [
            (B.all_of(x, y), p & q), (B.any_of(x, y), p | q), (B.all_of(B.any_of(x, y), z), (p | q) & o),
            (B.any_of(B.all_of(x, z), B.all_of(y, z)), p & o | q & o), (held.having("drug", a, b), p | q),
        ]:
            assert B.reports_in(found).first()[0] == len(wanted)


def test_numbering_in_chunks_over_several_buckets(spark):
    reports = spark.range(100_000).select(F.col("id").alias("report_id"), F.concat(F.lit("q"), F.col("id") % 3).alias("quarter"))
    rows = B.numbered(reports, 7, chunk=900)
    assert rows.agg(F.min("number"), F.max("number"), F.count_distinct("number")).first()[:] == (7, 100_006, 100_000)


def test_no_new_report_and_no_row(spark, tables, stored, tmp_path):
    B.update(spark, some(tables, "true"), stored)
    assert B.Bitmaps(spark, stored).by_value("sex").agg(F.sum("reports")).first()[0] == tables["demo"].filter("sex IS NOT NULL").count()
    empty = str(tmp_path / "empty")
    B.update(spark, some(tables, "false"), empty)
    assert B.Bitmaps(spark, empty).by_value("drug").count() == 0
    assert B.reports_in(B.Bitmaps(spark, empty).having("drug", "X")).first()[0] == 0
