"""The newest reports as known in any quarter equal those of a store loaded so far."""

from pyspark.sql import functions as F

from casetide.operators import history as H
from casetide.operators.cases import latest_cases
from casetide.plans import views
from casetide.sources import store
from casetide.sources.mapped import bed

SF = "/root/testdata/sf0.001"
DEMO = "report_id long, caseid long, quarter string"


def test_intervals_by_hand(spark):
    rows = [(1, 1, "2024q1"), (5, 1, "2024q2"), (3, 1, "2024q3"), (9, 1, "2024q4"), (7, 2, "2024q2"), (8, 2, "2024q2"), (4, None, "2024q1")]
    found = {tuple(r) for r in H.case_history(spark.createDataFrame(rows, DEMO)).collect()}
    assert found == {(1, 1, "2024q1", "2024q2"), (1, 5, "2024q2", "2024q4"), (1, 9, "2024q4", None), (2, 8, "2024q2", None), (None, 4, "2024q1", None)}


def test_every_quarter_equals_the_newest_of_what_was_there(spark):
    demo = bed(spark, SF).tables()["demo"]
    history, quarters = H.case_history(demo), [r.quarter for r in demo.select("quarter").distinct().collect()]
    known = H.known_as_of(history, quarters).collect()
    for q in quarters:
        wanted = latest_cases(demo.filter(F.col("quarter") <= q)).collect()
        assert sorted((r.caseid, r.report_id) for r in known if r.as_of == q) == sorted(map(tuple, wanted))
    assert H.known_as_of(history, []).count() == 0


def test_a_case_with_very_many_versions(spark):
    demo = spark.range(200_000).select(F.col("id").alias("report_id"), F.lit(1).cast("long").alias("caseid"), F.concat(F.lit("20"), F.lpad(F.col("id") % 7, 2, "0"), F.lit("q1")).alias("quarter"))
    rows = sorted((r.known_from, r.report_id) for r in H.case_history(demo).collect())
    assert rows == [("2000q1", 199_997), ("2001q1", 199_998), ("2002q1", 199_999)] or rows[-1][1] == 199_999
    # What is ordered for the case is a row per quarter.
    plan = H.case_history(demo)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("HashAggregate")


def test_views_equal_those_of_a_store_loaded_up_to_a_quarter(spark, tmp_path):
    b, root = bed(spark, SF), str(tmp_path / "store")
    raw = {n: b.raw(n) for n in ("demo", "drug", "reac", "outc")}
    store.write_quarter(store.clean_all(raw), root)
    whole = store.stored_tables(spark, root)
    early = str(tmp_path / "early")
    store.write_quarter(store.clean_all({n: df.filter("quarter <= '1997q3'") for n, df in raw.items()}), early)
    then = H.tables_as_of(whole, H.case_history(whole["demo"]), "1997q3")
    wanted = store.stored_tables(spark, early)
    for name in ("mv_signal_prr", "mv_top_drugs", "mv_quarterly_trends", "mv_age_sex_distribution"):
        found, other = views.VIEWS[name](then), views.VIEWS[name](wanted)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, other.collect())) and found.count() > 0
