"""Views kept up to date by what changed equal views built anew."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from casetide.plans import upkeep, views
from casetide.sources import snapshots, store
from casetide.sources.mapped import bed

SF = "/root/testdata/sf0.001"
QUARTERS = ("1996q1", "1998q2", "2000q4")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cleaned")
    b = bed(spark, SF)
    for name, df in store.clean_all({n: b.raw(n) for n in ("demo", "drug", "reac", "outc")}).items():
        df.write.parquet(f"{folder}/{name}")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in ("demo", "drug", "reac", "outc")}


def lines(found):
    return {n: sorted((tuple(repr(r[c]) for c in sorted(df.columns)) for r in df.collect())) for n, df in found.items()}


def rebuilt(spark, root):
    return lines(views.build_views(store.stored_tables(spark, root)))


def only(tables, where):
    return {n: df.filter(where) for n, df in tables.items()}


def test_first_build_one_more_quarter_and_a_correction(spark, tables, tmp_path):
    root, shown = str(tmp_path / "store"), str(tmp_path / "views")
    store.write_quarter(only(tables, F.col("quarter") != QUARTERS[1]), root)
    assert lines(upkeep.refresh(spark, root, shown)) == rebuilt(spark, root)
    store.write_quarter(tables, root)
    assert lines(upkeep.refresh(spark, root, shown)) == rebuilt(spark, root)
    # Fewer reports, other outcomes, and no reactions at all in one quarter.
    corrected = only(tables, "report_id % 3 <> 0")
    corrected["outc"] = corrected["outc"].withColumn("outc_cod", F.when(F.col("report_id") % 2 == 0, "DE").otherwise("HO"))
    corrected["reac"] = corrected["reac"].limit(0)
    store.reload_quarter(corrected, root, QUARTERS[0])
    before = upkeep.read_views(spark, shown)
    kept = lines(before)
    assert lines(upkeep.refresh(spark, root, shown)) == rebuilt(spark, root) != kept
    # Readers of the former version still see it, and nothing is done for no change.
    assert lines(before) == kept
    version = snapshots.current(spark, shown).version
    upkeep.refresh(spark, root, shown)
    assert snapshots.current(spark, shown).version == version


def test_a_report_that_moves_and_children_apart_from_it(spark, tables, tmp_path):
    root, shown = str(tmp_path / "store"), str(tmp_path / "views")
    store.write_quarter(only(tables, F.col("quarter") != QUARTERS[2]), root)
    upkeep.refresh(spark, root, shown)
    # Some stored reports come again in the new quarter, their children stay where they are.
    again = only(tables, F.col("quarter") == QUARTERS[0])
    moved = {n: df.filter("report_id % 2 = 0").withColumn("quarter", F.lit(QUARTERS[2])) for n, df in again.items()}
    new = {n: df.filter(F.col("quarter") == QUARTERS[2]) for n, df in tables.items()}
    new = {n: df.unionByName(moved[n]) if n in ("demo", "outc") else df for n, df in new.items()}
    store.write_quarter(new, root)
    apart = snapshots.current(spark, root).read(spark, "drug", store._layout("drug")).filter("has_parent = 2")
    assert apart.count() > 0
    assert lines(upkeep.refresh(spark, root, shown)) == rebuilt(spark, root)
    # The quarter goes again as a whole.
    store.reload_quarter({n: df.limit(0) for n, df in tables.items()}, root, QUARTERS[2])
    assert lines(upkeep.refresh(spark, root, shown)) == rebuilt(spark, root)


def test_untouched_quarters_of_drugs_and_reactions_are_not_read(spark, tables, tmp_path):
    """Their files are taken away before the refresh; signals with their totals are right all the same."""
    root, shown = str(tmp_path / "store"), str(tmp_path / "views")
    # A new quarter whose reports are follow-ups of one other quarter, and new cases.
    last = only(tables, f"quarter = '{QUARTERS[1]}'")
    base = only(tables, f"quarter <> '{QUARTERS[2]}'")
    base["demo"] = base["demo"].withColumn("caseid", F.col("report_id"))
    store.write_quarter(base, root)
    upkeep.refresh(spark, root, shown)
    follow = {n: df.filter("report_id % 2 = 0").withColumn("quarter", F.lit("2002q1")) for n, df in last.items()}
    follow = {n: df.withColumn("report_id", F.col("report_id") + 10_000_000) for n, df in follow.items()}
    follow["demo"] = follow["demo"].withColumn("caseid", F.col("report_id") - 10_000_000)
    store.write_quarter(follow, root)
    wanted = rebuilt(spark, root)
    for name in ("drug", "reac"):
        for path in glob.glob(f"{root}/{name}/load=*/quarter=*/has_parent=1/*.parquet"):
            if f"quarter={QUARTERS[1]}" not in path and "quarter=2002q1" not in path:
                os.remove(path)
    spark.catalog.clearCache()
    assert lines(upkeep.refresh(spark, root, shown)) == wanted


def test_only_quarters_with_a_change_are_written(spark, tables, tmp_path):
    root, shown = str(tmp_path / "store"), str(tmp_path / "views")
    demo = tables["demo"].withColumn("caseid", F.col("report_id"))
    store.write_quarter({**tables, "demo": demo}, root)
    upkeep.refresh(spark, root, shown)
    held = snapshots.current(spark, shown)
    store.reload_quarter({**only(tables, "report_id % 2 = 0"), "demo": demo.filter("report_id % 2 = 0")}, root, QUARTERS[1])
    upkeep.refresh(spark, root, shown)
    changed = snapshots.current(spark, shown).changed(held, ["tally_pairs", "mv_top_drugs", "mv_latest_cases", "mv_signal_prr"])
    assert changed["tally_pairs"] == changed["mv_top_drugs"] == changed["mv_latest_cases"] == {QUARTERS[1]}
    assert len(changed["mv_signal_prr"]) > 1


def test_medians_of_several_quarters(spark, tables, tmp_path):
    root, shown = str(tmp_path / "store"), str(tmp_path / "views")
    store.write_quarter(tables, root)
    upkeep.refresh(spark, root, shown)
    t = store.stored_tables(spark, root)
    rows = t["drug"].filter("role_cod = 'PS' AND drugname_clean <> ''").filter(F.col("quarter").isin(*QUARTERS)).select("report_id", "drugname_clean")
    rows = rows.join(t["demo"].select("report_id", "sex", "age_years"), "report_id").join(views.mv_latest_cases(t), "report_id")
    for by in ((), ("sex",), ("drugname_clean", "sex")):
        wanted = rows.filter("age_years IS NOT NULL").groupBy(*by).agg(F.count("*"), F.median("age_years").alias("m"))
        found = upkeep.medians(spark, shown, QUARTERS, *by).select(*by, "rows", "median_age")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
