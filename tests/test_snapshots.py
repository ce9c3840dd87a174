"""Versions of the store: all or nothing, readers in between, older versions, losses."""

import pytest
from pyspark.sql import functions as F

from casetide.operators import cleaning
from casetide.sources import raw, snapshots, store
from casetide.sources.mapped import bed

SF = "/root/testdata/sf0.001"
DEMO = "primaryid long, caseid long, caseversion string, quarter string, event_dt string, age string, age_cod string, wt string"


def tables(spark, demo, outc):
    """``demo``: report, case, quarter. ``outc``: report, quarter, code."""
    return store.clean_all({
        "demo": spark.createDataFrame([(r, c, "1", q, "20240101", "3", "YR", "5") for r, c, q in demo], DEMO.replace("primaryid", "report_id")),
        "outc": spark.createDataFrame(outc, "report_id long, quarter string, outc_cod string").withColumn("caseid", F.lit(1)),
    })


@pytest.fixture
def two(spark, tmp_path):
    root = str(tmp_path / "store")
    store.write_quarter(tables(spark, [(1, 1, "2024q1"), (2, 2, "2024q2")], [(1, "2024q1", "DE"), (2, "2024q2", "HO"), (9, "2024q2", "LT")]), root)
    return root


def stored(spark, root, version=None):
    held = store.stored_tables(spark, root, version)
    return {n: sorted((r.report_id, r.quarter) for r in held[n].collect()) for n in ("demo", "outc")}


FIRST = {"demo": [(1, "2024q1"), (2, "2024q2")], "outc": [(1, "2024q1"), (2, "2024q2")]}


def test_a_load_that_breaks_between_two_tables_changes_nothing(spark, two, monkeypatch):
    whole = store._Load.write_children

    def broken(self, name, rows):
        if name == "outc":
            raise ValueError("lost")
        whole(self, name, rows)

    monkeypatch.setattr(store._Load, "write_children", broken)
    with pytest.raises(ValueError, match="lost"):
        store.reload_quarter(tables(spark, [(3, 3, "2024q2")], []), two, "2024q2")
    assert stored(spark, two) == FIRST
    monkeypatch.undo()
    store.reload_quarter(tables(spark, [(3, 3, "2024q2")], []), two, "2024q2")
    assert stored(spark, two) == {"demo": [(1, "2024q1"), (3, "2024q2")], "outc": [(1, "2024q1")]}


def test_a_reader_keeps_its_version_during_a_reload(spark, two):
    before = store.stored_tables(spark, two)
    store.reload_quarter(tables(spark, [(3, 3, "2024q2")], [(3, "2024q2", "DE")]), two, "2024q2")
    assert sorted(r.report_id for r in before["demo"].collect()) == [1, 2]
    assert stored(spark, two, version=1) == FIRST
    assert stored(spark, two)["outc"] == [(1, "2024q1"), (3, "2024q2")]
    assert snapshots.versions(spark, two) == [1, 2]
    with pytest.raises(ValueError, match="no version"):
        snapshots.current(spark, two, 7)


def test_the_second_of_two_writers_fails_as_a_whole(spark, two):
    late = store._Load(spark, two, ["2024q3"])
    store.write_quarter(tables(spark, [(5, 5, "2024q4")], []), two)
    with pytest.raises(snapshots.Conflict):
        late.run(tables(spark, [(6, 6, "2024q3")], []))
    assert stored(spark, two)["demo"] == [*FIRST["demo"], (5, "2024q4")]


def test_children_of_a_quarter_without_reports_wait(spark, two):
    """Also when the quarter comes again without children, nothing of it is left over."""
    only = tables(spark, [(4, 4, "2024q4")], [(7, "2024q3", "DE"), (4, "2024q3", "HO"), (4, "2024q4", "OT")])
    store.write_quarter(only, two)
    assert stored(spark, two)["outc"] == [*FIRST["outc"], (4, "2024q3"), (4, "2024q4")]
    assert {r.report_id for r in store.waiting_rows(spark, two, "outc").collect()} == {7, 9}
    store.reload_quarter(tables(spark, [], []), two, "2024q3")
    assert {r.report_id for r in store.waiting_rows(spark, two, "outc").collect()} == {9}
    # Report 7 arrives in yet another quarter: too late for the child that was replaced.
    store.write_quarter(tables(spark, [(9, 9, "2025q1")], []), two)
    assert (9, "2024q2") in stored(spark, two)["outc"]


def test_children_follow_a_report_that_moves_or_goes(spark, two):
    store.write_quarter(tables(spark, [(1, 1, "2024q3")], [(1, "2024q3", "OT")]), two)
    assert stored(spark, two) == {"demo": [(1, "2024q3"), (2, "2024q2")], "outc": [(1, "2024q1"), (1, "2024q3"), (2, "2024q2")]}
    apart = snapshots.current(spark, two).read(spark, "outc", store._layout("outc")).filter("has_parent = 2")
    assert [(r.report_id, r.quarter) for r in apart.collect()] == [(1, "2024q1")]
    store.reload_quarter(tables(spark, [(8, 8, "2024q3")], []), two, "2024q3")
    assert stored(spark, two) == {"demo": [(2, "2024q2"), (8, "2024q3")], "outc": [(2, "2024q2")]}
    assert {r.report_id for r in store.waiting_rows(spark, two, "outc").collect()} == {1, 9}


def test_vacuum_leaves_what_is_used(spark, two):
    for r in (3, 4):
        store.reload_quarter(tables(spark, [(r, r, "2024q2")], [(r, "2024q2", "DE")]), two, "2024q2")
    now = stored(spark, two)
    assert snapshots.vacuum(spark, two, keep=1)
    assert stored(spark, two) == now and snapshots.versions(spark, two) == [3]
    assert not snapshots.vacuum(spark, two, keep=1)


def test_metadata_counts_what_is_stored(spark, two):
    lines = store.stored_metadata(spark, two).select("quarter", "demo_rows", "outc_rows", "total_rows").collect()
    assert sorted(map(tuple, lines)) == [("2024q1", 1, 1, 2), ("2024q2", 1, 1, 2)]


def test_metadata_equals_a_count_of_the_tables(spark, tmp_path):
    b = bed(spark, SF)
    root = str(tmp_path / "store")
    store.write_quarter(store.clean_all({n: b.raw(n) for n in store.S.TABLES}), root)
    columns = ["quarter", "demo_rows", "drug_rows", "reac_rows", "outc_rows", "total_rows"]
    counted = store.load_metadata(store.stored_tables(spark, root) | {}).select(*columns)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, store.stored_metadata(spark, root).select(*columns).collect()))


def test_losses_are_counted_while_writing(spark, tmp_path):
    folder, root = tmp_path / "raw", str(tmp_path / "store")
    raw.write_raw(spark.createDataFrame(
        [(1, 1, "1", "2024q1", "20240131", "30", "YR", "70"), (2, 2, "1", "2024q1", "no date", "300", "YR", ""), (3, 3, "x", "2024q1", " ", "-1", "YR", "5e9")], DEMO
    ), str(folder / "DEMO_ALL.txt"))
    raw.write_raw(spark.createDataFrame([(1, 1, "1", "12", "YR"), (1, 1, "two", "zero", "YR"), (9, 9, "3", "", "YR")], "primaryid long, caseid long, drug_seq string, dur string, dur_cod string").withColumn("quarter", F.lit("2024q1")), str(folder / "THER_ALL.txt"))
    store.load_quarters(spark, str(folder), root)
    found = {(r.table, r.column): r.nulled for r in store.losses(spark, root).collect() if r.nulled}
    assert found == {("demo", "event_dt"): 1, ("demo", "caseversion"): 1, ("demo", "age"): 2, ("demo", "wt"): 1, ("ther", "drug_seq"): 1, ("ther", "dur"): 1}
    assert store.LOST not in store.read_table(spark, root, "ther").columns


def test_marks_of_losses_are_bits_of_fixed_columns(spark):
    ther = spark.createDataFrame([(1, 1, "x", "y", "20240101", "z")], "report_id long, caseid long, drug_seq string, start_dt string, end_dt string, dur string").withColumn("quarter", F.lit("2024q1"))
    row = cleaning.clean_table(ther, "ther", losses=True).first()
    lost = {c for i, c in enumerate(cleaning.lossy_columns("ther")) if row[cleaning.LOST] >> i & 1}
    assert lost == {"drug_seq", "start_dt", "dur"}
