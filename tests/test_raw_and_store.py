"""Raw files with real-life flaws, and the stored tables."""

import re
import time

import pytest
from pyspark.sql import functions as F

from casetide.operators import joins
from casetide.operators.cleaning import clean_table
from casetide.plans import heavy, views
from casetide.plans.answers import reporter_type
from casetide.sources import raw, store
from casetide.sources.mapped import bed
from casetide.streaming.landing import land

LINES = [
    " PRIMARYID$CaseID $PT$DRUG_REC_ACT",
    "1$10$Caf\xe9 au lait spots$",
    "2$20$short row",
    '3$30$"quoted $ sign"$x',
    "4$40$too long$x$surplus",
    "5$50$trailing delimiter$x$",
    "6$60$very long$x$$late surplus",
]


def write(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes("\n".join(lines).encode("latin-1") + b"\n")
    return str(folder / name)


def test_flawed_lines(spark, tmp_path, rows):
    path = write(tmp_path / "2024Q1" / "ascii", "REAC24Q1.txt", LINES)
    assert raw.read_header(spark, path) == ["report_id", "caseid", "pt", "drug_rec_act"]
    read = raw.read_raw(spark, path)
    good = raw.with_quarter(raw.skip_bad_lines(read))
    assert rows(good, "report_id", "pt", "drug_rec_act", "quarter") == [
        ("1", "Caf\xe9 au lait spots", None, "2024q1"),
        ("2", "short row", None, "2024q1"),
        ("3", "quoted $ sign", "x", "2024q1"),
        ("5", "trailing delimiter", "x", "2024q1"),
    ]
    assert rows(raw.quarantine_rows(read), "report_id") == [("4",), ("6",)]
    cleaned = clean_table(good, "reac")
    assert "Caf\xe9 Au Lait Spots" in [r.pt_clean for r in cleaned.collect()]


def test_surplus_fields_and_quotes(spark, tmp_path, rows):
    lines = ["primaryid$caseid$pt", *[f"{n}$1$x" + "$" * n + "lost" for n in range(1, 9)], "20$1$x$$$$$", '21$1$"a ""b"" c"', '22$"x\\"$oral', '23$1$"q $ r"$"s ""t"" $"$u']
    path = write(tmp_path / "2024q1", "REAC24Q1.txt", lines)
    read = raw.read_raw(spark, path)
    assert rows(raw.skip_bad_lines(read), "report_id", "caseid", "pt") == [
        ("20", "1", "x"), ("21", "1", 'a "b" c'), ("22", "x\\", "oral"),
    ]
    bad = {r.report_id: r[raw.SURPLUS] for r in raw.quarantine_rows(read).collect()}
    assert set(bad) == {str(n) for n in range(1, 9)} | {"23"}
    assert bad["5"] == ["", "", "", "", "lost"] and bad["23"] == ['"s ""t"" $"', "u"]
    assert raw.skip_bad_lines(read).count() == 3  # without a look at the columns


def test_each_file_goes_by_its_own_header(spark, tmp_path, rows):
    write(tmp_path / "2024q1", "REAC24Q1.txt", ["primaryid$caseid$pt", "1$10$Rash"])
    write(tmp_path / "2024q2", "REAC24Q2.txt", ["primaryid$pt$caseid", "2$Rash$20"])
    write(tmp_path / "2024q3", "REAC24Q3.txt", [])
    read = raw.read_table(spark, f"{tmp_path}/*/{raw.file_glob('reac')}")
    assert rows(read, "report_id", "caseid", "pt") == [("1", "10", "Rash"), ("2", "20", "Rash")]


def test_parts_of_a_folder_are_held_to_their_header(spark, tmp_path):
    write(tmp_path / "2024q1" / "REAC.txt", "part-0", ["primaryid$caseid$pt", "1$10$Rash"])
    write(tmp_path / "2024q1" / "REAC.txt", "part-1", ["primaryid$pt$caseid", "2$Rash$20"])
    with pytest.raises(Exception, match="(?i)header"):
        raw.read_table(spark, f"{tmp_path}/2024q1/REAC.txt").collect()


def test_path_without_a_quarter_is_an_error(spark, tmp_path):
    path = write(tmp_path / "someday", "REAC.txt", ["primaryid$caseid$pt", "1$10$Rash"])
    with pytest.raises(Exception, match="no quarter in the path"):
        raw.read_table(spark, path).collect()


def test_files_are_found_in_either_case(spark, tmp_path, rows):
    write(tmp_path / "2024q1" / "ascii", "DEMO24Q1.txt", ["primaryid$caseid"])
    write(tmp_path / "2024q2" / "ascii", "demo24q2.txt", ["primaryid$caseid"])
    write(tmp_path / "2024q2" / "ascii", "readme.txt", ["hello"])
    write(tmp_path / "2024q2" / "ascii", "outc24q2.pdf", ["hello"])
    found = raw.discover_tables(spark, str(tmp_path))
    assert rows(found, "table", "quarter") == [("demo", "2024q1"), ("demo", "2024q2")]
    assert raw.file_glob("demo") == "[Dd][Ee][Mm][Oo]*.txt"


def test_columns_that_come_and_go(spark, tmp_path, rows):
    first = write(tmp_path / "2024q1", "OUTC24Q1.txt", ["PRIMARYID$CASEID$OUTC_COD", "1$1$DE"])
    second = write(tmp_path / "2024q2", "OUTC24Q2.txt", ["outc_cod$primaryid$note", "HO$2$new"])
    read = raw.read_table(spark, first, second)
    assert rows(read, "report_id", "caseid", "outc_cod", "note", "quarter") == sorted(
        [("1", "1", "DE", None, "2024q1"), ("2", None, "HO", "new", "2024q2")], key=repr
    )


DEMO = ["primaryid$caseid$caseversion$i_f_code$event_dt$fda_dt$rept_cod$age$age_cod$sex$wt$wt_cod$reporter_country$occr_country$occp_cod"]


def demo_line(report, case, version):
    return f"{report}${case}${version}$F$202411$20241130$EXP$40$YR$F$60$KG$US$US$MD"


@pytest.fixture
def quarters(spark, tmp_path):
    folder = tmp_path / "raw"
    write(folder / "2024q1", "DEMO24Q1.txt", DEMO + [demo_line(10, 1, 1), demo_line(11, 1, 2)])
    write(folder / "2024q1", "OUTC24Q1.txt", ["primaryid$caseid$outc_cod", "10$1$DE", "11$1$HO"])
    write(folder / "2024q2", "DEMO24Q2.txt", DEMO + [demo_line(20, 2, 1)])
    write(folder / "2024q2", "OUTC24Q2.txt", ["primaryid$caseid$outc_cod", "20$2$DE", "20$2$LT"])
    return folder


def load(spark, folder):
    return store.clean_all(
        {n: raw.read_table(spark, f"{folder}/*/{raw.file_glob(n)}") for n in ("demo", "outc")}
    )


def test_store_skip_and_reload(spark, quarters, tmp_path, rows):
    root = str(tmp_path / "store")
    stored = store.write_quarter(load(spark, quarters), root)
    demo = [(11, "2024q1"), (20, "2024q2")]
    outc = [(11, "HO"), (20, "DE"), (20, "LT")]
    assert rows(stored["demo"], "report_id", "quarter") == demo
    # The outcome of the superseded version has no parent and is not stored.
    assert rows(stored["outc"], "report_id", "outc_cod") == outc
    assert str(stored["demo"].collect()[0].event_dt) == "2024-11-01"

    again = store.write_quarter(load(spark, quarters), root)
    assert rows(again["demo"], "report_id", "quarter") == demo
    assert rows(again["outc"], "report_id", "outc_cod") == outc

    write(quarters / "2024q2", "OUTC24Q2.txt", ["primaryid$caseid$outc_cod", "20$2$OT"])
    untouched = store.write_quarter(load(spark, quarters), root)
    assert rows(untouched["outc"], "report_id", "outc_cod") == outc
    reloaded = store.reload_quarter(load(spark, quarters), root, "2024q2")
    assert rows(reloaded["outc"], "report_id", "outc_cod") == [(11, "HO"), (20, "OT")]
    assert rows(store.loaded_quarters(reloaded["demo"])) == [("2024q1",), ("2024q2",)]

    counts = store.load_metadata(reloaded).select("quarter", "demo_rows", "outc_rows", "total_rows")
    assert rows(counts) == [("2024q1", 1, 1, 2), ("2024q2", 1, 1, 2)]
    assert store.read_parquet_views(spark, root, "st_") == ["st_demo", "st_outc"]
    assert spark.sql("SELECT count(*) FROM st_outc WHERE quarter = '2024q2'").collect()[0][0] == 1


def test_an_interrupted_load_is_completed(spark, quarters, tmp_path, rows):
    root = str(tmp_path / "store")
    tables = load(spark, quarters)
    store._Load(spark, root, ["2024q1", "2024q2"]).write_reports(tables["demo"])  # and then it broke off
    assert store.read_table(spark, root, "demo").count() == 0
    stored = store.write_quarter(tables, root)
    assert rows(stored["outc"], "report_id", "outc_cod") == [(11, "HO"), (20, "DE"), (20, "LT")]


def test_reload_removes_what_the_correction_lacks(spark, quarters, tmp_path, rows):
    root = str(tmp_path / "store")
    tables = load(spark, quarters)
    store.write_quarter(tables, root)
    no_outcomes = {"demo": tables["demo"], "outc": tables["outc"].filter("report_id = 11")}
    assert rows(store.reload_quarter(no_outcomes, root, "2024q2")["outc"], "report_id") == [(11,)]
    # Reports alone: the quarter has no children any more.
    store.reload_quarter({"demo": tables["demo"].filter("report_id <> 11")}, root, "2024q1")
    assert rows(store.read_table(spark, root, "demo"), "report_id") == [(20,)]
    assert store.read_table(spark, root, "outc").count() == 0
    assert store.waiting_rows(spark, root, "outc").count() == 0


def test_load_of_all_quarters(spark, quarters, tmp_path, rows):
    root = str(tmp_path / "store")
    write(quarters / "2024q3", "DEMO24Q3.txt", DEMO + [demo_line(30, 3, 1)])
    write(quarters / "2024q3", "OUTC24Q3.txt", ["primaryid$caseid$outc_cod", "30$3$CA"])
    assert rows(store.load_quarters(spark, str(quarters), root, ["2024Q1"]), "quarter", "status") == [("2024q1", "loaded")]
    report = store.load_quarters(spark, str(quarters), root)
    assert rows(report, "quarter", "status") == [("2024q1", "skipped"), ("2024q2", "loaded"), ("2024q3", "loaded")]
    assert rows(store.read_table(spark, root, "outc"), "report_id", "outc_cod") == [(11, "HO"), (20, "DE"), (20, "LT"), (30, "CA")]
    lines = store.stored_metadata(spark, root)
    assert rows(lines, "quarter", "demo_rows", "outc_rows", "total_rows", "data_source_url") == [
        ("2024q1", 1, 1, 2, str(quarters)), ("2024q2", 1, 2, 3, str(quarters)), ("2024q3", 1, 1, 2, str(quarters)),
    ]


def test_a_damaged_quarter_does_not_stop_the_rest(spark, quarters, tmp_path, rows):
    root = str(tmp_path / "store")
    write(quarters / "2024q3" / "DEMO.txt", "part-0", DEMO + [demo_line(30, 3, 1)])
    write(quarters / "2024q3" / "DEMO.txt", "part-1", ["caseid$primaryid", "1$31"])
    report = {r.quarter: r for r in store.load_quarters(spark, str(quarters), root).collect()}
    assert {q: r.status for q, r in report.items()} == {"2024q1": "loaded", "2024q2": "loaded", "2024q3": "failed"}
    assert report["2024q3"].error
    assert rows(store.read_table(spark, root, "demo"), "report_id") == [(11,), (20,)]


def test_a_report_in_two_quarters_stays_in_the_newest(spark, quarters, tmp_path, rows):
    root = str(tmp_path / "store")
    write(quarters / "2024q3", "DEMO24Q3.txt", DEMO + [demo_line(11, 1, 3), demo_line(30, 3, 1)])
    wanted = [(11, "2024q3"), (20, "2024q2"), (30, "2024q3")]
    store.load_quarters(spark, str(quarters), root)
    assert rows(store.read_table(spark, root, "demo"), "report_id", "quarter") == wanted
    for turn, order in enumerate((["2024q1", "2024q2", "2024q3"], ["2024q3", "2024q1", "2024q2"])):
        root = str(tmp_path / f"store{turn}")
        for quarter in order:
            store.load_quarters(spark, str(quarters), root, [quarter])
        assert rows(store.read_table(spark, root, "demo"), "report_id", "quarter") == wanted
        assert (11, "HO") in rows(store.read_table(spark, root, "outc"), "report_id", "outc_cod")


def test_each_text_is_read_once_in_a_load(spark, quarters, tmp_path, monkeypatch):
    read = []
    whole = raw.read_table

    def counted(session, *paths, **how):
        df = whole(session, *paths, **how)
        seen = session.sparkContext.accumulator(0)
        read.append((seen, df))
        return df.filter(F.udf(lambda _: seen.add(1) or True, "boolean")("report_id"))

    monkeypatch.setattr(raw, "read_table", counted)
    store.load_quarters(spark, str(quarters), str(tmp_path / "store"))
    assert [seen.value for seen, _ in read] == [df.count() for _, df in read]


def test_no_base_table_is_read_to_plan_on_stored_tables(spark, quarters, tmp_path):
    root = str(tmp_path / "store")
    store.load_quarters(spark, str(quarters), root)
    t = store.stored_tables(spark, root)
    assert "hot_reports" in t
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        for build in (heavy.prr_full, joins.drug_reac_join, joins.drug_outc_join, reporter_type, views.mv_signal_prr, views.mv_top_drugs):
            build(t)
        found = spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
        stages = [spark.sparkContext.statusTracker().getJobInfo(j).stageIds for j in found]
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    # Looking whether there are large reports reads their list of one file, nothing else.
    assert all(len(s) == 1 for s in stages)


def test_stored_quarters_prune(spark, quarters, tmp_path):
    root = str(tmp_path / "store")
    stored = store.write_quarter(load(spark, quarters), root)
    plan = stored["outc"].filter(F.col("quarter") == "2024q2").filter(F.col("outc_cod") == "DE")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        text = plan.select("report_id")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = re.search(r"PartitionFilters: \[([^]]*)\]", text)[1]
    assert "= 2024q2" in filters and "has_parent" in filters
    assert "EqualTo(outc_cod,DE)" in text
    assert "ReadSchema: struct<report_id:bigint,outc_cod:string>" in text


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path, rows):
    tables = bed(spark, "/root/testdata/sf0.001").tables()
    chosen = {n: tables[n] for n in ("demo", "drug", "reac")}
    saved = store.bucket_tables(chosen, str(tmp_path), 4, "bucketed_")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = joins.drug_reac_join(saved)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert "Exchange" in joins.drug_reac_join(chosen)._jdf.queryExecution().executedPlan().toString()
        assert pairs.count() == joins.drug_reac_join(chosen).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in chosen:
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{name}")


def test_export_is_slim_and_skips(spark, quarters, tmp_path, rows):
    root = str(tmp_path / "export")
    tables = load(spark, quarters)
    assert store.export_parquet(tables, root) == ["demo", "outc"]
    first = spark.read.parquet(f"{root}/outc")
    assert set(first.columns) == {"report_id", "caseid", "quarter", "outc_cod", "outcome_label"}
    before = rows(first)
    store.export_parquet(tables, root)
    assert rows(spark.read.parquet(f"{root}/outc")) == before


def test_landing_of_new_files(spark, quarters, tmp_path, rows):
    root, marks = str(tmp_path / "landed"), str(tmp_path / "marks")

    def run():
        land(spark, str(quarters), root, marks).awaitTermination()
        return store.read_table(spark, root, "outc")

    assert rows(run(), "report_id", "outc_cod") == [(11, "HO"), (20, "DE"), (20, "LT")]
    write(quarters / "2024q3", "DEMO24Q3.txt", DEMO + [demo_line(30, 3, 1)])
    write(quarters / "2024q3", "OUTC24Q3.txt", ["primaryid$caseid$outc_cod", "30$3$CA"])
    spark.catalog.clearCache()
    assert (30, "CA") in rows(run(), "report_id", "outc_cod")
    assert rows(run(), "report_id", "outc_cod")[-1] == (30, "CA")


def test_landing_of_children_before_their_reports(spark, tmp_path, rows):
    folder, root, marks = tmp_path / "raw", str(tmp_path / "landed"), str(tmp_path / "marks")

    def run():
        land(spark, str(folder), root, marks).awaitTermination()
        spark.catalog.clearCache()
        return rows(store.read_table(spark, root, "outc"), "report_id", "outc_cod")

    write(folder / "2024q1", "OUTC24Q1.txt", ["primaryid$caseid$outc_cod", "10$1$DE", "99$9$HO"])
    assert run() == []
    assert rows(store.waiting_rows(spark, root, "outc"), "report_id") == [(10,), (99,)]
    write(folder / "2024q1", "DEMO24Q1.txt", DEMO + [demo_line(10, 1, 1)])
    assert run() == [(10, "DE")]
    # The report of the other child arrives with another quarter.
    write(folder / "2024q2", "DEMO24Q2.txt", DEMO + [demo_line(99, 9, 1)])
    assert run() == [(10, "DE"), (99, "HO")]
    assert store.waiting_rows(spark, root, "outc").count() == 0


def test_a_raw_copy_has_few_files_and_reads_the_same_compressed(spark, tmp_path, rows):
    """Not a file for each task and quarter."""
    made = spark.range(4000).selectExpr("id AS primaryid", "id % 7 AS caseid", "concat('term ', id % 9) AS pt", "concat('2024q', id % 4 + 1) AS quarter").repartition(8)
    raw.write_raw(made, str(tmp_path / "REAC_A.txt"))
    raw.write_raw(made, str(tmp_path / "REAC_B.txt"), "gzip")
    assert len(list(tmp_path.glob("REAC_A.txt/*/part-*"))) == 4
    assert len(list(tmp_path.glob("REAC_B.txt/*/part-*.gz"))) == 4
    a, b = (rows(raw.read_table(spark, str(tmp_path / f"REAC_{x}.txt"))) for x in "AB")
    assert a == b and len(a) == 4000


def test_losses_by_quarter_need_no_count_per_written_row(spark, tmp_path, monkeypatch):
    """Counts for every quarter and column, updated for every row, took longer than the writing itself."""
    for q in ("2024q1", "2024q2", "2024q3"):
        n = int(q[-1])
        write(tmp_path / "raw" / q, "DEMO.txt", ["primaryid$caseid$caseversion$event_dt", f"{n}$1$1$no date"])
        write(tmp_path / "raw" / q, "THER.txt", ["primaryid$caseid$drug_seq$dur", *[f"{n}$1$x$1"] * n, "99$9$1$y"])
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "observe", lambda *_: pytest.fail("observed"))
    root = str(tmp_path / "store")
    assert {r.status for r in store.load_quarters(spark, str(tmp_path / "raw"), root).collect()} == {"loaded"}
    found = {(r.quarter, r.table, r.column): r.nulled for r in store.losses(spark, root).collect() if r.nulled}
    assert found == {(f"2024q{n}", t, c): k for n in (1, 2, 3) for t, c, k in (("demo", "event_dt", 1), ("ther", "drug_seq", n), ("ther", "dur", 1))}
    noted = {r.quarter: r.total_rows for r in store.stored_metadata(spark, root).collect()}
    assert noted == {"2024q1": 2, "2024q2": 3, "2024q3": 4}


def test_shuffle_files_of_a_load_go_while_it_runs(spark, tmp_path):
    from casetide import runtime

    def held():
        return spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()

    for k in range(3):
        spark.range(1000).repartition(8, "id").write.parquet(str(tmp_path / str(k)))
    made = held()
    for _ in range(20):
        runtime.release(spark, 0.0)
        if held() < made:
            break
        time.sleep(0.2)
    assert held() < made
