"""Every query by name, over a folder of test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetide import schemas as S
from casetide.functions import clean as C
from casetide.operators import aggregates as A
from casetide.operators import cases, cleaning, history, joins
from casetide.operators import predicates as P
from casetide.operators import question_log as L
from casetide.plans import answers, bitmaps, heavy, reports, shares, upkeep, views
from casetide.runtime import materialize, release, scratch_path
from casetide.sources import raw, store
from casetide.sources.mapped import Bed, bed as planned_bed
from casetide.streaming import landing

# Parameters of the registered queries; the reference statements use the same.
DRUG = "ring"
REACTION = "pt 3"
QUARTER = "1998q2"
CUT_QUARTER = "1998q1"
AS_OF_QUARTERS = ("1995q4", "1996q3", "1998q1", "2000q2", "2001q3")
MEDIAN_QUARTERS = ("1996q4", "1998q2", "1999q1", "2000q3")
CLASS_NAMES = ("%GEAR%", "%bolt%")
CLASS_INGREDIENTS = ("%SMALL%", "%PROMO%")

Query = Callable[[Bed], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(build: Query) -> Query:
    REGISTRY[build.__name__.lstrip("_")] = build
    return build


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over(build: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(planned_bed(spark, sf_dir))

    return {name: over(build) for name, build in REGISTRY.items()}


def _view(bed: Bed, *names: str) -> dict[str, DataFrame]:
    tables = bed.tables()
    return {name: views.VIEWS[name](tables) for name in names}


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """So many decimals that the order of summation does not show, but no mean is a tie."""
    return df.withColumns({c: F.round(c, 9 if c.startswith("avg_") else 6) for c in columns})


def _keys(tables: dict[str, DataFrame]) -> DataFrame:
    """The reports of each table and quarter with their number of rows."""
    found = [
        df.groupBy("quarter", "report_id").agg(F.count("*").alias("n")).withColumn("table", F.lit(name))
        for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), found).select("table", "quarter", "report_id", "n")


# -- sources and sinks ------------------------------------------------------


def _raw_copy(bed: Bed, *tables: str, root: str | None = None, where: str = "true", label: str = "ALL") -> str:
    root = root or scratch_path(bed.spark, "raw")
    for name in tables:
        raw.write_raw(bed.raw(name).filter(where), f"{root}/{name.upper()}_{label}.txt", "gzip")
        release(bed.spark)
    return root


def _ragged_copy(bed: Bed) -> str:
    """Raw reaction lines with an untidy header.

    Some are too short, some hold doubled quotes and a delimiter, and some have one to
    eight surplus fields, part of them empty.
    """
    number = F.col("report_id")
    text = F.when(number % 10 == 5, F.concat(F.lit('"'), F.col("pt"), F.lit(' ""q"" $"'))).otherwise(F.col("pt"))
    surplus = F.transform(
        F.sequence(F.lit(1), (F.floor(number / 10) % 8 + 1).cast("int")),
        lambda j: F.when((number + j) % 3 == 0, "").otherwise(F.concat(F.lit("s"), j.cast("string"))),
    )
    line = F.concat_ws(
        "$",
        number.cast("string"),
        F.col("caseid").cast("string"),
        F.when(number % 10 != 4, text),
        F.when(number % 10 == 3, F.array_join(surplus, "$")),
    )
    folder = f"{scratch_path(bed.spark, 'ragged')}/REAC.txt"
    lines = bed.raw("reac").select(line.alias(" PRIMARYID$CaseID $PT"))
    (
        lines.write.option("header", True)
        .option("sep", "\x01")
        .option("quote", "\x00")
        .option("encoding", raw.ENCODING)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(folder)
    )
    return folder


@query
def discover_tables(bed: Bed) -> DataFrame:
    found = raw.discover_tables(bed.spark, _raw_copy(bed, *S.TABLES))
    return found.filter(F.col("length") > 0).select("table", "quarter").distinct()


@query
def read_raw(bed: Bed) -> DataFrame:
    """Two files with their columns in opposite order, under one glob."""
    root = scratch_path(bed.spark, "raw")
    for rest in (0, 1):
        rows = bed.raw("demo").filter(F.col("report_id") % 2 == rest)
        raw.write_raw(rows.select(rows.columns[:: 1 - 2 * rest]), f"{root}/DEMO{rest}.txt")
    rows = raw.read_raw(bed.spark, f"{root}/{raw.file_glob('demo')}")
    rows = raw.with_quarter(raw.skip_bad_lines(rows))
    return rows.select(
        "report_id", "caseid", "event_dt", "age", "age_cod", "sex", "reporter_country", "quarter"
    )


@query
def skip_bad_lines(bed: Bed) -> DataFrame:
    rows = raw.skip_bad_lines(raw.read_raw(bed.spark, _ragged_copy(bed)))
    return rows.drop(raw.SOURCE_COLUMN)


@query
def quarantine_rows(bed: Bed) -> DataFrame:
    rows = raw.quarantine_rows(raw.read_raw(bed.spark, _ragged_copy(bed)))
    return rows.select("report_id", "caseid", "pt", F.array_join(raw.SURPLUS, "|").alias("surplus"))


@query
def normalize_header(bed: Bed) -> DataFrame:
    untidy = bed.raw("reac").toDF(" PRIMARYID", "CaseID ", "PT", "Quarter")
    return untidy.toDF(*raw.normalize_header(untidy.columns))


@query
def conform_schema(bed: Bed) -> DataFrame:
    partial = cleaning.clean_ther(bed.raw("ther")).drop("end_dt", "dur_days")
    return cleaning.conform_schema(partial, "ther")


@query
def capture_drift(bed: Bed) -> DataFrame:
    extra = bed.raw("reac").withColumns(
        {
            "drug_rec_act": F.when(F.col("report_id") % 3 == 0, "stopped"),
            "site_note": F.when(F.col("report_id") % 2 == 0, F.concat(F.lit("n"), F.col("caseid"))),
        }
    )
    return cleaning.clean_table(extra, "reac").select("report_id", "pt", S.DRIFT_COLUMN)


def _all_tables(bed: Bed) -> dict[str, DataFrame]:
    return store.clean_all({name: bed.raw(name) for name in S.TABLES})


@query
def write_quarter(bed: Bed) -> DataFrame:
    return _keys(store.write_quarter(_all_tables(bed), scratch_path(bed.spark, "store")))


@query
def skip_loaded_quarters(bed: Bed) -> DataFrame:
    demo = bed.table("demo")
    stored = demo.filter(F.col("quarter") < CUT_QUARTER)
    return store.skip_loaded_quarters(demo, stored).select("report_id", "quarter")


@query
def reload_quarter(bed: Bed) -> DataFrame:
    """A correction of a quarter with fewer reports and no report sources at all."""
    root = scratch_path(bed.spark, "store")
    tables = _all_tables(bed)
    stored = store.write_quarter(tables, root)
    corrected = {n: df.filter(F.col("report_id") % 3 != 0) for n, df in tables.items() if n != "rpsr"}
    store.reload_quarter(corrected, root, QUARTER)
    return _keys({n: store.read_table(bed.spark, root, n) for n in stored})


@query
def load_all_quarters(bed: Bed) -> DataFrame:
    root = scratch_path(bed.spark, "store")
    store.load_quarters(bed.spark, _raw_copy(bed, *S.TABLES), root)
    return _keys({n: store.read_table(bed.spark, root, n) for n in S.TABLES})


@query
def land_quarters(bed: Bed) -> DataFrame:
    """Two arrivals: all children and the reports of early quarters, then the other reports."""
    early = f"quarter < '{CUT_QUARTER}'"
    source = _raw_copy(bed, *store.CHILDREN)
    root, marks = (scratch_path(bed.spark, n) for n in ("store", "marks"))
    for label, arrival in (("EARLY", early), ("LATE", f"NOT {early}")):
        _raw_copy(bed, "demo", root=source, where=arrival, label=label)
        landing.land(bed.spark, source, root, marks).awaitTermination()
    return _keys({n: store.read_table(bed.spark, root, n) for n in S.TABLES})


@query
def export_parquet(bed: Bed) -> DataFrame:
    root = scratch_path(bed.spark, "export")
    written = store.export_parquet(bed.tables(), root)
    return _keys({n: bed.spark.read.parquet(f"{root}/{n}").select(*S.EXPORT_COLUMNS[n]) for n in written})


@query
def read_parquet_views(bed: Bed) -> DataFrame:
    root = scratch_path(bed.spark, "export")
    store.export_parquet(bed.tables(), root)
    names = store.read_parquet_views(bed.spark, root, "kept_")
    counts = [f"SELECT '{n}' AS view, quarter, count(*) AS n FROM {n} GROUP BY quarter" for n in names]
    return bed.spark.sql(" UNION ALL ".join(counts))


@query
def loaded_quarters(bed: Bed) -> DataFrame:
    return store.loaded_quarters(bed.table("demo"))


@query
def load_metadata(bed: Bed) -> DataFrame:
    return store.load_metadata(bed.tables(), F.lit(1.5), F.lit("mapped")).drop("loaded_at")


def _rows_as_text(found: dict[str, DataFrame]) -> DataFrame:
    """All rows of all views, each as one text."""

    def text(df: DataFrame, name: str) -> F.Column:
        value = F.col(name).cast("decimal(28, 9)") if dict(df.dtypes)[name] == "double" else F.col(name)
        return F.coalesce(value.cast("string"), F.lit("~"))

    told = [
        df.select(F.lit(name).alias("view"), F.concat_ws("|", *[text(df, c) for c in sorted(df.columns)]).alias("line"))
        for name, df in found.items()
    ]
    return reduce(DataFrame.unionByName, told)


@query
def refresh_views(bed: Bed) -> DataFrame:
    return _rows_as_text(views.refresh_views(bed.spark, bed.tables(), scratch_path(bed.spark, "views")))


@query
def refresh_views_after_quarter(bed: Bed) -> DataFrame:
    """The views of all other quarters, brought up to date when one more quarter is stored."""
    root, shown = (scratch_path(bed.spark, n) for n in ("store", "views"))
    tables = {n: materialize(df, n) for n, df in _all_tables(bed).items()}
    store.write_quarter({n: df.filter(F.col("quarter") != QUARTER) for n, df in tables.items()}, root)
    upkeep.refresh(bed.spark, root, shown)
    store.write_quarter(tables, root)
    return _rows_as_text(upkeep.refresh(bed.spark, root, shown))


@query
def refresh_views_after_correction(bed: Bed) -> DataFrame:
    """The views brought up to date when a quarter is replaced by one with fewer reports."""
    root, shown = (scratch_path(bed.spark, n) for n in ("store", "views"))
    tables = {n: materialize(df, n) for n, df in _all_tables(bed).items()}
    store.write_quarter(tables, root)
    upkeep.refresh(bed.spark, root, shown)
    store.reload_quarter({n: df.filter(F.col("report_id") % 3 != 0) for n, df in tables.items()}, root, QUARTER)
    return _rows_as_text(upkeep.refresh(bed.spark, root, shown))


@query
def merged_medians(bed: Bed) -> DataFrame:
    """Exact median and mean age by drug and sex over several quarters, from stored counts."""
    root, shown = (scratch_path(bed.spark, n) for n in ("store", "views"))
    store.write_quarter(_all_tables(bed), root)
    upkeep.refresh(bed.spark, root, shown)
    return _rounded(upkeep.medians(bed.spark, shown, MEDIAN_QUARTERS, "drugname_clean", "sex"), "avg_age", "median_age")


# -- cleaning ---------------------------------------------------------------


@query
def parse_event_date(bed: Bed) -> DataFrame:
    rows = bed.raw("demo").select("report_id", "event_dt")
    return C.with_event_dates(rows, {"event_date": F.col("event_dt")})


@query
def age_to_years(bed: Bed) -> DataFrame:
    years = C.age_to_years(F.col("age"), F.col("age_cod"))
    return bed.raw("demo").select("report_id", "age", "age_cod", years.alias("age_years"))


@query
def weight_to_kg(bed: Bed) -> DataFrame:
    kilos = C.weight_to_kg(F.col("wt"), F.col("wt_cod"))
    return bed.raw("demo").select("report_id", "wt", "wt_cod", kilos.alias("weight_kg"))


@query
def duration_to_days(bed: Bed) -> DataFrame:
    days = C.duration_to_days(F.col("dur"), F.col("dur_cod"))
    rows = bed.raw("ther").select("report_id", "drug_seq", "dur", "dur_cod", days.alias("dur_days"))
    return _rounded(rows, "dur_days")


@query
def clean_sex(bed: Bed) -> DataFrame:
    return bed.raw("demo").select("report_id", C.clean_sex(F.col("sex")).alias("sex_clean"))


@query
def age_group(bed: Bed) -> DataFrame:
    years = C.age_to_years(F.col("age"), F.col("age_cod"))
    return bed.raw("demo").select("report_id", C.age_group(years).alias("age_group"))


@query
def clean_drug_name(bed: Bed) -> DataFrame:
    name = C.clean_name(F.col("drugname"))
    return bed.raw("drug").select("report_id", "drug_seq", "drugname", name.alias("drugname_clean"))


@query
def clean_ingredient(bed: Bed) -> DataFrame:
    name = C.clean_name(F.col("prod_ai"))
    return bed.raw("drug").select("report_id", "drug_seq", name.alias("prod_ai_clean"))


@query
def clean_route(bed: Bed) -> DataFrame:
    route = C.clean_route(F.col("route"))
    return bed.raw("drug").select("report_id", "drug_seq", route.alias("route_clean"))


@query
def drug_role_label(bed: Bed) -> DataFrame:
    role = C.drug_role_label(F.col("role_cod"))
    return bed.raw("drug").select("report_id", "drug_seq", "role_cod", role.alias("drug_role"))


@query
def outcome_label(bed: Bed) -> DataFrame:
    label = C.outcome_label(F.col("outc_cod"))
    return bed.raw("outc").select("report_id", "outc_cod", label.alias("outcome_label"))


@query
def clean_term(bed: Bed) -> DataFrame:
    term = C.clean_term(F.col("indi_pt"))
    return bed.raw("indi").select("report_id", "drug_seq", "indi_pt", term.alias("indi_pt_clean"))


@query
def coerce_keys(bed: Bed) -> DataFrame:
    """Report numbers as text of five kinds: plain, decimal, padded, damaged, empty."""
    number, text = F.col("report_id"), F.col("report_id").cast("string")
    spelled = (
        F.when(number % 5 == 0, text)
        .when(number % 5 == 1, F.concat(text, F.lit(".0")))
        .when(number % 5 == 2, F.concat(F.lit("  "), text))
        .when(number % 5 == 3, F.concat(F.lit("x"), text))
        .otherwise("")
    )
    rows = bed.raw("ther").select(
        spelled.alias("report_id"),
        F.col("caseid").cast("string").alias("caseid"),
        F.col("drug_seq").cast("string").alias("drug_seq"),
    )
    return cleaning.coerce_keys(rows)


@query
def tag_quarter(bed: Bed) -> DataFrame:
    return cleaning.tag_quarter(bed.raw("rpsr").select("report_id", "rpsr_cod"), "2026Q1")


@query
def clean_demo(bed: Bed) -> DataFrame:
    return bed.table("demo").drop(S.DRIFT_COLUMN)


@query
def clean_drug(bed: Bed) -> DataFrame:
    return bed.table("drug")


@query
def clean_reac(bed: Bed) -> DataFrame:
    return bed.table("reac")


@query
def clean_outc(bed: Bed) -> DataFrame:
    return bed.table("outc")


@query
def clean_ther(bed: Bed) -> DataFrame:
    return _rounded(bed.table("ther").drop(S.DRIFT_COLUMN), "dur_days")


@query
def clean_indi(bed: Bed) -> DataFrame:
    return bed.table("indi")


@query
def clean_rpsr(bed: Bed) -> DataFrame:
    return bed.table("rpsr")


@query
def parse_quarter(bed: Bed) -> DataFrame:
    return _keys(_all_tables(bed))


@query
def resolve_generic(bed: Bed) -> DataFrame:
    drug = bed.table("drug").select("report_id", "drug_seq", "drugname_clean")
    return cleaning.resolve_generic(drug, bed.mappings())


@query
def case_history(bed: Bed) -> DataFrame:
    return history.case_history(bed.table("demo"))


@query
def cases_as_of(bed: Bed) -> DataFrame:
    """Newest reports, and how many of them are serious, as known at the end of several quarters."""
    known = history.known_as_of(history.case_history(bed.table("demo")), AS_OF_QUARTERS)
    serious = P.serious_filter(bed.table("outc")).select("report_id").distinct().withColumn("serious", F.lit(1))
    told = known.join(serious, "report_id", "left").groupBy("as_of")
    return told.agg(F.count("*").alias("cases"), F.count("serious").alias("serious"), F.sum("report_id").alias("report_sum"))


@query
def views_as_of(bed: Bed) -> DataFrame:
    """All views as known in an earlier quarter."""
    tables = bed.tables()
    then = history.tables_as_of(tables, history.case_history(tables["demo"]), QUARTER)
    return _rows_as_text({n: then[n] if n == history.LATEST else build(then) for n, build in views.VIEWS.items()})


# -- filters ----------------------------------------------------------------


@query
def drug_search(bed: Bed) -> DataFrame:
    rows = bed.table("drug").select("report_id", "drug_seq", "drugname_clean", "prod_ai_clean")
    return P.drug_search(rows, "d_ring", ("drugname_clean", "prod_ai_clean"))


@query
def reaction_search(bed: Bed) -> DataFrame:
    return P.reaction_search(bed.table("reac"), REACTION, "pt_clean").select("report_id", "pt_clean")


@query
def ilike_any(bed: Bed) -> DataFrame:
    rows = bed.table("drug").select("report_id", "drug_seq", "drugname_clean")
    return P.ilike_any(rows, "drugname_clean", CLASS_NAMES)


@query
def role_filter(bed: Bed) -> DataFrame:
    return P.role_filter(bed.table("drug"), "SS").select("report_id", "drug_seq", "role_cod")


@query
def quarter_filter(bed: Bed) -> DataFrame:
    rows = bed.table("demo").select("report_id", "quarter")
    return P.quarter_filter(rows, [QUARTER, "1999q4"])


@query
def nonempty_filter(bed: Bed) -> DataFrame:
    """Names are blanked for some rows, as missing names are in cleaned files."""
    name = F.when(F.col("drug_seq") == 1, "").when(F.col("drug_seq") != 2, F.col("drugname_clean"))
    rows = bed.table("drug").select("report_id", "drug_seq", name.alias("drugname_clean"))
    return P.nonempty_filter(rows, "drugname_clean")


@query
def signal_filter(bed: Bed) -> DataFrame:
    signals = _view(bed, "mv_signal_prr")["mv_signal_prr"]
    return P.signal_filter(signals).select("drugname_clean", "reaction_term", "quarter", "prr")


@query
def serious_filter(bed: Bed) -> DataFrame:
    return P.serious_filter(bed.table("outc")).select("report_id", "outc_cod")


# -- joins ------------------------------------------------------------------


@query
def drug_reac_join(bed: Bed) -> DataFrame:
    return A.count_rows(joins.drug_reac_join(bed.tables()), "drugname_clean", "pt_clean")


@query
def drug_outc_join(bed: Bed) -> DataFrame:
    return A.count_rows(joins.drug_outc_join(bed.tables()), "drugname_clean", "outc_cod", "quarter")


@query
def drug_demo_join(bed: Bed) -> DataFrame:
    return A.count_rows(joins.drug_demo_join(bed.tables()), "drugname_clean", "sex", "age_group")


@query
def latest_case_join(bed: Bed) -> DataFrame:
    t = bed.tables()
    rows = t["drug"].select("report_id", "drug_seq", "drugname_clean")
    return cases.latest_only(rows, cases.latest_cases(t["demo"]))


@query
def demo_outc_left(bed: Bed) -> DataFrame:
    return joins.demo_outc_left(bed.tables())


@query
def drug_outc_reac_left(bed: Bed) -> DataFrame:
    facts = joins.drug_outc_reac_left(bed.tables())
    return facts.groupBy("drugname_clean", "quarter").agg(
        F.count("*").alias("report_count"),
        F.count_if(F.col("died") == 1).alias("deaths"),
        F.sum(F.coalesce("reactions", F.lit(0))).alias("reactions"),
    )


@query
def serious_semi(bed: Bed) -> DataFrame:
    rows = joins.serious_semi(bed.tables())
    return rows.select("report_id", "drug_seq", "drugname_clean", "role_cod")


@query
def pair_self_join_name(bed: Bed) -> DataFrame:
    return heavy.name_pairs(bed.table("drug").select("report_id", "drugname_clean"), 2)


@query
def pair_self_join_seq(bed: Bed) -> DataFrame:
    return heavy.place_pairs(bed.table("drug").select("report_id", "drugname_clean", "drug_seq"), 2)


@query
def totals_cross_join(bed: Bed) -> DataFrame:
    t = bed.tables()
    counts = A.count_distinct_reports(t["drug"], "drugname_clean")
    total = t["demo"].agg(F.count_distinct("report_id"))
    return joins.with_total(counts, total, "grand_total")


@query
def stat_joins(bed: Bed) -> DataFrame:
    return heavy.prr_full(bed.tables(), 2).select(
        "drug", "reaction", "drug_reaction_count", "drug_total", "reaction_total", "grand_total"
    )


@query
def scalar_subquery(bed: Bed) -> DataFrame:
    drug = bed.table("drug")
    counts = A.count_distinct_reports(drug, "prod_ai_clean", "role_cod")
    primary = drug.filter(F.col("role_cod") == "PS").agg(F.count_distinct("report_id"))
    share = joins.share_of_total(F.col("report_count"), primary)
    return counts.withColumn("pct_of_ps", F.round(share, 6))


@query
def correlated_scalar(bed: Bed) -> DataFrame:
    v = _view(bed, "mv_death_by_drug", "mv_top_drugs")
    deaths = A.sum_of(v["mv_death_by_drug"], "death_reports", "drugname_clean")
    totals = A.sum_of(v["mv_top_drugs"], "report_count", "drugname_clean")
    rates = joins.with_denominator(
        deaths, totals, ["drugname_clean"], "death_reports", "report_count", "death_rate_pct"
    )
    return _rounded(rates, "death_rate_pct")


def _kept_demo(bed: Bed) -> DataFrame:
    return cases.dedup_versions(bed.table("demo"))


@query
def orphan_children(bed: Bed) -> DataFrame:
    rows = cases.orphan_children(bed.table("drug"), _kept_demo(bed))
    return rows.select("report_id", "drug_seq", "drugname_clean")


@query
def enforce_parent(bed: Bed) -> DataFrame:
    rows = cases.enforce_parent(bed.table("drug"), _kept_demo(bed))
    return rows.select("report_id", "drug_seq", "drugname_clean")


# -- aggregations -----------------------------------------------------------


@query
def count_rows(bed: Bed) -> DataFrame:
    return A.count_rows(bed.table("drug"), "role_cod", "quarter")


@query
def count_distinct_reports(bed: Bed) -> DataFrame:
    return A.count_distinct_reports(bed.table("reac"), "pt_clean", "quarter")


# Two ranges of quarters that overlap.
BITMAP_RANGES = {"early": ("1995q1", "1998q2"), "late": ("1997q3", "2001q3")}


def _bitmaps(bed: Bed) -> dict[str, bitmaps.Bitmaps]:
    """Bitmaps of two thirds of the reports, then of the rest, for each range."""
    root, tables = scratch_path(bed.spark, "bitmaps"), bed.tables()
    for part in ("report_id % 3 <> 0", "true"):
        bitmaps.update(bed.spark, {n: tables[n].filter(part) for n in ("demo", "drug", "reac", "outc")}, root)
    known = [r.quarter for r in tables["demo"].select("quarter").distinct().collect()]
    return {n: bitmaps.Bitmaps(bed.spark, root, [q for q in known if lo <= q <= hi]) for n, (lo, hi) in BITMAP_RANGES.items()}


@query
def bitmap_distinct(bed: Bed) -> DataFrame:
    """Distinct reports of each drug, drug in a role, reaction and outcome over ranges of quarters."""
    found = [
        held.by_value(d).select(F.lit(name).alias("range"), F.lit(d).alias("dimension"), "value", "reports")
        for name, held in _bitmaps(bed).items() for d in ("drug", "drug_role", "reaction", "outcome")
    ]
    return reduce(DataFrame.unionByName, found)


@query
def bitmap_conditions(bed: Bed) -> DataFrame:
    """Reports with both of two drugs, or one of them, and a serious outcome, over ranges of quarters."""
    out = []
    for name, held in _bitmaps(bed).items():
        names = [r.value for r in held.by_value("drug").orderBy(F.desc("reports"), "value").limit(2).collect()]
        one, two = (held.having("drug", n) for n in names)
        serious = held.having("outcome", *S.SERIOUS_OUTCOMES)
        sets = {"both": bitmaps.all_of(one, two), "either": bitmaps.any_of(one, two), "both and serious": bitmaps.all_of(one, two, serious), "either and serious": bitmaps.all_of(bitmaps.any_of(one, two), serious)}
        out += [bitmaps.reports_in(x).select(F.lit(name).alias("range"), F.lit(c).alias("condition"), "reports") for c, x in sets.items()]
    return reduce(DataFrame.unionByName, out)


@query
def conditional_distinct(bed: Bed) -> DataFrame:
    roles = {
        "ps_count": F.col("role_cod") == "PS",
        "ss_count": F.col("role_cod") == "SS",
        "concomitant_count": F.col("role_cod") == "C",
    }
    return A.conditional_distinct(bed.table("drug"), roles, "drugname_clean", "quarter")


@query
def sum_of_counts(bed: Bed) -> DataFrame:
    tops = _view(bed, "mv_top_reactions")["mv_top_reactions"]
    return A.sum_of(tops, "report_count", "reaction_term")


@query
def avg(bed: Bed) -> DataFrame:
    return _rounded(A.mean_of(bed.table("demo"), "age_years", "sex", "quarter"), "avg_age_years")


@query
def avg_duration(bed: Bed) -> DataFrame:
    """Durations have any number of decimals."""
    return _rounded(A.mean_of(bed.table("ther"), "dur_days", "quarter"), "avg_dur_days")


@query
def median(bed: Bed) -> DataFrame:
    medians = A.median_of(bed.table("demo"), "age_years", "sex", "age_group")
    return _rounded(medians, "median_age_years")


@query
def max_bool_or(bed: Bed) -> DataFrame:
    return A.strongest(_view(bed, "mv_signal_prr")["mv_signal_prr"], "reaction_term")


@query
def string_agg_distinct(bed: Bed) -> DataFrame:
    return A.distinct_list(bed.table("drug"), "quarter", "drugname_clean")


@query
def string_agg_ordered(bed: Bed) -> DataFrame:
    return A.ordered_names(bed.table("drug"), "report_id")


@query
def having(bed: Bed) -> DataFrame:
    counts = A.count_distinct_reports(bed.table("drug"), "drugname_clean", "role_cod")
    return A.having(counts, "report_count", 250)


@query
def select_distinct(bed: Bed) -> DataFrame:
    return A.select_distinct(bed.table("outc"), "report_id", "quarter")


@query
def unique_terms(bed: Bed) -> DataFrame:
    return A.unique_terms(bed.table("reac"))


@query
def top_k(bed: Bed) -> DataFrame:
    rows = bed.table("demo").select("report_id", "weight_kg", "sex")
    return A.top_k(rows, "weight_kg", 100, ["report_id"])


@query
def disproportionality(bed: Bed) -> DataFrame:
    """The ratios over counts of ingredients and reactions that meet in three reports."""
    t = bed.tables()
    drugs = t["drug"].select("report_id", F.col("prod_ai_clean"))
    pairing = views.Pairing(drugs, t["reac"].select("report_id", "pt_clean"), None)
    counted = (
        pairing.count(["prod_ai_clean", "pt_clean"], "a", 3)
        .join(pairing.count_drugs(["prod_ai_clean"], "n_drug"), "prod_ai_clean")
        .join(pairing.count_others(["pt_clean"], "n_reac"), "pt_clean")
    )
    total = t["demo"].agg(F.count_distinct("report_id"))
    return views.with_ratios(joins.with_total(counted, total, "total"), "a", "n_drug", "n_reac", "total")


# -- versions of a case -----------------------------------------------------


@query
def dedup_versions(bed: Bed) -> DataFrame:
    return _kept_demo(bed).select("report_id", "caseid", "caseversion", "quarter")


@query
def latest_cases(bed: Bed) -> DataFrame:
    return cases.latest_cases(bed.table("demo"))


# -- standing views ---------------------------------------------------------


def _register_view(name: str, *rounded: str) -> None:
    def build(bed: Bed) -> DataFrame:
        return _rounded(_view(bed, name)[name], *rounded) if rounded else _view(bed, name)[name]

    REGISTRY[name] = build


_register_view("mv_latest_cases")
_register_view("mv_drug_reaction_pairs")
_register_view("mv_drug_outcomes")
_register_view("mv_death_by_drug", "pct_of_all_ps_reports")
_register_view("mv_reports_by_country")
_register_view("mv_signal_prr")
_register_view("mv_age_sex_distribution", "median_age", "avg_age", "avg_weight_kg")
_register_view("mv_quarterly_trends", "avg_age")
_register_view("mv_top_drugs")
_register_view("mv_top_reactions")


# -- reports ----------------------------------------------------------------


@query
def top_drugs(bed: Bed) -> DataFrame:
    return reports.top_drugs(_view(bed, "mv_top_drugs"))


@query
def top_drugs_in_role(bed: Bed) -> DataFrame:
    return reports.top_drugs(_view(bed, "mv_top_drugs"), QUARTER, "SS", 30)


@query
def drug_reactions(bed: Bed) -> DataFrame:
    return reports.drug_reactions(_view(bed, "mv_drug_reaction_pairs"), DRUG)


@query
def drug_reactions_all_roles(bed: Bed) -> DataFrame:
    v = _view(bed, "mv_drug_reaction_pairs")
    return reports.drug_reactions(v, DRUG, QUARTER, P.ANY_ROLE, 5)


@query
def drug_outcomes(bed: Bed) -> DataFrame:
    return reports.drug_outcomes(_view(bed, "mv_drug_outcomes"), DRUG)


@query
def drug_signal(bed: Bed) -> DataFrame:
    return reports.drug_signal(_view(bed, "mv_signal_prr"), DRUG)


@query
def drug_signal_confirmed(bed: Bed) -> DataFrame:
    v = _view(bed, "mv_signal_prr")
    return reports.drug_signal(v, "gear", None, 5, signals_only=True)


@query
def signal_count(bed: Bed) -> DataFrame:
    return reports.signal_count(reports.drug_signal(_view(bed, "mv_signal_prr"), DRUG))


@query
def drug_demographics(bed: Bed) -> DataFrame:
    return reports.drug_demographics(_view(bed, "mv_age_sex_distribution"), DRUG)


@query
def death_top_drugs(bed: Bed) -> DataFrame:
    return reports.death_top_drugs(_view(bed, "mv_death_by_drug"))


@query
def country_distribution(bed: Bed) -> DataFrame:
    return reports.country_distribution(_view(bed, "mv_reports_by_country"))


@query
def quarterly_trends(bed: Bed) -> DataFrame:
    return reports.quarterly_trends(_view(bed, "mv_quarterly_trends"))


@query
def top_reactions(bed: Bed) -> DataFrame:
    return reports.top_reactions(_view(bed, "mv_top_reactions"))


@query
def db_summary(bed: Bed) -> DataFrame:
    return reports.db_summary(bed.tables())


@query
def total_cases(bed: Bed) -> DataFrame:
    return reports.total_cases(bed.tables())


@query
def prr_full(bed: Bed) -> DataFrame:
    return heavy.prr_full(bed.tables())


@query
def drug_trend(bed: Bed) -> DataFrame:
    return heavy.drug_trend(bed.tables(), DRUG)


@query
def polypharmacy(bed: Bed) -> DataFrame:
    return heavy.polypharmacy(bed.tables())


@query
def drug_pairs_serious(bed: Bed) -> DataFrame:
    return heavy.drug_pairs_serious(bed.tables())


# -- standard answers -------------------------------------------------------


@query
def ex_reactions_for_drug(bed: Bed) -> DataFrame:
    return answers.reactions_for_drug(_view(bed, "mv_drug_reaction_pairs"), DRUG)


@query
def ex_deaths_by_quarter(bed: Bed) -> DataFrame:
    return answers.deaths_by_quarter(_view(bed, "mv_death_by_drug"), DRUG)


@query
def ex_countries(bed: Bed) -> DataFrame:
    return answers.countries(_view(bed, "mv_reports_by_country"))


@query
def ex_signal_pair(bed: Bed) -> DataFrame:
    return answers.signal_pair(_view(bed, "mv_signal_prr"), DRUG, REACTION)


@query
def ex_demographics(bed: Bed) -> DataFrame:
    return answers.demographics(_view(bed, "mv_age_sex_distribution"), DRUG)


@query
def ex_trend(bed: Bed) -> DataFrame:
    return answers.trend(_view(bed, "mv_quarterly_trends"))


@query
def ex_top_hospitalization(bed: Bed) -> DataFrame:
    return answers.top_hospitalization(_view(bed, "mv_drug_outcomes"))


@query
def ex_class_signals(bed: Bed) -> DataFrame:
    v = _view(bed, "mv_signal_prr", "mv_top_drugs")
    return answers.class_signals(v, QUARTER, CLASS_NAMES, CLASS_INGREDIENTS)


@query
def ex_compare_deaths(bed: Bed) -> DataFrame:
    v = _view(bed, "mv_death_by_drug", "mv_top_drugs")
    return _rounded(answers.compare_deaths(v, ["cold ring", "gear"]), "death_rate_pct")


@query
def ex_reporter_type(bed: Bed) -> DataFrame:
    return answers.reporter_type(bed.tables())


@query
def ex_drug_pairs(bed: Bed) -> DataFrame:
    return heavy.drug_pairs(bed.tables())


# -- shares -----------------------------------------------------------------


@query
def share_of_max(bed: Bed) -> DataFrame:
    top = reports.death_top_drugs(_view(bed, "mv_death_by_drug"))
    return _rounded(shares.share_of_max(top, "death_reports"), "share_of_max")


@query
def country_death_pct(bed: Bed) -> DataFrame:
    found = reports.country_distribution(_view(bed, "mv_reports_by_country"))
    return shares.country_death_pct(found).select(
        "country", "report_count", "death_count", "death_pct"
    )


@query
def quarter_outcome_pct(bed: Bed) -> DataFrame:
    trends = _view(bed, "mv_quarterly_trends")["mv_quarterly_trends"]
    found = shares.quarter_outcome_pct(trends)
    return _rounded(found, *[f"{c}_pct" for c in shares.TREND_COUNTS])


@query
def latest_six_quarters(bed: Bed) -> DataFrame:
    trends = reports.quarterly_trends(_view(bed, "mv_quarterly_trends"))
    return shares.latest_six_quarters(trends)


# -- question log -----------------------------------------------------------


@query
def log_history(bed: Bed) -> DataFrame:
    return L.log_history(bed.query_log())


@query
def log_sanitize(bed: Bed) -> DataFrame:
    return L.log_sanitize(bed.query_log())


@query
def log_route(bed: Bed) -> DataFrame:
    return L.log_route(bed.query_log())


@query
def log_route_counts(bed: Bed) -> DataFrame:
    return L.log_route_counts(bed.query_log())


@query
def log_warning(bed: Bed) -> DataFrame:
    return L.log_warning(bed.query_log())


@query
def log_sql_audit(bed: Bed) -> DataFrame:
    return L.log_sql_audit(bed.query_log()).drop("query_text")


@query
def sql_fingerprint(bed: Bed) -> DataFrame:
    return L.sql_fingerprint(bed.query_log())


@query
def log_latency(bed: Bed) -> DataFrame:
    return L.log_latency(bed.query_log())
