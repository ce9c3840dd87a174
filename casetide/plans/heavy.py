"""Analyses over whole tables, beyond what the standing views hold."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetide.functions import ratios as R
from casetide.functions.clean import nonempty
from casetide.operators.predicates import drug_search, role_filter, serious_filter
from casetide.plans.skew import ROWS_PER_TASK, Grid, stored_keys
from casetide.plans.views import Pairing, _outcome_flags, per_report, with_ratios
from casetide.runtime import materialize

Tables = Mapping[str, DataFrame]

# Drugs among which a first lower bound for the most frequent pairs is sought.
BOUND_DRUGS = 50


def prr_full(
    t: Tables, min_reports: int = R.SIGNAL_MIN_REPORTS, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Disproportionality over all quarters and all reports, superseded ones included."""
    named = t["drug"].filter(nonempty(F.col("drugname_clean")))
    drugs = role_filter(named, "PS").select("report_id", F.col("drugname_clean").alias("drug"))
    reactions = t["reac"].select("report_id", F.col("pt_clean").alias("reaction"))
    pairing = Pairing(drugs, reactions, None, rows_per_task, stored_keys(t, "drug", "reac"))
    pairs = pairing.count(["drug", "reaction"], "drug_reaction_count", min_reports)
    total = t["demo"].agg(F.count_distinct("report_id"))
    counted = (
        pairs.join(pairing.count_drugs(["drug"], "drug_total"), "drug")
        .join(pairing.count_others(["reaction"], "reaction_total"), "reaction")
        .withColumn("grand_total", total.scalar())
        .select(
            "drug", "reaction", "drug_reaction_count", "drug_total", "reaction_total",
            "grand_total",
        )
    )
    return with_ratios(
        counted, "drug_reaction_count", "drug_total", "reaction_total", "grand_total"
    ).orderBy(F.desc_nulls_last("prr"), "drug", "reaction")


def drug_trend(t: Tables, drug: str) -> DataFrame:
    """Reports, deaths, hospitalizations and different reactions of a drug by quarter.

    Outcomes and reactions are looked up apart from each other, for the drug's
    reports only; joining both to the drug rows at once would multiply them. The
    reports are stored in the scratch folder, so the drug table is searched once.
    """
    rows = role_filter(drug_search(t["drug"], drug), "PS")
    reports = materialize(rows.select("report_id", "quarter").distinct(), "reports")
    outcomes = t["outc"].select("report_id", "outc_cod").join(
        reports.select("report_id"), "report_id", "left_semi"
    )
    counts = (
        reports.join(_outcome_flags(outcomes), "report_id", "left")
        .groupBy("quarter")
        .agg(
            F.count("*").alias("report_count"),
            F.count_if(F.col("died") == 1).alias("deaths"),
            F.count_if(F.col("hospitalized") == 1).alias("hospitalizations"),
        )
    )
    reactions = (
        t["reac"].select("report_id", "pt_clean")
        .join(reports, "report_id")
        .groupBy("quarter")
        .agg(F.count_distinct("pt_clean").alias("unique_reactions_reported"))
    )
    found = F.coalesce("unique_reactions_reported", F.lit(0)).alias("unique_reactions_reported")
    return (
        counts.join(reactions, "quarter", "left")
        .select("quarter", "report_count", "deaths", "hospitalizations", found)
        .orderBy("quarter")
    )


def polypharmacy(t: Tables, min_drug_count: int = 5, limit: int = 1000) -> DataFrame:
    """Reports with the most drug rows, with their drugs in order.

    The rows are counted first, with a map-side combine; lists are put together only
    for the ``limit`` reports of the result. A list belongs to one line of the result, so it is one value.
    """
    drug = t["drug"].select("report_id", "drug_seq", "drugname_clean")
    top = (
        drug.groupBy("report_id")
        .agg(F.count("*").alias("drug_count"))
        .filter(F.col("drug_count") >= min_drug_count)
        .orderBy(F.desc("drug_count"), "report_id")
        .limit(limit)
    )
    names = F.expr(
        "listagg(drugname_clean, ' | ') "
        "within group (order by drug_seq asc nulls last, drugname_clean)"
    )
    return (
        drug.join(top, "report_id")
        .groupBy("report_id", "drug_count")
        .agg(names.alias("drug_list"))
        .orderBy(F.desc("drug_count"), "report_id")
    )


def _grid(rows: DataFrame, rows_per_task: int, t: Tables | None = None) -> Grid:
    """How reports with very many drugs are cut; holds for any part of ``rows`` as well."""
    known = None if t is None else stored_keys(t, "drug", "drug")
    return Grid(["report_id"], rows, rows, rows_per_task, known)


def _meet(rows: DataFrame, grid: Grid) -> DataFrame:
    """The rows of each report joined to each other, as ``a_`` and ``b_`` columns."""
    values = [c for c in rows.columns if c != "report_id"]

    def renamed(side: DataFrame, prefix: str) -> DataFrame:
        return side.select(*grid.keys, *[F.col(c).alias(prefix + c) for c in values])

    left = renamed(grid.left(rows, ["drugname_clean"]), "a_")
    right = renamed(grid.right(rows, ["drugname_clean"]), "b_")
    return left.join(right, grid.keys)


def _keep_drugs(rows: DataFrame, drugs: DataFrame) -> DataFrame:
    return rows.join(drugs.select("drugname_clean"), "drugname_clean", "left_semi")


def _frequent_pairs(rows: DataFrame, grid: Grid, least: int) -> DataFrame:
    """Name pairs that count at least ``least``, from the ``rows`` of each report and drug.

    In each report a pair counts the product of both drugs' rows, so a drug's pairs count at
    most its rows times the largest rows of any other drug there, summed over its reports.
    Drugs that cannot reach ``least`` go before any pair is formed.
    """
    size = F.struct("rows", "drugname_clean")
    first = rows.groupBy("report_id").agg(F.max(size).alias("_top"))
    beside = rows.join(first, "report_id")
    is_top = F.col("drugname_clean") == F.col("_top.drugname_clean")
    second = beside.filter(~is_top).groupBy("report_id").agg(F.max("rows").alias("_second"))
    most = F.when(is_top, F.col("_second")).otherwise(F.col("_top.rows"))
    frequent = (
        beside.join(second, "report_id")
        .groupBy("drugname_clean")
        .agg(F.sum(F.col("rows") * most).alias("bound"))
        .filter(F.col("bound") >= least)
    )
    pairs = _count_name_pairs(_keep_drugs(rows, frequent), grid)
    return pairs.filter(F.col("co_report_count") >= least)


def drug_pairs_serious(
    t: Tables,
    min_co_reports: int = 10,
    limit: int = 500,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Suspect drugs named together in serious reports, by pairs of drug rows.

    A pair counts the product of both drugs' rows in each report. The counted rows are
    stored in the scratch folder, as bound and pairs both start from them.
    """
    suspects = t["drug"].filter(
        F.col("role_cod").isin("PS", "SS") & nonempty(F.col("drugname_clean"))
    )
    serious = serious_filter(t["outc"]).select("report_id").distinct()
    rows = materialize(
        per_report(
            suspects.select("report_id", "drugname_clean"), serious, ["drugname_clean"],
            rows_per_task=rows_per_task, known=stored_keys(t, "drug"),
        ),
        "suspects",
    )
    return (
        _frequent_pairs(rows, _grid(rows, rows_per_task, t), min_co_reports)
        .orderBy(F.desc("co_report_count"), "drug_a", "drug_b")
        .limit(limit)
    )


def name_pairs(
    drug: DataFrame, least: int = 10, limit: int | None = None, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Pairs of drug rows within a report, by the names in alphabetical order."""
    rows = drug.groupBy("report_id", "drugname_clean").agg(F.count("*").alias("rows"))
    rows = materialize(rows, "drug-rows")
    pairs = _frequent_pairs(rows, _grid(rows, rows_per_task), least)
    return pairs if limit is None else pairs.orderBy(F.desc("co_report_count"), "drug_a", "drug_b").limit(limit)


def _count_name_pairs(rows: DataFrame, grid: Grid) -> DataFrame:
    pairs = _meet(rows, grid).filter(F.col("a_drugname_clean") < F.col("b_drugname_clean"))
    return pairs.groupBy(
        F.col("a_drugname_clean").alias("drug_a"), F.col("b_drugname_clean").alias("drug_b")
    ).agg(F.sum(F.col("a_rows") * F.col("b_rows")).alias("co_report_count"))


def _places(drug: DataFrame) -> DataFrame:
    """First and last place of each drug in each report."""
    return drug.groupBy("report_id", "drugname_clean").agg(
        F.min("drug_seq").alias("first"), F.max("drug_seq").alias("last")
    )


def place_pairs(
    drug: DataFrame, least: int = 10, limit: int | None = None, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Reports that list drug 1 somewhere before drug 2, of drugs in enough reports."""
    rows = materialize(_places(drug), "places")
    frequent = rows.groupBy("drugname_clean").count().filter(F.col("count") >= least)
    pairs = _count_ordered_pairs(_keep_drugs(rows, frequent), _grid(rows, rows_per_task))
    pairs = pairs.filter(F.col("co_occurrence_reports") >= least)
    order = [F.desc("co_occurrence_reports"), "drug_1", "drug_2"]
    return pairs if limit is None else pairs.orderBy(*order).limit(limit)


def _count_ordered_pairs(rows: DataFrame, grid: Grid) -> DataFrame:
    pairs = _meet(rows, grid).filter(F.col("a_first") < F.col("b_last"))
    return pairs.groupBy(
        F.col("a_drugname_clean").alias("drug_1"), F.col("b_drugname_clean").alias("drug_2")
    ).agg(F.count("*").alias("co_occurrence_reports"))


def drug_pairs(t: Tables, limit: int = 20, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Drugs listed one after the other in most reports; both orders may occur.

    A report has drug 1 before drug 2 if the first place of one lies before the last
    place of the other, so a line per report and drug with both places is enough.
    The pairs among the most reported drugs give a lower bound for the last line of
    the result; a drug with fewer reports than that cannot be in it, and is left out
    before the pairs of all others are formed.
    """
    named = t["drug"].filter(nonempty(F.col("drugname_clean")))
    rows = materialize(_places(named), "places")
    support = rows.groupBy("drugname_clean").agg(F.count("*").alias("reports"))
    foremost = support.orderBy(F.desc("reports"), "drugname_clean").limit(BOUND_DRUGS)
    among = rows.join(F.broadcast(foremost.select("drugname_clean")), "drugname_clean")
    order = [F.desc("co_occurrence_reports"), "drug_1", "drug_2"]
    grid = _grid(rows, rows_per_task, t)
    best = _count_ordered_pairs(among.select(rows.columns), grid).orderBy(*order).limit(limit)
    bound = best.agg(
        F.when(F.count("*") == limit, F.min("co_occurrence_reports")).otherwise(0)
    ).scalar()
    frequent = support.filter(F.col("reports") >= bound)
    kept = _keep_drugs(rows, frequent)
    return _count_ordered_pairs(kept, grid).orderBy(*order).limit(limit)
