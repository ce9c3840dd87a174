"""Ready-made reports over the standing views.

The views are small next to the tables they come from, and a report is one filter,
one combined aggregation and a top-k. Every limited report has a full order, so its
cut is the same on each run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetide.functions.clean import nonempty
from casetide.operators.predicates import (
    ANY_ROLE,
    drug_search,
    quarter_filter,
    role_filter,
    signal_filter,
)

Views = Mapping[str, DataFrame]
Quarters = str | Sequence[str] | None

ROLE_COUNTS = {
    "PS": "ps_count",
    "SS": "ss_count",
    "C": "concomitant_count",
    ANY_ROLE: "report_count",
}


def joined_quarters() -> Column:
    """Quarters of a group in order, as text; the set holds four entries a year."""
    return F.array_join(F.array_sort(F.collect_set("quarter")), ", ").alias("quarters")


def top_drugs(v: Views, quarter: Quarters = None, role: str = "PS", limit: int = 20) -> DataFrame:
    """Drugs by number of reports in the given role; a line per drug, ingredient and quarter.

    That is the grain of the view, so nothing has to be grouped again.
    """
    rows = quarter_filter(v["mv_top_drugs"], quarter).filter(F.col("drugname_clean") != "")
    if role != ANY_ROLE:
        rows = rows.filter(F.col(ROLE_COUNTS[role]) > 0)
    return (
        rows.orderBy(F.desc(ROLE_COUNTS[role]), "drugname_clean", "prod_ai_clean", "quarter")
        .limit(limit)
        .select(
            F.col("drugname_clean").alias("drug"),
            F.col("prod_ai_clean").alias("active_ingredient"),
            F.col("report_count").alias("total_reports"),
            F.col("ps_count").alias("primary_suspect_reports"),
            "quarter",
        )
    )


def drug_reactions(
    v: Views, drug: str, quarter: Quarters = None, role: str = "PS", limit: int = 30
) -> DataFrame:
    rows = drug_search(quarter_filter(v["mv_drug_reaction_pairs"], quarter), drug)
    return (
        role_filter(rows, role)
        .groupBy(F.col("reaction_term").alias("reaction"))
        .agg(F.sum("report_count").alias("report_count"), joined_quarters())
        .orderBy(F.desc("report_count"), "reaction")
        .limit(limit)
    )


def drug_outcomes(v: Views, drug: str, quarter: Quarters = None) -> DataFrame:
    rows = drug_search(quarter_filter(v["mv_drug_outcomes"], quarter), drug)
    return (
        role_filter(rows, "PS")
        .groupBy(F.col("outc_cod").alias("outcome_code"), F.col("outcome_label").alias("outcome"))
        .agg(F.sum("report_count").alias("report_count"))
        .orderBy(F.desc("report_count"), "outcome_code")
    )


def drug_signal(
    v: Views,
    drug: str,
    quarter: Quarters = None,
    min_reports: int = 3,
    signals_only: bool = False,
    limit: int = 50,
) -> DataFrame:
    """Reactions of a drug by signal strength: summed counts, the strongest ratios."""
    rows = drug_search(quarter_filter(v["mv_signal_prr"], quarter), drug)
    if signals_only:
        rows = signal_filter(rows)
    return (
        rows.groupBy(F.col("reaction_term").alias("reaction"))
        .agg(
            F.sum("drug_reaction_count").alias("report_count"),
            F.max("prr").alias("prr"),
            F.max("ror").alias("ror"),
            F.bool_or("is_signal").alias("is_signal"),
            joined_quarters(),
        )
        .filter(F.col("report_count") >= min_reports)
        .orderBy(F.desc_nulls_last("prr"), "reaction")
        .limit(limit)
    )


def signal_count(signals: DataFrame) -> DataFrame:
    return signals.agg(F.count_if("is_signal").alias("signal_count"))


def drug_demographics(v: Views, drug: str, quarter: Quarters = None) -> DataFrame:
    """Patients of a drug. The ages are plain means over the groups of the view."""
    rows = drug_search(quarter_filter(v["mv_age_sex_distribution"], quarter), drug)
    return (
        rows.groupBy("age_group", "sex")
        .agg(
            F.sum("report_count").alias("report_count"),
            F.round(F.avg("avg_age"), 1).alias("avg_age"),
            F.round(F.avg("median_age"), 1).alias("median_age"),
        )
        .orderBy(F.desc("report_count"), "age_group", "sex")
    )


def death_top_drugs(v: Views, quarter: Quarters = None, limit: int = 20) -> DataFrame:
    rows = quarter_filter(v["mv_death_by_drug"], quarter).filter(F.col("drugname_clean") != "")
    return (
        rows.groupBy(F.col("drugname_clean").alias("drug"))
        .agg(F.sum("death_reports").alias("death_reports"), joined_quarters())
        .orderBy(F.desc("death_reports"), "drug")
        .limit(limit)
    )


def country_distribution(v: Views, quarter: Quarters = None, limit: int = 50) -> DataFrame:
    rows = quarter_filter(v["mv_reports_by_country"], quarter)
    counts = ["report_count", "death_count", "hospitalization_count", "life_threatening_count"]
    return (
        rows.filter(nonempty(F.col("reporter_country")))
        .groupBy(F.col("reporter_country").alias("country"))
        .agg(*[F.sum(c).alias(c) for c in counts])
        .orderBy(F.desc("report_count"), "country")
        .limit(limit)
    )


def quarterly_trends(v: Views) -> DataFrame:
    trends = v["mv_quarterly_trends"]
    return trends.withColumn("avg_age", F.round("avg_age", 1)).orderBy("quarter")


def top_reactions(v: Views, quarter: Quarters = None, limit: int = 30) -> DataFrame:
    rows = quarter_filter(v["mv_top_reactions"], quarter)
    return (
        rows.filter(nonempty(F.col("reaction_term")))
        .groupBy(F.col("reaction_term").alias("reaction"))
        .agg(F.sum("report_count").alias("report_count"))
        .orderBy(F.desc("report_count"), "reaction")
        .limit(limit)
    )


def db_summary(t: Mapping[str, DataFrame]) -> DataFrame:
    """One row about the stored tables, superseded reports included."""
    def counted(name: str, column: str, records: str, different: str) -> DataFrame:
        both = F.struct(F.count("*").alias(records), F.count_distinct(column).alias(different))
        return t[name].agg(both)

    quarters = t["demo"].groupBy("quarter").agg(F.count("*").alias("n"), F.collect_set("reporter_country").alias("c"))
    summary = quarters.agg(
        F.sum("n").alias("total_cases"),
        F.size(F.array_distinct(F.flatten(F.collect_list("c")))).cast("long").alias("total_countries"),
        joined_quarters(),
    )
    drug = counted("drug", "drugname_clean", "records", "names").scalar()
    reac = counted("reac", "pt_clean", "records", "names").scalar()
    return summary.withColumns({"_drug": drug, "_reac": reac}).select(
        "total_cases",
        F.col("_drug.records").alias("total_drug_records"),
        F.col("_reac.records").alias("total_reaction_records"),
        "total_countries",
        F.col("_drug.names").alias("unique_drugs"),
        F.col("_reac.names").alias("unique_reactions"),
        F.col(summary.columns[2]).alias("loaded_quarters"),
    )


def total_cases(t: Mapping[str, DataFrame]) -> DataFrame:
    return t["demo"].agg(F.count("*").alias("total_cases"))
