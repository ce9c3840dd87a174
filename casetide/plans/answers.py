"""Standard answers: the fixed queries behind the example questions of analysts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetide.functions.clean import nonempty
from casetide.operators.cases import newest_quarter
from casetide.operators.predicates import (
    drug_search,
    ilike_any,
    quarter_filter,
    reaction_search,
    role_filter,
    signal_filter,
)
from casetide.plans.skew import stored_keys
from casetide.plans.views import per_report

Views = Mapping[str, DataFrame]


def reactions_for_drug(v: Views, drug: str, limit: int = 20) -> DataFrame:
    rows = role_filter(drug_search(v["mv_drug_reaction_pairs"], drug), "PS")
    return (
        rows.groupBy("reaction_term")
        .agg(F.sum("report_count").alias("total_reports"))
        .orderBy(F.desc("total_reports"), "reaction_term")
        .limit(limit)
    )


def deaths_by_quarter(v: Views, drug: str) -> DataFrame:
    return (
        drug_search(v["mv_death_by_drug"], drug)
        .groupBy("drugname_clean", "quarter")
        .agg(F.sum("death_reports").alias("total_deaths"))
        .orderBy("quarter", "drugname_clean")
    )


def countries(v: Views, limit: int = 20) -> DataFrame:
    return (
        v["mv_reports_by_country"]
        .groupBy("reporter_country")
        .agg(F.sum("report_count").alias("total_reports"), F.sum("death_count").alias("total_deaths"))
        .orderBy(F.desc("total_reports"), "reporter_country")
        .limit(limit)
    )


def signal_pair(v: Views, drug: str, term: str) -> DataFrame:
    rows = reaction_search(drug_search(v["mv_signal_prr"], drug), term)
    return rows.select(
        "drugname_clean", "reaction_term", "quarter", "drug_reaction_count", "prr", "ror",
        "is_signal",
    ).orderBy(F.desc_nulls_last("prr"), "drugname_clean", "reaction_term", "quarter")


def demographics(v: Views, drug: str) -> DataFrame:
    return (
        drug_search(v["mv_age_sex_distribution"], drug)
        .groupBy("age_group", "sex")
        .agg(
            F.sum("report_count").alias("reports"),
            F.round(F.avg("avg_age"), 1).alias("avg_age"),
        )
        .orderBy("age_group", "sex")
    )


def trend(v: Views) -> DataFrame:
    return (
        v["mv_quarterly_trends"]
        .select(
            "quarter", "total_cases", "deaths", "hospitalizations", "life_threatening",
            "female_cases", "male_cases", F.round("avg_age", 1).alias("avg_age"),
        )
        .orderBy("quarter")
    )


def top_hospitalization(v: Views, limit: int = 10) -> DataFrame:
    rows = role_filter(v["mv_drug_outcomes"].filter(F.col("outc_cod") == "HO"), "PS")
    return (
        rows.groupBy("drugname_clean")
        .agg(F.sum("report_count").alias("hospitalization_reports"))
        .orderBy(F.desc("hospitalization_reports"), "drugname_clean")
        .limit(limit)
    )


def class_signals(
    v: Views,
    quarter: str,
    names: Sequence[str],
    ingredients: Sequence[str],
    limit: int = 30,
) -> DataFrame:
    """Signals of a drug class, told by patterns of the drug name or of its ingredient.

    The signal view has no ingredient, so the drugs of the class come from the view
    of all drugs, which holds every name of the signal view.
    """
    by_name = ilike_any(v["mv_top_drugs"], "drugname_clean", names)
    by_ingredient = ilike_any(v["mv_top_drugs"], "prod_ai_clean", ingredients)
    members = by_name.select("drugname_clean").union(by_ingredient.select("drugname_clean"))
    return (
        signal_filter(quarter_filter(v["mv_signal_prr"], quarter))
        .join(members.distinct(), "drugname_clean", "left_semi")
        .select("drugname_clean", "reaction_term", "drug_reaction_count", "prr", "ror")
        .orderBy(F.desc_nulls_last("prr"), "drugname_clean", "reaction_term")
        .limit(limit)
    )


def compare_deaths(v: Views, drugs: Sequence[str]) -> DataFrame:
    """Death reports of some drugs, and their share of all reports of the same drug."""
    patterns = [f"%{drug}%" for drug in drugs]
    deaths = (
        ilike_any(v["mv_death_by_drug"], "drugname_clean", patterns)
        .groupBy("drugname_clean")
        .agg(F.sum("death_reports").alias("total_deaths"))
    )
    reports = (
        ilike_any(v["mv_top_drugs"], "drugname_clean", patterns)
        .groupBy("drugname_clean")
        .agg(F.sum("report_count").cast("double").alias("reports"))
    )
    rate = F.col("total_deaths") / F.nullif(F.col("reports"), F.lit(0.0)) * 100
    return (
        deaths.join(reports, "drugname_clean", "left")
        .select("drugname_clean", "total_deaths", rate.alias("death_rate_pct"))
        .orderBy(F.desc("total_deaths"), "drugname_clean")
    )


def reporter_type(
    t: Mapping[str, DataFrame], min_reports: int = 10, limit: int = 20
) -> DataFrame:
    """Primary suspect drugs by who reported them, physicians or consumers."""
    drugs = role_filter(t["drug"], "PS").filter(nonempty(F.col("drugname_clean")))
    # A report may be stored in several quarters; it counts once, by its newest.
    reporters = newest_quarter(t["demo"].select("report_id", "quarter", "occp_cod"))
    reported = per_report(
        drugs.select("report_id", "drugname_clean"),
        reporters.select("report_id", "occp_cod"),
        ["drugname_clean"],
        known=stored_keys(t, "drug"),
    )
    return (
        reported.groupBy("drugname_clean")
        .agg(
            F.count_if(F.col("occp_cod") == "MD").alias("physician_reports"),
            F.count_if(F.col("occp_cod") == "CN").alias("consumer_reports"),
            F.count("*").alias("total_reports"),
        )
        .filter(F.col("total_reports") >= min_reports)
        .orderBy(F.desc("total_reports"), "drugname_clean")
        .limit(limit)
    )
