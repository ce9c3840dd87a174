"""Joins of the report tables.

The adaptive planner splits a large key of the one big side; where both sides are large at
a report, the report is cut, see ``casetide.plans.skew``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetide.operators.predicates import serious_filter
from casetide.plans.skew import ROWS_PER_TASK, Grid, stored_keys

Tables = Mapping[str, DataFrame]
KEY = ["report_id"]


def many_to_many(
    left: DataFrame,
    right: DataFrame,
    rows_per_task: int = ROWS_PER_TASK,
    known: DataFrame | None = None,
) -> DataFrame:
    """All rows of both sides that share a report, with hot reports cut on either side."""
    grid = Grid(KEY, left, right, rows_per_task, known)
    placed = grid.left(left, left.columns), grid.right(right, right.columns)
    return placed[0].join(placed[1], grid.keys).drop(*grid.parts)


def drug_reac_join(t: Tables) -> DataFrame:
    return many_to_many(
        t["drug"].select("report_id", "drugname_clean", "role_cod", "quarter"),
        t["reac"].select("report_id", "pt_clean"),
        known=stored_keys(t, "drug", "reac"),
    )


def drug_outc_join(t: Tables) -> DataFrame:
    return many_to_many(
        t["drug"].select("report_id", "drugname_clean", "role_cod", "quarter"),
        t["outc"].select("report_id", "outc_cod"),
        known=stored_keys(t, "drug", "outc"),
    )


def drug_demo_join(t: Tables) -> DataFrame:
    drugs = t["drug"].select("report_id", "drugname_clean", "role_cod")
    people = t["demo"].select("report_id", "sex", "age_group", "age_years", "occp_cod")
    return drugs.join(people, KEY)


def demo_outc_left(t: Tables) -> DataFrame:
    """Every report with its outcomes, a null one where it has none."""
    demo = t["demo"].select("report_id", "quarter", "sex", "reporter_country")
    return demo.join(t["outc"].select("report_id", "outc_cod"), KEY, "left")


def drug_outc_reac_left(t: Tables) -> DataFrame:
    """Per report of a drug: is it a death, and which reactions; no row is multiplied."""
    drugs = t["drug"].select("report_id", "drugname_clean", "quarter").distinct()
    died = F.max(F.when(F.col("outc_cod") == "DE", 1).otherwise(0)).alias("died")
    deaths = t["outc"].groupBy("report_id").agg(died)
    reactions = t["reac"].groupBy("report_id").agg(
        F.count_distinct("pt_clean").alias("reactions")
    )
    facts = deaths.join(reactions, KEY, "full_outer")
    return drugs.join(facts, KEY, "left")


def serious_semi(t: Tables) -> DataFrame:
    """Drug rows of reports with a serious outcome."""
    serious = serious_filter(t["outc"]).select("report_id").distinct()
    return t["drug"].join(serious, KEY, "left_semi")


def with_total(df: DataFrame, total: DataFrame, name: str) -> DataFrame:
    """Put a one-row total beside every row."""
    return df.withColumn(name, total.scalar())


def share_of_total(count: Column, total: DataFrame) -> Column:
    return count.cast("double") / F.nullif(total.scalar().cast("double"), F.lit(0.0)) * 100


def with_denominator(
    counts: DataFrame, totals: DataFrame, on: list[str], top: str, bottom: str, name: str
) -> DataFrame:
    """Ratio of a group's count to the group's own total, null where there is none."""
    ratio = F.col(top) / F.nullif(F.col(bottom).cast("double"), F.lit(0.0)) * 100
    return counts.join(totals, on, "left").withColumn(name, ratio).drop(bottom)
