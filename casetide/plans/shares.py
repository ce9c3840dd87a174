"""Shares and percentages that the dashboards derive from report results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREND_COUNTS = ("deaths", "hospitalizations", "life_threatening", "female_cases", "male_cases")


def share_of_max(df: DataFrame, column: str) -> DataFrame:
    """Each count as a percentage of the largest one of a limited result, read once."""
    largest = F.max(column).over(Window.partitionBy())
    share = F.when(largest > 0, F.col(column) / largest * 100).otherwise(0.0)
    return df.withColumn("share_of_max", share)


def country_death_pct(countries: DataFrame) -> DataFrame:
    share = F.round(F.coalesce(F.col("death_count"), F.lit(0)) / F.col("report_count") * 100, 1)
    return countries.withColumn(
        "death_pct", F.when(F.col("report_count") > 0, share).otherwise(0.0)
    )


def quarter_outcome_pct(trends: DataFrame) -> DataFrame:
    """Outcome and sex counts of each quarter as percentages of its cases."""
    total = F.when(F.col("total_cases") > 0, F.col("total_cases")).otherwise(1)

    def share(column: str) -> Column:
        return (F.coalesce(F.col(column), F.lit(0)) / total * 100).alias(f"{column}_pct")

    return trends.select("quarter", "total_cases", *[share(c) for c in TREND_COUNTS])


def latest_six_quarters(trends: DataFrame) -> DataFrame:
    return trends.orderBy(F.desc("quarter")).limit(6).orderBy("quarter")
