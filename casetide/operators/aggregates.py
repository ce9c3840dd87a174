"""Grouped counts and summaries used by the views and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_rows(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def count_distinct_reports(df: DataFrame, *keys: str) -> DataFrame:
    """Exact number of different reports. Spark spreads a large group by the reports."""
    return df.groupBy(*keys).agg(F.count_distinct("report_id").alias("report_count"))


def conditional_distinct(df: DataFrame, conditions: dict[str, Column], *keys: str) -> DataFrame:
    """Different reports of a group that meet each condition in at least one row.

    The conditions become flags of the report first, then flags are summed; several
    conditional distinct counts would copy each row once per condition.
    """
    flags = [F.max(c.cast("int")).alias(name) for name, c in conditions.items()]
    per_report = df.groupBy(*keys, "report_id").agg(*flags)
    return per_report.groupBy(*keys).agg(
        F.count("*").alias("report_count"),
        *[F.count_if(F.col(name) == 1).alias(name) for name in conditions],
    )


def sum_of(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(column).alias(column))


def mean_of(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(column).alias(f"avg_{column}"))


def median_of(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Exact interpolated median. Equal values are counted before they are gathered."""
    counted = df.groupBy(*keys, column).agg(F.count("*").alias("_times"))
    median = F.percentile(column, F.lit(0.5), F.col("_times"))
    return counted.groupBy(*keys).agg(median.alias(f"median_{column}"))


def strongest(df: DataFrame, *keys: str) -> DataFrame:
    """Largest ratio of a group, and whether any of its rows is a signal."""
    return df.groupBy(*keys).agg(
        F.max("prr").alias("prr"), F.bool_or("is_signal").alias("is_signal")
    )


def distinct_list(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Different values of a group in order, as text; for columns of few values."""
    values = F.array_join(F.array_sort(F.collect_set(column)), ", ")
    return df.groupBy(*keys).agg(values.alias(f"{column}_list"))


def ordered_names(df: DataFrame, *keys: str) -> DataFrame:
    """Drug names of a group in the order they were listed, as text."""
    names = F.expr(
        "listagg(drugname_clean, ' | ') "
        "within group (order by drug_seq asc nulls last, drugname_clean)"
    )
    return df.groupBy(*keys).agg(names.alias("drug_list"))


def having(df: DataFrame, count: str, least: int) -> DataFrame:
    return df.filter(F.col(count) >= least)


def select_distinct(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def unique_terms(reac: DataFrame) -> DataFrame:
    return reac.agg(F.count_distinct("pt_clean").alias("unique_terms"))


def top_k(df: DataFrame, by: str, limit: int, tie_breakers: Sequence[str]) -> DataFrame:
    """The rows with the largest ``by``, fully ordered, nulls last."""
    return df.orderBy(F.desc_nulls_last(by), *tie_breakers).limit(limit)
