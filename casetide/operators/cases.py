"""Versions of a case, parents and children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_versions(demo: DataFrame) -> DataFrame:
    """Rows at the highest version of their case within a quarter, one per report.

    A missing version is version 0. Different reports that share the highest
    version all stay; rows without a case go. The highest version is found by a
    combined maximum and joined back, because a window over a case would put all
    rows of a large case into one task. Among rows of the same report the smallest
    by all columns stays, so a rerun keeps the same one.
    """
    columns = demo.columns
    case = ["quarter", "caseid"]
    versioned = demo.filter(F.col("caseid").isNotNull()).withColumn(
        "caseversion", F.coalesce(F.col("caseversion"), F.lit(0))
    )
    newest = versioned.groupBy(*case).agg(F.max("caseversion").alias("caseversion"))
    kept = versioned.join(newest, [*case, "caseversion"], "left_semi")
    rest = [c for c in columns if c not in ("quarter", "report_id")]
    one = kept.groupBy("quarter", "report_id").agg(F.min(F.struct(*rest)).alias("_row"))
    return one.select("quarter", "report_id", "_row.*").select(*columns)


def newest_quarter(demo: DataFrame) -> DataFrame:
    """One row per report: that of its newest quarter."""
    rest = [c for c in demo.columns if c not in ("report_id", "quarter")]
    newest = demo.groupBy("report_id").agg(F.max(F.struct("quarter", *rest)).alias("_row"))
    return newest.select("report_id", "_row.*").select(*demo.columns)


def latest_cases(demo: DataFrame) -> DataFrame:
    """The newest report of every case over all quarters."""
    return demo.groupBy("caseid").agg(F.max("report_id").alias("report_id"))


def latest_only(df: DataFrame, latest: DataFrame) -> DataFrame:
    """Rows that belong to the newest report of their case."""
    return df.join(latest.select("report_id"), "report_id", "left_semi")


def enforce_parent(child: DataFrame, demo: DataFrame) -> DataFrame:
    """Child rows whose report is known."""
    return child.join(demo.select("report_id"), "report_id", "left_semi")


def orphan_children(child: DataFrame, demo: DataFrame) -> DataFrame:
    """Child rows whose report is not known."""
    return child.join(demo.select("report_id"), "report_id", "left_anti")
