"""Row filters used by the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetide import schemas as S
from casetide.functions.clean import nonempty

ANY_ROLE = "all"


def drug_search(
    df: DataFrame, name: str, columns: Sequence[str] = ("drugname_clean",)
) -> DataFrame:
    """Rows where any of the columns contains ``name``, in any case.

    ``%`` and ``_`` in the name are wildcards, as the users of the reports expect.
    The name is a literal of the plan; it never becomes part of SQL text.
    """
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.col(column).ilike(f"%{name}%")
    return df.filter(hit)


def reaction_search(df: DataFrame, term: str, column: str = "reaction_term") -> DataFrame:
    return df.filter(F.col(column).ilike(f"%{term}%"))


def ilike_any(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """Rows that match at least one pattern."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | F.col(column).ilike(pattern)
    return df.filter(hit)


def role_filter(df: DataFrame, role: str) -> DataFrame:
    return df if role == ANY_ROLE else df.filter(F.col("role_cod") == role)


def quarter_filter(df: DataFrame, quarters: str | Sequence[str] | None = None) -> DataFrame:
    """One quarter, several, or all. Prunes partitions of stored tables."""
    if not quarters:
        return df
    wanted = [quarters] if isinstance(quarters, str) else list(quarters)
    return df.filter(F.col("quarter").isin(wanted))


def nonempty_filter(df: DataFrame, *columns: str) -> DataFrame:
    for column in columns:
        df = df.filter(nonempty(F.col(column)))
    return df


def signal_filter(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_signal"))


def serious_filter(outc: DataFrame) -> DataFrame:
    return outc.filter(F.col("outc_cod").isin(*S.SERIOUS_OUTCOMES))
