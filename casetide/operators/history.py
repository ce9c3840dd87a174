"""What was known when: the newest report of each case as of any quarter.

A report is the newest of its case from its own quarter on, until a quarter brings a larger
report number for the case. These intervals are computed once and joined with any set of
quarters, instead of resolving the versions again for each.

A case may have very many reports, so each quarter's largest number is taken first, with
map-side combine; what is ordered for a case is a row per quarter.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LATEST = "mv_latest_cases"


def case_history(demo: DataFrame) -> DataFrame:
    """``caseid``, ``report_id`` and the quarters ``known_from`` to, excluded, ``known_until``.

    ``known_until`` is null for the report that is newest today. Reports that never were the
    newest of their case have no row. Quarters are compared as text (``2024q1``).
    """
    newest = demo.groupBy("caseid", "quarter").agg(F.max("report_id").alias("report_id"))
    case = Window.partitionBy("caseid").orderBy("quarter")
    earlier = F.max("report_id").over(case.rowsBetween(Window.unboundedPreceding, -1))
    leading = newest.withColumn("earlier", earlier).filter("earlier IS NULL OR report_id > earlier")
    return leading.select(
        "caseid", "report_id", F.col("quarter").alias("known_from"), F.lead("quarter").over(case).alias("known_until")
    )


def known_as_of(history: DataFrame, quarters: Iterable[str]) -> DataFrame:
    """``as_of``, ``caseid`` and ``report_id``: the newest reports as known in each given quarter.

    The quarters are a short list, so each interval is unfolded into those that it holds;
    no pair of rows is looked at.
    """
    wanted = F.array(*[F.lit(q) for q in sorted(set(quarters))])
    inside = F.filter(
        wanted, lambda q: (F.col("known_from") <= q) & (F.col("known_until").isNull() | (q < F.col("known_until")))
    )
    return history.select(F.explode(inside).alias("as_of"), "caseid", "report_id")


def tables_as_of(t: Mapping[str, DataFrame], history: DataFrame, quarter: str) -> dict[str, DataFrame]:
    """The tables as if loaded up to a quarter, with the newest reports of that time.

    Views built from them are those of a store that had been loaded so far. A report is taken
    to have been in the quarter that it is stored in now.
    """
    upto = {n: df.filter(F.col("quarter") <= quarter) if "quarter" in df.columns else df for n, df in t.items()}
    return {**upto, LATEST: known_as_of(history, [quarter]).select("caseid", "report_id")}
