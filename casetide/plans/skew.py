"""Joins whose result is grouped by the key, balanced when a key holds a large share of rows.

A plain one-sided join needs none of this: the adaptive planner splits a large partition of
its big side. It cannot where both sides are large at the key, or where the rows are grouped
within the layout of the join. For those a ``Grid`` cuts keys with more rows than one task
should take into parts: each row of the big side goes to one part, and the matching rows of
the other side are copied to every part; with two big sides the parts form a grid. All other
keys have the single part 0. Every pair of matching rows meets exactly once, so the result
is that of the plain join.

The large keys are a table: the one stored when tables are loaded (``known``), or one that is
written when the plan is built, from a map-side-combined count over a sample of the key
column. It is fixed before it is used, so every table of the plan and every retried task
sees the same. It is joined like any table, as the planner decides by its size. With no
large key, as usual, the plan is the plain join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetide.runtime import materialize

ROWS_PER_TASK = 500_000
SAMPLED_ROWS = 5_000
SAMPLE_SEED = 7

SIDE, ROWS = "_side", "_rows"
#: Name under which the large reports of loaded tables are stored beside them.
HOT_REPORTS = "hot_reports"
LEFT_PART, RIGHT_PART = "_left_part", "_right_part"
_COUNTS = {LEFT_PART: "_left_parts", RIGHT_PART: "_right_parts"}


def hot_keys(
    sides: dict[str, DataFrame], on: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Keys above the task budget, by side, with their estimated number of rows.

    A key at the budget has ``SAMPLED_ROWS`` rows in the sample, enough to tell it
    from an ordinary one; a smaller budget is counted in full.
    """
    fraction = min(1.0, SAMPLED_ROWS / rows_per_task)

    def seen(side: DataFrame, name: str) -> DataFrame:
        keys = side.select(*on).dropna(subset=list(on))
        keys = keys.sample(fraction, seed=SAMPLE_SEED) if fraction < 1.0 else keys
        return keys.withColumn(SIDE, F.lit(name))

    keys = reduce(lambda a, b: a.union(b), [seen(df, name) for name, df in sides.items()])
    return (
        keys.groupBy(*on, SIDE)
        .agg((F.count("*") / fraction).alias(ROWS))
        .filter(F.col(ROWS) > rows_per_task)
    )


def stored_keys(t: Mapping[str, DataFrame], left: str, right: str | None = None) -> DataFrame | None:
    """The large reports of the tables on either side of a join, if they were stored."""
    if HOT_REPORTS not in t:
        return None
    stored = t[HOT_REPORTS].filter(F.col(SIDE).isin([n for n in (left, right) if n]))
    if left == right:
        both = F.explode(F.array(F.lit(LEFT_PART), F.lit(RIGHT_PART)))
        return stored.withColumn(SIDE, both)
    side = F.when(F.col(SIDE) == left, LEFT_PART).otherwise(RIGHT_PART)
    return stored.withColumn(SIDE, side)


class Grid:
    """How the keys ``on`` are cut, given the big left side and maybe a big right side.

    ``left``, ``right`` and ``copies`` add the part columns to a table; tables so
    prepared join on ``keys``. Rows of one side that agree on ``spread_by`` get the
    same part, so duplicates on those columns can be removed, and groups of them
    counted, within the partitioning of the join.

    ``known`` is a result of ``hot_keys`` for tables that the sides are taken from,
    with the sides named as here; it spares looking for the keys again.
    """

    def __init__(
        self,
        on: Sequence[str],
        left: DataFrame,
        right: DataFrame | None = None,
        rows_per_task: int = ROWS_PER_TASK,
        known: DataFrame | None = None,
    ):
        if LEFT_PART in left.columns:
            raise ValueError("drop the part columns of one grid before laying out another")
        self.on = list(on)
        sides = {LEFT_PART: left} if right is None else {LEFT_PART: left, RIGHT_PART: right}
        found = materialize(hot_keys(sides, on, rows_per_task), "large-keys") if known is None else known
        self._hot = None
        self.parts: list[str] = []
        if not found.isEmpty():
            self.parts = list(sides)

            def count(part: str) -> Column:
                rows = F.max(F.when(F.col(SIDE) == part, F.ceil(F.col(ROWS) / rows_per_task)))
                return F.coalesce(rows, F.lit(1)).cast("int").alias(_COUNTS[part])

            self._hot = found.groupBy(*self.on).agg(*[count(p) for p in sides])
        self.keys = [*self.on, *self.parts]

    def _place(self, df: DataFrame, cut: str | None, spread_by: Sequence[str]) -> DataFrame:
        if self._hot is None:
            return df
        names = df.columns
        df = df.join(self._hot, self.on, "left")
        for part in self.parts:
            count = F.coalesce(F.col(_COUNTS[part]), F.lit(1))
            if part == cut:
                own = F.pmod(F.xxhash64(*spread_by), count).cast("int")
            else:
                own = F.explode(F.sequence(F.lit(0), count - 1))
            df = df.withColumn(part, own)
        return df.select(*names, *self.parts)

    def left(self, df: DataFrame, spread_by: Sequence[str]) -> DataFrame:
        return self._place(df, LEFT_PART, spread_by)

    def right(self, df: DataFrame, spread_by: Sequence[str]) -> DataFrame:
        return self._place(df, RIGHT_PART, spread_by)

    def copies(self, df: DataFrame) -> DataFrame:
        return self._place(df, None, ())

    def first_copy(self, part: str) -> Column:
        """True for one of the copies that a row has along ``part``."""
        return F.col(part) == 0 if part in self.parts else F.lit(True)
