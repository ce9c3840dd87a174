"""Exact distinct counts of reports that add up: bitmaps over dense report numbers.

``count_distinct`` over two quarters is not the sum of those over each, so every range of
quarters and every condition needs its own pass over the rows. Here each report has a small
number, and for every value of a dimension (a drug, a drug in a role, a reaction, an outcome,
a sex) and every quarter there are bitmaps of the reports that have it, 32,768 reports each.
Any range of quarters is the union of its bitmaps and any combination of conditions their
union or intersection; counting the bits gives the exact number of reports, without a look at
the rows.

Numbers are dealt quarter after quarter, so the reports of a quarter share few bitmaps, and
do not change when quarters are added. Built-in functions throughout: bitmaps are made and
united by aggregates that combine on the map side.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetide.functions.clean import nonempty
from casetide.runtime import materialize
from casetide.sources import snapshots
from casetide.sources.snapshots import Snapshot

NUMBERS, BITMAPS = "report_numbers", "report_bitmaps"
#: Reports that are numbered at once by one task.
CHUNK = 200_000
#: Between the parts of a value of several columns.
SEPARATOR = "\x1f"

_LAYOUTS = {
    NUMBERS: "report_id long, number long, quarter string",
    BITMAPS: "value string, bucket long, bits binary, dimension string, quarter string",
}

Tables = Mapping[str, DataFrame]


def stored(spark: SparkSession, held: Snapshot, name: str, quarters: Iterable[str] | None = None) -> DataFrame:
    return held.read(spark, name, T.StructType.fromDDL(_LAYOUTS[name]), quarters)


def dimensions(t: Tables) -> dict[str, DataFrame]:
    """``report_id``, ``quarter`` and ``value`` of each dimension, as the rows have them."""
    drug = t["drug"].filter(nonempty(F.col("drugname_clean")))
    value = {
        "drug": (drug, F.col("drugname_clean")),
        "drug_role": (drug, F.concat_ws(SEPARATOR, "drugname_clean", F.coalesce("role_cod", F.lit("")))),
        "role": (t["drug"], F.col("role_cod")),
        "reaction": (t["reac"], F.col("pt_clean")),
        "outcome": (t["outc"], F.col("outc_cod")),
        "sex": (t["demo"], F.col("sex")),
    }
    return {name: df.select("report_id", "quarter", v.alias("value")).filter("value IS NOT NULL") for name, (df, v) in value.items()}


def numbered(reports: DataFrame, first: int = 1, chunk: int = CHUNK) -> DataFrame:
    """``report_id`` and ``number``: from ``first`` on without gaps, quarter after quarter.

    Reports (with their ``quarter``) fall into chunks by hash, each numbered for itself; the
    chunks' sizes, a small table, tell where each begins.
    """
    sizes = reports.groupBy("quarter").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    placed = reports.join(sizes, "quarter").withColumn("chunk", F.pmod(F.xxhash64("report_id"), "chunks"))
    placed = materialize(placed.select("report_id", "quarter", "chunk"), "chunks")
    counts = placed.groupBy("quarter", "chunk").count()
    before = F.sum("count").over(Window.orderBy("quarter", "chunk")) - F.col("count")
    starts = counts.select("quarter", "chunk", before.alias("start"))
    own = F.row_number().over(Window.partitionBy("quarter", "chunk").orderBy("report_id"))
    found = placed.withColumn("own", own).join(starts, ["quarter", "chunk"])
    return found.select("report_id", (F.col("start") + F.col("own") - 1 + first).alias("number"))


def _bits(rows: DataFrame, numbers: DataFrame, dimension: str) -> DataFrame:
    place = F.col("number")
    known = rows.distinct().join(numbers, "report_id")
    made = known.groupBy("value", "quarter", F.bitmap_bucket_number(place).alias("bucket"))
    return made.agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).withColumn("dimension", F.lit(dimension))


def update(spark: SparkSession, t: Tables, root: str) -> None:
    """Number the reports that have no number yet and add the bitmaps of their rows.

    The first time that is all of them; later only quarters with a row of a new report are
    written again. Numbers and bitmaps become visible together (``snapshots``), so a run that
    breaks off leaves no bit of a report without a number. Rows of reports with a number are
    taken to be known; after a correction of those build the bitmaps anew, in another folder.
    """
    held, load = snapshots.current(spark, root), snapshots.new_load()
    known = stored(spark, held, NUMBERS)
    reports = t["demo"].select("report_id", "quarter").join(known, "report_id", "left_anti")
    first = (known.agg(F.max("number")).first()[0] or 0) + 1
    numbers = materialize(numbered(reports, first), "new-numbers")
    every = [_bits(rows, numbers, name) for name, rows in dimensions(t).items()]
    fresh = {
        NUMBERS: numbers.join(reports, "report_id").select("report_id", "number", "quarter"),
        BITMAPS: materialize(reduce(DataFrame.unionByName, every), "new-bitmaps"),
    }
    replaced = {}
    for name, rows in fresh.items():
        replaced[name] = {r.quarter for r in rows.select("quarter").distinct().collect()}
        rows = rows.unionByName(stored(spark, held, name, replaced[name]))
        further = ["dimension"] if name == BITMAPS else []
        path = snapshots.load_path(held.root, name, load)
        rows.hint("rebalance", "quarter", *further).write.partitionBy("quarter", *further).parquet(path)
    snapshots.publish(spark, held, load, replaced, {})


class Bitmaps:
    """The stored bitmaps, for a set of quarters (None: all)."""

    def __init__(self, spark: SparkSession, root: str, quarters: Iterable[str] | None = None):
        self.rows = stored(spark, snapshots.current(spark, root), BITMAPS, quarters)

    def by_value(self, dimension: str) -> DataFrame:
        """``value`` and ``reports``: distinct reports of each value of a dimension."""
        united = self._of(dimension).groupBy("value", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        return united.groupBy("value").agg(F.sum(F.bitmap_count("bits")).alias("reports"))

    def having(self, dimension: str, *values: str) -> DataFrame:
        """Reports with any of the values, as bitmaps ``bucket``, ``bits``."""
        chosen = self._of(dimension).filter(F.col("value").isin(*values))
        return chosen.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def _of(self, dimension: str) -> DataFrame:
        return self.rows.filter(F.col("dimension") == dimension)


def any_of(*sets: DataFrame) -> DataFrame:
    """Reports in any of the sets."""
    return reduce(DataFrame.unionByName, sets).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def all_of(*sets: DataFrame) -> DataFrame:
    """Reports in all of the sets: only buckets that each of them has can hold one."""
    met = reduce(DataFrame.unionByName, sets).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    return met.filter(F.col("n") == len(sets)).select("bucket", "bits")


def reports_in(reports: DataFrame) -> DataFrame:
    """The number of reports in a set, one row."""
    return reports.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("reports"))
