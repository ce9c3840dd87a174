"""Lines that many documents share, found by levelled sorted runs of line hashes.

A run is a table of line hashes with the number of documents that have the line, saved in
buckets of the hash and sorted within them. Documents arrive in batches. Each batch is reduced
to its own line counts, merge-anti-joined with the runs (hashes that a run already shows to
be in enough documents need no more counting), and what is left becomes a run of level 0.
As soon as a level has ``fanout`` runs, they are merged into one run of the next level, so a
batch meets a number of runs that grows with the logarithm of the batches.

Batch and runs share the hash layout, so the anti-join moves no run; a merge moves those it
takes once. A line's hash has 128 bits. All of it is built from SQL functions; nothing is collected and
no Python code runs on rows.
"""

from __future__ import annotations

import uuid
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casetide.runtime import materialize, scratch_path

#: Documents that must have a line, and code points of its key at least.
MIN_DOCS = 10
MIN_CHARS = 1
#: Batches that a whole table is dealt to, and runs of a level that are merged.
BATCHES = 4
FANOUT = 3

_BLANKS = " \t\n\x0b\x0c\r"
HASH = ("h1", "h2")


def _hash(value: Column, *names: str) -> list[Column]:
    """128 bits of a text as two long columns."""
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit(1), value).alias(names[1])]


def line_keys(text: Column) -> Column:
    """The key of each line: white space stripped at both ends, A-Z in lower case."""
    lines = F.split(F.translate(text, ascii_uppercase, ascii_lowercase), "\n", -1)
    return F.transform(lines, lambda line: F.btrim(line, F.lit(_BLANKS)))


class LineRuns:
    """The runs of one index. ``min_docs`` of 1 makes it a plain index of lines seen before."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def new(self, counts: DataFrame) -> DataFrame:
        """Rows of ``counts`` whose hash no run shows to be in enough documents."""
        for run in sum(self.levels, []):
            settled = self.spark.table(run).where(F.col("docs") >= self.min_docs).select(*HASH)
            counts = counts.join(settled, list(HASH), "left_anti")
        return counts

    def add(self, lines: DataFrame) -> None:
        """Add a batch: a row ``h1``, ``h2``, ``docs`` per line and document, or already counted."""
        counts = lines.groupBy(*HASH).agg(F.sum("docs").alias("docs"))
        self.levels[0].append(self._write(self.new(counts)))
        for level, runs in enumerate(self.levels):
            if len(runs) < self.fanout:
                break
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(runs)))
            self._drop(runs)
            self.levels[level] = []

    def common(self) -> DataFrame:
        """Hashes of the lines in ``min_docs`` documents or more."""
        runs = sum(self.levels, [])
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return self._merged(runs).where(F.col("docs") >= self.min_docs).select(*HASH)

    def close(self) -> None:
        self._drop(sum(self.levels, []))
        self.levels = [[]]

    def _merged(self, runs: list[str]) -> DataFrame:
        # Read as plain files: Spark 4.1 takes a union of bucketed tables for bucketed and then
        # groups each table for itself.
        files = self.spark.read.schema("h1 long, h2 long, docs long")
        every = reduce(DataFrame.unionAll, [files.parquet(self.paths[run]) for run in runs])
        return every.groupBy(*HASH).agg(F.sum("docs").alias("docs"))

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex[:12]}"
        path = scratch_path(self.spark, "line-run")
        counts.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).saveAsTable(name)
        self.paths[name] = path
        return name

    def _drop(self, runs: list[str]) -> None:
        """Forget tables; their files are scratch, like every intermediate table."""
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")


def common_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``h1``, ``h2`` of the line keys that at least ``min_docs`` rows of ``docs`` have."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keys = F.filter(F.array_distinct(line_keys(body)), lambda key: F.char_length(key) >= min_chars)
    batch = F.pmod(F.xxhash64(body), F.lit(batches)).cast("int").alias("batch")
    lines = docs.select(batch, F.explode(F.transform(keys, lambda key: F.struct(*_hash(key, *HASH)))).alias("h")).select("batch", "h.*")
    # Counted before the shuffle: a line in very many documents is a row per task.
    counts = lines.groupBy("batch", *HASH).agg(F.count("*").alias("docs"))
    path = scratch_path(docs.sparkSession, "line-counts")
    counts.write.partitionBy("batch").parquet(path)
    counts = docs.sparkSession.read.schema(counts.schema).parquet(path)
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for i in range(batches):
        runs.add(counts.where(F.col("batch") == i).drop("batch"))
    found = materialize(runs.common(), "common-lines")
    runs.close()
    return found


def _without(lines: Column, gone: Column) -> Column:
    """``lines`` without the places ``gone``, which are sorted: what is between them, put together."""

    def between(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(gone, i - 1) + 1)
        return F.slice(lines, start + 1, F.coalesce(F.get(gone, i), F.size(lines)) - start)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), between)), "\n")


def without_common_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, **runs: int) -> DataFrame:
    """``doc_id``, ``text`` without the common lines, ``n_lines`` before and ``n_dropped``.

    A line is common if at least ``min_docs`` documents have its key, and the key has at
    least ``min_chars`` code points. All its places in all documents go. Every row is a
    document, so rows that repeat, or share or lack an id, each count and each stay. A null or
    empty text is one empty line. A text that loses all lines is empty. An empty table gives
    no rows. Other columns, whatever their names, are not read.
    """
    chosen = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    common = common_lines(chosen, "text", min_docs, min_chars, **runs)
    named = chosen.select("*", *_hash(F.col("text"), "t1", "t2"))
    # Equal texts lose the same lines, so the places go by text; each text's list is as long as its lines.
    hashes = F.transform(line_keys(F.col("text")), lambda k: F.struct(*_hash(k, *HASH)))
    places = named.select("t1", "t2", F.posexplode(hashes).alias("at", "h")).select("t1", "t2", "at", "h.*")
    gone = places.join(common, list(HASH), "left_semi").groupBy("t1", "t2").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    joined = named.join(gone, ["t1", "t2"], "left")
    lines = F.split("text", "\n", -1)
    return joined.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(lines, F.col("gone"))).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
