"""The cleaned tables at rest: Parquet by quarter, in versions that change as a whole.

A load writes all its quarters of all seven tables to folders of its own and then publishes
one version of the store (``snapshots``). Readers take a version, so none sees a quarter half
replaced, and a load that breaks off changes nothing.

Children are partitioned by where their report is: in the same quarter, in another, or
nowhere. Those without one wait beside the table instead of being lost, and reading a table
prunes them. When reports come, go or move to another quarter, only children that wait or
are apart from their report are looked at again, and those of quarters that reports left.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Iterable, Mapping
from datetime import UTC, datetime
from functools import partial, reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetide import schemas as S
from casetide.operators.cases import dedup_versions, newest_quarter
from casetide.operators.cleaning import LOST, clean_table, lossy_columns
from casetide.plans.skew import HOT_REPORTS, ROWS, ROWS_PER_TASK, SIDE, hot_keys
from casetide.runtime import materialize, path_exists, release, together
from casetide.sources import raw, snapshots
from casetide.sources.snapshots import Snapshot

MAX_ROWS_PER_FILE = 20_000_000
# What a Spark job can fail with; anything else is a fault of the program.
_FAILURES = (PySparkException, Py4JJavaError)
# Partition of a child table: where the report of its rows is stored.
HAS_PARENT = "has_parent"
WAITING, AT_HOME, APART = 0, 1, 2
CHILDREN = tuple(name for name in S.TABLES if name != "demo")
#: Notes of a version: a line per quarter, and what cleaning made null in it.
LOADED, LOSSES = "quarters", "losses"
_HOT_LAYOUT = f"report_id long, {SIDE} string, {ROWS} double, quarter string"
#: Children that are written side by side: each needs disk for two shuffles of its rows.
CHILDREN_AT_ONCE = 2
#: Share of a task's rows from which on a report's rows of one quarter are noted.
_NOTED = 8


def clean_all(raw_tables: Mapping[str, DataFrame], quarter: str | None = None) -> dict[str, DataFrame]:
    """Clean every raw table that is present and keep one version of each case."""
    tables = {name: clean_table(df, name, quarter) for name, df in raw_tables.items()}
    if "demo" in tables:
        tables["demo"] = dedup_versions(tables["demo"])
    return tables


def _write(df: DataFrame, path: str, *further: str) -> None:
    """Overwrite only the quarters (and ``further`` partitions) that ``df`` contains.

    The rebalance brings a quarter's rows together and lets the adaptive planner cut
    a large quarter into several files and merge small ones, by their real size.
    """
    (
        df.hint("rebalance", F.col("quarter"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
        .option("compression", "snappy")
        .partitionBy("quarter", *further)
        .parquet(path)
    )


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def _layout(table: str) -> T.StructType:
    layout = S.CLEAN[table]
    return layout if table == "demo" else T.StructType([*layout.fields, T.StructField(HAS_PARENT, T.IntegerType())])


def read_version(spark: SparkSession, held: Snapshot, table: str, quarters: Iterable[str] | None = None) -> DataFrame:
    """A table of one version under its fixed layout, whole or some of its quarters."""
    rows = held.read(spark, table, _layout(table), quarters)
    if table != "demo":
        rows = rows.filter(F.col(HAS_PARENT) > WAITING)
    return rows.select(*S.CLEAN[table].names)


def read_table(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A stored table under its fixed layout; empty if nothing was stored yet."""
    return read_version(spark, snapshots.current(spark, root, version), table)


def waiting_rows(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows of a child table whose report is not stored."""
    rows = snapshots.current(spark, root).read(spark, table, _layout(table))
    return rows.filter(F.col(HAS_PARENT) == WAITING).select(*S.CLEAN[table].names)


def stored_tables(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of one version by name, with the list of large reports that joins go by."""
    held = snapshots.current(spark, root, version)
    tables = {n: read_version(spark, held, n) for n in S.TABLES}
    hot = held.read(spark, HOT_REPORTS, T.StructType.fromDDL(_HOT_LAYOUT))
    if held.parts.get(HOT_REPORTS):
        hot = hot.groupBy("report_id", SIDE).agg(F.sum(ROWS).alias(ROWS)).filter(F.col(ROWS) > ROWS_PER_TASK)
    tables[HOT_REPORTS] = hot.select("report_id", SIDE, ROWS)
    return tables


def skip_loaded_quarters(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of quarters that are not among those of ``stored``.

    There are four quarters a year, so the list of stored ones is small whatever
    the number of rows; the planner broadcasts it by its size.
    """
    return incoming.join(stored.select("quarter").distinct(), "quarter", "left_anti").select(*incoming.columns)


def stored_metadata(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A line per quarter that was loaded: when, from where, how long it took, and its rows."""
    held = snapshots.current(spark, root, version).notes.get(LOADED, {})
    names = ("demo", "drug", "reac", "outc")
    lines = [
        (q, datetime.fromisoformat(n["loaded_at"]), *(n["rows"].get(t, 0) for t in names), sum(n["rows"].values()), n["load_seconds"], n["source"])
        for q, n in sorted(held.items())
    ]
    counts = ", ".join(f"{t}_rows long" for t in names)
    return spark.createDataFrame(lines, f"quarter string, loaded_at timestamp, {counts}, total_rows long, load_seconds double, data_source_url string")


def losses(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """How many values of a text column cleaning could not read, by quarter, of those loaded from raw files."""
    held = snapshots.current(spark, root, version).notes.get(LOSSES, {})
    lines = [(q, t, c, n) for q, tables in sorted(held.items()) for t, counts in sorted(tables.items()) for c, n in sorted(counts.items())]
    return spark.createDataFrame(lines, "quarter string, table string, column string, nulled long")


def _ids(df: DataFrame) -> DataFrame:
    return df.select("report_id", F.col("quarter").alias("home"))


def _loss_counts(name: str, measured: DataFrame, quarters: Iterable[str]) -> dict[str, dict[str, int]]:
    """By quarter and column: values that cleaning made null, from the bits of ``LOST``.

    ``measured`` is a written table, of which only that column is read, where it is not 0. (One
    observed count for each quarter and column would be updated for every row that is written.)
    """
    columns = lossy_columns(name)
    bits = [F.count_if(F.col(LOST).bitwiseAND(1 << i) > 0).alias(c) for i, c in enumerate(columns)]
    found = {r.quarter: r for r in measured.filter(F.col(LOST) > 0).groupBy("quarter").agg(*bits).collect()} if columns else {}
    return {q: {c: found[q][c] if q in found else 0 for c in columns} for q in quarters}


class _Load:
    """One load on its way from cleaned tables to a published version.

    ``quarters`` are replaced in all tables, whatever the given tables have for them. If they
    are not known beforehand they must not be stored yet.
    """

    def __init__(self, spark: SparkSession, root: str, quarters: Iterable[str] | None, source: str | None = None):
        self.spark, self.source, self.began = spark, source, time.time()
        self.base, self.load = snapshots.current(spark, root), snapshots.new_load()
        self.root = self.base.root
        self.quarters = set(quarters or ())
        self.others = self.base.quarters("demo") - self.quarters
        self.moved: set[str] = set()
        self.rows: dict[str, dict[str, int]] = defaultdict(dict)
        self.lost: dict[str, Mapping[str, Mapping[str, int]]] = {}

    def path(self, table: str) -> str:
        return snapshots.load_path(self.root, table, self.load)

    def written(self, table: str, quarters: Iterable[str] | None = None, marks: bool = False) -> DataFrame:
        """What this load has written of a table so far, also with the marks of losses."""
        found = snapshots.written_quarters(self.spark, self.root, table, self.load)
        found &= found if quarters is None else set(quarters)
        layout = T.StructType([*_layout(table).fields, *([T.StructField(LOST, T.IntegerType())] if marks else [])])
        return Snapshot(self.root, 0, {table: dict.fromkeys(found, self.load)}).read(self.spark, table, layout)

    def run(self, tables: Mapping[str, DataFrame]) -> Snapshot:
        self.write_reports(tables.get("demo"))
        release(self.spark)
        together([partial(self.write_children, n, tables.get(n)) for n in CHILDREN], CHILDREN_AT_ONCE)
        self.write_hot_reports()
        return self.publish()

    def write_reports(self, demo: DataFrame | None) -> None:
        """Reports, each in its newest quarter; stored ones that a newer quarter has move there."""
        new = newest_quarter(demo) if demo is not None else self.spark.createDataFrame([], S.CLEAN["demo"])
        self.came = None
        if self.others:
            stored = read_version(self.spark, self.base, "demo", self.others)
            new = materialize(new.join(_ids(stored), "report_id", "left"), "reports")
            new = new.filter("home IS NULL OR home < quarter")
            self.came = new.select("report_id")
            earlier = new.filter("home IS NOT NULL")
            self.moved = {r.home for r in earlier.select("home").distinct().collect()}
            new = new.drop("home")
            if self.moved:
                rest = stored.filter(F.col("quarter").isin(*self.moved))
                new = new.unionByName(rest.join(earlier.select("report_id"), "report_id", "left_anti"))
        _write(new, self.path("demo"))
        demo = self.written("demo")
        # No column is read for it.
        self.rows["demo"] = {r.quarter: r["count"] for r in demo.groupBy("quarter").count().collect()}
        self.quarters |= set(self.rows["demo"]) - self.moved
        self.known = _ids(demo)
        if self.others - self.moved:
            self.known = self.known.union(_ids(read_version(self.spark, self.base, "demo", self.others - self.moved)))
        self.changed = self.came
        if self.others:
            before = read_version(self.spark, self.base, "demo", self.quarters).select("report_id")
            self.changed = self.came.union(before.join(self.known, "report_id", "left_anti")).distinct()

    def flagged(self, child: DataFrame) -> DataFrame:
        """``child`` with ``has_parent``. One-sided, so the adaptive planner cuts a large report."""
        where = F.when(F.col("home").isNull(), WAITING).when(F.col("home") == F.col("quarter"), AT_HOME).otherwise(APART)
        return child.join(self.known, "report_id", "left").select(*child.columns, where.alias(HAS_PARENT))

    def to_settle(self, name: str) -> set[str]:
        """Other quarters with children whose report came, went or moved."""
        others = self.base.quarters(name) - self.quarters
        if not others or self.changed is None:
            return set()
        apart = self.base.read(self.spark, name, _layout(name), others).filter(F.col(HAS_PARENT) != AT_HOME)
        found = apart.join(self.changed, "report_id", "left_semi").select("quarter").distinct()
        return {r.quarter for r in found.collect()} | (others & self.moved)

    def write_children(self, name: str, rows: DataFrame | None) -> None:
        again = self.to_settle(name)
        columns = list(S.CLEAN[name].names)
        measured = rows is not None and LOST in rows.columns
        if again:
            settled = self.base.read(self.spark, name, _layout(name), again).select(*columns)
            if measured:
                settled = settled.withColumn(LOST, F.lit(0))
            rows = settled if rows is None else rows.unionByName(settled)
        if rows is None:
            return
        quarters = sorted(self.quarters)
        expected = {*quarters, *again}
        # The marks of losses stay in the files, beside the table's layout.
        _write(self.flagged(rows.select(*columns, *([LOST] if measured else []))), self.path(name), HAS_PARENT)
        release(self.spark)
        # By partitions, so only the files' footers are read.
        sizes = self.written(name).groupBy("quarter", HAS_PARENT).count().collect()
        if any(r.quarter not in expected for r in sizes if r.quarter is not None):
            # Children of quarters without any report; they wait.
            self.quarters |= snapshots.written_quarters(self.spark, self.root, name, self.load) - expected
        self.rows[name] = dict.fromkeys(sorted(expected), 0)
        for r in sizes:
            if r.quarter in expected and r[HAS_PARENT] > WAITING:
                self.rows[name][r.quarter] += r["count"]
        self.lost[name] = _loss_counts(name, self.written(name, quarters, marks=True), quarters) if measured else {}

    def write_hot_reports(self) -> None:
        """Note reports with many rows in one quarter, from the key columns of what was just stored."""
        keyed = {n: self.written(n) for n in ("drug", "reac", "outc")}
        keyed = {n: df.filter(F.col(HAS_PARENT) > WAITING) for n, df in keyed.items()}
        hot = hot_keys(keyed, ["report_id", "quarter"], ROWS_PER_TASK // _NOTED)
        hot.coalesce(1).write.partitionBy("quarter").parquet(self.path(HOT_REPORTS))

    def publish(self) -> Snapshot:
        seconds = round(time.time() - self.began, 3)
        lines, ledger = (dict(self.base.notes.get(n, {})) for n in (LOADED, LOSSES))
        for quarter in self.quarters:
            lines[quarter] = {"loaded_at": datetime.now(UTC).isoformat(), "load_seconds": seconds, "source": self.source, "rows": {}}
            lost = {n: dict(found[quarter]) for n, found in self.lost.items() if quarter in found}
            ledger.pop(quarter, None)
            if lost:
                ledger[quarter] = lost
        for name, counts in self.rows.items():
            for quarter, n in counts.items():
                if quarter in lines:
                    lines[quarter] = {**lines[quarter], "rows": {**lines[quarter]["rows"], name: n}}
        replaced = {n: self.quarters | snapshots.written_quarters(self.spark, self.root, n, self.load) | (self.moved if n == "demo" else set()) for n in (*S.TABLES, HOT_REPORTS)}
        return snapshots.publish(self.spark, self.base, self.load, replaced, {LOADED: lines, LOSSES: ledger})


def _quarters_of(tables: Mapping[str, DataFrame]) -> list[str]:
    every = reduce(DataFrame.union, [df.select("quarter").distinct() for df in tables.values()])
    return sorted(r.quarter for r in every.distinct().collect())


def write_quarter(
    tables: Mapping[str, DataFrame], root: str, force: bool = False
) -> dict[str, DataFrame]:
    """Store cleaned tables by quarters, reports first, then the children side by side.

    Quarters that are stored already are skipped, or replaced with ``force``. A replaced
    quarter loses, in all seven tables, what the given tables do not have for it. A report
    that is in several quarters stays in the newest one. All becomes visible at once. Gives
    the stored tables.
    """
    spark = tables["demo"].sparkSession
    if force:
        given = {**tables, "demo": materialize(tables["demo"], "reports")}
        _Load(spark, root, _quarters_of(given)).run(given)
    else:
        stored = _loaded(spark, root)
        given = dict(tables)
        if stored:
            given = {n: skip_loaded_quarters(df, _named(spark, stored)) for n, df in tables.items()}
        _Load(spark, root, None).run(given)
    return {n: read_table(spark, root, n) for n in S.TABLES if n in tables}


def _loaded(spark: SparkSession, root: str) -> list[str]:
    """Quarters whose load is part of the current version."""
    return sorted(snapshots.current(spark, root).notes.get(LOADED, {}))


def _named(spark: SparkSession, quarters: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(q,) for q in quarters], "quarter string")


def load_quarters(
    spark: SparkSession,
    raw_root: str,
    store_root: str,
    quarters: Iterable[str] | None = None,
    force: bool = False,
) -> DataFrame:
    """Load quarters from the raw files below a folder: all seven tables, reports first.

    Quarters that were loaded already are skipped, or replaced with ``force``. All are read
    together, each file once, and become visible at once; if that fails, they are loaded one
    by one, so that a damaged quarter does not stop the rest. Nothing of a quarter that fails
    is visible. A report in several quarters stays in the newest.

    Returns a row per quarter: ``quarter``, ``status`` (loaded, skipped or failed) and
    ``error``.
    """
    files = raw.discover_tables(spark, raw_root).filter("length > 0 AND quarter <> ''")
    paths = defaultdict(lambda: defaultdict(list))
    for row in files.select("table", "quarter", "path").collect():
        paths[row.quarter][row.table].append(row.path)
    wanted = sorted(set(paths) if quarters is None else {q.lower() for q in quarters})
    done = set() if force else set(_loaded(spark, store_root))
    todo = [q for q in wanted if q not in done]

    def load(some: list[str]) -> None:
        into = _Load(spark, store_root, some, raw_root)
        tables = {}
        for name in S.TABLES:
            found = [p for q in some for p in paths[q][name]]
            if found:
                tables[name] = clean_table(raw.read_table(spark, *found), name, losses=True)
        if "demo" in tables:
            # Stored first: picking the newest versions reads it more than once.
            cleaned = materialize(tables["demo"], "cleaned")
            into.lost["demo"] = _loss_counts("demo", cleaned, some)
            tables["demo"] = dedup_versions(cleaned.drop(LOST))
        into.run(tables)

    failed: dict[str, str] = {}
    try:
        if todo:
            load(todo)
    except _FAILURES as whole:
        for quarter in todo:
            try:
                if len(todo) == 1:
                    raise whole
                load([quarter])
            except _FAILURES as error:
                said = error.java_exception.getMessage() if isinstance(error, Py4JJavaError) else str(error)
                failed[quarter] = " ".join(str(said).split())[:500]
    rows = [(q, "failed" if q in failed else "skipped" if q in done else "loaded", failed.get(q)) for q in wanted]
    return spark.createDataFrame(rows, "quarter string, status string, error string")


def reload_quarter(
    tables: Mapping[str, DataFrame], root: str, quarter: str
) -> dict[str, DataFrame]:
    """Replace one quarter in all seven tables; a table that is not given has no rows for it."""
    spark = tables["demo"].sparkSession
    only = {n: df.filter(F.col("quarter") == quarter) for n, df in tables.items()}
    _Load(spark, root, [quarter]).run(only)
    return {n: read_table(spark, root, n) for n in S.TABLES if n in tables}


def export_parquet(
    tables: Mapping[str, DataFrame], root: str, overwrite: bool = False
) -> list[str]:
    """Write the slim column subset of each table for analysis; stored quarters are skipped."""
    written = []
    for name, columns in S.EXPORT_COLUMNS.items():
        if name not in tables:
            continue
        path, df = table_path(root, name), tables[name].select(*columns)
        if not overwrite and path_exists(df.sparkSession, path):
            df = skip_loaded_quarters(df, materialize(loaded_quarters(df.sparkSession.read.parquet(path)), "exported"))
        _write(df, path)
        written.append(name)
    return written


def bucket_tables(
    tables: Mapping[str, DataFrame], root: str, buckets: int, prefix: str = ""
) -> dict[str, DataFrame]:
    """Save the tables in buckets of ``report_id``, for repeated joins on it.

    With the same number of buckets everywhere, drugs, reactions, outcomes and reports
    meet without a shuffle of any of them. Worth it before all views are refreshed or
    many analyses are run. Choose buckets so that one fits a task.
    """

    def save(name: str) -> None:
        spread = tables[name].repartition(buckets, "report_id")
        (
            spread.write.mode("overwrite")
            .bucketBy(buckets, "report_id")
            .sortBy("report_id")
            .option("path", f"{table_path(root, name)}_by_report")
            .saveAsTable(f"{prefix}{name}")
        )

    together([partial(save, name) for name in tables])
    return {name: df.sparkSession.table(f"{prefix}{name}") for name, df in tables.items()}


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the data files of a table partitioned by quarter; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.filter(F.contains("path", F.lit("/quarter=")))


def read_parquet_views(spark: SparkSession, root: str, prefix: str = "") -> list[str]:
    """Register every stored table below ``root`` as a temporary view.

    Tables that are absent, or were never given a row, are left out.
    """
    names = []
    held = snapshots.current(spark, root) if snapshots.is_store(spark, root) else None
    for table in S.TABLES:
        path = table_path(root, table)
        if held:
            rows = read_version(spark, held, table) if held.parts.get(table) else None
        else:
            rows = spark.read.parquet(path) if path_exists(spark, path) and not _files(spark, path).isEmpty() else None
        if rows is not None:
            rows.createOrReplaceTempView(f"{prefix}{table}")
            names.append(f"{prefix}{table}")
    return names


def loaded_quarters(demo: DataFrame) -> DataFrame:
    return demo.select("quarter").distinct().orderBy("quarter")


def load_metadata(
    tables: Mapping[str, DataFrame],
    load_seconds: Column | None = None,
    source_url: Column | None = None,
) -> DataFrame:
    """Rows per table and quarter, one line per quarter.

    Every table is counted in its own scan, so only a few numbers per quarter are
    ever moved.
    """
    counted = [
        tables[name].groupBy("quarter").agg(F.count("*").alias("n")).withColumn("t", F.lit(name))
        for name in S.TABLES
        if name in tables
    ]
    rows = reduce(lambda a, b: a.unionByName(b), counted)
    main = ("demo", "drug", "reac", "outc")
    return rows.groupBy("quarter").agg(
        F.current_timestamp().alias("loaded_at"),
        *[
            F.coalesce(F.sum(F.when(F.col("t") == name, F.col("n"))), F.lit(0)).alias(
                f"{name}_rows"
            )
            for name in main
        ],
        F.sum("n").alias("total_rows"),
        F.first(load_seconds if load_seconds is not None else F.lit(None).cast("double")).alias(
            "load_seconds"
        ),
        F.first(source_url if source_url is not None else F.lit(None).cast("string")).alias(
            "data_source_url"
        ),
    )
