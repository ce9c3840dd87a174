"""Session helpers: a test session and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_root: str | None = None
_folder: ContextVar[str | None] = ContextVar("scratch folder", default=None)


def local_session(cpus: int | str = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("casetide")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        # The JVM does not compile larger methods; Spark then splits the work differently.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh folder for a table that one job writes and reads again.

    It lies in the shared folder the cluster names in ``spark.checkpoint.dir``, or in the
    caller's own folder within ``scratch_folder``. Only a local session that names none
    gets a folder of this machine.
    """
    global _local_root
    root = _folder.get() or spark.conf.get(CHECKPOINT_KEY, None) or _local_root
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        root = _local_root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch_folder(path: str) -> Iterator[str]:
    """Within it all scratch tables lie in ``path``, for the caller to remove with ``remove``."""
    before = _folder.set(path)
    try:
        yield path
    finally:
        _folder.reset(before)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if there is a file or folder, on whatever file system; a failure to look is an error."""
    system, place = _place(spark, path)
    return system.exists(place)


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, on whatever file system; none if there is no such folder."""
    system, place = _place(spark, path)
    return [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, on whatever file system."""
    system, place = _place(spark, path)
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    system, place = _place(spark, path)
    stream = system.create(place, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file unless there is one of the new name already; False if there is."""
    system, place = _place(spark, target)
    return not system.exists(place) and system.rename(_place(spark, source)[1], place)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder on whatever file system it lies."""
    system, place = _place(spark, path)
    system.delete(place, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Store an intermediate table in the scratch folder and go on from there.

    For results that a plan needs several times. The table outlives any executor.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_released = 0.0


def release(spark: SparkSession, every: float = 10.0) -> None:
    """Let Spark remove the shuffle files of jobs that are done.

    It does so when the driver collects its garbage, which a driver with little to do hardly
    ever does; until then the files of all jobs add up. Nothing is done within some seconds of
    the last time, so that short jobs are not held up.
    """
    global _released
    if time.monotonic() - _released >= every:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released = time.monotonic()


def together(jobs: Iterable[Callable[[], None]], at_once: int = 4) -> None:
    """Run independent Spark jobs side by side, so that one's last tasks leave no core idle.

    The first failure is raised after the others have ended.
    """
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        for future in [pool.submit(copy_context().run, job) for job in jobs]:
            future.result()
