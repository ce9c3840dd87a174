"""Small helpers that the operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casetide.runtime import scratch_path


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1_000


def shipped(spark: SparkSession) -> SparkSession:
    """Send this library to the executors, once per session, so that tasks can import it.

    Needed where it is not installed there and was not named in ``--py-files``. Texts are long,
    and a task holds a batch of rows as a whole on both sides; where the session leaves the
    batch size as it is, it becomes ``BATCH_ROWS``.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    context, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    name = f"casetide-{context.applicationId}.zip"
    if not any(path.endswith(name) for path in context.listFiles):
        made = os.path.join(tempfile.mkdtemp(prefix="ship-"), name)
        with zipfile.ZipFile(made, "w") as bundle:
            for source in sorted((root / "casetide").rglob("*.py")):
                bundle.write(source, source.relative_to(root))
        context.addPyFile(made)
    return spark


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Like ``materialize``, for a table that goes when it is no longer needed: also its folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def crc32_of_id(key: str) -> Column:
    """CRC-32 of an integer key written as text; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def parts_for(rows: int, rows_per_part: int) -> int:
    return max(1, -(-rows // rows_per_part))
