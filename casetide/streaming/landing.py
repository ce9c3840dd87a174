"""Landing newly arrived raw files in the cleaned tables.

The stream carries file names only. A batch finds out which quarters have new files and
loads those quarters again, in all tables, from all of their files. A quarter is replaced
as a whole, so neither a repeated batch nor the way files fall into batches changes the
result; children that come before their reports wait for them in the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casetide.sources import raw, store

# Layout of Spark's file source; only the path is read.
FILE_LAYOUT = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def load_touched(spark: SparkSession, raw_root: str, store_root: str, paths: DataFrame) -> None:
    """Load again every quarter that one of ``paths`` belongs to; a failed one is an error."""
    touched = [r.quarter for r in raw.classify(paths).select("quarter").distinct().collect()]
    report = store.load_quarters(spark, raw_root, store_root, [q for q in touched if q], force=True)
    failed = report.filter("status = 'failed'").collect()
    if failed:
        raise RuntimeError("; ".join(f"{r.quarter}: {r.error}" for r in failed))


def land(
    spark: SparkSession, raw_root: str, store_root: str, checkpoint: str
) -> StreamingQuery:
    """Process all files that have arrived since the last run, then stop."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_LAYOUT)
        .option("recursiveFileLookup", True)
        .load(raw_root)
        .select(F.col("path"))
    )

    def process(batch: DataFrame, _: int) -> None:
        load_touched(batch.sparkSession, raw_root, store_root, batch)

    return (
        files.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
