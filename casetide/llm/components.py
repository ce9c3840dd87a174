"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetide.llm.tables import parts_for
from casetide.runtime import materialize


def connected(links: DataFrame, a: str = "a", b: str = "b", rows_per_task: int | None = None) -> DataFrame:
    """The smallest node that each linked node can reach: columns ``node``, ``root``.

    Nodes are integers. Large-star and small-star steps alternate until the links no
    longer change; that takes a number of rounds logarithmic in the component size. Every
    step takes minima with map-side combine and joins them back, so that a node with very
    many links is split by the adaptive planner. Each round is a written table.

    Null ends and links of a node to itself are ignored; repeated links count once. No
    links give no rows: nodes without links are not listed.

    With ``rows_per_task`` a step over few links takes no more tasks than so many links each
    need, however many partitions a shuffle has; with many links it changes nothing.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    edges = materialize(edges.distinct(), "links")
    seen = _mark(edges)
    while True:
        parts = parts_for(seen[0], rows_per_task) if rows_per_task else None
        edges = materialize(_small_star(_large_star(edges, parts), parts), "links")
        if (mark := _mark(edges)) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = mark


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _within(df: DataFrame, parts: int | None) -> DataFrame:
    return df.coalesce(parts) if parts else df


def _large_star(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Every node's larger neighbours go to its smallest neighbour, or to itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    up = _within(edges.join(_within(least, parts).withColumnRenamed("u", "v"), "v"), parts)
    return _within(up.select("u", F.col("m").alias("v")).where("u != v").distinct(), parts)


def _small_star(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Every node's smaller neighbours, and the node, go to the smallest of them."""
    least = _within(edges.groupBy("u").agg(F.min("v").alias("m")), parts)
    rest = _within(edges.join(least, "u"), parts).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _within(rest.union(least.select("u", F.col("m").alias("v"))).distinct(), parts)
