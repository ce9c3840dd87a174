"""Shards from a hierarchical weighted hash tree.

A key descends from the root through regions and racks to a shard. At each level every child
draws a number from a hash of the key and the child's name, scaled by the child's weight,
and the smallest draw wins. A draw depends on the key, the child and its weight alone, so a
key moves only if a weight changes beside its path: into a child whose weight rose, or out of
one whose weight fell. A new shard in a region of its own therefore takes rows into itself
only, and a changed weight inside a rack moves rows in that rack's ancestors only.

All of it is built from SQL expressions; nothing is collected and no Python code runs on rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetide.runtime import materialize

LAW = "key"
#: Rows of one numbering chunk, about.
CHUNK_ROWS = 100_000


@dataclass(frozen=True)
class Node:
    """A region or rack with children, or a shard, which has a number and a weight."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    weight: float = 1.0

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight

    @property
    def shards(self) -> list[int]:
        return [s for c in self.children for s in c.shards] if self.children else [self.shard]


def even_tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2) -> Node:
    """Shards of weight 1, filled rack by rack and region by region."""
    leaves = [Node(f"s{i}", shard=i) for i in range(shards)]
    racks = _grouped(leaves, shards_per_rack, "k")
    return Node("root", _grouped(racks, racks_per_region, "r"))


def _grouped(nodes: Sequence[Node], size: int, prefix: str) -> tuple[Node, ...]:
    return tuple(Node(f"{prefix}{i // size}", tuple(nodes[i : i + size])) for i in range(0, len(nodes), size))


def grown(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a rack and a region of its own."""
    n = max(tree.shards) + 1
    leaf = Node(f"s{n}", shard=n, weight=weight)
    return replace(tree, children=(*tree.children, Node(f"new-r{n}", (Node(f"new-k{n}", (leaf,)),))))


def draw(key: Column, node: Node) -> Column:
    """Exponential draw with the node's weight as its rate; the smallest of a level wins."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(node.name), key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(uniform) / F.lit(float(node.total))


def shard_of(key: Column, tree: Node) -> Column:
    """Shard number of a key. A null key is a key like any other."""
    children = [c for c in tree.children if c.total > 0]
    if not tree.children:
        return F.lit(tree.shard)
    if len(children) == 1:
        return shard_of(key, children[0])
    won = F.array_min(F.array(*(F.struct(draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(children))))["i"]
    # One CASE per level: the draws of a child's own children are only made where it won.
    out = F.when(won == 0, shard_of(key, children[0]))
    for i, child in enumerate(children[1:], 1):
        out = out.when(won == i, shard_of(key, child))
    return out


def numbered(rows: DataFrame, by: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``rows`` with ``slot``: the rows of each value of ``by`` numbered from 0 without gaps.

    Equal rows are counted first and unfolded last, so a row that repeats very often is no
    large group. Numbers follow a hash of the row, in chunks: each chunk is numbered for
    itself, and the chunks' totals, a small table, give where it starts.
    """
    counted = materialize(rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")), "counted")
    total = counted.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    chunks = max(1, -(-total // chunk_rows))
    own = F.xxhash64(*rows.columns)
    # Chunks of equal hash ranges; the hash orders the rows within one, then the row itself.
    placed = counted.withColumn("_h", own).withColumn("_chunk", F.pmod("_h", F.lit(chunks)))
    sizes = placed.groupBy(by, "_chunk").agg(F.sum("_n").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(by).orderBy("_chunk")) - F.col("_size")
    starts = sizes.select(F.col(by).alias("_by"), F.col("_chunk").alias("_at"), before.alias("_first"))
    inner = Window.partitionBy(by, "_chunk").orderBy("_h", *rows.columns)
    within = placed.withColumn("_before", F.sum("_n").over(inner) - F.col("_n"))
    joined = within.join(starts, within[by].eqNullSafe(starts["_by"]) & (within["_chunk"] == starts["_at"]))
    first = F.col("_first") + F.col("_before")
    return joined.select(*rows.columns, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias("slot"))


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, tree: Node | None = None) -> DataFrame:
    """Shard and slot of every document, and its shard after one more was added.

    Columns ``doc_id``, ``size`` (bytes plus one; a null text has none), ``text_crc32`` (a
    null text counts as empty), ``law``, ``shard``, ``slot`` and ``grown_shard``. The law is
    ``key``: only the id and the shards decide, so rows with equal ids, or with a null id,
    share a shard. Repeated rows each get a slot. An empty table gives no rows.
    """
    tree = tree or even_tree(shards)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumns(
        {
            "law": F.lit(LAW),
            "shard": shard_of(F.col("doc_id"), tree),
            "grown_shard": shard_of(F.col("doc_id"), grown(tree)),
        }
    )
    return numbered(rows, "shard").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
