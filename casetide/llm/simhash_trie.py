"""Near-duplicate documents: SimHash fingerprints joined by a binary trie self-join.

Fingerprints are computed document by document, then reduced to distinct ones, so that a
large group of copies is one fingerprint. The 64 bits are cut into ``radius + 1`` blocks.
Two fingerprints within the radius agree on one block at least, so for each block there is
one trie that starts with it, and its subtries below that block are joined one by one. A
subtrie with more than ``NODE_ROWS`` fingerprints is cut further down into nodes; pairs of
nodes that already differ in more bits than the radius are dropped.

Inside a task a trie node is a range of a sorted array. Node pairs are traversed together
from the root; the bits in which their paths differ are added up and a pair is dropped as
soon as they exceed the radius. What is found is passed on as a spanning forest, not as
pairs, so the number of links grows with the fingerprints only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casetide.llm.components import connected
from casetide.llm.tables import parts_for
from casetide.runtime import materialize

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42

#: Fingerprints of one trie node that one task joins with another node.
NODE_ROWS = 20_000
#: Fingerprints, of many small nodes, that one call joins.
CALL_ROWS = 200_000
#: Bits by which a large node is cut further.
STEP = 6
_FRONTIER = 1 << 18
_HASHES = 1 << 16


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """Fingerprint of a text; zero if it has no word.

    Letters A-Z count as lower case, words are separated by ASCII white space. A bit is set
    if over half of the shingle hashes have it. Hashes are taken in blocks, so a very long
    text needs no more memory than its own words.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _HASHES):
        spans = zip(starts[at : at + _HASHES], ends[at : at + _HASHES], strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((ones * 2 > len(starts)) @ (np.uint64(1) << np.arange(BITS, dtype=np.uint64)))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``doc_id`` and ``fp`` (the 64 bits as a signed integer), a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t.as_py()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"]
            )

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, fp long")


def blocks(radius: int) -> list[tuple[int, int]]:
    """First bit and width of the blocks, one more than bits may differ."""
    cuts = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _rotations(prints: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint once per block, with that block's bits in front, and its root node."""
    turned = [
        F.struct(
            F.lit(at).alias("rot"),
            (F.col("fp") if at == 0 else F.shiftleft("fp", at).bitwiseOR(F.shiftrightunsigned("fp", BITS - at))).alias("key"),
            F.lit(width).alias("depth"),
        )
        for at, width in blocks(radius)
    ]
    return prints.select("fp", F.inline(F.array(*turned))).withColumn("root", F.col("depth"))


def _prefix(depth: str) -> F.Column:
    return F.expr(f"CASE WHEN {depth} >= {BITS} THEN key ELSE shiftleft(shiftrightunsigned(key, {BITS} - {depth}), {BITS} - {depth}) END")


def _cut(keys: DataFrame, node_rows: int) -> tuple[DataFrame, bool]:
    """Move fingerprints of large nodes deeper until no node is large."""
    cut = False
    while True:
        at = keys.withColumn("node", _prefix("depth"))
        large = at.groupBy("rot", "depth", "node").count().where(F.col("count") > node_rows)
        large = materialize(large.where(F.col("depth") < BITS).select("rot", "depth", "node", F.lit(True).alias("large")), "large-nodes")
        if large.isEmpty():
            return at, cut
        cut = True
        deeper = F.least(F.col("depth") + STEP, F.lit(BITS))
        keys = at.join(large, ["rot", "depth", "node"], "left").select(
            "fp", "rot", "key", "root", F.when(F.col("large"), deeper).otherwise(F.col("depth")).alias("depth")
        )


def _near_nodes(radius: int):
    """Pairs of nodes below one root whose common path differs in at most ``radius`` bits."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node, depth = pdf["node"].to_numpy().view(np.uint64), pdf["depth"].to_numpy()
        ids, out = pdf["task"].to_numpy(), []
        for i in range(len(node)):
            common = np.minimum(depth[i + 1 :], depth[i]).astype(np.uint64)
            apart = (node[i + 1 :] ^ node[i]) >> (np.uint64(BITS) - common)
            near = np.nonzero(np.bitwise_count(apart) <= radius)[0] + i + 1
            out.append(pd.DataFrame({"x": ids[i], "y": ids[near]}))
        return pd.concat(out) if out else pd.DataFrame({"x": [], "y": []})

    return run


def _tasks(keys: DataFrame, radius: int, cut: bool) -> DataFrame:
    """Rows of every node pair to join: ``task``, ``side`` and the fingerprint."""
    at = keys.withColumn("task", F.xxhash64("rot", "depth", "node"))
    alone = at.select("task", F.lit(0).alias("side"), "key", "fp")
    if not cut:
        return alone
    split = at.where("depth > root")
    nodes = split.withColumn("top", F.expr("shiftrightunsigned(key, 64 - root)"))
    nodes = nodes.select("rot", "top", "depth", "node", "task").distinct()
    pairs = nodes.groupBy("rot", "top").applyInPandas(_near_nodes(radius), "x long, y long")
    sides = [
        split.join(pairs, split["task"] == pairs[c]).select(
            F.xxhash64("x", "y").alias("task"), F.lit(side).alias("side"), "key", "fp"
        )
        for side, c in enumerate("xy")
    ]
    return alone.union(sides[0]).union(sides[1])


class _Forest:
    """Union-find over array positions, for many links at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit of ``counts`` its index and its number within the index."""
    at = np.repeat(np.arange(len(counts)), counts)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)


def trie_join(task: np.ndarray, side: np.ndarray, key: np.ndarray, radius: int, few: int = 64) -> np.ndarray:
    """For each row the first row it is linked to, directly or through others.

    Rows are sorted by task, side and key (unsigned). A task with one side is joined with
    itself, a task with two sides joins one with the other.
    """
    n, forest = len(key), _Forest(len(key))
    new = np.concatenate(([True], (task[1:] != task[:-1]) | (side[1:] != side[:-1])))
    lo = np.nonzero(new)[0]
    hi = np.append(lo[1:], n)
    second = np.append(task[lo][1:] == task[lo][:-1], False)  # its other side follows
    other = np.concatenate(([False], second[:-1]))
    start = [(lo[~second & ~other], hi[~second & ~other])]
    pair = np.nonzero(second)[0]
    a0, a1 = start[0]
    first = (
        np.concatenate((a0, lo[pair])), np.concatenate((a1, hi[pair])),
        np.concatenate((a0, lo[pair + 1])), np.concatenate((a1, hi[pair + 1])),
    )
    stack = [(0, *first, np.zeros(len(first[0]), np.int64))]
    while stack:
        level, alo, ahi, blo, bhi, apart = stack.pop()
        if len(alo) > _FRONTIER:
            half = len(alo) // 2
            stack.append((level, *(x[half:] for x in (alo, ahi, blo, bhi, apart))))
            alo, ahi, blo, bhi, apart = (x[:half] for x in (alo, ahi, blo, bhi, apart))
        size = (ahi - alo) * (bhi - blo)
        leaf = (size <= few) | (level >= BITS)
        for part in np.array_split(np.nonzero(leaf)[0], 1 + int(size[leaf].sum()) // (16 * _FRONTIER)):
            at, k = _spread(size[part])
            width = (bhi - blo)[part][at]
            i, j = alo[part][at] + k // width, blo[part][at] + k % width
            near = (i < j) & (np.bitwise_count(key[i] ^ key[j]) <= radius)
            forest.link(i[near], j[near])
        if leaf.all():
            continue
        alo, ahi, blo, bhi, apart = (x[~leaf] for x in (alo, ahi, blo, bhi, apart))
        # Within a node the rows whose next bit is 0 come first.
        ones = np.concatenate(([0], np.cumsum((key >> np.uint64(BITS - 1 - level)) & np.uint64(1), dtype=np.int64)))
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same = alo == blo
        down = [
            (alo, amid, blo, bmid, apart),
            (amid, ahi, bmid, bhi, apart),
            (alo, amid, bmid, bhi, apart + 1),
            tuple(x[~same] for x in (amid, ahi, blo, bmid, apart + 1)),
        ]
        alo, ahi, blo, bhi, apart = (np.concatenate(x) for x in zip(*down, strict=True))
        alone = (alo == blo) & (ahi - alo < 2)
        keep = (ahi > alo) & (bhi > blo) & (apart <= radius) & ~alone
        stack.append((level + 1, *(x[keep] for x in (alo, ahi, blo, bhi, apart))))
    return forest.root


def _join_call(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["key"].to_numpy().view(np.uint64)
        task, side, fp = (pdf[c].to_numpy() for c in ("task", "side", "fp"))
        order = np.lexsort((key, side, task))
        root = trie_join(task[order], side[order], key[order], radius)
        linked = root != np.arange(len(root))
        fp = fp[order]
        return pd.DataFrame({"a": fp[linked], "b": fp[root[linked]]})

    return run


def links(prints: DataFrame, radius: int = RADIUS, node_rows: int = NODE_ROWS, call_rows: int = CALL_ROWS) -> DataFrame:
    """A spanning forest, within each call, of the links between distinct fingerprints ``fp``."""
    keys, cut = _cut(_rotations(prints, radius), node_rows)
    tasks = _tasks(keys, radius, cut)
    if cut:
        tasks = materialize(tasks, "trie-tasks")
        rows = tasks.count()
    else:
        rows = prints.count() * (radius + 1)
    call = F.pmod(F.xxhash64("task"), F.lit(parts_for(rows, call_rows)))
    return tasks.groupBy(call.alias("call")).applyInPandas(_join_call(radius), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    radius: int = RADIUS,
    node_rows: int = NODE_ROWS,
    call_rows: int = CALL_ROWS,
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every document.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; the component
    is the smallest ``doc_id`` that can be reached. A null or wordless text has fingerprint
    zero and is linked like any other. A row without ``doc_id`` gets its group's component,
    which is null if no row of the group has an id. Repeated rows stay. An empty table gives
    an empty result. Other columns, whatever their names, are not read.
    """
    prints = materialize(fingerprints(docs, key, text), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = connected(links(distinct.select("fp"), radius, node_rows, call_rows))
    grouped = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def first_of_groups(docs: DataFrame, groups: DataFrame, key: str, text: str) -> DataFrame:
    """The documents that ``groups`` (``doc_id``, ``component_id``) names as their group's smallest."""
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    first, nth = F.row_number().over(Window.partitionBy(key).orderBy(text)), f"_nth_{uuid.uuid4().hex}"
    named = docs.join(kept, key, "left_semi").withColumn(nth, first).where(F.col(nth) == 1)
    return named.select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """The documents with one row of each near-duplicate group: that with the smallest id.

    Rows that repeat this id are reduced to the one with the smallest text. Rows without an
    id can't be named in a group and stay. Columns and their order are those of ``docs``.
    """
    return first_of_groups(docs, near_duplicates(docs, key, text, **limits), key, text)
