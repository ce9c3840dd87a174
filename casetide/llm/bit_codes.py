"""Hard negatives by rotated one-bit codes with an interval for each inner product.

Vectors are taken as integers and rotated at random. A code keeps the signs of the rotated
components; besides it are stored the length of the vector and the alignment of its direction
with the code's. The anchor stays finer: its rotated components become numbers of ``PLANES``
bits, so its product with a code is a sum of popcounts, off by no more than the length of what
was rounded off. The part of a vector beside its code has a known length and is at right
angles to it, so by Cauchy-Schwarz it adds no more than that length times the part of the
anchor beside the code. Both together give an interval that surely holds the score.

Rows whose interval cannot reach the best scores found so far, or misses the allowed band,
are dropped; the rest is scored in integers. So the results are exact and the codes only
save work.

Anchors are compared with all rows in blocks: a task holds a block of anchors and streams a
group of rows past it. Positives are looked for among the rows of a label, hard negatives
among all rows; both kinds of groups are cut by size, so one label may hold any share.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetide.runtime import materialize

POSITIVES = 5
NEGATIVES = 3
#: Band of a negative's score, in percent of the positive's.
LOW, HIGH = 50, 95
SCALE = 256

#: Anchors of a block, and rows of a group that is streamed past it.
ANCHORS = 8_192
ROWS = 16_384
#: Bits of an anchor's rotated components.
PLANES = 6
#: Tasks of one comparison, at most; more blocks share them.
TASKS = 20_000
_SEED = 17
# Anchors and rows compared at once, and pairs scored at once.
_A, _R, _PAIRS = 256, 4_096, 1 << 16
# Room for rounding in the intervals, relative to the product of both lengths.
_SLACK = 1e-9

FOUND = "anchor long, nth int, score long, other long, id long"


@cache
def _rotation(size: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(_SEED).standard_normal((size, size)))[0]


def _turned(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotated directions, and lengths."""
    length = np.sqrt(np.einsum("ij,ij->i", q.astype(float), q.astype(float)))
    return (q / np.where(length > 0, length, 1)[:, None]) @ _rotation(q.shape[1]).T, length


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words, one at least."""
    raw = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(raw, [(0, 0), (0, -raw.shape[1] % 8 or 8 * (not raw.shape[1]))]).view(np.uint64)


def encode(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows of 64-bit words), lengths and alignments of integer vectors."""
    y, length = _turned(q)
    return _packed(y >= 0), length, np.abs(y).sum(axis=1) / np.sqrt(max(1, q.shape[1]))


class Anchors:
    """Some anchors, ready for intervals of their scores with coded rows."""

    def __init__(self, q: np.ndarray):
        y, self.length = _turned(q)
        self.size = q.shape[1]
        self.low = y.min(axis=1, initial=0)
        self.step = np.maximum((y.max(axis=1, initial=0) - self.low) / (2**PLANES - 1), 1e-300)
        level = np.rint((y - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [_packed(level >> j & 1) for j in range(PLANES)]
        near = self.low[:, None] + self.step[:, None] * level
        self.total = near.sum(axis=1)
        self.error = np.sqrt(((y - near) ** 2).sum(axis=1))

    def interval(self, code: np.ndarray, length: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of all anchors (rows) with all coded vectors (columns)."""
        on = np.zeros((len(self.low), len(code)))
        for j, plane in enumerate(self.planes):
            count = np.bitwise_count(plane[:, None, 0] & code[None, :, 0]).astype(np.uint32)
            for word in range(1, code.shape[1]):
                count += np.bitwise_count(plane[:, None, word] & code[None, :, word])
            on += count * float(1 << j)
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        # Product of the rounded anchor with the code's direction.
        t = (2 * (self.low[:, None] * ones + self.step[:, None] * on) - self.total[:, None]) / np.sqrt(max(1, self.size))
        e = self.error[:, None]
        beside = np.sqrt(np.maximum(0, 1 - np.maximum(0, np.abs(t) - e) ** 2)) * np.sqrt(np.maximum(0, 1 - align**2))
        both = self.length[:, None] * length
        half = (align * e + beside + _SLACK) * both
        middle = align * t * both
        return middle - half, middle + half


class _Best:
    """The ``k`` best rows of each anchor and band, so far."""

    def __init__(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int):
        self.q, self.lo, self.hi, self.k = q, lo, hi, k
        self.blocks = [Anchors(q[at : at + _A]) for at in range(0, len(q), _A)]
        self.floor = lo.astype(float)  # what a score must reach, by anchor and band
        self.found = np.zeros((0, 4), np.int64)  # anchor and band in one number, score, id, row

    def take(self, q: np.ndarray, code: np.ndarray, length: np.ndarray, align: np.ndarray, row: np.ndarray, id_: np.ndarray, allowed) -> int:
        """Compare some rows; gives the number of pairs that had to be scored."""
        scored = 0
        for nth, block in enumerate(self.blocks):
            own = slice(nth * _A, nth * _A + len(block.low))
            lower, upper = block.interval(code, length, align)
            floor, hi = self.floor[own], self.hi[own]
            open_ = np.zeros(upper.shape, bool)
            for band in range(floor.shape[1]):
                open_ |= (upper >= floor[:, band, None]) & (lower <= hi[:, band, None])
            a, r = np.nonzero(open_ & allowed(own))
            a += own.start
            scored += len(a)
            score = np.concatenate([np.zeros(0, np.int64)] + [
                np.einsum("ij,ij->i", self.q[a[i : i + _PAIRS]], q[r[i : i + _PAIRS]]) for i in range(0, len(a), _PAIRS)
            ])
            bands = self.floor.shape[1]
            fits = [np.nonzero((score >= self.floor[a, b]) & (score <= self.hi[a, b]))[0] for b in range(bands)]
            new = [np.stack((a[f] * bands + b, score[f], id_[r[f]], row[r[f]]), axis=1) for b, f in enumerate(fits)]
            self._keep(np.concatenate([self.found, *new]))
        return scored

    def _keep(self, rows: np.ndarray) -> None:
        order = np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))
        rows = rows[order]
        first = np.nonzero(np.diff(rows[:, 0], prepend=-1))[0]
        size = np.diff(first, append=len(rows))
        place = np.arange(len(rows)) - np.repeat(first, size)
        self.found = rows[place < self.k]
        last = rows[place == self.k - 1]
        self.floor.reshape(-1)[last[:, 0]] = np.maximum(self.floor.reshape(-1)[last[:, 0]], last[:, 1])


def _matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind, copy=False)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, q = batch.schema.names, batch.column("q")
        sizes = q.value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            some = batch.filter(pa.array(sizes == size))
            code, length, align = encode(_matrix(some.column("q")))
            if int(size) * float(np.abs(_matrix(some.column("q"), float)).max(initial=0)) ** 2 >= 2.0**63:
                raise ValueError("a component is too large: scores must fit in 64 bits")
            words = pa.array(list(code.view(np.int64)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, words, pa.array(length), pa.array(align)], [*names, "code", "length", "align"])


def coded(vectors: DataFrame, anchors: Column, key: str, vector: str, label: Column) -> DataFrame:
    """Usable rows with a number of their own, integer components and code."""
    value = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), value.alias("v"), F.coalesce(anchors, F.lit(False)).alias("is_anchor")
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "is_anchor", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * SCALE)).alias("q"))
    return materialize(rows.mapInArrow(_coded, "row long, id long, label long, is_anchor boolean, dim int, q array<long>, code array<long>, length double, align double"), "coded-vectors")


def _compare(by: list[str], k: int, same_label: bool, low: int, high: int):
    """Stream rows past the anchors of their task; tasks follow each other in a partition."""
    keys = [*by, "block", "part"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*keys, "kind"]], axis=1)
            cuts = np.nonzero((own[1:] != own[:-1]).any(axis=1))[0] + 1
            for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True):
                if b > a:
                    yield tuple(own[a]), batch.slice(a, b - a)

    def results(best: _Best | None, anchor: np.ndarray) -> pa.RecordBatch:
        found = best.found if best else np.zeros((0, 4), np.int64)
        bands = best.floor.shape[1] if best else 1
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor[found[:, 0] // bands]), pa.array((found[:, 0] % bands).astype(np.int32)), *(pa.array(found[:, c]) for c in (1, 3, 2))],
            ["anchor", "nth", "score", "other", "id"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, best, held = None, None, []
        anchor = label = np.zeros(0, np.int64)
        for (*own, kind), batch in pieces(batches):
            if own != task:
                if best:
                    yield results(best, anchor)
                task, best, held = own, None, []
            if kind == 0:
                held.append(batch)
                continue
            if best is None and held:
                table = pa.Table.from_batches(held).combine_chunks()
                anchor, label = table["row"].to_numpy(), table["label"].to_numpy()
                q = _matrix(table["q"].chunk(0))
                scores = [x or [] for x in table["scores"].to_pylist()]
                bands = 1 if same_label else max(1, *map(len, scores))
                # A band that an anchor lacks is empty.
                lo, hi = np.ones((len(q), bands), np.int64), np.zeros((len(q), bands), np.int64)
                if same_label:
                    lo[:], hi[:] = -(2**62) * 2, 2**63 - 1
                for i, x in enumerate([] if same_label else scores):
                    lo[i, : len(x)], hi[i, : len(x)] = [-(-low * s // 100) for s in x], [high * s // 100 for s in x]
                best, held = _Best(q, lo, hi, k), []
            if best is None:
                continue
            q, code = _matrix(batch.column("q")), _matrix(batch.column("code")).view(np.uint64)
            length, align, row, id_, of = (batch.column(c).to_numpy() for c in ("length", "align", "row", "id", "label"))
            at, many = 0, 64  # the first rows are few, so that floors rise early
            while at < len(row):
                s = slice(at, at + many)

                def allowed(a: slice, s=s) -> np.ndarray:
                    if same_label:
                        return anchor[a, None] != row[s]
                    return label[a, None] != of[s]

                best.take(q[s], code[s], length[s], align[s], row[s], id_[s], allowed)
                at, many = at + many, min(_R, many * 2)
        if best:
            yield results(best, anchor)

    return run


def _found(rows: DataFrame, anchors: DataFrame, by: list[str], k: int, same_label: bool, sizes: tuple[int, int], band: tuple[int, int]) -> DataFrame:
    """The ``k`` best rows per anchor and band within each block of rows, then over all."""
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    m = anchors.groupBy(*by).agg(F.count("*").alias("m"))
    parts = F.ceil(F.col("n") / sizes[1]).cast("int")
    blocks = F.ceil(F.col("m") / sizes[0]).cast("int")
    grid = materialize(n.join(m, by).select(*by, blocks.alias("blocks"), parts.alias("parts")), "grid")
    tasks = grid.agg(F.coalesce(F.sum(F.col("blocks").cast("long") * F.col("parts")), F.lit(0))).first()[0]
    spread = lambda c: F.pmod(F.xxhash64("row"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    carried = ["row", "id", "label", "q", "code", "length", "align"]
    empty = F.array().cast("array<long>").alias("scores")
    left = anchors.join(grid, by).select(*dict.fromkeys([*by, *carried]), "scores", F.lit(0).alias("kind"), spread("blocks").alias("block"), every("parts").alias("part"))
    right = rows.join(grid, by).select(*dict.fromkeys([*by, *carried]), empty, F.lit(1).alias("kind"), spread("parts").alias("part"), every("blocks").alias("block"))
    keys = [*by, "block", "part"]
    dealt = left.unionByName(right).repartition(max(1, min(TASKS, tasks)), *keys).sortWithinPartitions(*keys, "kind")
    local = dealt.mapInArrow(_compare(by, k, same_label, *band), FOUND)
    order = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id", "other")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(
    vectors: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block: tuple[int, int] = (ANCHORS, ROWS),
) -> DataFrame:
    """Hard negatives of the rows that ``anchors`` is true for.

    Columns ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``,
    ``positive_score`` and ``negative_score``. Scores are inner products of integer vectors;
    an anchor's positives are its best other rows of the same label, a positive's negatives the
    best rows of other labels whose score is within ``low`` to ``high`` percent of it. Ties go
    to the smaller id.

    Rows without an id or a label, and those whose vector is null or holds a null or a
    non-finite component, take no part; ``anchors`` null is false. Vectors of different
    lengths are not compared; empty ones score 0. Rows that repeat are rows of their own,
    also as each other's positives. Scores that 64 bits cannot hold are an error. An empty
    table gives no rows. Other columns are not read.
    """
    rows = coded(vectors, anchors, key, vector, F.col("label") if label is None else label)
    own = rows.where("is_anchor").withColumn("scores", F.array().cast("array<long>"))
    near = materialize(_found(rows, own, ["dim", "label"], positives, True, block, (low, high)), "positives")
    # A positive's place in the list is its rank less one.
    listed = near.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    own = rows.where("is_anchor").join(listed, F.col("row") == F.col("anchor")).drop("anchor")
    hard = _found(rows, own, ["dim"], negatives, False, block, (low, high))
    pairs = near.select("anchor", (F.col("rank") - 1).alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = rows.where("is_anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    hard = hard.select("anchor", "nth", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    joined = pairs.join(hard, ["anchor", "nth"]).join(names, "anchor")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
