"""Best-fit packing with certified bin counts.

Documents become token pieces of at most ``CAPACITY`` ids. Pieces are dealt to partitions,
each packed by best-fit decreasing. Dual feasible functions give a lower bound on the
sequences that a partition needs; where best fit meets it, the count is certified. Partitions
with a gap give up all pieces that are not in full sequences; certified ones give up their
emptiest sequence, as only others can fill it. What was given up is dealt anew, to fewer
partitions, and packed again, as long as that saves sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetide.llm.tables import parts_for
from casetide.llm.token_ids import ids_of
from casetide.runtime import materialize

CAPACITY = 1024
FILE = "byte_bpe_50k.json"

#: Pieces of a partition.
PART_PIECES = 40_000
#: Times that pieces are dealt.
ROUNDS = 5
#: Texts that are encoded at once.
_BATCH = 500

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(length: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a document's pieces. Only the first may be shorter than the rest."""
    starts = np.arange(length - capacity, 0, -capacity)[::-1] if length > capacity else np.zeros(0, int)
    starts = np.concatenate(([0], starts)).astype(np.int64)
    return starts, np.append(starts[1:], length)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", file: str = FILE, spaced: bool = True, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Token pieces of every document: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids_crc32`` and, if wanted, ``ids``.

    A null or empty text is one piece with the end id alone. Rows with equal or null ids are
    encoded one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _BATCH):
                part = batch.slice(at, _BATCH)
                yield encode(part.column(0), part.column(1).to_pylist())

    def encode(keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        ids, ends = ids_of(texts, file, spaced)
        begins = np.concatenate(([0], ends[:-1]))
        cuts = [cut(n, capacity) for n in ends - begins]
        row = np.repeat(np.arange(len(cuts)), [len(a) for a, _ in cuts])
        start, stop = (np.concatenate([c[i] for c in cuts]) for i in (0, 1))
        lo, hi = begins[row] + start, begins[row] + stop
        number = np.concatenate([np.arange(len(a)) for a, _ in cuts])
        raw = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        columns = [
            keys.take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start), pa.array(stop - start),
            pa.array(crc, pa.int64()),
        ]
        if with_ids:
            offsets = pa.array(np.append(lo, len(ids)), pa.int32())
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, names)

    schema = PIECE + (", ids array<int>" if with_ids else "")
    names = [part.split()[0] for part in schema.split(", ")]
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, by best-fit decreasing; equal lengths in given order."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    has_room, count = 0, 0  # bit r: a bin with room r is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = has_room >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                has_room &= ~(1 << room)
        else:
            room, at, count = capacity, count, count + 1
        bins[i], offsets[i] = at, capacity - room
        open_bins[room - size].append(at)
        has_room |= 1 << (room - size)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that any packing of these lengths needs at least.

    The largest over two families of dual feasible functions f, which keep every set of
    lengths that fits into one bin at a sum of f of at most 1:

    * lengths below e count 0, those above capacity - e count 1, the rest in proportion;
    * for k = 1, 2, ...: x = length / capacity counts x if (k + 1) x is whole, else
      floor((k + 1) x) / k.
    """
    if not len(lengths):
        return 0
    sizes = np.arange(capacity + 1)
    many = np.bincount(lengths, minlength=capacity + 1)
    mass, number = np.cumsum(many * sizes), np.cumsum(many)
    best = -(-int(mass[-1]) // capacity)
    for e in range(1, capacity // 2 + 1):
        whole = int(number[-1] - number[capacity - e])
        between = int(mass[capacity - e] - mass[e - 1])
        best = max(best, whole + -(-between // capacity))
    for k in range(1, 41):
        times = (k + 1) * sizes
        value = np.where(times % capacity == 0, k * sizes, times // capacity * capacity)
        best = max(best, -(-int((many * value).sum()) // (capacity * k)))
    return best


def _packed(turn: int, capacity: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        load = np.bincount(bins, lengths).astype(np.int64)
        given = load < capacity
        if len(load) == lower_bound(lengths, capacity):
            given &= np.arange(len(load)) == np.argmin(load)
        part = int(pdf["part"].iloc[0])
        pdf["sequence_id"] = (turn << 58) + (part << 28) + bins
        pdf["offset"] = offsets
        pdf["given"] = given[bins] & (not last)
        return pdf.drop(columns="part")

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Rows with a ``length`` of 1 to ``capacity``, plus ``sequence_id`` and ``offset``.

    Every row keeps its other columns, repeated rows included. Rows share a sequence without
    gaps. ``items`` needs no key: rows are numbered when they are first written. Only numbers
    and lengths are packed; the other columns, ids for instance, join the result by number.
    No rows give no sequences. Columns named item, sequence_id or offset are refused.
    """
    if clash := {"item", "sequence_id", "offset"} & set(items.columns):
        raise ValueError(f"rename {sorted(clash)}")
    numbered = materialize(items.withColumn("item", F.monotonically_increasing_id()), "pieces")
    left = numbered.select("item", F.col("length").cast("long").alias("length"))
    schema = "item long, length long, sequence_id long, offset long, given boolean"
    done, before = [], None
    rows = left.count()
    for turn in range(rounds):
        parts = parts_for(rows, part_pieces)
        last = parts == 1 or turn == rounds - 1
        dealt = left.withColumn("part", F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(parts)))
        packed = materialize(dealt.groupBy("part").applyInPandas(_packed(turn, capacity, last), schema), "packed")
        first = F.col("offset") == 0
        counted = packed.agg(F.count_if("given"), F.count_if(first), F.count_if(F.col("given") & first))
        rows, bins, given_bins = counted.first()
        if before is not None and bins >= before[1]:
            done.append(before[0])  # no sequence saved: what was given up stays as it was
            break
        done.append(packed.where("NOT given"))
        if last or not rows:
            break
        before = (packed.where("given"), given_bins)
        left = before[0].select("item", "length")
    placed = reduce(DataFrame.union, done).select("item", "sequence_id", "offset")
    return numbered.join(placed, "item").drop("item")


def packed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", with_ids: bool = True, **limits: int) -> DataFrame:
    """Pieces of every document with the sequence and the offset where they are placed.

    Null and empty texts are one piece with the end id; see ``pieces`` and ``pack``.
    """
    return pack(pieces(docs, key, text, with_ids=with_ids), **limits)
