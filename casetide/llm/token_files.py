"""Token files: ids of all documents in ascending key order, coded by ``mixing_coder``.

A file is a series of segments. A segment holds whole documents and has all that is needed
to read it: a head, a table of its documents, a table of its blocks, and the coded blocks.
Blocks are reset one by one and carry checksums, and so do head and tables.

Documents are range-partitioned by key, each task writes one file, and the rows that Spark
commits name the segments in order, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casetide.llm import mixing_coder
from casetide.llm.files import new_name, opened, writing
from casetide.llm.token_ids import ids_of
from casetide.runtime import materialize, scratch_path

FILE = "word_bpe_49k.json"
#: Characters of documents that go into a segment, about; a longer document has its own.
SEGMENT_CHARS = 18_000_000

_MAGIC = b"CMIX2\n"
_HEAD = struct.Struct("<6sIIIIII")  # magic, documents, ids, block size, blocks, bytes of tables, their CRC-32
_DOC = np.dtype([("doc_id", "<i8"), ("named", "u1"), ("length", "<u4")])
_BLOCK = np.dtype([("bytes", "<u4"), ("crc32", "<u4")])


def encode_segment(keys: list[int | None], ids: np.ndarray, ends: np.ndarray) -> bytes:
    """Documents with these keys, whose ids end at ``ends``, as bytes."""
    docs = np.zeros(len(keys), _DOC)
    docs["doc_id"] = [k or 0 for k in keys]
    docs["named"] = [k is not None for k in keys]
    docs["length"] = np.diff(ends, prepend=0)
    codes = mixing_coder.encode(ids)
    blocks = np.array([(len(c), check) for c, check in codes], _BLOCK)
    tables = zlib.compress(docs.tobytes() + blocks.tobytes())
    head = _HEAD.pack(_MAGIC, len(docs), len(ids), mixing_coder.BLOCK, len(codes), len(tables), zlib.crc32(tables))
    return b"".join((head, tables, *(c for c, _ in codes)))


def decode_segment(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, ids and ends of a segment. Damage is an error."""
    magic, n_docs, n_ids, block, n_blocks, size, check = _HEAD.unpack_from(raw)
    tables = raw[_HEAD.size : _HEAD.size + size]
    if magic != _MAGIC or zlib.crc32(tables) != check:
        raise ValueError("damaged segment")
    tables = zlib.decompress(tables)
    docs = np.frombuffer(tables, _DOC, n_docs)
    blocks = np.frombuffer(tables, _BLOCK, n_blocks, n_docs * _DOC.itemsize)
    stops = np.cumsum(blocks["bytes"], dtype=np.int64) + _HEAD.size + size
    codes = [(raw[b - n : b], c) for b, n, c in zip(stops.tolist(), blocks["bytes"].tolist(), blocks["crc32"].tolist(), strict=True)]
    keys = [k if named else None for k, named in zip(docs["doc_id"].tolist(), docs["named"].tolist(), strict=True)]
    return keys, mixing_coder.decode(codes, n_ids, block), np.cumsum(docs["length"], dtype=np.int64)


def write(docs: DataFrame, root: str, key: str = "doc_id", text: str = "text", file: str = FILE, spaced: bool = False, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Write the ids of all documents below ``root``, in ascending key order, null keys first.

    A row per segment: ``file``, ``part`` and ``nth`` (its place in the order), ``offset``,
    ``bytes``, ``n_docs`` and ``n_tokens``. Rows with equal keys are ordered by text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        segments = _segments(batches, segment_chars)
        segment = next(segments, None)
        if segment is None:
            return
        name, offset, rows = new_name(f"part-{part:06d}", ".cmix"), 0, []
        with writing(root, name) as out:
            while segment is not None:
                keys, texts = segment
                ids, ends = ids_of(texts, file, spaced)
                raw = encode_segment(keys, ids, ends)
                out.write(raw)
                rows.append((name, part, len(rows), offset, len(raw), len(keys), len(ids)))
                offset += len(raw)
                segment = next(segments, None)
        names = ("file", "part", "nth", "offset", "bytes", "n_docs", "n_tokens")
        yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)})

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = chosen.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "file string, part long, nth long, offset long, bytes long, n_docs long, n_tokens long"
    return materialize(ordered.mapInArrow(run, schema), "segments")


def _segments(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list]]:
    keys, texts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py() or ""
            if texts and held + len(text) > chars:
                yield keys, texts
                keys, texts, held = [], [], 0
            keys.append(key.as_py())
            texts.append(text)
            held += len(text)
    if texts:
        yield keys, texts


def read(segments: DataFrame, root: str, with_ids: bool = True) -> DataFrame:
    """Documents of the segments: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if wanted, ``ids``.

    ``start`` counts the ids of all documents before, over all files. The segments' own sums
    are a table of one row per segment; only that is summed up in one place.
    """
    before = F.sum("n_tokens").over(Window.orderBy("part", "nth")) - F.col("n_tokens")
    tasks = segments.select("file", "offset", "bytes", before.alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(root)
        for batch in batches:
            for name, offset, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(f"{path}/{name}") as f:
                    f.seek(offset)
                    keys, ids, ends = decode_segment(f.read(size))
                begins = np.concatenate(([0], ends[:-1]))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(keys, pa.int64()), pa.array(begins + start), pa.array(ends - begins), pa.array(crc, pa.int64())]
                if with_ids:
                    offsets = pa.array(np.append(begins, len(ids)), pa.int32())
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = [part.split()[0] for part in schema.split(", ")]
    # A number of its own: the rows are small, and the planner would put them into one task.
    return tasks.repartition(max(1, segments.count())).mapInArrow(run, schema)


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text", with_ids: bool = True, **how) -> DataFrame:
    """Write the ids of every document and read the files back.

    Null and empty texts have the end id alone. Rows with equal or null ids are documents of
    their own. An empty table gives no file and no rows. Files stay below
    ``spark.checkpoint.dir``.
    """
    root = scratch_path(docs.sparkSession, "tokens")
    return read(write(docs, root, key, text, **how), root, with_ids)
