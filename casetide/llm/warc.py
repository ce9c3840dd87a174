"""WARC archives: one gzip member per record, read back in byte ranges.

Each task writes its own archive in the shared folder. The rows that Spark commits name the
archives, so files of lost or repeated attempts are never read.

The reader is splittable without an index. An archive is cut into byte ranges. A task looks
for the gzip magic in its range, takes a place as a record only if the member there
decompresses to a WARC header, and then goes from member to member. It owns the records that
start inside its range, and reads the last one to its end.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetide.llm.files import new_name, opened, writing
from casetide.runtime import materialize, scratch_path

RESPONSE, REVISIT = "response", "revisit"
#: Payloads of fewer bytes are always written whole.
REVISIT_BYTES = 0
#: Bytes of an archive that one task scans.
SPLIT_BYTES = 8 << 20
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 512 << 20

# Fixed values of the WARC 1.1 and gzip formats.
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1.1\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLANK = b"\r\n\r\n"
_LEVEL = 6
_CHUNK = 1 << 20


def digest_of(payload: bytes) -> str:
    """SHA-1 in bare upper-case base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str) -> str:
    """Control characters and line breaks as percent codes, so that a value stays in its header."""
    return re.sub(r"[\x00-\x1f\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit without."""
    revisit = refers_to is not None
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": REVISIT if revisit else RESPONSE,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
        "WARC-Date": "1970-01-01T00:00:00Z",  # the table has no time of retrieval
        "WARC-Target-URI": None if url is None else _one_line(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Refers-To-Target-URI": _one_line(refers_url) if revisit and refers_url is not None else None,
        "WARC-Refers-To-Date": "1970-01-01T00:00:00Z" if revisit else None,
        "WARC-Profile": _PROFILE if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
        # Own fields, which other readers pass over.
        "X-Payload-Length": str(len(payload)),
        "X-Page-Id": None if page_id is None else str(page_id),
        "X-Refers-To-Page-Id": None if refers_to is None else str(refers_to),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(_VERSION + lines.encode() + b"\r\n" + block + _BLANK) + packer.flush()


#: Tasks that read archives, at most; more ranges share them.
TASKS = 20_000


@dataclass
class Record:
    page_id: int | None
    url: str | None
    kind: str
    refers_to: int | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


class BadRecord(ValueError):
    pass


def decode_record(raw: bytes) -> Record:
    """The record in a decompressed member; lengths and the response's digest are checked."""
    end = raw.find(_BLANK)
    if not raw.startswith(_VERSION) or end < 0:
        raise BadRecord("no WARC header")
    head = dict(line.split(": ", 1) for line in raw[len(_VERSION) : end].decode().split("\r\n"))
    block = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    if len(raw) != end + 4 + int(head["Content-Length"]) + len(_BLANK) or not raw.endswith(_BLANK):
        raise BadRecord("length of the block")
    number = lambda name: int(head[name]) if name in head else None
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block[block.index(_BLANK) + 4 :] if kind == RESPONSE else None
    size = number("X-Payload-Length") if payload is None else len(payload)
    if payload is not None and digest_of(payload) != digest:
        raise BadRecord("digest of the payload")
    return Record(number("X-Page-Id"), head.get("WARC-Target-URI"), kind, number("X-Refers-To-Page-Id"), size, digest, payload)


class _Members:
    """Gzip members of an open file that start in a byte range."""

    def __init__(self, file, start: int, stop: int):
        self.file, self.stop, self.base, self.data = file, stop, start, b""
        file.seek(start)

    def _more(self) -> bool:
        chunk = self.file.read(_CHUNK)
        self.data += bytes(chunk)
        return bool(chunk)

    def _member(self, at: int) -> tuple[bytes, int] | None:
        """Decompressed member at a place in ``data`` and where it ends; None if there is none, or a damaged one."""
        packed, fed, out = zlib.decompressobj(31), at, []
        seen = 0
        try:
            while not packed.eof:
                if fed == len(self.data) and not self._more():
                    return None
                out.append(packed.decompress(self.data[fed : fed + _CHUNK]))
                fed = min(fed + _CHUNK, len(self.data))
                if seen < len(_VERSION):
                    seen += len(out[-1])
                    if b"".join(out)[: len(_VERSION)] != _VERSION[:seen]:
                        return None
        except zlib.error:
            return None
        return b"".join(out), fed - len(packed.unused_data)

    def _ended(self, at: int) -> bool:
        return len(self.data) <= at and not self._more()

    def __iter__(self) -> Iterator[Record]:
        at, known = 0, self.base == 0  # where a record must begin, once one has been read
        while self.base + at < self.stop:
            if len(self.data) < at + len(_MAGIC) and self._more():
                continue
            if known:
                if self._ended(at):
                    return
                place = at
            else:
                place = self.data.find(_MAGIC, at)
            if place < 0:
                # The magic may begin in the last bytes.
                at = max(at, len(self.data) - len(_MAGIC) + 1)
                if self.base + at >= self.stop or not self._more():
                    return
            elif self.base + place >= self.stop:
                return
            elif (found := self._member(place)) is None:
                if known:
                    raise BadRecord(f"no whole record at {self.base + place}")
                at = place + 1
            else:
                raw, at = found
                known = True
                yield decode_record(raw)
            if at > _CHUNK:
                self.data, self.base, at = self.data[at:], self.base + at, 0
        # The next range finds its first record by itself; that there is one is seen from here.
        if known and not self._ended(at) and self._member(at) is None:
            raise BadRecord(f"no whole record at {self.base + at}")


def read_range(file, start: int, stop: int) -> Iterator[Record]:
    """Records whose members start in ``[start, stop)`` of an open binary file.

    A damaged archive is an error: from its start on, and behind each record, there is a
    record or the end. So each member is vouched for by the one before it, in whatever range.
    """
    return iter(_Members(file, start, stop))


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``page_id``, ``url``, ``payload`` and, for payloads that a smaller id also has, ``refers_to``.

    Only digests are grouped, with map-side combine. Rows that share the smallest id of
    their payload are all responses, and so are rows of a payload that no row with an id has.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("_digest", F.sha1("payload"))
    size = F.octet_length("payload")
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.col("url").alias("refers_url")))
    groups = rows.where(size >= least_bytes).groupBy("_digest").agg(F.min(named).alias("_least"), F.count("*").alias("_n"))
    groups = groups.where("_n > 1 AND _least IS NOT NULL").select("_digest", F.col("_least.page_id").alias("_first"), "_least.refers_url")
    first = F.when((size >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return rows.join(groups, "_digest", "left").select("page_id", "url", "payload", first.alias("refers_to"), "refers_url")


def write(records: DataFrame, root: str) -> DataFrame:
    """Write the rows of ``with_revisits`` below ``root``; the archives as ``archive``, ``bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c for c in batch.columns), strict=True))
        row = next(rows, None)
        while row is not None:
            name, size = new_name("part", ".warc.gz"), 0
            with writing(root, name) as out:
                while row is not None and size < ARCHIVE_BYTES:
                    member = encode_record(*(x.as_py() for x in row))
                    out.write(member)
                    size += len(member)
                    row = next(rows, None)
            yield pa.RecordBatch.from_pydict({"archive": [name], "bytes": [size]})

    return materialize(records.mapInArrow(run, "archive string, bytes long"), "archives")


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(archives: DataFrame, root: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the archives; the payload of a revisit is null."""
    ranges = archives.select(
        "archive", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = opened(root)
        for batch in batches:
            for name, start in zip(batch["archive"], batch["start"], strict=True):
                with system.open_input_file(f"{path}/{name}") as file:
                    rows, held = [], 0
                    for r in read_range(file, int(start), int(start) + split_bytes):
                        rows.append((r.page_id, r.url, r.kind, r.refers_to, r.payload_bytes, r.payload_digest, r.payload))
                        held += len(r.payload or b"")
                        if held > _CHUNK:
                            yield _frame(rows)
                            rows, held = [], 0
                    yield _frame(rows)

    # A number of its own: the rows are small, and the planner would put them into one task.
    return ranges.repartition(max(1, min(TASKS, ranges.count()))).mapInPandas(run, RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [part.split()[0] for part in RECORD.split(", ")]
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per page, read the archives back, and give what was read.

    Columns ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to`` and ``payload``. A null html is an empty payload, a null url has no target
    header, a null id no id header. Empty tables give no archive and no rows. The archives
    stay below ``spark.checkpoint.dir``.
    """
    root = scratch_path(pages.sparkSession, "warc")
    return read(write(with_revisits(pages, key, url, html), root), root)
