"""Benchmark decontamination by SimHash windows.

For every benchmark item, windows of the item's own number of words slide over each
document; a document that is shorter is one window. A window's SimHash over word shingles is looked up in a multi-index: the 64 bits
are cut into blocks, and the items are stored by the value of each block. Fingerprints
within ``RADIUS`` differ in at most ``RADIUS // BLOCKS`` bits of some block, so looking up
all values that near finds all of them. Candidates are verified by the exact weighted
Jaccard similarity of their shingle counts.

A window can only be verified if it shares a shingle with an item, so fingerprints are
computed for the windows around such shingles; all other windows have similarity zero with
every item. The items are handled in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetide.llm.tables import parts_for

SHINGLE = 5
SIMILARITY = 0.8
#: Bits in which fingerprints may differ; shingle sets of similarity 0.8 differ in about 10.
RADIUS = 23
BLOCKS = 4
#: Characters of items that are sent to the tasks at once, about.
ITEM_CHARS = 8_000_000
_WORD = re.compile(r"\w+")
_SEED = 1

HIT = "doc_id long, item_id long, start_word long, n_words long, hamming int, similarity double"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return _WORD.findall((text or "").lower())


def shingles_of(words: list[str]) -> list[int]:
    """Hash of every run of five words; of all words if there are fewer."""
    if not words:
        return []
    joined = " ".join(words).encode()
    size = min(SHINGLE, len(words))
    if len(joined) == sum(map(len, words)) + len(words) - 1:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
    else:
        ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], _SEED) for s, e in spans]


def _bits(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return (sums > 0).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64))


def fingerprint(hashes: list[int]) -> int:
    """SimHash of a bag of shingle hashes: each counts as often as it occurs."""
    return int(_pack(_bits(np.array(hashes, np.uint64)).sum(axis=0)[None])[0])


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of shingle counts."""
    both = sum(min(n, b[h]) for h, n in a.items() if h in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


@dataclass
class Item:
    item_id: int
    n_words: int
    counts: Counter
    fp: int


class Index:
    """Items by the values of their fingerprint's blocks, and by their shingles."""

    def __init__(self, rows: list[tuple[int, str]], radius: int = RADIUS, blocks: int = BLOCKS):
        self.radius, self.items = radius, []
        for item_id, text in rows:
            words = words_of(text)
            if words:
                hashes = shingles_of(words)
                self.items.append(Item(item_id, len(words), Counter(hashes), fingerprint(hashes)))
        width = 64 // blocks
        self.shifts = [width * b for b in range(blocks)]
        self.mask = (1 << width) - 1
        near = radius // blocks
        flips = [sum(1 << b for b in c) for n in range(near + 1) for c in combinations(range(width), n)]
        self.flips = np.array(flips, np.uint64)
        # Of each window size: the items, and for each block its values with their items.
        self.by_size: dict[int, list[int]] = defaultdict(list)
        for i, item in enumerate(self.items):
            self.by_size[item.n_words].append(i)
        self.blocks = {
            n: [self._block(ids, shift) for shift in self.shifts] for n, ids in self.by_size.items()
        }
        #: Sizes of the items that have a shingle, by shingle.
        self.sizes: dict[int, set[int]] = defaultdict(set)
        for item in self.items:
            for h in item.counts:
                self.sizes[h].add(item.n_words)
        self.shingles = np.array(sorted(self.sizes), np.uint64)

    def _block(self, ids: list[int], shift: int) -> dict[int, list[int]]:
        table = defaultdict(list)
        for i in ids:
            table[self.items[i].fp >> shift & self.mask].append(i)
        return table

    def near(self, size: int, fp: int) -> list[tuple[int, int]]:
        """All items of that size within the radius of a fingerprint, with their distance."""
        found = {}
        for shift, table in zip(self.shifts, self.blocks[size], strict=True):
            value = fp >> shift & self.mask
            if len(table) < len(self.flips):
                # Fewer stored values than values to look up: compare with those instead.
                most = self.radius // len(self.shifts)
                hits = [v for v in table if (v ^ value).bit_count() <= most]
            else:
                hits = [v for v in (self.flips ^ np.uint64(value)).tolist() if v in table]
            for v in hits:
                for i in table[v]:
                    found[i] = (self.items[i].fp ^ fp).bit_count()
        return [(i, d) for i, d in found.items() if d <= self.radius]

    def hits(self, text: str | None) -> list[tuple[int, int, int, int, float]]:
        """Best window for each item found: item, first word, words, distance, similarity."""
        words = words_of(text)
        hashes = np.array(shingles_of(words), np.uint64)
        if not len(hashes) or not len(self.shingles):
            return []
        best: dict[int, tuple] = {}
        if len(words) < SHINGLE:
            self._verify(len(words), 0, Counter(hashes.tolist()), fingerprint(hashes.tolist()), best)
        else:
            # Shorter items have shingles of fewer words.
            at = np.minimum(np.searchsorted(self.shingles, hashes), len(self.shingles) - 1)
            shared = np.nonzero(self.shingles[at] == hashes)[0]
            spots = defaultdict(list)
            for p in shared.tolist():
                for size in self.sizes[int(hashes[p])]:
                    spots[size].append(p)
            for size, places in spots.items():
                if size <= len(words):
                    self._slide(size, places, hashes, best)
                elif len(hashes) >= SIMILARITY * (size - SHINGLE + 1):
                    # A document shorter than the item is one window.
                    values = hashes.tolist()
                    self._check(len(words), 0, Counter(values), self.near(size, fingerprint(values)), best)
        self._short(words, best)
        return [best[i] for i in sorted(best)]

    def _short(self, words: list[str], best: dict) -> None:
        """Windows of items with fewer words than a shingle: equal words, by their one hash."""
        for size in self.by_size:
            if size < SHINGLE and size < len(words):
                for start in range(len(words) - size + 1):
                    h = shingles_of(words[start : start + size])
                    if h[0] in self.sizes:
                        self._verify(size, start, Counter(h), fingerprint(h), best)

    def _slide(self, size: int, places: list[int], hashes: np.ndarray, best: dict) -> None:
        """All windows of ``size`` words that contain one of the shingles at ``places``."""
        many = size - SHINGLE + 1  # shingles of a window
        last = len(hashes) - many
        covered = np.zeros(len(hashes) + 1, np.int32)
        spot = np.array(places)
        np.add.at(covered, np.maximum(spot - many + 1, 0), 1)
        np.add.at(covered, spot + 1, -1)
        starts = np.nonzero(np.cumsum(covered[: max(last + 1, 0)]) > 0)[0]
        if not len(starts):
            return
        breaks = np.nonzero(np.diff(starts) > many)[0] + 1
        for run in np.split(starts, breaks):
            # Rolling sums of the bits over the run's shingles.
            lo, hi = int(run[0]), int(run[-1]) + many
            sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_bits(hashes[lo:hi]), axis=0)))
            prints = _pack(sums[run - lo + many] - sums[run - lo])
            values = hashes[lo:hi].tolist()
            for start, fp in zip(run.tolist(), prints.tolist(), strict=True):
                if found := self.near(size, fp):
                    counts = Counter(values[start - lo : start - lo + many])
                    self._check(size, start, counts, found, best)

    def _verify(self, size: int, start: int, counts: Counter, fp: int, best: dict) -> None:
        if size in self.by_size:
            self._check(size, start, counts, self.near(size, fp), best)

    def _check(self, size: int, start: int, counts: Counter, found: list, best: dict) -> None:
        for i, apart in found:
            item = self.items[i]
            alike = similarity(counts, item.counts)
            if alike >= SIMILARITY and ((old := best.get(i)) is None or alike > old[4]):
                best[i] = (item.item_id, start, size, apart, alike)


def _search(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                rows += [(key.as_py(), *hit) for hit in index.hits(text.as_py())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, _TYPES, strict=True)], _NAMES
            )

    return run


_NAMES = [part.split()[0] for part in HIT.split(", ")]
_TYPES = [pa.int64()] * 4 + [pa.int32(), pa.float64()]


def _indexes(benchmark: DataFrame, item: str, text: str, item_chars: int) -> Iterator[Index]:
    """An index for each block of items, of bounded size."""
    rows = benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    chars = rows.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0
    blocks = parts_for(chars, item_chars)
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t")
        yield Index([tuple(r) for r in block.toLocalIterator()])


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_chars: int = ITEM_CHARS) -> DataFrame:
    """A row for each document and item that it contains: the window most like the item.

    Columns ``doc_id``, ``item_id``, ``start_word``, ``n_words``, ``hamming`` and
    ``similarity`` (0.8 or more); of equally similar windows the first. Null, empty and
    wordless texts, on either side, hold and match nothing. Rows with equal or null ids are
    searched one by one. An empty benchmark or document table gives no rows.
    """
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = [chosen.mapInArrow(_search(index), HIT) for index in _indexes(benchmark, item, text, item_chars)]
    return reduce(DataFrame.union, found)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_chars: int = ITEM_CHARS) -> DataFrame:
    """The documents that contain no benchmark item, with their columns."""
    for index in _indexes(benchmark, item, text, item_chars):
        leaks_here = F.pandas_udf(lambda s, index=index: pd.Series([bool(index.hits(t)) for t in s]), "boolean")
        docs = docs.where(~leaks_here(F.col(text).cast("string")))
    return docs
