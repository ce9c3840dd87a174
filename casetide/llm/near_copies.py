"""Near copies of documents: five-word shingle sets with a Jaccard similarity of 0.8 or more.

Texts of equal words are one class, so a large group of copies is one. Candidates come from
two sources, and every one is verified by the exact similarity of its shingle sets before
components are made:

* The binary trie (``simhash_trie``) on five-word fingerprints gives a spanning forest of
  close fingerprints, which puts most of a large group together by few comparisons. Shingle
  sets of similarity 0.8 differ in up to 14 bits and more, which no trie can carry: 15 blocks
  of four bits leave nearly all pairs to compare. So the trie alone would not find them.
* A prefix join finds all the rest. Shingles have one global order. Of ``n`` shingles the
  first ``n - ceil(0.8 n) + 1`` are a prefix, and sets of similarity 0.8 have a shingle of
  their prefixes in common, whatever the order. Classes that share one are compared: first
  with one class of the shingle's group, which leaves little of a large group, then all that
  are not yet in one component.

Two bounds keep a large group of texts that are alike, yet not by 0.8, from being compared in full.
From a shared shingle on no more can be equal than either class has left, so classes whose own
shingles fill most of their prefix meet nobody of the group. And the sketch of a set, the parity
of its shingles over 512 bits, differs in one bit at most for every shingle that only one of two
sets has, so classes whose sketches differ in more bits than similar sets can make no pair.

Frequent shingles, counted in one of eight texts, come last in the order, so few classes share a
prefix's shingles. That only saves comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetide.llm import simhash_trie
from casetide.llm.components import connected
from casetide.llm.tables import written
from casetide.runtime import materialize, remove

SHINGLE = 5
#: One in so many texts, by their hash, in which frequent shingles are counted.
ONE_IN = 8
#: Of those, the texts that make a shingle frequent.
OFTEN = 3
#: Bits of a place in the bitmap of frequent shingles: 16 MB, whatever the corpus.
SPOT_BITS = 27
#: Classes of a shingle's group, on average, from which on they are first compared with one.
PAIRS = 16
#: Rounds of comparing with one class of a group, at most; what is left is compared in full.
ROUNDS = 4
#: Classes to compare, at most, whose list is sent to all tasks (24 MB).
BROADCAST = 1_000_000
#: Links of classes that a task takes in a step towards components.
LINKS = 20_000
#: Bits of the sketch of a shingle set.
SKETCH_BITS = 512
#: Texts that a task takes at once.
_TEXTS = 500
#: Two hashes of a text, which name it in joins.
_TEXT_KEY = ("t1", "t2")
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def words_of(text: str | None) -> list[bytes]:
    """Words as ``simhash_trie.simhash`` takes them."""
    return (text or "").encode().lower().split()


def shingles_of(words: list[bytes]) -> np.ndarray:
    """Sorted hashes of the distinct runs of five words; of all words if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    digest, size = xxhash.xxh64_intdigest, min(SHINGLE, len(words))
    one = np.array([digest(w) for w in words], np.uint64)
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out += one[i : len(words) - size + 1 + i] * np.uint64(_MIX[i])
    out ^= out >> np.uint64(31)
    out *= np.uint64(_MIX[2])
    return np.unique(out ^ (out >> np.uint64(29)))


def _class(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words))


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few texts at a time, so that a task holds little beside the batch it was given."""
    for batch in batches:
        for at in range(0, len(batch), _TEXTS):
            yield batch.slice(at, _TEXTS)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        texts = [t.as_py() for t in batch.column("text")]
        found = [_class(words_of(t)) for t in texts], [simhash_trie.simhash(t, SHINGLE) for t in texts]
        kept = [batch.column(c) for c in ("doc_id", *_TEXT_KEY)]
        yield pa.RecordBatch.from_arrays([*kept, *map(_signed, found)], ["doc_id", *_TEXT_KEY, "cls", "fp"])


def sketch(found: np.ndarray) -> np.ndarray:
    """Whether the number of shingles is odd, for each value of their last bits."""
    odd = np.bincount((found & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _apart(x: str, y: str) -> F.Column:
    """Bits in which two sketches differ: no more than there are shingles that only one of the sets has."""
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))


def _prefix_size(n):
    """Shingles of a prefix, of ``n``; also for columns."""
    return n - (4 * n + 4) // 5 + 1


def _prefixes(often: np.ndarray):
    """Rows of a class, its number of shingles, a shingle of its prefix, the place of that and, in
    the first row of a class, the sketch of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            own, sizes, drawn, out = [], [], [], [np.zeros(0, np.uint64)]
            for text in batch.column(0):
                words = words_of(text.as_py())
                if not words:
                    continue
                found = shingles_of(words)
                n = len(found)
                spot = (found >> np.uint64(64 - SPOT_BITS)).astype(np.int64)
                late = ((often[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1).astype(bool)
                out.append(np.concatenate((found[~late], found[late]))[: _prefix_size(n)])
                own.append(_class(words))
                sizes.append(n)
                drawn += [sketch(found), *[None] * (len(out[-1]) - 1)]
            each = [len(x) for x in out[1:]]
            yield pa.RecordBatch.from_arrays(
                [_signed(np.repeat(np.array(own, np.uint64), each)), pa.array(np.repeat(np.array(sizes, np.int32), each)), _signed(np.concatenate(out)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in [0, *each]])), pa.array(drawn, pa.list_(pa.int64()))],
                ["cls", "n", "h", "at", "sketch"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        found = [shingles_of(words_of(t.as_py())).view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["cls", "set"])


def _often(texts: DataFrame, one_in: int) -> np.ndarray:
    """Bitmap of the shingles that several of one in so many texts have; none for 0.

    Its size is fixed. Other shingles that share a bit count as frequent too, everywhere alike.
    """
    out = np.zeros(1 << (SPOT_BITS - 3), np.uint8)
    if not one_in:
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [shingles_of(words_of(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate([np.zeros(0, np.uint64), *found]))], ["h"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)
    often = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= OFTEN)
    place = F.shiftrightunsigned("h", 64 - SPOT_BITS) + 1
    parts = often.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    for row in parts.collect():
        bits = np.frombuffer(row["bits"], np.uint8)
        out[(row["part"] - 1) * len(bits) :][: len(bits)] = bits
    return out


def _sets_of(pairs: DataFrame, docs: DataFrame, tagged: DataFrame) -> tuple[DataFrame, str]:
    """Shingle sets of the classes that are to be compared, from one text of each, and where they lie."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    chosen = tagged.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct(*_TEXT_KEY)).alias("t")).select("cls", "t.*")
    chosen = materialize(chosen, "classes-to-compare")
    # 24 bytes a row: where they are few, texts need not be moved to meet them.
    small = F.broadcast(chosen) if chosen.count() <= BROADCAST else chosen
    one = docs.join(small, list(_TEXT_KEY)).groupBy("cls").agg(F.min("text").alias("text"))
    return written(one.mapInArrow(_sets, "cls long, set array<long>"), "shingle-sets")


def _verified(pairs: DataFrame, docs: DataFrame, tagged: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` of classes whose shingle sets have a similarity of 0.8 or more."""
    sets, path = _sets_of(pairs, docs, tagged)
    a = sets.select(F.col("cls").alias("a"), F.col("set").alias("x"))
    b = sets.select(F.col("cls").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    met = pairs.join(b, "b").join(a, "a").where(9 * both >= 4 * (F.size("x") + F.size("y"))).select("a", "b")
    met = materialize(met, "verified")
    remove(docs.sparkSession, path)
    return met


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _sharing(rows: DataFrame, by: str, *more: F.Column) -> DataFrame:
    """Shingles that several values of ``by`` have."""
    found = rows.groupBy("h").agg(F.min(by).alias("lo"), F.max(by).alias("hi"), *more)
    return found.where("lo != hi").drop("lo", "hi")


def _first(nth: int) -> F.Column:
    """The first class of a group in some order, with all that its row says."""
    return F.min(F.struct(F.xxhash64("cls", F.lit(nth)).alias("turn"), *_ROW)).alias("end")


def links(docs: DataFrame, tagged: DataFrame, one_in: int = ONE_IN, rounds: int = ROUNDS) -> DataFrame:
    """Links ``a``, ``b`` between classes; all near copies are in one component of them."""
    texts = docs.select("text").where("text IS NOT NULL")
    rows = texts.mapInArrow(_prefixes(_often(texts, one_in)), "cls long, n int, h long, at int, sketch array<long>")
    # Read twice. Classes and places repeat, so the table takes little more than its shingles.
    rows, all_rows = written(rows, "all-prefixes")
    first, shared = written(_sharing(rows, "cls"), "shared-shingles")
    # Only classes that share a shingle go on.
    every, rows = rows, materialize(rows.drop("sketch").join(first, "h", "left_semi").distinct(), "prefixes")
    sketches = every.where("sketch IS NOT NULL").select("cls", "sketch").join(rows.select("cls").distinct(), "cls", "left_semi")
    sketches = materialize(sketches.dropDuplicates(["cls"]), "sketches")
    for path in (all_rows, shared):
        remove(docs.sparkSession, path)

    prints = tagged.groupBy("fp").agg(F.min("cls").alias("one"))
    prints = materialize(prints, "five-word-fingerprints")
    near = simhash_trie.links(prints.select("fp"))
    name = lambda c: prints.select(F.col("fp").alias(c), F.col("one").alias(f"{c}1"))
    near = near.join(name("a"), "a").join(name("b"), "b").select("a1", "b1")
    same = tagged.select("cls", "fp").distinct().join(prints, "fp").select("cls", "one")
    tested = materialize(_ordered(near, "a1", "b1").union(_ordered(same, "cls", "one")).distinct(), "candidates")
    found = _verified(tested, docs, tagged)

    for nth in range(rounds + 1):
        known = connected(found, rows_per_task=LINKS)
        rest = rows.join(known, F.col("cls") == F.col("node"), "left").select(*_ROW, "h", F.coalesce("root", "cls").alias("comp"))
        ends = _sharing(rest, "comp", _first(nth)).select("h", *(F.col(f"end.{c}").alias(f"y{c}") for c in _ROW))
        ends, heads = written(ends, "first-of-open")
        if ends.isEmpty():
            break
        rest, opened = written(rest.join(ends.select("h"), "h", "left_semi"), "open-prefixes")
        many, square = rest.groupBy("h").count().agg(F.sum("count"), F.sum(F.col("count") * F.col("count"))).first()
        large = square > PAIRS * many
        if nth < rounds and large:
            x = rest.select("h", *(F.col(c).alias(f"x{c}") for c in _ROW))
            both = x.join(ends, "h").where("xcls != ycls")
        else:
            drawn = rest.join(sketches, "cls")
            x, y = (drawn.select("h", *(F.col(c).alias(f"{s}{c}") for c in ("comp", "sketch", *_ROW))) for s in "xy")
            both = x.join(y, "h").where("xcls < ycls AND xcomp != ycomp")
            both = both.where(9 * _apart("xsketch", "ysketch") <= F.col("xn") + F.col("yn"))
        pairs = materialize(_possible(both).join(tested, ["a", "b"], "left_anti"), "candidates")
        for path in (heads, opened):
            remove(docs.sparkSession, path)
        found = found.union(_verified(pairs, docs, tagged))
        if not (nth < rounds and large):
            break
        tested = tested.union(pairs)
    return found


_ROW = ("cls", "n", "at")


def _possible(both: DataFrame) -> DataFrame:
    """Pairs that can have a similarity of 0.8, from the shingles that their prefixes share.

    From a shared shingle on no more can be equal than either class has left in the order. The
    first shingle that similar classes share lies in both prefixes, and all that they share follow.
    """
    left = F.least(F.col("xn") - F.col("xat"), F.col("yn") - F.col("yat"))
    return _ordered(both.where(9 * left >= 4 * (F.col("xn") + F.col("yn"))), "xcls", "ycls")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """``doc_id`` and ``component_id`` of every document.

    Documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more are
    linked; wordless and null texts are equal texts. The component is the smallest
    ``doc_id`` that can be reached, null if no row of the group has an id.
    """
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chosen = chosen.withColumns({_TEXT_KEY[0]: F.xxhash64("text"), _TEXT_KEY[1]: F.xxhash64(F.lit(1), "text")})
    tagged = materialize(chosen.mapInArrow(_classes, "doc_id long, t1 long, t2 long, cls long, fp long"), "classes")
    roots = connected(links(chosen, tagged, **limits), rows_per_task=LINKS)
    grouped = tagged.join(roots, F.col("cls") == F.col("node"), "left").select("doc_id", F.coalesce("root", "cls").alias("root"))
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(least, "root").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """The documents with one row of each group of near copies, see ``simhash_trie.first_of_groups``."""
    return simhash_trie.first_of_groups(docs, near_copies(docs, key, text, **limits), key, text)
