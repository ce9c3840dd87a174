"""Phrase collocations by stripes: each prefix keys a counter of the words that follow it.

Tasks read texts and keep, for every prefix, an associative counter of next words, with an
end mark where a piece ends. Whenever a task has read enough it sends its stripes on; stripes
of equal prefixes are merged elementwise. From the stripes of single words come the totals of
the words (the sum of a stripe) and all phrases of two words (its elements); from those of
word pairs the phrases of three. A phrase is subsumed by the largest element of its own stripe
or of a stripe that ends in it.

Pairs of which too few occur cannot be in a phrase of three that counts, so the second pass
makes stripes only where both pairs are frequent, looked up in a bitmap of fixed size. It has
no false negatives, and the exact counts decide.

Stripes go to tiles by a hash of their prefix, many of a task and tile in one packed row. Stripes
of very frequent words, whose share is known from a sample, are cut by their next words into as
many slices as they would fill tiles; the sample decides where elements are merged, never what is
counted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetide.llm.tables import parts_for
from casetide.runtime import materialize

MIN_COUNT = 10
#: A phrase goes if one that contains it has this share (in percent) of its occurrences.
SUBSUMED = 50
PER_LANG = 2_000
UNKNOWN = "und"

#: Bytes of text whose stripes are merged in one group, about.
TILE_BYTES = 4_000_000
#: Words after which a task sends its stripes on.
FLUSH_WORDS = 2_000_000
#: Documents in which very frequent words are counted, and the least share that is noted.
SAMPLE = 4_000
HOT_SHARE = 1e-5
#: Bits of a place in the bitmap of frequent pairs: 16 MB, whatever the corpus.
SPOT_BITS = 27
#: Bytes of a text that are cut into words at once.
_SPAN = 1 << 22

# No word holds it: it is one of the marks at which texts are cut.
_END = b"."
_CUTS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

STRIPES = "tile int, lang string, stripes binary"
_PACKED = pa.schema([("prefix", pa.string()), ("next", pa.list_(pa.string())), ("n", pa.list_(pa.int32()))])
MERGED = "lang string, prefix string, next string, n long, spot long"


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Words and end marks of a text, span by span; a span ends where a piece does."""
    text, at = text.lower().translate(_CUTS), 0
    while at < len(text):
        stop = text.find(_END, at + _SPAN) + 1 or len(text)
        yield text[at:stop].replace(_END, b" . ").split()
        at = stop


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    out = first * _MIX[0] + second
    out ^= out >> np.uint64(32)
    out *= _MIX[1]
    return out ^ (out >> np.uint64(29))


def _spots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places of word pairs in the bitmap."""
    return (_mixed(first, second) >> np.uint64(64 - SPOT_BITS)).astype(np.int64)


def _strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


class _Numbers(dict):
    """Number of each word; a new word gets the next one. The end mark is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Read:
    """Words of some texts as numbers, by language."""

    def __init__(self):
        self.number, self.parts, self.size = _Numbers({_END: 0}), {}, 0

    def add(self, lang: str, text: bytes) -> None:
        parts = self.parts.setdefault(lang, [])
        for words in words_of(text):
            parts.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
            self.size += len(words)
        parts.append(np.zeros(1, np.int64))


def _word_stripes(codes: np.ndarray, hashes: np.ndarray, slices: np.ndarray):
    """Elements of the stripes of single words: prefix, next word, count, and where they go."""
    first, second = codes[:-1], codes[1:]
    keys, counts = np.unique((first << 32 | second)[first > 0], return_counts=True)
    first, second = keys >> 32, keys & 0xFFFFFFFF
    return first, second, counts, hashes[first] + hashes[second] % slices[first]


def _pair_stripes(frequent: np.ndarray):
    """The same for word pairs; a prefix is two numbers in one. Both pairs must be frequent."""

    def build(codes: np.ndarray, hashes: np.ndarray, slices: np.ndarray):
        pairs, at = np.unique(codes[:-1] << 32 | codes[1:], return_inverse=True)
        first, second = pairs >> 32, pairs & 0xFFFFFFFF
        spot = _spots(hashes[first], hashes[second])
        good = (first > 0) & (second > 0) & ((frequent[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1).astype(bool)
        good = good[at]
        both = np.nonzero(good[:-1] & good[1:])[0]
        third = codes[both + 2]
        # Both numbers are below 2 ** 31: a pair's place and the third word fit one key.
        keys, counts = np.unique(at[both] << 32 | third, return_counts=True)
        prefix, third = pairs[keys >> 32], keys & 0xFFFFFFFF
        first, second = prefix >> 32, prefix & 0xFFFFFFFF
        # A pair has no more of all words than either of its words.
        place = _mixed(hashes[first], hashes[second]) + hashes[third] % np.minimum(slices[first], slices[second])
        return prefix, third, counts, place

    return build


def _packed_rows(stripes: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, stripes.schema) as out:
        out.write_batch(stripes)
    return sink.getvalue().to_pybytes()


def _emitted(read: _Read, build: Callable, slices: dict[bytes, int], tiles: int) -> Iterator[pa.RecordBatch]:
    """The stripes of what was read, a row per tile and language."""
    known = list(read.number)
    words, hashes = _strings(known), _hashes(known)
    cut = np.fromiter((slices.get(w, 1) for w in known), np.uint64, len(known))
    for lang, parts in read.parts.items():
        prefix, following, counts, place = build(np.concatenate(parts), hashes, cut)
        if not len(prefix):
            continue
        tile = (place % np.uint64(tiles)).astype(np.int32)
        order = np.lexsort((prefix, tile))
        prefix, following, counts, tile = prefix[order], following[order], counts[order], tile[order]
        starts = np.nonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (tile[1:] != tile[:-1]))))[0]
        ends, own = np.append(starts[1:], len(prefix)), tile[starts]
        firsts = np.nonzero(np.concatenate(([True], own[1:] != own[:-1])))[0]
        rows = []
        for a, b in zip(firsts, np.append(firsts[1:], len(own)), strict=True):
            lo, hi = starts[a], ends[b - 1]
            offsets = pa.array(np.append(starts[a:b], hi) - lo, pa.int32())
            names, high = words.take(pa.array(prefix[starts[a:b]] & 0xFFFFFFFF)), prefix[starts[a:b]] >> 32
            if high.any():
                names = pc.binary_join_element_wise(words.take(pa.array(high)), names, " ")
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (words.take(pa.array(following[lo:hi])), pa.array(counts[lo:hi], pa.int32()))]
            rows.append(_packed_rows(pa.RecordBatch.from_arrays([names, *lists], schema=_PACKED)))
        yield pa.RecordBatch.from_arrays([pa.array(own[firsts]), pa.array([lang] * len(rows), pa.string()), pa.array(rows, pa.binary())], ["tile", "lang", "stripes"])


def _read_all(flush_words: int, emit: Callable[[_Read], Iterator[pa.RecordBatch]]):
    """Read texts, and emit what was read whenever it is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Read()
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                read.add(lang.as_py(), text.as_py())
                if read.size >= flush_words:
                    yield from emit(read)
                    read = _Read()
        yield from emit(read)

    return run


def _stripes(docs: DataFrame, build: Callable, slices: dict[bytes, int], tiles: int, flush_words: int) -> DataFrame:
    return docs.mapInArrow(_read_all(flush_words, lambda read: _emitted(read, build, slices, tiles)), STRIPES)


def _merge(least: int):
    """Stripes of one tile merged elementwise: a row per stripe with its sum, and one per
    element that is a word and counts ``least`` or more."""

    def run(table: pa.Table) -> pa.Table:
        packed = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in table["stripes"].combine_chunks()]
        rows = [len(x) for x in packed]
        langs = table["lang"].combine_chunks().dictionary_encode()
        stripes = pa.concat_tables(packed).combine_chunks()
        prefix, lists = stripes["prefix"].combine_chunks().dictionary_encode(), stripes["next"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        following, counts = lists.flatten().dictionary_encode(), stripes["n"].combine_chunks().flatten().to_numpy().astype(np.int64)
        own = np.repeat(langs.indices.to_numpy().astype(np.int64), rows) << 32 | prefix.indices.to_numpy()
        keys, at = np.unique(own, return_inverse=True)
        totals = np.zeros(len(keys), np.int64)
        elements = np.repeat(at, sizes) << 32 | following.indices.to_numpy()
        order = np.argsort(elements, kind="stable")
        elements, counts = elements[order], counts[order]
        starts = np.nonzero(np.concatenate(([True], elements[1:] != elements[:-1])))[0]
        elements, counts = elements[starts], np.add.reduceat(counts, starts)
        np.add.at(totals, elements >> 32, counts)
        end = following.dictionary.index(_END.decode()).as_py()
        good = (counts >= least) & ((elements & 0xFFFFFFFF) != end)
        elements, counts = elements[good], counts[good]
        of, word = elements >> 32, elements & 0xFFFFFFFF
        every = np.concatenate((np.arange(len(keys)), of))
        names = prefix.dictionary.take(pa.array(keys[every] & 0xFFFFFFFF))
        nexts = following.dictionary.take(pa.array(word))
        hashes = [_hashes([w.encode() for w in x.to_pylist()]) for x in (names[len(keys) :], nexts)]
        return pa.Table.from_arrays([
            langs.dictionary.take(pa.array(keys[every] >> 32)), names,
            pa.concat_arrays([pa.nulls(len(keys), pa.string()), nexts]),
            pa.array(np.concatenate((totals, counts))),
            pa.concat_arrays([pa.nulls(len(keys), pa.int64()), pa.array(_spots(*hashes))]),
        ], ["lang", "prefix", "next", "n", "spot"])

    return run


def _merged(stripes: DataFrame, least: int, label: str) -> DataFrame:
    return materialize(stripes.groupBy("tile").applyInArrow(_merge(least), MERGED), label)


def _hot_words(docs: DataFrame, rows: int, sample: int, flush_words: int) -> dict[bytes, float]:
    """Words with at least ``HOT_SHARE`` of a sample's words, so at most 1 / ``HOT_SHARE``, and their shares."""

    def emit(read: _Read) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate([np.zeros(0, np.int64), *(x for parts in read.parts.values() for x in parts)])
        counts = np.bincount(codes, minlength=len(read.number))[1:]
        yield pa.RecordBatch.from_arrays([_strings(list(read.number)[1:]), pa.array(counts)], ["word", "n"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(min(1.0, sample / max(1, rows)) * 1_000_000))
    counts = some.mapInArrow(_read_all(flush_words, emit), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "sampled-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r["word"].encode(): r["n"] / total for r in counts.where(F.col("n") >= F.lit(HOT_SHARE * total)).collect()}


def _bitmap(spots: DataFrame) -> np.ndarray:
    """Bitmap of the places ``spot``, built in parts of 4 KB; its size does not depend on the data."""
    place = F.col("spot") + 1
    parts = spots.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(1 << (SPOT_BITS - 3), np.uint8)
    for row in parts.collect():
        bits = np.frombuffer(row["bits"], np.uint8)
        out[(row["part"] - 1) * len(bits) :][: len(bits)] = bits
    return out


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)), exact for counts below 10 ** 15."""
    n = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {n(a)} * {n(a)}) div ({n(l)} * {n(r)})")


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, tile_bytes: int = TILE_BYTES, flush_words: int = FLUSH_WORDS, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The merged stripes: all words, and the phrases of two and of three with ``min_count`` or more.

    Columns ``lang``, ``w`` (a word, or words with a space between) and ``f``; for phrases
    ``head`` and ``tail`` (their last word) besides.
    """
    chosen = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    rows, size = chosen.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    tiles = parts_for(size, tile_bytes)
    hot = {w: math.ceil(share * tiles) for w, share in _hot_words(chosen, rows, sample, flush_words).items()}
    one = _merged(_stripes(chosen, _word_stripes, hot, tiles, flush_words), min_count, "word-stripes")
    words = one.where("next IS NULL").groupBy("lang", F.col("prefix").alias("w")).agg(F.sum("n").alias("f"))
    two = one.where("next IS NOT NULL")
    three = _merged(_stripes(chosen, _pair_stripes(_bitmap(two)), hot, tiles, flush_words), min_count, "pair-stripes")
    named = [F.col("lang"), F.concat_ws(" ", "prefix", "next").alias("w"), F.col("prefix").alias("head"), F.col("next").alias("tail"), F.col("n").alias("f")]
    return materialize(words, "words"), two.select(*named), three.where("next IS NOT NULL").select(*named)


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, per_lang: int = PER_LANG, **sizes: int) -> DataFrame:
    """The best collocations of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``,
    ``r``, ``n`` and ``score``.

    Words are what lies between blanks and tabs in the pieces between punctuation and line
    ends, in ASCII lower case. Phrases have two or three words and occur ``min_count`` times or
    more. ``l`` and ``r`` belong to the cut that scores lowest, at the first such place. A null
    language is ``und``; null and empty texts have no words; repeated rows count each; ties go
    by occurrences, then by the phrase. An empty table gives no rows. Other columns are not read.
    """
    words, two, three = counted(docs, text, lang, min_count, **sizes)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    known = words.where(F.col("f") >= min_count)

    def with_f(table: DataFrame, of: DataFrame, column: str, name: str) -> DataFrame:
        found = of.select(F.col("lang"), F.col("w").alias(column), F.col("f").alias(name))
        return table.join(found, ["lang", column])

    pairs = with_f(with_f(two, known, "head", "l"), known, "tail", "r").withColumn("score", _score("f", "l", "r"))
    # The two cuts of three words: after the first, and before the last.
    cut = three.withColumns({"first": F.substring_index("head", " ", 1), "rest": F.concat_ws(" ", F.substring_index("head", " ", -1), "tail")})
    for column, of, name in (("first", known, "l1"), ("rest", two, "r1"), ("head", two, "l2"), ("tail", known, "r2")):
        cut = with_f(cut, of, column, name)
    cut = cut.withColumns({"s1": _score("f", "l1", "r1"), "s2": _score("f", "l2", "r2")})
    early = F.col("s1") <= F.col("s2")
    cut = cut.withColumns({"l": F.when(early, F.col("l1")).otherwise(F.col("l2")), "r": F.when(early, F.col("r1")).otherwise(F.col("r2")), "score": F.least("s1", "s2")})
    # Largest extension of each pair, to the right (its own stripe) and to the left.
    longest = cut.select("lang", F.explode(F.array("head", "rest")).alias("w"), "f").groupBy("lang", "w").agg(F.max("f").alias("longest"))
    free = pairs.join(longest, ["lang", "w"], "left").where(f"longest IS NULL OR 100 * longest < {SUBSUMED} * f")
    chosen = [F.col("lang"), F.col("w").alias("phrase"), F.col("f").alias("a"), "l", "r", "score"]
    every = free.select(*chosen).unionByName(cut.select(*chosen))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
