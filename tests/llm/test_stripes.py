import random
import re
from collections import Counter

import pytest

from casetide.llm import stripes as S

DOCS = "doc_id long, text string, lang string, tile string, prefix string, n string"
SF = "/root/testdata/sf0.01"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_count, per_lang):
    """``rows``: text and language."""
    f = {}
    for text, lang in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            for k in (1, 2, 3):
                own.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in f.items():
        n = sum(v for w, v in own.items() if len(w) == 1)
        many = {w: a for w, a in own.items() if len(w) > 1 and a >= min_count}
        longest = Counter()
        for w, a in many.items():
            if len(w) == 3:
                for part in (w[:2], w[1:]):
                    longest[part] = max(longest[part], a)
        found = []
        for w, a in many.items():
            if w in longest and 100 * longest[w] >= 50 * a:
                continue
            cuts = [(1_000_000 * a * a // (own[w[:k]] * own[w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(w).encode(), own[w[:k]], own[w[k:]]))
        for rank, (s, a, w, x, y) in enumerate(sorted(found)[:per_lang], 1):
            out.append((lang, rank, w.decode(), -a, x, y, n, -s))
    return sorted(out)


def test_query_equals_brute_force(spark):
    from casetide.llm.catalog import op11_stripes

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()]
    assert sorted(map(tuple, op11_stripes(spark, SF).collect())) == brute(docs, 10, 2000)


@pytest.fixture(scope="module")
def mixed():
    """Few words, so that phrases repeat, overlap and subsume each other."""
    rng = random.Random(5)
    docs = []
    for i in range(120):
        words = rng.choices(["a", "b", "ä", "New", "york", "city", "the", "の"], [9, 4, 3, 2, 2, 2, 9, 1], k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ";"]) for w in words)
        docs.append((i, text, rng.choice(["en", "en", "de", None]), "x", "y", "z"))
    docs += [(None, None, "en", "", "", ""), (1, "", "xx", "", "", ""), (1, " . \t;", "de", "", "", "")]
    return docs + [(7, "the new york city. " * 3, "en", "", "", "")] * 20


@pytest.mark.parametrize("sizes", [{}, {"tile_bytes": 300, "flush_words": 50}, {"tile_bytes": 900, "sample": 0}])
def test_odd_rows_and_small_tiles(spark, mixed, sizes):
    df = spark.createDataFrame(mixed, DOCS).repartition(3)
    for min_count, per_lang in ((2, 2000), (6, 5)):
        out = sorted(map(tuple, S.phrases(df, min_count=min_count, per_lang=per_lang, **sizes).collect()))
        assert out == brute([(r[1], r[2]) for r in mixed], min_count, per_lang)


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert S.phrases(df).count() == 0
    assert S.phrases(spark.createDataFrame([(1, None, None, "", "", "")], DOCS)).count() == 0


def test_very_long_text_is_cut_where_pieces_end():
    text = b"aa bb, cc " * (S._SPAN // 5) + b"dd"
    spans = list(S.words_of(text))
    assert len(spans) > 1 and all(s[-1] == b"." for s in spans[:-1])
    assert sum(spans, []) == text.replace(b",", b" .").split()


def test_a_word_of_a_third_of_all_is_cut(spark):
    """The stripe of a very frequent word lies in many tiles."""
    docs = [(f"the w{i} x{i}",) for i in range(2000)]
    df = spark.createDataFrame(docs, "text string").selectExpr("'en' AS lang", "CAST(text AS BINARY) AS text")
    hot = S._hot_words(df, 2000, 4000, S.FLUSH_WORDS)
    assert abs(hot[b"the"] - 1 / 3) < 0.01
    read = S._Read()
    for r in df.collect():
        read.add(r["lang"], bytes(r["text"]))
    tiles = set()
    for batch in S._emitted(read, S._word_stripes, {b"the": 10}, 30):
        for tile, _, packed in zip(*batch, strict=True):
            stripes = S.pa.ipc.open_stream(packed.as_buffer()).read_all()
            tiles |= {tile.as_py()} if "the" in stripes["prefix"].to_pylist() else set()
    assert len(tiles) == 10


def test_scores_are_exact(spark):
    n = 10**14 + 7
    df = spark.createDataFrame([(n, n + 1, n + 5)], "a long, l long, r long")
    assert df.select(S._score("a", "l", "r")).first()[0] == 1_000_000 * n * n // ((n + 1) * (n + 5))
