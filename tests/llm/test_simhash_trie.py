import numpy as np
import pytest
import xxhash

from casetide.llm import simhash_trie as S
from casetide.llm.components import connected

SCHEMA = "doc_id long, text string, component_id string"


def plain(text):
    """The definition, word by word."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius=4):
    ids = list(range(len(prints)))

    def find(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                ids[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprint_follows_the_definition():
    words = "The quick BROWN fox x jumps\tover é É the lazy dog\r\nagain".split(" ")
    for text in [None, "", " \n\t", "one", "One two\nthree", " ".join(words), " ".join(words * 7)]:
        assert S.simhash(text) == plain(text)


def test_long_text_is_hashed_in_blocks(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(900))
    whole = S.simhash(text)
    monkeypatch.setattr(S, "_HASHES", 10)
    assert S.simhash(text) == whole == plain(text)


@pytest.mark.parametrize("node_rows,call_rows", [(20_000, 200_000), (4, 30)])
def test_links_equal_brute_force(spark, node_rows, call_rows):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(base[0]) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2)) if a != b]
    more = [int(base[i % 40]) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, 1 + i % 6))) for i in range(200)]
    prints = list(dict.fromkeys([0, (1 << 64) - 1, *map(int, base), *near, *more]))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = connected(S.links(table, 4, node_rows, call_rows)).collect()
    root = {r["node"]: r["root"] for r in found}
    wanted = components(prints)
    groups, mine = {}, {}
    for p, w in zip(signed, wanted, strict=True):
        groups.setdefault(w, set()).add(p)
        mine.setdefault(root.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_documents_with_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(20_000))
    docs = [(5, "a b c d e f", "x"), (2, "A  b\nc d e f", None), (9, None, "x"), (7, "", "x"), (8, long, "x"),
            (1, long, "x"), (1, long, "x"), (None, "a b c d e f", "x"), (None, None, "x"), (3, "other words", "x")]
    df = spark.createDataFrame(docs, SCHEMA)
    out = S.near_duplicates(df).collect()
    assert len(out) == len(docs)
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in out) == sorted(
        [(5, 2), (2, 2), (9, 7), (7, 7), (8, 1), (1, 1), (1, 1), (-1, 2), (-1, 7), (3, 3)]
    )
    kept = S.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 1, 2, 3, 7]


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_brute_force(spark):
    from casetide.llm.catalog import op7_simhash_trie

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [plain(d["text"]) for d in docs]
    wanted = [(d["doc_id"], f"{p:016x}", docs[w]["doc_id"]) for d, p, w in zip(docs, prints, components(prints), strict=True)]
    assert sorted(map(tuple, op7_simhash_trie(spark, sf).collect())) == wanted


def test_components_of_a_long_path(spark):
    ends = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    found = {r["node"]: r["root"] for r in connected(spark.createDataFrame(ends, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}
