"""The queries of this package, each over a whole given table, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetide.llm import (
    bit_codes,
    decontaminate,
    forest,
    line_runs,
    packing,
    quality_gam,
    sharding,
    simhash_trie,
    stripes,
    token_files,
    url_trees,
    warc,
    wrapper,
)
from casetide.llm.tables import given, shipped

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(given(spark, sf_dir, "documents"), given(spark, sf_dir, "benchmark"))


def op2_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trees.judge(given(spark, sf_dir, "pages"))


def op3_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(given(spark, sf_dir, "embeddings"))


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.judge(given(spark, sf_dir, "documents"), given(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(given(spark, sf_dir, "pages")).drop("url", "payload")


def op6_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(given(spark, sf_dir, "documents"))


def op7_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_duplicates(given(spark, sf_dir, "documents"))


def op8_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(given(spark, sf_dir, "documents"), with_ids=False)


def op9_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(given(spark, sf_dir, "pages"))


def op10_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.stored(given(spark, sf_dir, "documents"), with_ids=False)


def op11_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stripes.phrases(given(spark, sf_dir, "documents"))


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.without_common_lines(given(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return bit_codes.mined(given(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0"), label=label)


def queries() -> dict[str, Query]:
    def over(build: Query) -> Query:
        return lambda spark, sf_dir: build(shipped(spark), sf_dir)

    return {name: over(build) for name, build in globals().items() if name.startswith("op") and callable(build)}


# SHA-1 in base 32: 40 hex digits are eight groups of five, each four letters.
_WARC = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x,
                 min(page_id) OVER (PARTITION BY h) AS least FROM p)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr(
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + ((('0x' || substr(x, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)
           ), '') AS payload_digest,
           CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> least THEN least END AS refers_to
    FROM q"""


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_LINES = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
    k AS (SELECT *, translate(trim(line, {_BLANKS}), {_LOWER}) AS key FROM l),
    c AS (SELECT key, TRUE AS common FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(common)::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE common IS NULL), '')) AS kept_sha256
    FROM k LEFT JOIN c USING (key) GROUP BY r, doc_id"""


_PHRASES = f"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                 translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM (
            SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase
            FROM w, (VALUES (1), (2), (3)) AS sizes(k)) GROUP BY ALL),
    t AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
    cut AS (SELECT lang, phrase, k, a, p, array_to_string(ws[1 : p], ' ') AS x, array_to_string(ws[p + 1 : k], ' ') AS y
            FROM c, (VALUES (1), (2)) AS cuts(p) WHERE p < k),
    scored AS (SELECT cut.*, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
               FROM cut JOIN f AS l ON l.lang = cut.lang AND l.phrase = x JOIN f AS r ON r.lang = cut.lang AND r.phrase = y),
    one AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, p) = 1),
    inner_ AS (SELECT lang, phrase, max(f) AS longest FROM (
            SELECT lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase, a AS f FROM c WHERE k = 3) GROUP BY ALL),
    kept AS (SELECT one.* FROM one LEFT JOIN inner_ USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
           a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM kept JOIN t USING (lang) QUALIFY rank <= 2000"""


_NEGATIVES = """
    WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
          FROM q AS a JOIN q AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
           id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY rank <= 3"""


def oracle_sql() -> dict[str, str]:
    """Statements for the queries that SQL can express: no tokenizer, XXH64 or model."""
    return {"op5_warc": _WARC, "op11_stripes": _PHRASES, "op12_line_runs": _LINES, "op13_bit_codes": _NEGATIVES}
