"""URL filter: rules for hosts and paths, and boosted trees where no rule applies.

Rules label the URLs they fit. Gradient-boosted trees are trained on all labelled URLs, on
lexical features alone, and judge the others. Host, path, rules and features are SQL
expressions; the trees are Spark's.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetide.runtime import materialize

ALLOW, BLOCK = "allow", "block"
#: (verdict, host/path): fits the host and its subdomains where the path starts that way.
RULES = (
    (ALLOW, "org/"),
    (BLOCK, "example.org/es/"),
    (BLOCK, "example.org/en/1"),
    (ALLOW, "com/fr/"),
    (BLOCK, "com/de/"),
)
TREES, DEPTH = 20, 4
#: Labelled URLs that a suffix's block rate counts in addition, at the overall rate.
PRIOR = 20.0

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "host_digits", "hyphens",
    "entropy", "parameters", "fragment", "secure", "suffix_rate", "suffix_urls", "domain_rate",
    "domain_urls", "ending_rate", "head_rate",
)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest fitting rule as a struct ``verdict``, ``rule``; null if none fits.

    Of rules of equal length the first in alphabetical order counts.
    """
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits per character. A text of n characters has at most n different ones."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")

    def add(total: Column, char: Column) -> Column:
        share = (F.length(text) - F.length(F.replace(text, char, F.lit("")))) / size
        return total - share * F.log2(share)

    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda t, c: F.when(c == "", t).otherwise(add(t, c)))


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (with ``url``, ``host`` and ``path``) plus the features of the URL alone."""
    url, query = F.coalesce("url", F.lit("")), F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1)
    return urls.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
            "host_labels": F.regexp_count("host", F.lit(r"[^.]+")).cast("double"),
            "digit_ratio": _share(url, "[0-9]"),
            "host_digits": _share(F.col("host"), "[0-9]"),
            "hyphens": F.regexp_count(url, F.lit("[-_]")).cast("double"),
            "entropy": _entropy(url),
            "parameters": F.regexp_count(query, F.lit("[^&;]+")).cast("double"),
            "fragment": F.contains(url, F.lit("#")).cast("double"),
            "secure": F.startswith(F.lower(url), F.lit("https:")).cast("double"),
            "suffix": F.substring_index("host", ".", -1),
            "domain": F.substring_index("host", ".", -2),
            "head": F.regexp_extract("path", "^/([^/]*)", 1),
            "ending": F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})/?$", 1),
        }
    )


def rates(rows: DataFrame, labelled: DataFrame, by: str, n: int, bad: float) -> DataFrame:
    """``rows`` with the smoothed block rate and the number of labelled URLs of their ``by``.

    A labelled row does not count itself, in either number, so its own label is not among its
    features. ``n`` and ``bad`` are those of all labelled rows.
    """
    each = labelled.groupBy(F.col(by).alias("_value")).agg(F.sum("label").alias("_bad"), F.count("*").alias("_n"))
    known = rows.join(each, F.col(by) == F.col("_value"), "left")
    own, one = F.coalesce("label", F.lit(0.0)), F.when(F.col("label").isNotNull(), 1).otherwise(0)
    overall = (F.lit(bad) - own) / F.greatest(F.lit(n) - one, F.lit(1))
    others = F.coalesce("_n", F.lit(0)) - one
    rate = (F.coalesce("_bad", F.lit(0.0)) - own + PRIOR * overall) / (others + PRIOR)
    return known.select(*rows.columns, rate.alias(f"{by}_rate"), F.log1p(others).alias(f"{by}_urls"))


def train(examples: DataFrame, trees: int = TREES, depth: int = DEPTH) -> GBTClassificationModel:
    """Boosted trees on all rows of ``examples`` with ``features`` and ``label`` 0 or 1."""
    grower = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, maxBins=64, minInstancesPerNode=5)
    return grower.fit(examples)


def labelled_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Lexical features of every page's url, with the ``label`` of the rule that fits it (1: block), if any."""
    base = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"))
    base = base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    base = base.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    return lexical(base).withColumn("label", F.when(F.col("_rule.verdict") == BLOCK, 1.0).when(F.col("_rule").isNotNull(), 0.0))


def scored(parsed: DataFrame, n: int, bad: float) -> DataFrame:
    """The rows without a label, with the ``block_score`` of trees that learn from all others."""
    labelled = parsed.where("label IS NOT NULL")
    known = reduce(lambda df, by: rates(df, labelled, by, n, bad), ("suffix", "domain", "ending", "head"), parsed)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(known)
    model = train(materialize(vectors.where("label IS NOT NULL").select("features", "label"), "labelled-urls"))
    judged = model.transform(vectors.where("label IS NULL"))
    return judged.withColumn("block_score", vector_to_array("probability")[1])


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Per page ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``block_score``.

    A null URL, and one without ``://``, has an empty host and path and fits no rule. If the
    rules label no URL, or all alike, the others get the same verdict, or allow. Rows are
    judged one by one, repeated ones too; the score is null where a rule decides.
    """
    parsed = materialize(labelled_urls(pages, key, url, rules), "urls")
    labelled = parsed.where("label IS NOT NULL")
    n, bad = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    shown = ["page_id", "host", "path", F.col("_rule.rule").alias("rule")]
    if not 0 < bad < n:
        other = BLOCK if n and bad else ALLOW
        return parsed.select(*shown, F.coalesce("_rule.verdict", F.lit(other)).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    ruled = labelled.select(*shown, F.col("_rule.verdict").alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    told = F.when(F.col("block_score") >= 0.5, BLOCK).otherwise(ALLOW)
    return ruled.union(scored(parsed, n, bad).select(*shown, told.alias("verdict"), "block_score"))
