import math
from collections import Counter

import pytest

from casetide.llm import url_trees as U

PAGES = "page_id long, url string, host string, verdict string, label string"
URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.org", "https://EXAMPLE.org/", "https://a.b.Example.ORG/en/12?x=1#y",
    "https://example.org/es/1", "https://x.example.org/en/2", "http://com/fr/", "http://xcom/fr/1", "http://a.com/fr/1", "http://a.com/fr",
    "http://a.com/de/x.html", "http://a.com?u=http://b.org/", "http://a.com#/fr/", "ftp://É.com/DE/", "//x.org/", "http://org/", "http://a.org:80/",
    "http://user@b.org/es/", "x://y://z.org/p", "http://a.net/" + "long/" * 5000, "http://a.net/a\nb/c", "http://a.com/de/", "http://a.com/de/2",
]


def plain(url):
    """Host, path and rule by the definition."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url[url.index("://") + 3 :]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    rest = rest[cut:]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fit = []
    for verdict, rule in U.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fit.append((len(rule), rule, verdict))
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "h", "v", "l") for i, u in enumerate(URLS)], PAGES)
    rows = {r["page_id"]: r for r in U.judge(df).collect()}
    assert len(rows) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule, verdict = plain(url)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule), url
        assert rows[i]["verdict"] in ("allow", "block") and (not rule or rows[i]["verdict"] == verdict)


def test_features(spark):
    url = "https://a1.b-c.net/x/yy/z9.html?p=1&q=2&r#f"
    df = spark.createDataFrame([(url, "a1.b-c.net", "/x/yy/z9.html"), (None, "", "")], "url string, host string, path string")
    row, none = U.lexical(df).collect()
    shares = [n / len(url) for n in Counter(url).values()]
    assert abs(row["entropy"] + sum(s * math.log2(s) for s in shares)) < 1e-9
    wanted = {"url_length": len(url), "depth": 3, "host_labels": 3, "parameters": 3, "hyphens": 1, "fragment": 1, "secure": 1, "suffix": "net", "ending": "html"}
    assert {k: row[k] for k in wanted} == wanted
    assert abs(row["digit_ratio"] - sum(c.isdigit() for c in url) / len(url)) < 1e-12
    assert none["entropy"] == 0 and none["depth"] == 0


@pytest.mark.parametrize("rules,verdict", [((), "allow"), ((("allow", "com/"),), "allow"), ((("block", "com/"),), "block")])
def test_without_two_kinds_of_labels(spark, rules, verdict):
    df = spark.createDataFrame([(1, "http://a.com/x", "", "", ""), (2, "http://a.net/x", "", "", ""), (None, None, None, None, None)], PAGES)
    rows = U.judge(df, rules=rules).collect()
    assert len(rows) == 3 and all(r["verdict"] == verdict for r in rows)
    assert U.judge(df.limit(0), rules=rules).count() == 0


def test_trees_learn_from_labelled_urls(spark):
    made = [(i, f"http://h{i % 7}.{'bad' if i % 3 else 'good'}.{'com' if i % 2 else 'net'}/{'9' * 8 if i % 3 else 'abc'}/x", "", "", "") for i in range(400)]
    df = spark.createDataFrame(made, PAGES)
    rules = [("allow", "good.com/"), ("block", "bad.com/")]
    wrong = [r for r in U.judge(df, rules=rules).where("rule IS NULL").collect() if (r["verdict"] == "block") != ("bad" in r["host"])]
    assert not wrong


def test_query_over_all_pages(spark):
    from casetide.llm.catalog import op2_url_trees

    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    rows = {r["page_id"]: r for r in op2_url_trees(spark, sf).collect()}
    assert len(rows) == len(pages)
    for page_id, url in pages:
        host, path, rule, verdict = plain(url)
        r = rows[page_id]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["block_score"] >= 0.5 else "allow"))


def test_rates_leave_out_the_row_itself(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0), ("c", None), ("a", None)], "suffix string, label double")
    found = {(r["suffix"], r["label"]): (r["suffix_rate"], r["suffix_urls"]) for r in U.rates(rows, rows.where("label IS NOT NULL"), "suffix", 3, 2.0).collect()}
    p = U.PRIOR
    assert found["a", 1.0] == (pytest.approx((0 + p * 0.5) / (1 + p)), pytest.approx(math.log1p(1)))
    assert found["b", 1.0] == (pytest.approx(0.5), 0.0)
    assert found["c", None] == (pytest.approx(2 / 3), 0.0)
    assert found["a", None] == (pytest.approx((1 + p * 2 / 3) / (2 + p)), pytest.approx(math.log1p(2)))


def test_trees_are_right_on_labelled_urls_held_out(spark):
    """A third of the given table's labelled URLs loses its label; the trees give it back better than a guess."""
    from pyspark.sql import functions as F

    parsed = U.labelled_urls(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).where("label IS NOT NULL")
    unseen = F.pmod(F.xxhash64("page_id"), F.lit(3)) == 0
    wanted = parsed.where(unseen).select("page_id", F.col("label").alias("wanted"))
    hidden = parsed.withColumn("label", F.when(~unseen, F.col("label")))
    n, bad = hidden.agg(F.count("label"), F.sum("label")).first()
    found = U.scored(hidden, n, bad).join(wanted, "page_id")
    right, share, rows = found.agg(F.avg(((F.col("block_score") >= 0.5) == (F.col("wanted") == 1)).cast("double")), F.avg("wanted"), F.count("*")).first()
    assert rows > 100 and right > max(share, 1 - share) + 0.5 * min(share, 1 - share), (right, share, rows)
