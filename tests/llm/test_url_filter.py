import re

from pyspark.sql import functions as F

from rainshed.llm import url_filter as U
from rainshed.llm.queries import URL_RULES

URLS = [
    None,
    "",
    "no scheme/here",
    "http://ORG",
    "http://org/",
    "https://A.Example.ORG/es/x?y#z",
    "https://example.org/en/123",
    "https://example.org/en/2",
    "http://notexample.org/es/",
    "http://x.com/fr/",
    "http://x.com/de/1",
    "http://com/de/",
    "http://com?/de/",
    "http://x.com/fr#/de/",
    "a://b://c/d",
    "http://ÄB.org/Ä\n/x",
    "http://x.net/" + "long/" * 30_000,
    "http://x.net/en/7",
    "http://x.net/en/7",
]


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text)) if fits else None


def test_parts_rules_and_verdicts(spark):
    d = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("score", F.lit("x")).withColumn("rule", F.lit("y"))
    rows = {r.page_id: r for r in U.judge(d, URL_RULES).collect()}
    assert len(rows) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = parts(url)
        r = rule(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, r.text if r else None), url
        assert rows[i].verdict == (r.verdict if r else ("allow" if rows[i].score >= 0.5 else "block"))
    assert rows[17].score == rows[18].score


def test_model_learns_from_a_small_table_and_generalises(spark):
    good = [(f"news{i}.site.net", f"/articles/{i}/story", "allow") for i in range(60)]
    bad = [(f"win{i}.casino.net", f"/bonus/{i}/free-spins", "block") for i in range(60)]
    labelled = spark.createDataFrame(good + bad, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://blog.site.net/articles/999/x"), (2, "http://m.casino.net/bonus/777/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge(pages, [], labelled).collect()}
    assert got == {1: "allow", 2: "block"}


def test_hashed_grams_and_margin_equal_a_plain_computation(spark):
    p = U.Params(width=64)
    model = U.Model(p, 0.25, tuple((i % 7 - 3) / 10 for i in range(64)))
    d = spark.createDataFrame([("ab.net", "/x/é"), ("", "")], "host string, path string")
    for r in d.select("host", "path", U.buckets(F.col("host"), F.col("path"), p).alias("g"), U.margin(U.buckets(F.col("host"), F.col("path"), p), model).alias("m")).collect():
        assert len(r.g) == len(r.host) + len(r.path) + 4
        assert abs(r.m - (0.25 + sum(model.weights[k] for k in r.g) / len(r.g) ** 0.5)) < 1e-9


def test_empty_tables_and_one_class(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(none, URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.net/y")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.judge(one, URL_RULES).collect()} == {1: "allow", 2: "allow"}
