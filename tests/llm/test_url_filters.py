from __future__ import annotations

from pyspark.sql import functions as F

from hygroflow.llm import tables, url_filters

URLS = [
    "http://a.net/x", "http://a.net", "https://Example.NET/en/1", "https://www.example.net/en/", "https://badexample.net/en/",
    "http://sub.example.com/de/x?y", "http://example.com/fr/", "http://x.org/fr/1#t", "http://x.org/en/1", "no scheme.net/", None,
    "http://www.spam-farm.example.org/en/9/?utm_source=z&b=2&a=1#t", "://net/", "http://É.net/q", "a://b://c.net/p", "http://?net/",
]


def brute(url):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([after.find(c) for c in "/?#" if c in after], default=len(after))
    host = "".join(c.lower() if c.isascii() else c for c in after[:cut])
    rest = after[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for verdict, site, start in url_filters.RULES:
        if (host == site or host.endswith("." + site)) and path.startswith(start) and (best is None or len(site + start) > len(best[0])):
            best = site + start, verdict
    return host, path, best


def test_rules_and_list(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    listed = spark.createDataFrame([("x.org/en/1?",), (None,), ("x.org/en/1?",), ("unknown",)], "canonical string")
    got = {r["page_id"]: r for r in url_filters.judged(pages, listed).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, best = brute(url)
        assert (got[i]["host"], got[i]["path"]) == (host, path), url
        assert got[i]["rule"] == (best[0] if best else None)
        assert got[i]["verdict"] == (best[1] if best else "block" if url == "http://x.org/en/1" else "allow")


def test_canonical_forms(spark):
    urls = ["http://www.A.org/x/?utm_source=1&b=2&a=1#z", "https://m.a.org/x?a=1&b=2", "https://a.org/x//?ref=k&a=1&b=2&", "a.org/x"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(url_filters.canonical(F.col("url")).alias("c")).collect()
    assert [r["c"] for r in rows] == ["a.org/x?a=1&b=2"] * 3 + [None]


def test_filter_loses_no_key_and_drops_most_others(spark):
    keys = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    words = tables.bloom_words(keys.where("k % 10 = 3"), "k")
    assert words.count() <= tables.BLOOM_BLOCKS
    kept = tables.possible(keys, "k", words)
    assert kept.where("k % 10 = 3").count() == 200
    assert kept.count() < 260
    assert tables.without(keys, "k", keys.where("k % 10 = 3")).count() == 1800


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judged(pages, url_filters.listed_urls(pages)).count() == 0


def test_filter_follows_the_list(spark):
    assert tables.blocks_for(0) == tables.LEAST_BLOCKS and tables.blocks_for(10**10) == tables.MOST_BLOCKS
    keys = spark.range(60_000).select(F.col("id").cast("string").alias("k"))
    blocks = tables.blocks_for(30_000)
    assert blocks == 7500
    words = tables.bloom_words(keys.where("k % 2 = 0"), "k", blocks)
    kept = tables.possible(keys, "k", words, blocks)
    assert kept.where("k % 2 = 0").count() == 30_000 and kept.count() < 32_000


def test_urls_without_a_form_and_clashing_columns(spark):
    names = ("canonical", "listed", "host", "path", "rule", "verdict", "__block", "__word", "__key")
    urls = [None] * 300 + ["no scheme"] * 300 + ["http://x.org/listed"] * 5 + ["", "none 7"]
    rows = [(i if i % 3 else None, u, *range(len(names))) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string" + "".join(f", {c} int" for c in names)).repartition(4)
    listed = spark.createDataFrame([("x.org/listed?", 1), ("none 7", 2), (None, 3)], "canonical string, url int")
    got = url_filters.judged(pages, listed).collect()
    assert len(got) == len(urls) and sum(r["verdict"] == "block" for r in got) == 5
    assert {(r["host"], r["path"], r["rule"]) for r in got if r["verdict"] == "allow"} == {("", "", None)}
