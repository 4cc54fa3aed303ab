"""URL verdicts: host and path rules, then a list of canonical URLs.

A blocked Bloom filter of the listed canonical URLs passes possible hits; these
go through an exact hash join with the list, which removes the false positives.
The filter is sized to the list, one 64-bit word for four URLs and
``tables.MOST_BLOCKS`` words at most, therefore broadcast.  Everything is a
column expression.

Defined cases: a null url, or one without ``://``, has an empty host and path,
no canonical form and the verdict ``allow``; repeated rows are judged alike;
repeated or null list entries count once or not at all; empty tables give no
rows.  Of the rules that fit, the one with the most characters wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hygroflow.llm import tables

#: (verdict, host, path): fixed values of the query.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Sites whose pages make up the list of the query: names of a host's labels.
LISTED_SITES = ("spam-farm", "cheap-pills")
#: Join keys among which urls without a canonical form are spread.
SPREAD = 4096
#: Query parameters that name a visit, not a page.
TRACKING = r"^(utm_[a-z]*|ref|fbclid|gclid)(=|$)"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS after FROM pages),
p AS (
  SELECT page_id, after,
         translate(coalesce(regexp_extract(after, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(after, '^[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(after, '^[^?#]*\?([^#]*)', 1), '') AS query
  FROM u),
j AS (
  SELECT page_id, host, path,
         CASE WHEN host LIKE '%.example.net' OR host = 'example.net' THEN starts_with(path, '/en/') ELSE false END AS r2,
         (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') AS r3,
         (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') AS r4,
         (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') AS r1,
         list_has_any(string_split(host, '.'), ['spam-farm', 'cheap-pills']) AS site,
         CASE WHEN after IS NOT NULL THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '')
              || '?' || array_to_string(list_sort(list_filter(string_split(query, '&'),
                   lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]*|ref|fbclid|gclid)(=|$)'))), '&') END AS canonical
  FROM p),
l AS (SELECT DISTINCT canonical FROM j WHERE site AND canonical IS NOT NULL)
SELECT page_id, host, path,
       CASE WHEN r2 THEN 'example.net/en/' WHEN r3 THEN 'example.com/de/' WHEN r4 THEN 'org/fr/' WHEN r1 THEN 'net/' END AS rule,
       CASE WHEN r2 THEN 'allow' WHEN r3 THEN 'block' WHEN r4 THEN 'allow' WHEN r1 THEN 'block'
            WHEN canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host(url: Column) -> Column:
    raw = F.regexp_extract(_after(url), r"^[^/?#]*", 0)
    return F.translate(F.coalesce(raw, F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One name per page: no scheme, ``www.`` or ``m.``, end slash, fragment or tracking; null without host."""
    query = F.coalesce(F.regexp_extract(_after(url), r"^[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    site = F.regexp_replace(host(url), r"^(www|m)\.", "")
    page = F.regexp_replace(path(url), r"/+$", "")
    name = F.concat(site, page, F.lit("?"), F.array_join(F.array_sort(kept), "&"))
    return F.when(F.instr(url, "://") > 0, name)


def _fits(rule: tuple[str, str, str]) -> Column:
    _, site, start = rule
    same = (F.col("host") == site) | F.col("host").endswith(f".{site}")
    return same & F.col("path").startswith(start)


def judged(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (page_id, url) against ``listed`` (canonical): page_id, host, path, rule, verdict."""
    rows = pages.select(
        "page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
        canonical(F.col("url")).alias("canonical"),
    )
    listed = tables.stored(listed.select("canonical").where(F.col("canonical").isNotNull()).distinct(), "listed")
    blocks = tables.blocks_for(listed.count())
    names = rows.select("canonical").where(F.col("canonical").isNotNull()).distinct()
    possible = tables.possible(names, "canonical", tables.bloom_words(listed, "canonical", blocks), blocks)
    hits = possible.join(listed, "canonical").select("canonical", F.lit(True).alias("listed"))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("listed"), "block").otherwise("allow")
    for r in sorted(rules, key=lambda r: len(r[1] + r[2])):
        rule = F.when(_fits(r), r[1] + r[2]).otherwise(rule)
        verdict = F.when(_fits(r), r[0]).otherwise(verdict)
    # urls without a canonical form match nothing; their keys are spread, a canonical form holds a "?"
    nowhere = F.concat(F.lit("none "), F.monotonically_increasing_id() % SPREAD)
    rows = rows.withColumn("canonical", F.coalesce("canonical", nowhere))
    return rows.join(hits, "canonical", "left").select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict")
    )


def listed_urls(pages: DataFrame, sites=LISTED_SITES) -> DataFrame:
    """Canonical URLs of every page on a listed site."""
    labels = F.split(host(F.col("url")), r"\.")
    on_list = F.arrays_overlap(labels, F.array(*map(F.lit, sites)))
    return pages.where(on_list).select(canonical(F.col("url")).alias("canonical"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    pages = tables.read(spark, folder, "pages", "page_id", "url")
    return judged(pages, listed_urls(pages))
