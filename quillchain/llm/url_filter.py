"""URL filters: redirect equivalence.

Each URL is judged by host/path rules (longest fitting rule wins).  URLs that redirect
to one another or share a canonical link form one component; a page without a rule of
its own is blocked when its component holds a blocked URL and no explicitly allowed one.
All work is DataFrame expressions: no Python on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
NODE = r"(?s)^.*?://([^/?#]*)([^#]*)"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str  # "block" or "allow"


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, SPLIT, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """What names a resource: lower-case host plus path and query, without scheme and
    fragment; null for what is no absolute URL."""
    host = F.translate(F.regexp_extract(url, NODE, 1), UPPER, LOWER)
    return F.when(host != "", F.concat(host, F.regexp_extract(url, NODE, 2)))


def judged(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest fitting rule; null if none fits.

    The rules are literals of the plan (a list of a few hundred at most).
    """
    fits = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r))
    ]
    return F.coalesce(*fits)


def absolute(link: Column, url: Column) -> Column:
    """``link`` of a page at ``url`` as an absolute URL."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    top = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(top, link))
        .when(link.startswith("#") | (link == ""), url)
        .otherwise(F.concat(F.when(folder.endswith("/") & ~folder.endswith("://"), folder).otherwise(F.concat(top, F.lit("/"))), link))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): page and target of each canonical link and meta refresh in its HTML."""
    tags = pages.where(F.col(html).rlike(r"(?i)\bcanonical\b|\brefresh\b")).select(
        F.col(url).alias("_url"),
        F.concat(
            F.transform(F.regexp_extract_all(html, F.lit(CANONICAL), F.lit(0)), lambda t: F.regexp_extract(t, HREF, 1)),
            F.transform(F.regexp_extract_all(html, F.lit(REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, TARGET, 1)),
        ).alias("_links"),
    )
    found = tags.select("_url", F.explode("_links").alias("_link")).where("_link <> ''")
    return found.select(node_of(F.col("_url")).alias("a"), node_of(absolute(F.col("_link"), F.col("_url"))).alias("b"))


def alias_verdicts(edges: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(node, alias_verdict) for every node of ``edges`` whose component holds a judged URL."""
    stars = written(connected_components(edges, "url-cc"), "url-stars")
    url = F.concat(F.lit("x://"), F.col("node"))
    own = stars.select("root", judged(host_of(url), path_of(url), rules)["verdict"].alias("v"))
    by_root = own.groupBy("root").agg(F.max(F.when(F.col("v") == "allow", 1)).alias("allows"), F.max(F.when(F.col("v") == "block", 1)).alias("blocks"))
    by_root = by_root.where("allows = 1 or blocks = 1").select("root", F.when(F.col("allows") == 1, "allow").otherwise("block").alias("alias_verdict"))
    return stars.join(by_root, "root").select("node", "alias_verdict")


def url_verdicts(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, alias_verdict.

    ``redirects`` may add edges as columns (src, dst) of absolute URLs.  Order of
    precedence: the page's own longest rule; else, in its component of redirects and
    canonical links, an explicit allow before any block; else ``default``.  Null URLs and
    those without ``://`` have empty host and path and get ``default``; URLs of any length
    are compared whole; repeated rows are judged alike; other columns of ``pages`` are
    ignored, whatever their names; an empty table gives an empty result.
    """
    edges = link_edges(pages, url, html)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")))
    aliases = written(alias_verdicts(edges, rules), "url-aliases")
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), node_of(F.col(url)).alias("node"))
    rows = rows.withColumn("own", judged(F.col("host"), F.col("path"), rules)).join(aliases, "node", "left")
    return rows.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "alias_verdict", F.lit(default)).alias("verdict"), "alias_verdict")


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_DUCK_JUDGE = """CASE WHEN ({h} = 'example.net' OR {h} LIKE '%.example.net') AND starts_with({p}, '/en/') THEN 'example.net/en/'
 WHEN ({h} = 'example.com' OR {h} LIKE '%.example.com') AND starts_with({p}, '/de/') THEN 'example.com/de/'
 WHEN ({h} = 'org' OR {h} LIKE '%.org') AND starts_with({p}, '/fr/') THEN 'org/fr/'
 WHEN ({h} = 'net' OR {h} LIKE '%.net') AND starts_with({p}, '/') THEN 'net/' END"""
_DUCK_LOWER = f"translate(regexp_extract({{u}}, '{{s}}', 1), '{UPPER}', '{LOWER}')"


def _duck_host(u: str) -> str:
    return _DUCK_LOWER.format(u=u, s=SPLIT)


def _duck_node(u: str) -> str:
    host = _DUCK_LOWER.format(u=u, s=NODE)
    return f"CASE WHEN {host} <> '' THEN {host} || regexp_extract({u}, '{NODE}', 2) END"


ORACLE = f"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, coalesce({_duck_host('url')}, '') AS host, coalesce(regexp_extract(url, '{SPLIT}', 2), '') AS path, {_duck_node('url')} AS node FROM pages),
tags AS (
  SELECT url, regexp_extract(unnest(regexp_extract_all(html, '{CANONICAL.replace("'", "''")}')), '{HREF.replace("'", "''")}', 1) AS link FROM p
  UNION ALL
  SELECT url, regexp_extract(unnest(regexp_extract_all(html, '{REFRESH.replace("'", "''")}')), '{TARGET.replace("'", "''")}', 1) FROM p),
goals AS (
  SELECT url, replace(trim(link), '&amp;', '&') AS link, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS top, regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1) AS folder FROM tags WHERE link <> ''),
far AS (
  SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN 'http:' || link WHEN starts_with(link, '/') THEN top || link
    WHEN starts_with(link, '#') OR link = '' THEN url WHEN ends_with(folder, '/') AND NOT ends_with(folder, '://') THEN folder || link ELSE top || '/' || link END AS dst FROM goals),
e AS (SELECT {_duck_node('url')} AS a, {_duck_node('dst')} AS b FROM far),
s AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
reach(a, b) AS (SELECT a, a FROM s UNION SELECT reach.a, s.b FROM reach JOIN s ON reach.b = s.a),
seen AS (SELECT a, {_DUCK_JUDGE.format(h=_duck_host("('x://' || b)"), p=f"regexp_extract('x://' || b, '{SPLIT}', 2)")} AS r FROM reach),
al AS (SELECT a AS node, CASE WHEN max(CASE WHEN r IN ('example.net/en/', 'org/fr/') THEN 1 END) = 1 THEN 'allow' ELSE 'block' END AS alias_verdict FROM seen WHERE r IS NOT NULL GROUP BY a),
j AS (SELECT page_id, host, path, node, {_DUCK_JUDGE.format(h='host', p='path')} AS rule FROM p)
SELECT page_id, host, path, rule, coalesce(CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END, alias_verdict, 'allow') AS verdict, alias_verdict
FROM j LEFT JOIN al USING (node)
"""
