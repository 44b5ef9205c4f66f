"""Query op12: decisions on the URLs of pages, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import url_filters
from .common import spread

#: Host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filters.judged(pages, rules).withColumnRenamed("id", "page_id")


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


QUERIES = {"op12_url_filters": op12_url_filters}
ORACLE = {
    "op12_url_filters": f"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {", ".join(map(str, RULES))}) AS r(host, path, verdict)),
p AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1) AS query FROM p),
shown AS (SELECT host, path, query, regexp_replace(html, '{_quoted(url_filters.HIDDEN)}', ' ', 'g') AS h FROM q WHERE contains(lower(html), 'canonical') OR contains(lower(html), 'refresh')),
tags AS (
  SELECT host, path, query, regexp_replace(regexp_extract(list_filter(regexp_extract_all(h, '{url_filters.LINK_TAG}'),
           lambda t: regexp_matches(t, '{_quoted(url_filters.CANONICAL)}') AND regexp_matches(t, '{_quoted(url_filters.HREF)}'))[1], '{_quoted(url_filters.HREF)}', 1), '^["'']|["'']$', '', 'g') AS ref FROM shown
  UNION ALL
  SELECT host, path, query, regexp_extract(replace(regexp_replace(regexp_extract(list_filter(regexp_extract_all(h, '{url_filters.META_TAG}'),
           lambda t: regexp_matches(t, '{_quoted(url_filters.REFRESH)}'))[1], '{_quoted(url_filters.CONTENT)}', 1), '^["'']|["'']$', '', 'g'), '&amp;', '&'), '{_quoted(url_filters.REFRESH_URL)}', 1) FROM shown),
refs AS (SELECT host, path, query, trim(replace(ref, '&amp;', '&'), ' ') AS ref FROM tags WHERE ref IS NOT NULL),
placed AS (
  SELECT host || path || query AS u, CASE
    WHEN regexp_matches(ref, '(?i)^https?://') THEN ref
    WHEN regexp_matches(ref, '^(#|$)') OR regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(ref, '//') THEN 'http:' || ref
    WHEN host = '' THEN NULL
    WHEN starts_with(ref, '/') THEN 'http://' || host || ref
    WHEN starts_with(ref, '?') THEN 'http://' || host || path || ref
    ELSE 'http://' || host || CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*/)[^/]*$', 1) ELSE '/' END || ref END AS url FROM refs WHERE host <> ''),
ends AS (SELECT u, url[instr(url, '://') + 3:] AS rest FROM placed WHERE url IS NOT NULL),
parts AS (
  SELECT u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         string_split(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '/') AS steps, regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1) AS query FROM ends),
links AS (
  SELECT DISTINCT u, host || list_reduce(list_concat([''], steps[2:]), lambda done, step: CASE WHEN step = '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN step = '.' THEN done ELSE done || '/' || step END)
         || CASE WHEN steps[-1] IN ('.', '..') THEN '/' ELSE '' END || query AS v FROM parts WHERE host <> ''),
two_way AS (SELECT u, v FROM links WHERE u <> v UNION SELECT v, u FROM links WHERE u <> v),
reach(node, other) AS (SELECT u, u FROM two_way UNION SELECT r.node, b.v FROM reach r JOIN two_way b ON b.u = r.other),
urls AS (
  SELECT host, path FROM q UNION
  SELECT regexp_extract(node, '^[^/?#]*'), regexp_extract(node, '^[^/?#]*([^?#]*)', 1) FROM reach),
fits AS (
  SELECT u.host, u.path, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY u.host, u.path ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict) AS k
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)),
best AS (SELECT * FROM fits WHERE k = 1),
of_aliases AS (
  SELECT node, min(b.verdict) AS verdict FROM reach JOIN best b
    ON b.host = regexp_extract(other, '^[^/?#]*') AND b.path = regexp_extract(other, '^[^/?#]*([^?#]*)', 1) GROUP BY node)
SELECT q.page_id, q.host, q.path, b.rule, coalesce(b.verdict, a.verdict, 'allow') AS verdict
FROM q LEFT JOIN best b ON b.host = q.host AND b.path = q.path LEFT JOIN of_aliases a ON a.node = q.host || q.path || q.query
"""
}
