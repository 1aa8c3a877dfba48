"""Site-relative line deduplication, in DataFrame functions only.

A line's frequency is the number of pages of its host that contain it, divided by the
host's page total; lines above a boilerplate ratio are dropped from all pages of the
host. A line that fewer than ``least_pages`` pages contain is no boilerplate: without that
floor, which callers may set to 1, every line of a host of one or two pages stands in more
than any ratio of its pages, and whole pages would vanish (17 of the 58 hosts, 28 of the
250 pages of sf0.01).

Lines are what block markup separates, without markup, scripts, styles and comments,
with single spaces. A line that stands several times in a page counts once for it and
goes or stays everywhere. Null html or url counts as empty; a url without a host is of
the host ''. Rows of equal page_id and url count as one page, and each gives its row; null
ids are ids like others. Pages of any length are read whole. An empty table gives no rows.
Other columns are ignored, also those of the same names as results. Lines are told apart
by 64-bit hashes within their host, pages by such hashes of id and url: two pages that
share one by accident (one pair is expected at six billion pages) lose the lines that are
boilerplate of the other's host as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, table

HIDDEN = r"(?is)<(script|style|noscript|template|title)\b.*?</\1\s*>|<!--.*?-->"
BLOCK = r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|nav|article|section|aside|header|footer|main|form|table|tr|td|th|br|hr|dl|dt|dd|pre|blockquote|body|head|html|figure)\b[^>]*>"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def lines(html: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, ""), SPACE, " "), BLOCK, "\n"), "<[^>]*>", "")
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def without_boilerplate(pages: DataFrame, ratio: float = 0.3, least_pages: int = 3) -> DataFrame:
    """page_id, url, host, text (kept lines), n_lines, n_dropped for each page."""
    scratch = Scratch(pages.sparkSession, "lines")
    page = F.xxhash64("page_id", "url").alias("page")
    split = pages.select(page, "page_id", "url", host(F.col("url")).alias("host"), lines(F.col("html")).alias("lines"))
    keys = scratch.keep(split.select("page", "host", F.explode_outer(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("key")).distinct(), "keys")
    totals = keys.select("page", "host").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    found = keys.where("key IS NOT NULL").groupBy("host", "key").agg(F.count("*").alias("on")).where(F.col("on") >= least_pages)
    common = found.join(totals, "host").where(F.col("on") > ratio * F.col("pages")).select("host", "key")
    # Only hashes are dealt by line; texts move once, to what their page drops.
    drops = keys.join(common, ["host", "key"]).groupBy("page").agg(F.collect_set("key").alias("drops"))
    whole = split.join(drops, "page", "left")
    kept = F.filter("lines", lambda x: F.col("drops").isNull() | ~F.array_contains("drops", F.xxhash64(x)))
    return whole.select("page_id", "url", "host", F.col("lines"), kept.alias("kept")).select("page_id", "url", "host", F.array_join("kept", "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_boilerplate(table(spark, sf_dir, "pages"))


OP7_SQL = r"""
WITH plain AS (
  SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>|<title\b.*?</title\s*>|<!--.*?-->', '', 'g'),
      '[\x20\x09-\x0D]+', ' ', 'g'),
      '(?i)</?(?:p|div|li|ul|ol|h[1-6]|nav|article|section|aside|header|footer|main|form|table|tr|td|th|br|hr|dl|dt|dd|pre|blockquote|body|head|html|figure)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g') AS t FROM pages),
each AS (SELECT page_id, url, host, i, trim(l) AS line FROM (SELECT page_id, url, host, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM plain)),
total AS (SELECT host, count(*) AS pages FROM (SELECT DISTINCT page_id, url, host FROM plain) GROUP BY host),
often AS (SELECT host, line FROM (SELECT DISTINCT page_id, url, host, line FROM each WHERE line <> '') JOIN total USING (host) GROUP BY host, line, pages HAVING count(*) >= 3 AND count(*) > 0.3::DOUBLE * pages)
SELECT p.page_id, p.url, p.host, coalesce(string_agg(e.line, chr(10) ORDER BY i) FILTER (WHERE o.line IS NULL AND e.line <> ''), '') AS text,
  count(*) FILTER (WHERE e.line <> '') AS n_lines, count(*) FILTER (WHERE o.line IS NOT NULL) AS n_dropped
FROM plain p LEFT JOIN each e ON p.page_id = e.page_id AND p.url IS NOT DISTINCT FROM e.url LEFT JOIN often o ON o.host = p.host AND o.line = e.line
GROUP BY p.page_id, p.url, p.host
"""
