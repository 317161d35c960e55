"""Site-relative line dedup with DataFrame functions only: lines that too large a part of a host's pages share go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, join_lookup

#: A line is boilerplate if over this part of the host's pages have it, and the host has pages enough to tell.
RATIO, LEAST_PAGES = 0.3, 5


def host_of(url):
    """Column: the lower-case host of a URL without user and port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def page_text(html):
    """Column: the text of a page, a line for each block element; script, style, comments and tags left out."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    text = F.regexp_replace(F.translate(text, "\r\n\t", "   "), "  +", " ")
    text = F.regexp_replace(text, r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|table|article|section|nav|header|footer|title|head|body|html|blockquote|pre|td)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.array_join(F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def _key(line):
    """A line's key: two unlike hashes, so that a chance meeting is out of the question."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, keys): the keys of each host's boilerplate lines, from (host, lines).

    A page counts once for a line however often it has it, and once for the null key, whose count is the host's page
    total: one pass counts both. A host has at most (mean lines a page) / ratio such lines, whatever its size, and no
    others are collected, so ``keys`` is short. Only keys are shuffled, counted on the map side before.
    """
    return over_ratio(pages, ratio, least_pages).groupBy("host").agg(F.collect_list("key").alias("keys"))


def over_ratio(pages: DataFrame, ratio: float, least_pages: int) -> DataFrame:
    """(host, key): the lines that over ``ratio`` of the pages of a host of ``least_pages`` and more have."""
    keys = F.array_distinct(F.transform(F.filter("lines", lambda x: x.rlike(WORD)), _key))
    each = F.when(F.col("host").isNotNull(), F.concat(F.array(F.lit(None).cast("struct<a:bigint,b:int>")), keys))
    counted = pages.select("host", F.explode(each).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
    often = cut(counted.filter(F.col("n") > F.when(F.col("key").isNull(), least_pages - 1).otherwise(ratio * least_pages)))
    totals = often.filter("key IS NULL").select("host", F.col("n").alias("pages"))
    return join_lookup(often.filter("key IS NOT NULL"), totals, ["host"]).filter(F.col("n") > ratio * F.col("pages")).select("host", "key")


def drop_boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` with ``text`` rid of lines that over ``ratio`` of the rows of its host have, and ``dropped_lines``.

    Lines are what \\n separates; lines without a word are never dropped. Each row is a page, repeated ones
    included. A null text is left null; rows with a null host, and those of hosts with under ``least_pages``
    rows, are left as they are. An empty table stays empty. A column ``dropped_lines`` is replaced; other columns pass inside
    a struct, so none can clash.
    The lookup has one short row a host and is broadcast only if its keys are counted to be few; otherwise the join is
    shuffled, and AQE splits a hot host.
    """
    names = [c for c in pages.columns if c.lower() != "dropped_lines"]
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(f"`{host}`").alias("host"), F.split(F.col(f"`{text}`"), "\n", -1).alias("lines"))
    found = cut(boilerplate(rows.select("host", "lines"), ratio, least_pages))
    joined = join_lookup(rows, found, ["host"], "left", entries="keys")
    left = F.filter("lines", lambda x: ~(x.rlike(WORD) & F.array_contains(F.col("keys"), _key(x))))
    out = joined.select("row", "lines", F.when(F.col("keys").isNull(), F.col("lines")).otherwise(left).alias("left"))
    dropped = F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long").alias("dropped_lines")
    return out.select(*(F.array_join("left", "\n").alias(c) if c == text else F.col("row")[c].alias(c) for c in names), dropped)


#: op10 in DuckDB's SQL over ``pages``.
SQL = r"""
WITH stripped AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'), '[\r\n\t ]+', ' ', 'g'),
      '(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|table|article|section|nav|header|footer|title|head|body|html|blockquote|pre|td)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS raw FROM pages),
texts AS (SELECT row_number() OVER () AS row_id, page_id, host,
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), ' *\n[ \n]*', chr(10), 'g'), chr(10) || ' ') AS text FROM stripped),
lines AS (SELECT row_id, host, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT row_id, host, string_split(text, chr(10)) AS l FROM texts)),
totals AS (SELECT host, count(*) AS pages FROM texts WHERE host IS NOT NULL AND text IS NOT NULL GROUP BY host HAVING count(*) >= 5),
often AS (SELECT l.host, l.line FROM lines l JOIN totals t ON t.host = l.host WHERE regexp_matches(l.line, '[^\x20\x09-\x0D]') GROUP BY l.host, l.line, t.pages HAVING count(DISTINCT row_id) > 0.3 * t.pages),
kept AS (SELECT l.row_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE o.line IS NULL) AS text, CAST(count(o.line) AS BIGINT) AS dropped_lines FROM lines l LEFT JOIN often o ON o.host = l.host AND o.line = l.line GROUP BY l.row_id)
SELECT t.page_id, t.host, CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.dropped_lines, 0) AS dropped_lines FROM texts t LEFT JOIN kept k USING (row_id)
"""
