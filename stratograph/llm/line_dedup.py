"""Site-relative line frequency: boilerplate lines of web pages (DataFrame functions only).

Pages are grouped by host.  For every line the share of the host's pages that hold it is taken, and lines above the
boilerplate ratio, on enough pages, are dropped from all pages of that host.

A line above ratio r stands on more than r times the host's pages, so a host has fewer than (lines of an average page) /
r such lines, however many pages it has: they fit one array for each host, and while there are few of them in all, cleaning
the pages is a map.  Beyond that the pages' lines join them, a line on many pages salted, and each page gets its own back
by its number.  Counting sums partial counts of each task, so a host with a third of all pages is never in one task.

Lines come from the HTML: scripts, styles and comments go, block ends break lines, other tags vanish, the common
entities are read, white space is collapsed and blank lines are left out.

Defined results: a null page or one without text has no lines; an address without a host has the empty host; lines that
a page repeats count once for the ratio, and all their copies are dropped; repeated page ids are pages of their own; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import join_counted, read_table, written

MAX_RATIO = 0.3
MIN_PAGES = 3
#: Boilerplate lines (hash and host, under 100 bytes) that are broadcast at most; beyond, lines are joined by a shuffle.
MAX_BROADCAST_LINES = 200_000

# Fixed values: (pattern, replacement) in order.
HTML_RULES = [
    (r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)\s*>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?i)</?(p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|nav|article|section|header|footer|title|head|body|html|main|aside|pre|blockquote|form)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
]
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def html_text(html: Column) -> Column:
    out = F.coalesce(html, F.lit(""))
    for pattern, new in HTML_RULES:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(new)) if "<" in pattern or "(" in pattern else F.replace(out, F.lit(pattern), F.lit(new))
    return out


def lines_of(text: Column) -> Column:
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))
    return F.filter(trimmed, lambda x: x != "")


def boilerplate(lined: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, pages): hashes of the lines above the ratio.  ``lined``: host, lines."""
    totals = lined.groupBy("host").agg(F.count("*").alias("host_pages"))
    counts = (
        lined.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    return counts.join(totals, "host").where(F.col("pages") > max_ratio * F.col("host_pages")).select("host", "line", "pages")


def without_boilerplate(
    pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = MAX_BROADCAST_LINES
) -> DataFrame:
    """page_id, host, n_lines, n_dropped and the text that is left of every page."""
    lined = pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(html_text(F.col("html"))).alias("lines"))
    lined = written(lined.withColumn("row", F.monotonically_increasing_id()), "page-lines")
    found = written(boilerplate(lined, max_ratio, min_pages), "boilerplate")
    if found.count() <= broadcast_lines:
        out = lined.join(F.broadcast(found.groupBy("host").agg(F.collect_set("line").alias("drop"))), "host", "left")
    else:
        own = lined.select("row", "host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
        hits = join_counted(own, found, ["host", "line"], "pages", found.agg(F.sum("pages")).first()[0])
        out = lined.join(hits.groupBy("row").agg(F.collect_set("line").alias("drop")), "row", "left")
    drop = F.coalesce("drop", F.array().cast("array<bigint>"))
    out = out.select("page_id", "host", "lines", F.explode(F.array(drop)).alias("drop"))
    kept = F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), F.xxhash64(x)))
    out = out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), F.explode(F.array(kept)).alias("kept"))
    return out.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def _sql_text() -> str:
    out = "coalesce(html, '')"
    for pattern, new in HTML_RULES:
        quoted, plain = pattern.replace("'", "''"), new.replace("'", "''")
        to = "chr(10)" if new == "\n" else f"'{plain}'"
        out = f"regexp_replace({out}, '{quoted}', {to}, 'g')" if "<" in pattern or "(" in pattern else f"replace({out}, '{quoted}', {to})"
    return out


#: The same rows in DuckDB SQL.
ORACLE_SQL = rf"""
with p as (
  select row_number() over () as r, page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) as host,
    list_filter(list_transform(string_split({_sql_text()}, chr(10)),
      lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') as lines
  from pages
), l as (select r, page_id, host, lines, unnest(lines) as line, generate_subscripts(lines, 1) as i from p
), n as (select host, count(*) as host_pages from p group by host
), b as (
  select l.host, l.line from l join n on l.host = n.host group by l.host, l.line, n.host_pages
  having count(distinct r) >= {MIN_PAGES} and count(distinct r) > {MAX_RATIO} * n.host_pages
), k as (
  select l.r, count(*) filter (where b.line is not null) as n_dropped,
    string_agg(l.line, chr(10) order by i) filter (where b.line is null) as text
  from l left join b on l.host = b.host and l.line = b.line group by l.r
)
select page_id, host, len(lines)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped, coalesce(text, '') as text
from p left join k using (r)
"""


def op5_line_dedup(spark, sf_dir):
    return without_boilerplate(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
