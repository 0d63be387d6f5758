"""Operator 8: lines that a large share of a site's pages repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, sized_hint

#: A line goes when this percentage of the host's pages, and so many pages, hold it.
PERCENT, LEAST_PAGES = 30, 3
#: Parts that a host's pages are dealt into where the lines to drop are too many to broadcast.
PARTS = 64
HIDDEN = "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BLOCK_TAG = "(?i)</?(p|br|div|li|ul|ol|tr|td|th|table|h[1-6]|section|article|header|footer|nav|main|title|body|head|html)\\b[^>]*>"
TAG = "<[^>]*>"
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def page_lines(html: Column) -> Column:
    """Visible lines of a page: block tags break lines, other tags go, white space runs become a space."""
    text = F.regexp_replace(html, HIDDEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK_TAG, "\n"), TAG, "")
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t\\r\\x0B\\f]+", " "), " ?\\n[ \\n]*", "\n")
    return F.array_remove(F.split(F.trim(text), "\n"), "")


def without_boilerplate(pages: DataFrame, percent: int = PERCENT, least: int = LEAST_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text (lines that stay, joined by line ends) of each page.

    A line counts once for a page. Null, empty or unparsable urls share the host ''; a null html has no
    lines. Repeated rows are pages of their own; other columns are ignored. A host has at most
    100 / ``percent`` times its mean lines per page to drop, so a host's list stays short however many
    pages it has; pages are never gathered by host. The table of hosts (host, pages) is broadcast while its counted
    size allows it, so the counted lines of a large host stay where the count left them.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))
    lined = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), page_lines(F.coalesce("html", F.lit(""))).alias("lines"))
    counts = lined.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    totals = lined.groupBy("host").agg(F.count("*").alias("pages"))
    totals = materialize(totals, "hosts")
    drop = counts.join(sized_hint(totals, totals.count()), "host").where(F.col("n") * 100 >= F.col("pages") * percent)
    drop = materialize(drop.groupBy("host").agg(F.collect_list("line").alias("dropped")), "boilerplate")
    if (drop.agg(F.sum(F.size("dropped"))).first()[0] or 0) <= BROADCAST_ROWS:
        met = lined.join(F.broadcast(drop), "host", "left")
    else:
        parts = drop.select("host", "dropped", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        met = lined.withColumn("part", F.pmod(F.xxhash64("page_id", "lines"), F.lit(PARTS)).cast("int")).join(parts.hint("merge"), ["host", "part"], "left")
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("dropped", F.xxhash64(x))))
    met = met.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return met.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def sql(percent: int = PERCENT, least: int = LEAST_PAGES) -> str:
    """The same result in DuckDB SQL."""
    block = BLOCK_TAG.removeprefix("(?i)")
    return f"""with lined as (
  select row_number() over () as nr, page_id, lower(coalesce(regexp_extract(url, '{HOST}', 1), '')) as host,
    list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '{HIDDEN.removeprefix("(?is)")}', chr(10), 'gis'), '{block}', chr(10), 'gi'), '{TAG}', '', 'g'), '[ \\t\\r\\x0B\\f]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')), chr(10)), lambda x: x <> '') as lines
  from pages),
one as (select distinct nr, host, unnest(lines) as line from lined),
totals as (select host, count(*) as pages from lined group by host),
dropped as (select host, line from (select host, line, count(*) as n from one group by host, line) join totals using (host) where n >= {least} and n * 100 >= pages * {percent}),
placed as (select nr, host, unnest(lines) as line, generate_subscripts(lines, 1) as pos from lined),
kept as (select nr, count(*) as n, string_agg(line, chr(10) order by pos) as text from placed p where not exists (select 1 from dropped d where d.host = p.host and d.line = p.line) group by nr)
select page_id, host, cast(len(lines) as bigint) as n_lines, cast(len(lines) - coalesce(n, 0) as bigint) as n_dropped, coalesce(kept.text, '') as text from lined left join kept using (nr)"""
