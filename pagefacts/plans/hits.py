"""Hit, URL and cache queries over ``lineitem`` x ``part``, ``pages`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import hits as H
from ..operators import run_stats
from ..operators.page_jobs import document_urls
from . import fixtures as X
from .fixtures import NOW
from .registry import register, table

#: Key and stem of the hits' urls, and of the pages' (which have no content parameters but page and sort).
_KEY = "regexp_replace(regexp_replace(regexp_replace(url, '^https?://(www\\.)*', ''), '[?#].*$', ''), '/+$', '')"
_STEM = "regexp_extract(url, '([^./]+)\\.[a-z]+(/|$)', 1)"
_FIRST = f"""{X.HITS}, h as (select *, {_KEY} as key from hits), f as (select query, key, min(pos) as pos, string_agg(distinct lane, ',' order by lane) as engines,
  count(distinct lane) as n, arg_min(url, lane_ord*100+pos) as url, arg_min(title, lane_ord*100+pos) as title, min(lane_ord*100+pos) as first from h group by query, key)"""
_TKEY = "array_to_string(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')[1:8], ' ')"


@register("dedupe_hits", f"""with {X.HITS}, k as (select *, {_KEY} as key, row_number() over (partition by query order by lane_ord, pos, url, snippet) as rank from hits),
  o as (select *, row_number() over (partition by query, key order by rank) as nr from k), p as (select query, key, row_number() over (partition by query order by rank) as place from o where nr = 1) select * from p where place <= 3""")
def dedupe_hits(spark, d):
    from pyspark.sql import Window

    h = X.hits(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("lane_ord", "pos", "url", "snippet")))
    return H.dedupe_hits(h, 3).select("query", "key", "place")


@register("union_lanes", f"with {X.HITS} select lane, cast(lane_ord as integer) as lane_ord, count(*) as n from hits group by 1, 2")
def union_lanes(spark, d):
    h = X.hits(spark, d).drop("lane_ord")
    return H.union_lanes(h.where("lane = 'ddg'"), h.where("lane = 'jina'"), None).groupBy("lane", "lane_ord").agg(F.count("*").alias("n"))


@register("lane_agreement", f"with {X.HITS}, h as (select query, lane, {_KEY} as key from hits) select query, key from h where lane='ddg' intersect select query, key from h where lane='jina'")
def lane_agreement(spark, d):
    h = X.hits(spark, d)
    return H.lane_agreement(h.where("lane = 'ddg'"), h.where("lane = 'jina'"))


@register("union_engines", f"with {X.HITS} select query, {_KEY} as key, string_agg(distinct lane, ',' order by lane) as engines from hits group by 1, 2")
def union_engines(spark, d):
    return H.union_engines(X.hits(spark, d))


@register("syndicated_titles", f"""with {_FIRST}, t as (select query, key, first, {_TKEY} as tkey, {_STEM} as stem from f)
  select query, key, len(string_split(tkey, ' ')) >= 4 and first_value(stem) over (partition by query, tkey order by first) <> stem as syndicated from t""")
def syndicated_titles(spark, d):
    return H.syndicated_titles(X.hits(spark, d).withColumn("pos", F.col("pos"))).select("query", "key", "syndicated")


@register("merge_hits")
def merge_hits(spark, d):
    return H.merge_hits(X.hits(spark, d), 5).select("query", "key", "pos", F.array_join("engines", ",").alias("engines"), F.col("place").cast("long").alias("place"))


@register("exclude_seen", """with k as (select page_id, page_id%3=0 as seen, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://(www\\.)*', ''), '[?#].*$', ''), '/+$', ''), '$', case when url like '%page=%' then '?page=2' else '' end) as key from pages)
  select page_id from k where key not in (select key from k where seen)""")
def exclude_seen(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.lower("url").alias("url"))
    seen = pages.selectExpr("case when page_id%3=0 then url else concat('https://seen.example.org/', page_id) end as url")
    return H.exclude_seen(pages, seen).select("page_id")


@register("new_items", "select user_id from (select distinct user_id from events where event_type='purchase') where user_id not in (select user_id from events where event_type='signup' and value > 50)")
def new_items(spark, d):
    e = table(spark, d, "events")
    return H.new_items(e.where("event_type = 'purchase'"), e.where("event_type = 'signup' and value > 50"), "user_id")


_NORMAL = "lower(trim(regexp_replace(query, '\\s+', ' ', 'g')))"
_LATEST = f"{X.CACHE}, n as (select put_id, lane, {_NORMAL} as query, max_hits, stored_at, hits from puts), latest as (select * from (select *, row_number() over (partition by lane, query, max_hits order by stored_at desc, put_id desc) as nr from n where hits > 0) where nr = 1)"


@register("latest_cache_entry", f"with {_LATEST} select lane, query, max_hits, put_id, stored_at, hits from latest")
def latest_cache_entry(spark, d):
    return H.latest_cache_entry(X.puts(spark, d))


def _lookup(spark, d):
    puts = X.puts(spark, d)
    wanted = puts.select(F.col("put_id").alias("id"), "lane", "query", (F.col("max_hits") + 1).alias("max_hits"))
    newest = puts.agg(F.max("stored_at")).first()[0]
    return H.cache_lookup(wanted, H.latest_cache_entry(puts), str(newest), 24 * 3)


_LOOKUP = f"{_LATEST}, w as (select put_id as id, lane, {_NORMAL} as query, max_hits+1 as max_hits from puts), looked as (select id, coalesce(stored_at + interval 72 hours >= (select max(stored_at) from puts), false) as hit, hits from w left join latest using (lane, query, max_hits))"


@register("cache_lookup", f"with {_LOOKUP}, m as (select lane, query, max_hits, count(*) as waiting from looked join w using (id) where not hit group by all) select 'lookup' as kind, cast(id as varchar) as what, cast(hit as bigint) as n from looked union all select 'search', lane || '|' || query || '|' || max_hits, 1 from m")
def cache_lookup(spark, d):
    found = _lookup(spark, d)
    searches = H.missing_queries(found).select(F.lit("search"), F.concat_ws("|", "lane", "query", "max_hits"), F.lit(1).cast("long"))
    return found.select(F.lit("lookup").alias("kind"), F.col("id").cast("string").alias("what"), F.col("hit").cast("long").alias("n")).union(searches)


@register("cache_summary", f"with {_LOOKUP} select count(*) filter (hit) as hits, count(*) filter (not hit) as misses, cast(coalesce(sum(hits*100) filter (hit), 0) as bigint) as bytes from looked")
def cache_summary(spark, d):
    return run_stats.cache_summary(_lookup(spark, d).withColumn("bytes", F.col("hits") * 100))


@register("fan_out_queries", """with a as (select case when r_regionkey%2=0 then replace(r_name, ' ', '') || '.org' else r_name end as anchor, case when r_regionkey%2=0 then replace(r_name, ' ', '') else r_name end as stem from region), q as (select concat_ws(' ', anchor, n_name, kind) as query from a, nation, (select unnest(['news','report']) as kind)),
  p as (select n_name || ' ' || kind as query, stem from a, nation, (select unnest(['news','report']) as kind)) select query from q union all select query || ' ' || stem from p""")
def fan_out_queries(spark, d):
    kinds = spark.createDataFrame([("news",), ("report",)], "kind string")
    given = table(spark, d, "region").selectExpr("case when r_regionkey%2=0 then concat(replace(r_name, ' ', ''), '.org') else r_name end as anchor"), table(spark, d, "nation").select(F.col("n_name").alias("value")), kinds
    return H.fan_out_queries(*given).union(H.fan_out_queries(*given, "{value} {kind}"))


_PAGE_KEY = "regexp_replace(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^(www\\.)+', '') || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', ''), '$', case when url like '%page=%' then '?page=2' else '' end)"


@register("canonical_urls", f"select page_id, {_PAGE_KEY} as key from pages")
def canonical_urls(spark, d):
    return table(spark, d, "pages").select("page_id", U.canonical_url(F.col("url")).alias("key"))


@register("display_urls", "select page_id, case when url like '%?utm_source=feed' then regexp_replace(url, '\\?.*$', '') else regexp_replace(url, '&ref=x$', '') end as url from pages")
def display_urls(spark, d):
    return table(spark, d, "pages").select("page_id", U.display_url(F.col("url")).alias("url"))


@register("url_parts", """with h as (select page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^(www\\.)+', '') as domain from pages)
  select page_id, domain, regexp_extract(domain, '([^.]+\\.)?[^.]+$', 0) as registrable, regexp_extract(domain, '([^.]+)\\.[^.]+$', 1) as stem from h""")
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", U.domain(u).alias("domain"), U.registrable_domain(u).alias("registrable"), U.site_stem(u).alias("stem"))


_WRAPPED = {"spark": "case when page_id%3=0 then concat('//duckduckgo.com/l/?uddg=', url_encode(url), '&rut=1') when page_id%3=1 then 'https://duckduckgo.com/about' else url end"}


@register("unwrap_redirects", "select page_id, case when page_id%3=1 then '' else url end as url from pages")
def unwrap_redirects(spark, d):
    return table(spark, d, "pages").selectExpr("page_id", f"{_WRAPPED['spark']} as url").select("page_id", U.unwrap_redirect(F.col("url")).alias("url"))


@register("lang_variant_key", f"select page_id, regexp_replace({_PAGE_KEY}, '^([^/?]*)/[a-z]{{2}}(-[A-Za-z]{{2}})?(/|$)', '\\1/') as key from pages")
def lang_variant_key(spark, d):
    return table(spark, d, "pages").select("page_id", U.lang_variant_key(F.col("url")).alias("key"))


@register("sentinel_urls", """with p as (select page_id, regexp_extract(replace(url, '.html', ' paper.PDF'), '://[^/?#]*([^?#]*)', 1) as path from pages)
  select page_id, ends_with(lower(path), '.pdf') as is_document, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.pdf$', '', 'i') as title from p""")
def sentinel_urls(spark, d):
    return document_urls(table(spark, d, "pages").selectExpr("page_id", "replace(url, '.html', '%20paper.PDF') as url"))


@register("title_keys", f"with t as (select p_partkey, p_name || case p_partkey%3 when 0 then ' - Site Name' when 1 then '' else ' | One' end as full_title, p_name as title from part) select p_partkey, {_TKEY} as key from t")
def title_keys(spark, d):
    title = "concat(p_name, case p_partkey%3 when 0 then ' - Site Name' when 1 then '' else ' | One' end)"
    return table(spark, d, "part").selectExpr("p_partkey", f"{title} as title").select("p_partkey", T.title_key(F.col("title")).alias("key"))


@register("normalize_queries", "select doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as query from documents")
def normalize_queries(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_query(F.col("text")).alias("query"))
