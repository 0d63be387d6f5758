"""Search hits: lanes, dedup, merging, syndicated copies, the search cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_query, title_key
from ..functions.urls import canonical_url, lang_variant_key, site_stem, unwrap_redirect
from .graph import materialize

#: Words that a title has at least to claim its key.
CLAIM_WORDS = 4


def dedupe_hits(hits: DataFrame, limit: int = 0) -> DataFrame:
    """First hit of each page per query in rank order, redirects unwrapped; ``limit`` 0 keeps all."""
    h = hits.withColumn("url", unwrap_redirect(F.col("url"))).where("url != ''").withColumn("key", canonical_url(F.col("url")))
    h = h.withColumn("nr", F.row_number().over(Window.partitionBy("query", "key").orderBy("rank"))).where("nr = 1")
    h = h.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank")).cast("long"))
    return (h.where(F.col("place") <= limit) if limit else h).drop("nr")


def union_lanes(*lanes: DataFrame) -> DataFrame:
    """All lanes' hits with the lane's number; a lane of None (failed) adds nothing."""
    out = None
    for i, lane in enumerate(lanes):
        if lane is not None:
            lane = lane.withColumn("lane_ord", F.lit(i))
            out = lane if out is None else out.unionByName(lane, allowMissingColumns=True)
    return out


def lane_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query, key) of pages that both lanes return."""
    keyed = lambda df: df.select("query", canonical_url(F.col("url")).alias("key"))
    return keyed(a).intersect(keyed(b))


def union_engines(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query", canonical_url(F.col("url")).alias("key")).agg(F.array_join(F.array_sort(F.collect_set("lane")), ",").alias("engines"))


def _keyed(hits: DataFrame) -> DataFrame:
    """Hits with a url, and their keys; those that come with keys keep them."""
    h = hits.where(F.coalesce(F.col("url"), F.lit("")) != "")
    if "stem" in hits.columns:
        return h
    h = h.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "snippet")})
    return h.select("query", "lane", "lane_ord", "pos", "url", "title", "snippet", canonical_url(F.col("url")).alias("key"), title_key(F.col("title")).alias("tkey"), site_stem(F.col("url")).alias("stem"))


def _first_seen(hits: DataFrame) -> DataFrame:
    """One row for each (query, page): merged values and the order of its first appearance."""
    order = F.struct("lane_ord", "pos")
    h = _keyed(hits)
    longest = F.struct(F.octet_length("snippet").alias("n"), (-F.col("lane_ord")).alias("a"), (-F.col("pos")).alias("b"))
    return h.groupBy("query", "key").agg(
        F.min("pos").alias("pos"), F.array_sort(F.collect_set("lane")).alias("engines"), F.max_by("snippet", longest).alias("snippet"), F.min_by("url", order).alias("url"),
        F.coalesce(F.min_by("title", F.when(F.trim("title") != "", order)), F.lit("")).alias("title"), F.coalesce(F.min_by("tkey", F.when(F.trim("title") != "", order)), F.lit("")).alias("tkey"),
        F.min_by("stem", order).alias("stem"), F.min(order).alias("first"),
    )


def syndicated_titles(hits: DataFrame) -> DataFrame:
    """(query, key, syndicated) of each page: its headline was claimed before by another site."""
    return _syndicated(_first_seen(hits))


def _syndicated(pages: DataFrame) -> DataFrame:
    order = Window.partitionBy("query", "tkey").orderBy("first")
    claims = F.size(F.split("tkey", " ")) >= CLAIM_WORDS
    return pages.withColumn("syndicated", claims & (F.first("stem").over(order) != F.col("stem")))


def merge_hits(hits: DataFrame, limit: int = 0) -> DataFrame:
    """Per query one ranked list over all lanes, syndicated copies left out; hits without a url are no pages. Of several
    snippets the longest in bytes stays.

    Only a page that is kept claims its title, so a query's hits (a few lanes' result pages) are gone through in
    order, and those that belong to kept pages are merged. Hits are dealt out by query once, before their keys are made; all
    that follows stays in place, and nothing is written.
    """
    names = ["query", "key", "url", "title", "snippet", "pos", "engines", "first"]
    kept = _first_seen(_kept_hits(_keyed(hits.repartition("query")))).select(names)
    order = Window.partitionBy("query").orderBy("pos", F.desc(F.size("engines")), "first", "key")
    kept = kept.withColumn("place", F.row_number().over(order))
    return (kept.where(F.col("place") <= limit) if limit else kept).drop("first")


def _kept_hits(hits: DataFrame) -> DataFrame:
    """The hits of pages that are kept, from the hit on that a page is kept with: in order, a page is left out while
    another site's kept page has its title."""
    held = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("lane_ord", "pos", "lane", "url", "title", "snippet", "key", "tkey", "stem"))).alias("hits"))
    texts = F.expr("cast(array() as array<string>)")
    start = F.struct(F.lit(0).alias("i"), F.expr("cast(array() as array<int>)").alias("taken"), texts.alias("keys"), texts.alias("titles"), texts.alias("stems"))
    grown = lambda values, v, ok: F.when(ok, F.concat(values, F.array(v))).otherwise(values)

    def step(s: Column, h: Column) -> Column:
        claims = F.size(F.split(h["tkey"], " ")) >= CLAIM_WORDS
        at = F.array_position(s["titles"], h["tkey"])
        known = F.array_contains(s["keys"], h["key"])
        new = ~known & ~(claims & (at > 0) & (F.get(s["stems"], (at - 1).cast("int")) != h["stem"]))
        first = new & claims & (at == 0)
        return F.struct(
            (s["i"] + 1).alias("i"), grown(s["taken"], s["i"], known | new).alias("taken"), grown(s["keys"], h["key"], new).alias("keys"),
            grown(s["titles"], h["tkey"], first).alias("titles"), grown(s["stems"], h["stem"], first).alias("stems"),
        )

    gone = held.select("query", "hits", F.aggregate("hits", start, step)["taken"].alias("taken"))
    return gone.select("query", F.explode(F.transform("taken", lambda i: F.get("hits", i))).alias("h")).select("query", "h.*")


def exclude_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates whose page was not fetched before."""
    keyed = candidates.withColumn("key", canonical_url(F.col("url")))
    return keyed.join(seen.select(canonical_url(F.col("url")).alias("key")).distinct(), "key", "left_anti")


def new_items(items: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return items.select(key).distinct().join(seen.select(key), key, "left_anti")


def latest_cache_entry(puts: DataFrame) -> DataFrame:
    """Last write of each (lane, query, limit); empty responses are not stored."""
    puts = puts.where("hits > 0").withColumn("query", normalize_query(F.col("query")))
    return puts.groupBy("lane", "query", "max_hits").agg(F.max_by(F.struct("put_id", "stored_at", "hits"), F.struct("stored_at", "put_id")).alias("e")).select("lane", "query", "max_hits", "e.*")


def cache_lookup(queries: DataFrame, cache: DataFrame, now: str, ttl_hours: int = 6) -> DataFrame:
    """Queries with ``hit``: stored, not empty and younger than the time to live (an age is 0 at least)."""
    keys = ["lane", "query", "max_hits"]
    wanted = queries.withColumn("query", normalize_query(F.col("query")))
    fresh = F.expr(f"stored_at + interval {ttl_hours} hours >= timestamp_ntz'{now}'")
    return wanted.join(cache.select(*keys, "stored_at", "hits"), keys, "left").withColumn("hit", F.coalesce(fresh & (F.col("hits") > 0), F.lit(False)))


def missing_queries(lookups: DataFrame) -> DataFrame:
    """Each (lane, query, max_hits) that no lookup found, once: what is to be searched."""
    return lookups.where("not hit").select("lane", "query", "max_hits").distinct()


#: Most rows of a list of query parameters.
MOST_PARAMETERS = 10_000


def anchor_stem(anchor: Column) -> Column:
    """The name in a domain-shaped anchor, without www. and what follows the name; another anchor as it is."""
    domain = F.rlike(anchor, F.lit("^[A-Za-z0-9_-]+(\\.[A-Za-z0-9_-]+)+$"))
    return F.when(domain, F.regexp_extract(anchor, "^(?i:www\\.)?([^.]+)", 1)).otherwise(anchor)


def ensure_anchor(query: Column, anchor: Column) -> Column:
    """The query, with the anchor's stem at its end unless it holds it, in whatever case."""
    stem = anchor_stem(anchor)
    return F.when(F.contains(F.lower(query), F.lower(stem)), query).otherwise(F.concat_ws(" ", query, stem))


def fan_out_queries(anchors: DataFrame, values: DataFrame, kinds: DataFrame, template: str = "{anchor} {value} {kind}") -> DataFrame:
    """Every combination of three short parameter lists, as queries that hold the anchor's stem. Combining them is
    the feature; lists of more than MOST_PARAMETERS rows are refused."""
    for given in (anchors, values, kinds):
        if given.limit(MOST_PARAMETERS + 1).count() > MOST_PARAMETERS:
            raise ValueError(f"a list of query parameters has more than {MOST_PARAMETERS} rows")
    query = F.lit(template)
    for name in ("anchor", "value", "kind"):
        query = F.replace(query, F.lit(f"{{{name}}}"), F.col(name))
    return anchors.crossJoin(F.broadcast(values)).crossJoin(F.broadcast(kinds)).select(ensure_anchor(query, F.col("anchor")).alias("query"))


def follow_links(links: DataFrame, pages: DataFrame, floor: float = 0.6, k: int = 12, anchor_k: int = 20, least: int = 2) -> DataFrame:
    """Best links of each page that yielded ``least`` entities, is a seed or lies on the anchor's site: one language
    variant of each, ``anchor_k`` on the anchor's site. ``pages``: page_id, entities, seed, anchor."""
    chosen = pages.where((F.col("entities") >= least) | F.col("seed") | F.col("anchor")).select("page_id", "anchor")
    l = links.join(chosen.hint("merge"), "page_id")  # noqa: E741
    l = l.where(F.col("score") >= floor).withColumn("variant", lang_variant_key(F.col("href")))  # noqa: E741
    l = l.withColumn("nr", F.row_number().over(Window.partitionBy("page_id", "variant").orderBy("pos"))).where("nr = 1")  # noqa: E741
    l = l.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "pos")))  # noqa: E741
    return l.where(F.col("place") <= F.when(F.col("anchor"), anchor_k).otherwise(k)).drop("nr", "variant")
