"""Gate queries over ``lineitem``, ``documents``, ``labels`` and ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import page_text
from ..operators import gates as G
from . import fixtures as X
from .pages import text_table
from .registry import register, table


@register("gate_triage", f"""with {X.SCORES} select query, item, relevance >= 0.35 and slop <= 0.75 as kept,
  case when relevance >= 0.35 then case when slop <= 0.75 then null else 'slop' end else 'relevance' end as drop_reason from scores""")
def gate_triage(spark, d):
    return G.gate_triage(X.scores(spark, d)).select("query", "item", "kept", "drop_reason")


@register("gate_quarantine", f"""with {X.PASSAGES} select source, count(*) filter (coalesce(injection, 1.0) >= 0.55) as quarantined, count(*) filter (coalesce(injection, 1.0) < 0.55) as safe,
  count(distinct source || '/' || doc_id%50) filter (coalesce(injection, 1.0) >= 0.55) as urls from passages group by source""")
def gate_quarantine(spark, d):
    safe, bad = G.gate_quarantine(X.passages(spark, d).withColumn("url", F.concat("source", F.lit("/"), F.col("doc_id") % 50)))
    urls = G.quarantined_urls(bad).select(F.substring_index("url", "/", 1).alias("source"), F.lit(None).cast("boolean").alias("bad"))
    both = safe.select("source", F.lit(False).alias("bad")).union(bad.select("source", F.lit(True).alias("bad"))).union(urls)
    return both.groupBy("source").agg(F.count_if("bad").alias("quarantined"), F.count_if(~F.col("bad")).alias("safe"), F.count_if(F.col("bad").isNull()).alias("urls"))


@register("gate_extractable", f"with {X.SCORES} select query, item from scores where slop >= 0.12")
def gate_extractable(spark, d):
    return G.gate_extractable(X.scores(spark, d).withColumnRenamed("slop", "has_items")).select("query", "item")


@register("gate_grounding", f"with {X.SCORES} select query, count(*) filter (coalesce(p,0) >= 0.6) as grounded, count(*) filter (coalesce(p,0) < 0.6) as rejected from scores group by query")
def gate_grounding(spark, d):
    g = G.gate_grounding(X.scores(spark, d).withColumnRenamed("p", "grounding"))
    return g.groupBy("query").agg(F.count_if("grounded").alias("grounded"), F.count_if(~F.col("grounded")).alias("rejected"))


@register("gate_support", f"with {X.SCORES} select query, item from scores where p >= 0.45 or relevance >= 0.45 or slop >= 0.45")
def gate_support(spark, d):
    s = X.scores(spark, d).withColumn("part_support", F.array("relevance", "slop")).withColumnRenamed("p", "supports")
    return G.gate_support(s).select("query", "item")


@register("gate_constraints", f"""with {X.SCORES}, v as (select query as record, item as "constraint", coalesce(p,0) as p, relevance as page_p,
    case when label in ('supports','contradicts','not_addressed','ambiguous','mixed') then label else 'not_addressed' end as known from scores),
  s as (select *, case when known='contradicts' then known when p >= 0.5 or (coalesce(page_p,0) >= 0.70 and p >= 0.25) then 'supports' when known='supports' then 'not_addressed' else known end as status from v)
  select record, bool_or(status='contradicts') as excluded, min(p) as support, string_agg(status, ',' order by "constraint", status) as statuses from s group by record""")
def gate_constraints(spark, d):
    s = X.scores(spark, d).select(F.col("query").alias("record"), F.col("item").alias("constraint"), "p", F.col("relevance").alias("page_p"), "label")
    return G.gate_constraints(s)


@register("gate_binding", f"with {X.RECORDS} select record_id, case binding when 'same' then true when 'related' then false when 'different' then false else coalesce(grounding >= 0.75, false) end as accepted from records")
def gate_binding(spark, d):
    return G.gate_binding(X.records(spark, d)).select("record_id", "accepted")


@register("validate_scores", f"with {X.SCORES} select query, item from scores where (relevance is null or (not isnan(relevance) and relevance between 0 and 1)) and (authority is null or authority between 0 and 1) and (p is null or p between 0 and 1)")
def validate_scores(spark, d):
    s = X.scores(spark, d).withColumn("probabilities", F.create_map(F.lit("yes"), "p"))
    return G.validate_scores(s, ["relevance", "authority"], "probabilities").select("query", "item")


@register("thin_pages", f"""with t as (select page_id, length(html) as chars, length(text) as text from {text_table()}) select page_id, text < 1200 and chars > 2000 as shell from t where (text < 1200 and chars > 2000) or (page_id%3 = 0 and page_id%2 <> 0)""")
def thin_pages(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html", page_text(F.col("html")).alias("text"), (F.col("page_id") % 3).alias("records"), (F.col("page_id") % 2 == 0).alias("rendered"))
    return G.thin_pages(pages)


@register("completeness", f"""with {X.RECORDS} select record_id, coalesce(brand,'') <> '' and status = 'supports' and binding <> 'related' as complete,
  concat_ws('; ', case when coalesce(brand,'') = '' then 'missing brand' end, case when status <> 'supports' then 'unverified constraint' end, case when binding = 'related' then 'related entity' end) as status from records""")
def completeness(spark, d):
    r = X.records(spark, d).withColumn("fields", F.map_filter(F.create_map(F.lit("name"), "name", F.lit("brand"), "brand", F.lit("type"), "type"), lambda k, v: v.isNotNull()))
    return G.completeness(r.withColumn("constraint_status", F.array("status")), ["name", "brand", "type"])


@register("support_band", f"with {X.SCORES} select query, item, case when p >= 0.8 then 'strong' when p >= 0.5 then 'medium' when p is not null then 'weak' end as band from scores")
def support_band(spark, d):
    return G.support_band(X.scores(spark, d)).select("query", "item", "band")


@register("determination", f"with {X.SCORES} select query, item, case when p >= 0.6 then 'yes' when p <= 0.1 then 'no' else '' end as answer from scores")
def determination(spark, d):
    return G.determination(X.scores(spark, d)).select("query", "item", "answer")


@register("gate_queries", f"with {X.SCORES}, r as (select query as round, item as query, p as score, row_number() over (partition by query order by p desc nulls last, item) as rank from scores) select round, query, score from r where rank <= 2 or score >= 0.4")
def gate_queries(spark, d):
    return G.gate_queries(X.scores(spark, d).select(F.col("query").alias("round"), F.col("item").alias("query"), F.col("p").alias("score")))


@register("gate_claims", f"with {X.SCORES} select query as run, count(p) as claims_checked, count(*) filter (p < 0.5) as unsupported_claims from scores group by query")
def gate_claims(spark, d):
    return G.gate_claims(X.scores(spark, d).select(F.col("query").alias("run"), F.col("p").alias("score")))


@register("attach_scores", """select d.doc_id, coalesce(cast(l.quality as double), 0) as score, coalesce(case doc_id%3 when 0 then l.quality when 1 then 1 - l.quality end, 0)*1.0e0 as option_p
  from documents d left join labels l using (doc_id)""")
def attach_scores(spark, d):
    quality = F.col("quality").cast("double")
    labels = table(spark, d, "labels").select("doc_id", quality.alias("score"), F.create_map(F.lit("yes"), quality, F.lit("no"), 1 - quality).alias("probabilities"))
    items = table(spark, d, "documents").selectExpr("doc_id", "case doc_id%3 when 0 then 'yes' when 1 then 'no' else 'other' end as picked")
    return G.attach_scores(items, labels, ["doc_id"], 0.0, "picked").select("doc_id", "score", "option_p")


@register("best_evidence", f"""with {X.SCORES} select query, item, row_number() over (partition by query order by p*coalesce(case when item=3 then null else relevance end, 1.0e0) desc nulls last, item, coalesce(case when item=3 then null else relevance end, 1.0e0)) as rank,
  case when coalesce(case when item=3 then null else relevance end, 1.0e0) < 0.25 then 'may be superseded' else '' end as note from scores""")
def best_evidence(spark, d):
    s = X.scores(spark, d).select("query", "item", F.col("p").alias("supports"), F.when(F.col("item") != 3, F.col("relevance")).alias("currency"))
    return G.best_evidence(s)


@register("rank_with_agreement", f"""with {X.SCORES}, k as (select query, item, authority, round(relevance*(1+least(0.15e0*(l_partkey%4), 0.30e0)), 9) as boosted from scores where relevance >= 0.35 and slop <= 0.75),
  r as (select query, item, boosted, row_number() over (partition by query order by boosted desc, authority desc, item) as place from k) select * from r where place <= 3""")
def rank_with_agreement(spark, d):
    s = G.gate_triage(X.scores(spark, d)).select("query", "item", "authority", "kept", F.col("relevance").alias("rank"), (F.col("l_partkey") % 4 + 1).alias("engines"))
    return G.rank_with_agreement(s)


@register("drop_unmentioned", f"""with {X.SCORES}, e as (select l_suppkey%10 as page, count(distinct l_partkey) as entities, l_suppkey%10/10.0e0 as completeness, l_suppkey%10 <> 7 as on_anchor, -(l_suppkey%10) as seq from scores group by l_suppkey%10),
  a as (select page from e where on_anchor and entities >= 3 and completeness >= 0.8 order by seq limit 3), r as (select query as record, bool_or(l_suppkey%5=0) as own_site from scores group by 1),
  m as (select query as record, max(coalesce(p,1)) as most, count(distinct page) as answered from scores join a on l_suppkey%10 = page group by 1)
  select record, own_site from r left join m using (record) where own_site or case when coalesce(answered, 0) < (select count(*) from a) then 1 else coalesce(most, 1) end > 0.2""")
def drop_unmentioned(spark, d):
    s = X.scores(spark, d).select(F.col("query").alias("record"), (F.col("l_suppkey") % 10).alias("page"), F.col("p").alias("presence"), "l_suppkey", "l_partkey")
    pages = s.groupBy("page").agg(F.count_distinct("l_partkey").alias("entities")).selectExpr("page", "entities", "page/10.0D as completeness", "page <> 7 as on_anchor", "-page as seq")
    records = s.groupBy("record").agg(F.bool_or(F.col("l_suppkey") % 5 == 0).alias("own_site"))
    return G.drop_unmentioned(records, s.select("record", "page", "presence"), G.enumeration_authorities(pages))


@register("other_set_excluded", f"with {X.SCORES} select query as record from scores group by 1 having not bool_and(l_suppkey%3<2) or bool_or(label='supports')")
def other_set_excluded(spark, d):
    s = X.scores(spark, d).select(F.col("query").alias("record"), (F.col("l_suppkey") % 3 < 2).alias("other_set"), (F.col("label") == "supports").alias("supported"))
    return G.other_set_excluded(s)
