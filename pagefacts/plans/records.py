"""Record, report and run-log-file queries over ``part``, ``orders``, ``lineitem`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize_entity
from ..functions.urls import domain
from ..operators import records as R
from ..operators.graph import work_path
from ..sources import export, runlog
from . import fixtures as X
from .registry import register, table

_NAMES = """p_partkey, case p_partkey%5 when 0 then concat('Ayuntamiento de ', p_name) when 1 then concat(upper(p_name), ' (Madrid)') when 2 then concat('owner/', replace(p_name, ' ', '-')) when 3 then concat(p_name, ' Udala') else p_name end as name"""


@register("normalize_entities", f"select p_partkey, trim(regexp_replace(case p_partkey%5 when 2 then replace(p_name, ' ', '-') else lower(p_name) end, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as key from (select {_NAMES}, p_name from part)")
def normalize_entities(spark, d):
    return X._columns(table(spark, d, "part"), _NAMES).select("p_partkey", normalize_entity(F.col("name")).alias("key"))


@register("drop_category_echo", f"with {X.RECORDS} select record_id from records where exists (select 1 from (select unnest(string_split(name, ' ')) as w) where w not in ('small','steel','blue'))")
def drop_category_echo(spark, d):
    return R.drop_category_echo(X.records(spark, d), "Small Steel Blue").select("record_id")


@register("name_pairs", """with k as (select distinct concat_ws(' ', case when p_size%9=0 then replace(p_name, ' ', '') else p_name end, case when p_size%7=0 then lower(p_brand) end) as key from part), w as (select distinct key, unnest(string_split(key, ' ')) as word from k), n as (select key, count(*) as n from w group by key),
  s as (select x.key as a, y.key as b, count(*) as shared from w x join w y on x.word = y.word and x.key < y.key group by 1, 2)
  select a, b, cast(shared as integer) as shared from s join n na on a = na.key join n nb on b = nb.key where shared*100 >= least(na.n, nb.n)*60
  union select least(x.key, y.key), greatest(x.key, y.key), cast(len(list_intersect(list_distinct(string_split(x.key, ' ')), list_distinct(string_split(y.key, ' ')))) as integer) from k x join k y on x.key <> y.key and contains(y.key, x.key) and length(x.key) >= 3""")
def name_pairs(spark, d):
    return R.name_pairs(table(spark, d, "part").selectExpr("concat_ws(' ', case when p_size%9=0 then replace(p_name, ' ', '') else p_name end, case when p_size%7=0 then lower(p_brand) end) as key"))


@register("shared_email_pairs", "with e as (select c_custkey as id, 'm' || c_nationkey || '@' || c_mktsegment || '.org' as email from customer), l as (select email, min(id) as a from e group by email) select a, id as b from e join l using (email) where id <> a")
def shared_email_pairs(spark, d):
    mails = table(spark, d, "customer").selectExpr("c_custkey as id", "concat('m', c_nationkey, '@', c_mktsegment, '.org') as email")
    return R.shared_email_pairs(mails)


_PAIRS = "p_partkey as a, p_partkey+p_size as b, case when p_size%20=0 then 'email' else 'name' end as kind, (p_partkey%4)*0.6e0 as score"


@register("merge_groups", f"""with recursive p as (select {_PAIRS} from part), ok as (select a, b from p where score >= case kind when 'email' then 1.0 else 1.5 end),
  e as (select a as u, b as v from ok union select b, a from ok), r as (select u as node, u as reach from e union select r.node, e.v from r join e on r.reach = e.u)
  select node, min(reach) as component from r group by node""")
def merge_groups(spark, d):
    return R.merge_groups(X._columns(table(spark, d, "part"), _PAIRS))


_STATUSES = "case when record_id%3=0 then array(status) when record_id%3=1 then array('unchecked', status) else array(status, 'mixed', 'not_addressed') end"
_DUCK_STATUSES = _STATUSES.replace("array(", "list_value(")


_OWN_SOURCE = "case when record_id%4=0 then concat('https://checked', cast(record_id%9 as varchar(9)), '.example.org/') end"


@register("merge_records", f"""with {X.RECORDS}, s as (select *, coalesce({_OWN_SOURCE}, source_url) as brand_url, case when record_id%4=0 then 0.985e0 - (record_id%90)/1000.0e0 else grounding end as brand_grounding from records),
  m as (select name, arg_max(brand, brand_grounding*1000000000 - record_id) filter (brand <> '') as brand, arg_max(type, grounding*1000000000 - record_id) as type,
    arg_max(brand_url || ' ' || round(brand_grounding, 6), brand_grounding*1000000000 - record_id) filter (brand <> '') as brand_source, arg_max(source_url || ' ' || round(grounding, 6), grounding*1000000000 - record_id) as type_source,
    ['different','unresolved','related','same'][max(list_position(['different','unresolved','related','same'], binding))] as binding, string_agg(distinct source_url, '|' order by source_url) as sources from s group by name),
  e as (select name, record_id, unnest({_DUCK_STATUSES}) as status, generate_subscripts({_DUCK_STATUSES}, 1) as i from records),
  c as (select name, i, case when bool_or(status='supports') then 'supports' else coalesce(arg_min(status, record_id) filter (status <> 'unchecked'), 'unchecked') end as status from e group by name, i),
  l as (select name, string_agg(status, ',' order by i) as statuses from c group by name)
  select name, brand, type, binding, sources, statuses, concat_ws(';', 'brand=' || brand_source, 'type=' || type_source) as provenance from m join l using (name)""")
def merge_records(spark, d):
    """Some brands were verified on another page than their records'."""
    source = F.struct(F.expr(_OWN_SOURCE).alias("source_url"), F.expr("0.985D - (record_id%90)/1000.0D").alias("grounding"))
    records = X.records(spark, d).withColumn("statuses", F.expr(_STATUSES)).withColumn("provenance", F.when(F.col("record_id") % 4 == 0, F.create_map(F.lit("brand"), source)))
    merged = R.merge_records(records, "name", ["brand", "type"])
    told = F.array_join(F.array_sort(F.transform(F.map_entries("provenance"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["source_url"], F.lit(" "), F.round(e["value"]["grounding"], 6)))), ";")
    return merged.select("name", "brand", "type", "binding", "sources", F.array_join("statuses", ",").alias("statuses"), told.alias("provenance"))


_RUN_RECORDS = "record_id%50 as run, record_id, brand is not null and status='supports' as complete, p_size%13 as grounding, record_id as seq"


@register("complete_first", f"""with {X.RECORDS}, r as (select {_RUN_RECORDS} from records), o as (select run, record_id, row_number() over (partition by run order by complete desc, grounding desc, seq) as place,
    count(*) over (partition by run) as total, count(*) filter (complete) over (partition by run) as n_complete from r) select *, least(total, 10) as shown from o where place <= 10""")
def complete_first(spark, d):
    r = X._columns(X.records(spark, d), _RUN_RECORDS)
    return R.complete_first(r, target=10).select("run", "record_id", "place", "total", "n_complete", "shown")


@register("field_fill_profile", f"""with {X.RECORDS}, c as (select 'name' as field, count(*) filter (coalesce(name,'')<>'') as filled, count(*) as n from records union all select 'brand', count(*) filter (coalesce(brand,'')<>''), count(*) from records union all select 'type', count(*) filter (coalesce(type,'')<>''), count(*) from records),
  s as (select * from records order by record_id limit 5)
  select 'field' as section, field as name, filled as n, round(filled/cast(n as double), 4) as rate from c union all select 'domain', regexp_extract(source_url, '://([^/]*)', 1), count(*), null from records group by 2
  union all select 'sample', '{{"name":"' || name || '"' || coalesce(',"brand":"' || brand || '"', '') || ',"type":"' || type || '"}}', record_id, null from s""")
def field_fill_profile(spark, d):
    return R.set_summary(X.records(spark, d).withColumn("domain", domain(F.col("source_url"))), ["name", "brand", "type"])


@register("run_sources", f"with {X.RECORDS} select distinct record_id%10 as run, source_url from records where grounding >= 0.6")
def run_sources(spark, d):
    return R.run_sources(X.records(spark, d).withColumn("run", F.col("record_id") % 10))


@register("domain_productivity", "with r as (select regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^(www\\.)+', '') as domain, page_id%3=0 as complete from pages) select domain, count(*) as records, count(*) filter (complete) as complete from r group by domain")
def domain_productivity(spark, d):
    return R.domain_productivity(table(spark, d, "pages").select(domain(F.col("url")).alias("domain"), (F.col("page_id") % 3 == 0).alias("complete")))


@register("page_yield", f"with {X.RECORDS} select source_url, count(distinct name) as entities from records group by source_url having count(distinct name) >= 2")
def page_yield(spark, d):
    return R.page_yield(X.records(spark, d))


@register("yield_sketch", "with r as (select l_suppkey, count(distinct l_orderkey) as n from lineitem group by 1 having count(distinct l_orderkey) >= 2) select cast(l_suppkey as varchar) as source_url, true as close from r")
def yield_sketch(spark, d):
    """Sketches of months, merged, against the exact number of orders: within 3 % (with so many registers a supplier's error
    is 0.8 % in the mean) or two orders."""
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("source_url"), F.col("l_orderkey").cast("string").alias("name"), F.date_trunc("month", "l_shipdate").alias("month"))
    found = R.merged_yield(R.yield_sketches(items, "month")).withColumnRenamed("entities", "about")
    return R.page_yield(items).join(found.hint("merge"), "source_url", "left").select("source_url", F.coalesce(F.abs(F.col("about") - F.col("entities")) <= F.greatest(F.lit(2.0), F.col("entities") * 0.03), F.lit(False)).alias("close"))


@register("conflict_report", "with v as (select c_custkey, o_orderpriority, count(distinct o_orderkey) as sources from customer join orders on c_custkey=o_custkey group by 1, 2) select c_custkey, count(*) as n_values, string_agg(o_orderpriority || '=' || sources, '; ' order by o_orderpriority) as seen from v group by c_custkey having count(*) > 1")
def conflict_report(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return R.conflict_report(joined, "c_custkey", "o_orderpriority", "o_orderkey")


_TEMPLATES = ["{entity} official {field}", "{entity} {field} report", "{entity} {field}"]


@register("enrich_worklist", f"""with {X.RECORDS}, l as (select concat(name, ' ', record_id%40) as name, max(brand) as brand, max(type) as type from records group by 1), f as (select name, 'brand' as field, (row_number() over (order by name) - 1)//25 + 1 as round from l where brand is null)
  select name, field, replace(replace(t, '{{entity}}', name), '{{field}}', field) as query, round from f, (select unnest({_TEMPLATES}) as t)""")
def enrich_worklist(spark, d):
    named = X.records(spark, d).withColumn("name", F.expr("concat(name, ' ', record_id%40)"))
    return R.enrich_worklist(named, ["brand", "type"], _TEMPLATES)


@register("fact_rollup", f"with {X.RECORDS} select type as kind, count(*) as records, count(p) as with_metric, round(avg(cast(brand is not null as int)), 4) as share, round(quantile_cont(p, 0.5), 4) as median from (select *, case when p_size%5=1 then null else price end as p from records) group by type")
def fact_rollup(spark, d):
    r = X.records(spark, d).selectExpr("type as kind", "case when p_size%5=1 then null else price end as p", "brand is not null as has_brand")
    return R.fact_rollup(r, "kind", "p", "has_brand")


@register("retain_newest", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as nr from orders) where nr <= 5")
def retain_newest(spark, d):
    return R.retain_newest(table(spark, d, "orders"), "o_custkey", "o_orderdate", 5, "o_orderkey").select("o_custkey", "o_orderkey")


@register("retain_stored", """with r as (select *, o_orderkey%3 as day from orders), k as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as nr from r) select o_custkey, o_orderkey from k where nr <= 5""")
def retain_stored(spark, d):
    """Orders come in three rounds, the last one twice."""
    path, orders = work_path(spark, "retained"), table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    for day in (0, 1, 2, 2):
        R.retain_stored(orders.where(F.col("o_orderkey") % 3 == day), path, "o_custkey", "o_orderdate", 5, "o_orderkey", 8)
    return spark.read.parquet(path).select("o_custkey", "o_orderkey")


@register("read_run_log", "select event_id as id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0) as records, case when event_id%7=0 then 0 else event_id%9 end as judge_requests, event_id%7=0 as rejected from events where event_id%11 <> 0")
def read_run_log(spark, d):
    line = "case when event_id%11=0 then '  ' when event_id%7=0 then concat('{\"id\": ', event_id) else concat('{\"id\":\"', event_id, '\",\"unknown\":1,\"records\":', get_json_object(props,'$.k'), ',\"scorer_requests\" : ', event_id%9, ',\"search_requests\":99,\"scorer_input_tokens\":1,\"scorer_cost_usd\":0.5}') end"
    path = work_path(spark, "runlog")
    table(spark, d, "events").selectExpr(f"{line} as value").write.text(path)
    runs, rejects = runlog.read_run_log(spark, path)
    bad = rejects.join(table(spark, d, "events").selectExpr("event_id as id", "cast(get_json_object(props,'$.k') as bigint) as records", "concat('{\"id\": ', event_id) as value").hint("merge"), "value")
    return runs.select(F.col("id").cast("long").alias("id"), "records", "judge_requests", F.lit(False).alias("rejected")).union(bad.select("id", "records", F.lit(0).cast("long"), F.lit(True)))


_EVENT = "case event_type when 'signup' then 'accepted' when 'view' then 'progress' when 'click' then 'usage' when 'purchase' then 'result' else 'error' end"


@register("demux_event_log", f"select {_EVENT} as type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k from events group by 1")
def demux_event_log(spark, d):
    events = table(spark, d, "events").selectExpr(f"{_EVENT} as type", "props as payload").withColumn("k", F.from_json("payload", "k long")["k"])
    parts = [df.select(F.lit(t).alias("type"), "k") for t, df in runlog.demux_event_log(events).items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.groupBy("type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@register("append_run_log", "select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 1")
def append_run_log(spark, d):
    path = work_path(spark, "runlog")
    runs = X.runs(spark, d).select(F.col("id").cast("string").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("started_at"), "elapsed_ms", "outcome")
    for part in ("id % 2 = 0", "id % 2 = 0", "id % 2 = 1"):
        runlog.append_run_log(runs.where(part), path)
    return spark.read.schema("id string, started_at long, elapsed_ms long, outcome string, day string").json(path).groupBy("day").agg(F.count("*").alias("n"))


def _exported(spark, d):
    r = X.records(spark, d)
    fields = F.map_filter(F.create_map(F.lit("name"), "name", F.lit("brand"), "brand", F.lit("type"), "type"), lambda k, v: v.isNotNull())
    source = F.create_map(F.lit("name"), "source_url", F.lit("brand"), F.when(F.col("record_id") % 9 == 0, F.lit("https://other.example.org/")).otherwise(F.col("source_url")))
    return r.select("record_id", fields.alias("fields"), source.alias("provenance"), "source_url", "grounding", F.lit(1.0).alias("constraint_support"))


@register("export_csv", f"with {X.RECORDS} select type, name, coalesce(brand, '') as brand, source_url, printf('%.2f', grounding) as grounding, '1.00' as constraint_support, case when record_id%9=0 then 'https://other.example.org/' else source_url end as brand_source_url from records")
def export_csv(spark, d):
    return export.csv_table(_exported(spark, d), ["type", "name"])


@register("export_jsonl", """with r as (select o_custkey as run, o_orderkey as seq, o_orderstatus as status, o_custkey%2=0 as answer from orders), lines as (select run, 0 as section, seq, '{"status":"' || status || '"}' as value from r where not answer
  union all select distinct run, 0, 0, '{"type":"answer","text":"answer ' || run || '"}' from r where answer union all select run, 1, seq, '{"passage":"' || status || '"}' from r where answer
  union all select run, 2, 0, '{"type":"summary","records":' || count(*) || '}' from r group by run) select run, section, cast(seq as bigint) as seq, value from lines""")
def export_jsonl(spark, d):
    r = table(spark, d, "orders").selectExpr("o_custkey as run", "o_orderkey as seq", "o_orderstatus as status", "o_custkey%2=0 as answer")
    answers = r.where("answer").select("run", F.concat(F.lit("answer "), "run").alias("text")).distinct()
    evidence = r.where("answer").select("run", "seq", F.col("status").alias("passage"))
    return export.jsonl_lines(r.where("not answer").drop("answer"), r.groupBy("run").agg(F.count("*").alias("records")), answers, evidence)


@register("export_report_json", """with l as (select l_orderkey as run, string_agg('{"seq":' || l_linenumber || ',"part":' || l_partkey || '}', ',' order by l_linenumber, l_partkey) as items from (select distinct l_orderkey, l_linenumber, l_partkey from lineitem) group by 1)
  select o_orderkey as run, '{"outcome":"' || o_orderstatus || '","records":[' || coalesce(items, '') || ']}' as report from orders left join l on o_orderkey = run""")
def export_report_json(spark, d):
    items = table(spark, d, "lineitem").selectExpr("l_orderkey as run", "l_linenumber as seq", "l_partkey as part").distinct()
    return export.report_json(table(spark, d, "orders").selectExpr("o_orderkey as run", "o_orderstatus as outcome"), items)
