"""Views over the given tables in the shapes that the operators take, once for each engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

#: The moment that range queries count from; never the wall clock.
NOW = "2024-01-30 12:00:00"

_RUNS = """event_id as id, ts, cast(round(value*1000) as bigint) as elapsed_ms, {query} as query,
  case when k%3=0 then 'harvest' when k%3=1 then 'answer' else 'unknown' end as kind,
  case when user_id%2=0 then 'ui' else 'mcp' end as source,
  case when k%4=0 then 'quick' when k%4=1 then 'thorough' else 'standard' end as preset,
  case event_type when 'purchase' then 'complete' when 'click' then 'partial' when 'signup' then 'truncated'
       when 'view' then 'empty' else case when k%2=0 then 'failed' else 'cancelled' end end as outcome,
  k%7 as records, k%11 as pages, k%5 as rounds, k as judge_requests, k*1000 as judge_input_tokens,
  cast(k*0.000042 as decimal(18,6)) as judge_cost_usd, k%3 as llm_requests,
  k*30 as llm_prompt_tokens, k*7 as llm_completion_tokens,
  case when k%5=0 then null else cast(k*0.001 as decimal(18,6)) end as llm_cost_usd,
  k%2 as planner_requests, k*20 as planner_prompt_tokens, k*3 as planner_completion_tokens,
  case when k%7=0 then null else cast(k*0.002 as decimal(18,6)) end as planner_cost_usd"""
RUNS = f"""runs as (select {_RUNS.format(query="'query ' || user_id")} from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events))"""

_HITS = """l_orderkey as query, case l_linestatus when 'O' then 'ddg' else 'jina' end as lane,
  case l_linestatus when 'O' then 0 else 1 end as lane_ord, l_linenumber as pos,
  concat(case when l_partkey%3=0 then 'https://www.site' else 'https://site' end, cast(l_partkey%50 as varchar(9)), '.example.org/p/', cast(l_partkey%7 as varchar(9)),
    case when l_partkey%5=0 then '/?utm_source=feed' when l_partkey%5=1 then '#top' else '' end) as url,
  case when l_partkey%2=0 then concat(p_name, ' ', p_name) else p_name end as title,
  repeat(p_type, l_linenumber%3+1) as snippet"""
HITS = f"hits as (select {_HITS} from lineitem join part on l_partkey = p_partkey)"

_SCORES = """l_orderkey as query, l_linenumber as item, l_partkey, l_suppkey, l_discount*10 as relevance, l_tax*10 as slop, l_extendedprice/100000 as authority,
  case when l_suppkey%9=0 then null else l_quantity/50 end as p,
  case l_partkey%6 when 0 then 'supports' when 1 then 'contradicts' when 2 then 'not_addressed' when 3 then 'ambiguous' when 4 then 'mixed' else 'odd' end as label"""
SCORES = f"scores as (select {_SCORES} from lineitem)"

_PASSAGES = """d.doc_id, d.source, d.text, cast(l.toxic as double) as injection, cast(l.quality as double) as supports"""
PASSAGES = f"passages as (select {_PASSAGES} from documents d left join labels l on d.doc_id = l.doc_id)"

_RECORDS = """p_partkey as record_id, p_name as name, case when p_size%5=0 then null else p_brand end as brand, p_type as type,
  concat('https://site', cast(p_partkey%97 as varchar(9)), '.example.org/list') as source_url, p_size/50.0e0 as grounding,
  case p_partkey%4 when 0 then 'same' when 1 then 'related' when 2 then 'unresolved' else 'different' end as binding,
  case p_partkey%6 when 0 then 'supports' when 1 then 'contradicts' when 2 then 'not_addressed' when 3 then 'supports' when 4 then 'unchecked' else 'mixed' end as status,
  p_retailprice as price, p_size"""
RECORDS = f"records as (select {_RECORDS} from part)"

_STAGES = """l_orderkey as run, case l_partkey%8 when 0 then 'search' when 1 then 'fetch' when 2 then 'classify (LLM)' when 3 then 'plan' when 4 then 'extract' when 5 then 'triage' when 6 then 'screen' else 'other' end as stage,
  cast(l_quantity*100 as bigint) as ms, l_linenumber as calls"""
STAGES = f"stages as (select {_STAGES} from lineitem)"

_CACHE = """o_orderkey as put_id, o_orderstatus as lane, case when o_orderkey%2=0 then upper(o_orderpriority) else concat('  ', replace(o_orderpriority, ' ', '   ')) end as query,
  o_custkey%3 as max_hits, o_orderdate as stored_at, o_custkey%4 as hits"""
CACHE = f"puts as (select {_CACHE} from orders)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return _columns(events, _RUNS.format(query="concat('query ', user_id)"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return _columns(table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")), _HITS)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(table(spark, sf_dir, "lineitem"), _SCORES)


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").alias("d"), table(spark, sf_dir, "labels").alias("l")
    return _columns(docs.join(labels, F.col("d.doc_id") == F.col("l.doc_id"), "left"), _PASSAGES)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(table(spark, sf_dir, "part"), _RECORDS)


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(table(spark, sf_dir, "lineitem"), _STAGES)


def puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(table(spark, sf_dir, "orders"), _CACHE)


def _columns(df: DataFrame, select: str) -> DataFrame:
    """The select list, its top-level commas parted, over ``df``."""
    parts, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(select):
        quoted ^= c == "'"
        depth += (not quoted) * ((c == "(") - (c == ")"))
        if c == "," and not depth and not quoted:
            parts.append(select[start:i])
            start = i + 1
    return df.selectExpr(*parts, select[start:])
