"""Run log queries over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import run_stats as S
from . import fixtures as X
from .fixtures import NOW
from .registry import register, table

_COST = "coalesce(judge_cost_usd,0)+coalesce(llm_cost_usd,0)+coalesce(planner_cost_usd,0)"
_FROM = {
    "hour": f"date_trunc('hour', timestamp '{NOW}' - interval 167 hours)",
    "day": f"date_trunc('day', timestamp '{NOW}' - interval 29 days)",
    "week": f"date_trunc('week', timestamp '{NOW}' - interval 29 days)",
}
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"


def _ranged(bucket: str) -> str:
    return f"ranged as (select * from runs where ts >= {_FROM[bucket]} and ts <= timestamp '{NOW}')"


def _counts(column: str, values: list[str]) -> str:
    return ", ".join(f"count(*) filter ({column} = '{v}') as {column}_{v}" for v in values)


@register("in_range", f"with {X.RUNS}, {_ranged('day')} select id, ts from ranged")
def in_range(spark, d):
    return S.in_range(X.runs(spark, d), "day", 30, NOW).select("id", "ts")


@register("run_totals", f"""with {X.RUNS}, {_ranged('day')} select count(*) as runs, {_counts('outcome', S.OUTCOMES)}, {_counts('kind', S.KINDS)}, {_counts('source', S.SOURCES)},
  cast(coalesce(sum(records),0) as bigint) as records, cast(coalesce(sum(pages),0) as bigint) as pages, round(cast(coalesce(sum({_COST}),0) as double), 6) as cost,
  coalesce(round(cast(sum({_COST}) as double)/count(*), 6), 0) as avg_cost, coalesce(round(sum(elapsed_ms)/(count(*)*1000.0e0), 3), 0) as avg_seconds,
  coalesce(round(count(*) filter (outcome='complete')/cast(count(*) as double), 4), 0) as success_rate from ranged""")
def run_totals(spark, d):
    return S.run_totals(S.in_range(X.runs(spark, d), "day", 30, NOW))


@register("latency_percentiles", f"with {X.RUNS} select preset, coalesce(quantile_disc(elapsed_ms, 0.5)/1000.0e0, 0) as p50, coalesce(quantile_disc(elapsed_ms, 0.9)/1000.0e0, 0) as p90 from runs group by preset")
def latency_percentiles(spark, d):
    return S.latency_percentiles(X.runs(spark, d), ["preset"])


@register("cost_by_actor", f"""with {X.RUNS} select round(cast(coalesce(sum(judge_cost_usd),0) as double),6) as judge, round(cast(coalesce(sum(llm_cost_usd),0) as double),6) as writer,
  round(cast(coalesce(sum(planner_cost_usd),0) as double),6) as planner, round(cast(coalesce(sum({_COST}),0) as double),6) as total from runs""")
def cost_by_actor(spark, d):
    return S.cost_by_actor(X.runs(spark, d))


@register("strict_run_cost", f"""with {X.RUNS} select id, cast((case when judge_requests=0 then 0 else judge_cost_usd end) + (case when llm_requests=0 then 0 else llm_cost_usd end)
  + (case when planner_requests=0 then 0 else planner_cost_usd end) as double) as cost from runs""")
def strict_run_cost(spark, d):
    return S.strict_run_cost(X.runs(spark, d))


@register("token_totals", f"""with {X.RUNS} select {', '.join(f'cast(coalesce(sum({c}),0) as bigint) as {c}' for c in ('judge_input_tokens', 'llm_prompt_tokens', 'llm_completion_tokens', 'planner_prompt_tokens', 'planner_completion_tokens'))},
  round(cast(coalesce(sum(judge_input_tokens),0) as bigint) * 42e-9, 9) as judge_cost from runs""")
def token_totals(spark, d):
    return S.token_totals(X.runs(spark, d))


def _series(bucket: str, step: str) -> str:
    return f"""{X.RUNS}, {_ranged(bucket)}, days as (select unnest(generate_series({_FROM[bucket]}, date_trunc('{bucket}', timestamp '{NOW}'), interval {step})) as b),
  own as (select date_trunc('{bucket}', ts) as b, count(*) as runs, {', '.join(f"count(*) filter (outcome = '{o}') as {o}" for o in S.OUTCOMES)}, sum({_COST}) as cost, sum(elapsed_ms) as ms from ranged group by 1),
  series as (select {_ISO.format('days.b')} as bucket, coalesce(runs,0) as runs, {', '.join(f'coalesce({o},0) as {o}' for o in S.OUTCOMES)}, round(coalesce(cast(cost as double),0),6) as cost,
    coalesce(round(ms/(runs*1000.0e0),3),0) as avg_seconds from days left join own using (b))"""


@register("activity_series", f"with {_series('day', '1 day')} select * from series")
def activity_series(spark, d):
    return S.activity_series(X.runs(spark, d), "day", 30, NOW)


@register("activity_series_hour", f"with {_series('hour', '1 hour')} select * from series")
def activity_series_hour(spark, d):
    return S.activity_series(X.runs(spark, d), "hour", 30, NOW)


@register("activity_series_week", f"with {_series('week', '7 days')} select * from series")
def activity_series_week(spark, d):
    return S.activity_series(X.runs(spark, d), "week", 30, NOW)


def _by(column: str, values: list[str]) -> str:
    return f"""with {X.RUNS}, wanted as (select unnest({values}) as v), own as (select {column} as v, count(*) as n, sum(elapsed_ms) as ms, cast(sum({_COST}) as double) as cost, count(*) filter (outcome='complete') as complete from runs group by 1)
  select wanted.v as {column}, coalesce(n,0) as runs, coalesce(round(ms/(n*1000.0e0),3),0) as avg_seconds, coalesce(round(cost/n,6),0) as avg_cost, coalesce(round(complete/cast(n as double),4),0) as success_rate from wanted left join own using (v)"""


@register("by_kind", _by("kind", S.KINDS))
def by_kind(spark, d):
    return S.by_value(X.runs(spark, d), "kind", S.KINDS)


@register("by_preset", f"with {X.RUNS}, wanted as (select unnest({S.PRESETS}) as preset) select preset, coalesce(n,0) as runs from wanted left join (select preset, count(*) as n from runs group by 1) using (preset)")
def by_preset(spark, d):
    return S.by_value(X.runs(spark, d), "preset", S.PRESETS).select("preset", "runs")


@register("run_breakdown", f"""with {X.RUNS}, wanted as (select 'all' as dimension, '' as value union all select 'kind', unnest({S.KINDS}) union all select 'preset', unnest({S.PRESETS})),
  own as (select d as dimension, case d when 'all' then '' when 'kind' then kind else preset end as value, count(*) as n, sum(elapsed_ms) as ms, cast(sum({_COST}) as double) as cost, count(*) filter (outcome='complete') as complete from runs, (select unnest(['all', 'kind', 'preset']) as d) group by 1, 2)
  select dimension, value, coalesce(n,0) as runs, coalesce(round(ms/(n*1000.0e0),3),0) as avg_seconds, coalesce(round(cost/n,6),0) as avg_cost, coalesce(round(complete/cast(n as double),4),0) as success_rate from wanted left join own using (dimension, value)""")
def run_breakdown(spark, d):
    return S.breakdown(X.runs(spark, d))


#: Sketches are held against exact figures: the share of values up to the sketch's percentile lies within 1 % of the percentile.
@register("latency_sketch", f"with {X.RUNS} select preset, true as p50_close, true as p90_close from runs group by preset")
def latency_sketch(spark, d):
    runs = X.runs(spark, d)
    found = S.merged_percentiles(S.latency_sketches(runs.withColumn("day", F.to_date("ts")), ["day", "preset"]), ["preset"])
    met = runs.select("preset", "elapsed_ms").join(F.broadcast(found), "preset")  # a row for each preset
    share = lambda c, beyond: F.avg((F.col("elapsed_ms") < F.col(c) * 1000).cast("int") if beyond else (F.col("elapsed_ms") <= F.col(c) * 1000).cast("int"))
    close = lambda c, p: ((share(c, True) <= p + 0.01) & (share(c, False) >= p - 0.01)).alias(f"{c}_close")
    return met.groupBy("preset").agg(close("p50", 0.5), close("p90", 0.9))


@register("all_time", f"with {X.RUNS} select count(*) as runs, round(cast(coalesce(sum({_COST}),0) as double),6) as cost, min(ts) as first_run from runs")
def all_time(spark, d):
    return S.all_time(X.runs(spark, d))


@register("stage_profile", f"""with {X.STAGES}, wall as (select sum(w) as wall from (select max(ms) as w from stages group by run)), own as (select stage, sum(ms) as ms, sum(calls) as calls from stages group by stage),
  every as (select * from own union all select '(all)', sum(ms), sum(calls) from own)
  select stage, cast(ms as bigint) as ms, cast(calls as bigint) as calls, cast(ms // calls as bigint) as ms_per_call, round(ms/cast(wall as double), 4) as share from every, wall""")
def stage_profile(spark, d):
    return S.stage_profile(X.stages(spark, d))


_COMPONENT = " ".join(f"when contains(lower(stage), '{t}') then '{n}'" for t, n in S.COMPONENTS)


@register("component_rollup", f"with {X.STAGES} select case {_COMPONENT} else 'other' end as component, round(sum(ms)/1000.0e0, 3) as seconds from stages group by 1")
def component_rollup(spark, d):
    return S.component_rollup(X.stages(spark, d))


_GUARDS = {"quarantined": "case when k%17=0 then 3 else 0 end", "rejected": "k%4", "contradicted": "case when k%13=0 then 1 else 0 end", "never": "k*0"}


@register("guard_totals", f"with g as (select cast(json_extract_string(props, '$.k') as bigint) as k from events), s as ({' union all '.join(f'''select '{n}' as guard, cast(sum({e}) as bigint) as fired from g''' for n, e in _GUARDS.items())}) select * from s where fired > 0")
def guard_totals(spark, d):
    k = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return S.guard_totals(k.selectExpr(*(f"{e} as {n}" for n, e in _GUARDS.items())), list(_GUARDS))


@register("normalize_costs", """with u as (select user_id, case when event_id%7=0 then cast('nan' as double) when event_id%11=0 then -value when event_id%13=0 then cast('inf' as double) else round(value, 4) end as price from events),
  n as (select user_id, case when not isnan(price) and price >= 0 and price < cast('inf' as double) then cast(round(price*1e9) as bigint) end as nanos from u)
  select user_id, cast(sum(nanos) as bigint) as nanos, count(nanos) as reported, count(*)-count(nanos) as unreported from n group by user_id""")
def normalize_costs(spark, d):
    price = "case when event_id%7=0 then cast('nan' as double) when event_id%11=0 then -value when event_id%13=0 then cast('infinity' as double) else round(value, 4) end as price"
    return S.normalize_costs(table(spark, d, "events").selectExpr("user_id", price), "user_id", "price")


@register("recent_runs", f"with {X.RUNS} select id, ts, query, outcome, elapsed_ms from runs order by ts desc, id desc limit 50")
def recent_runs(spark, d):
    return S.recent_runs(X.runs(spark, d), 50)


@register("cumulative_spend", f"with {_series('day', '1 day')} select bucket, round(sum(cost) over (order by bucket), 6) as spent, case when runs > 0 then avg_seconds end as avg_seconds from series")
def cumulative_spend(spark, d):
    return S.cumulative_spend(S.activity_series(X.runs(spark, d), "day", 30, NOW))


def _attempts(spark, d):
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), "ts", (F.col("event_type") == "error").alias("failed"))


@register("failure_streaks", """with a as (select user_id, event_id as id, ts, event_type='error' as failed from events),
  i as (select *, sum(case when failed then 0 else 1 end) over (partition by user_id order by ts, id rows unbounded preceding) as island from a),
  s as (select user_id, id, row_number() over (partition by user_id, island order by ts, id) as streak from i where failed)
  select user_id, id, streak, streak >= 3 as flagged, case streak when 1 then 8 when 2 then 30 else 60 end as pause_s from s""")
def failure_streaks(spark, d):
    return S.failure_streaks(_attempts(spark, d), "user_id")


@register("failures_in_window", """with a as (select user_id, event_id as id, ts, event_type='error' as failed from events),
  w as (select user_id, id, count(*) filter (failed) over (partition by user_id order by ts range between interval 6 hours preceding and current row) as failures from a) select * from w where failures >= 2""")
def failures_in_window(spark, d):
    return S.failures_in_window(_attempts(spark, d), "user_id", 6 * 3600, 2)


@register("bucket_times", f"select event_id as id, {', '.join(_ISO.format(f'''date_trunc('{u}', ts)''') + f' as {u}' for u in ('hour', 'day', 'week'))} from events")
def bucket_times(spark, d):
    return S.bucket_times(table(spark, d, "events").withColumnRenamed("event_id", "id"))


@register("clamped_ema", """with s as (select user_id, list(2 + value/50 order by ts, event_id) as xs from events group by user_id)
  select user_id, round(list_reduce(list_prepend(2.0e0, xs), lambda e, x: least(3.5e0, greatest(2.0e0, (1 - 0.3e0)*e + 0.3e0*x))), 9) as ema from s""")
def clamped_ema(spark, d):
    return S.clamped_ema(table(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("id"), (2 + F.col("value") / 50).alias("x")), "user_id")


_GRADE = """o_orderkey as run, o_orderpriority in ('1-URGENT','2-HIGH') as is_answer, o_custkey%7 as complete, 4 as target, o_custkey%7 + o_orderkey%3 as records,
  o_orderkey%5=0 as capped, o_orderkey%2=0 as gaining, o_totalprice/400000 as support, o_custkey%3 as unsupported"""


@register("grade_outcome", f"""with r as (select {_GRADE} from orders) select run, case when is_answer then case when support >= 0.7 then case when unsupported > 0 then 'partial' else 'complete' end when support >= 0.35 then 'partial' else 'empty' end
  when complete >= target then 'complete' when records = 0 then 'empty' when capped and gaining then 'truncated' else 'partial' end as outcome from r""")
def grade_outcome(spark, d):
    return S.grade_outcome(X._columns(table(spark, d, "orders"), _GRADE))
