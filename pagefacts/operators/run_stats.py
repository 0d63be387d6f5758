"""Statistics over the run log: totals, percentiles, cost, calendar series and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import materialize
from .ranges import positions

OUTCOMES = ["complete", "partial", "empty", "truncated", "failed", "cancelled"]
KINDS, PRESETS, SOURCES = ["harvest", "answer"], ["quick", "standard", "thorough"], ["ui", "mcp"]
BUCKETS = {"hour": "1 hour", "day": "1 day", "week": "7 days"}
#: Price of a judge token, in US dollars.
JUDGE_TOKEN_USD = 42e-9
COST = "coalesce(judge_cost_usd, 0) + coalesce(llm_cost_usd, 0) + coalesce(planner_cost_usd, 0)"


def clamp_days(days: int, bucket: str = "day") -> int:
    return max(1, min(days, 7 if bucket == "hour" else 365))


def _start(bucket: str, days: int, now: str) -> str:
    """Start of the first bucket, as an SQL timestamp: aligned to the hour, day or ISO week (UTC)."""
    unit, back = ("hour", f"{clamp_days(days, bucket) * 24 - 1} hours") if bucket == "hour" else (bucket, f"{clamp_days(days) - 1} days")
    return f"date_trunc('{unit}', timestamp_ntz'{now}' - interval {back})"


def in_range(runs: DataFrame, bucket: str, days: int, now: str) -> DataFrame:
    """Runs from the first bucket's start up to ``now``; later ones are left out."""
    return runs.where(f"ts >= {_start(bucket, days, now)} and ts <= timestamp_ntz'{now}'")


def _rate(part: Column, whole: Column, digits: int) -> Column:
    return F.coalesce(F.round(part / F.nullif(whole, F.lit(0)), digits), F.lit(0.0))


def run_totals(runs: DataFrame) -> DataFrame:
    """One row of counts, sums, mean cost (6 digits), mean seconds (3) and success rate (4); zeros without runs."""
    cost = F.expr(COST)
    each = [F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c, vs in (("outcome", OUTCOMES), ("kind", KINDS), ("source", SOURCES)) for v in vs]
    sums = runs.agg(
        F.count("*").alias("runs"), *each, F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"),
        F.coalesce(F.sum(cost), F.lit(0)).cast("double").alias("cost"), F.coalesce(F.sum("elapsed_ms"), F.lit(0)).alias("ms"),
    )
    return sums.select("*", _rate(F.col("cost"), F.col("runs"), 6).alias("avg_cost"), _rate(F.col("ms"), F.col("runs") * 1000, 3).alias("avg_seconds"), _rate(F.col("outcome_complete"), F.col("runs"), 4).alias("success_rate")).drop("ms").withColumn("cost", F.round("cost", 6))


def latency_percentiles(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Nearest-rank 50th and 90th percentile of seconds; 0 without runs."""
    pick = lambda p: F.coalesce(F.expr(f"percentile_disc({p}) within group (order by elapsed_ms)") / 1000, F.lit(0.0))
    return runs.groupBy(*(by or [])).agg(pick(0.5).alias("p50"), pick(0.9).alias("p90"))


def cost_by_actor(runs: DataFrame) -> DataFrame:
    """Sums per actor; an unreported price counts as 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    out = runs.agg(total("judge_cost_usd").alias("judge"), total("llm_cost_usd").alias("writer"), total("planner_cost_usd").alias("planner"))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns), F.round(F.col("judge") + F.col("writer") + F.col("planner"), 6).alias("total"))


def strict_run_cost(runs: DataFrame) -> DataFrame:
    """Each run's cost, null if an actor that had requests reported no price."""
    part = lambda requests, price: F.when(F.col(requests) == 0, F.lit(0)).otherwise(F.col(price))
    total = part("judge_requests", "judge_cost_usd") + part("llm_requests", "llm_cost_usd") + part("planner_requests", "planner_cost_usd")
    return runs.select("id", total.cast("double").alias("cost"))


def token_totals(runs: DataFrame) -> DataFrame:
    names = ["judge_input_tokens", "llm_prompt_tokens", "llm_completion_tokens", "planner_prompt_tokens", "planner_completion_tokens"]
    out = runs.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
    return out.withColumn("judge_cost", F.round(F.col("judge_input_tokens") * JUDGE_TOKEN_USD, 9))


def calendar(like: DataFrame, bucket: str, days: int, now: str) -> DataFrame:
    """All buckets of the range, oldest first; at most 365 days or 168 hours of rows."""
    last = f"date_trunc('{bucket}', timestamp_ntz'{now}')"
    return like.sparkSession.range(1).selectExpr(f"explode(sequence({_start(bucket, days, now)}, {last}, interval {BUCKETS[bucket]})) as bucket")


def activity_series(runs: DataFrame, bucket: str, days: int, now: str) -> DataFrame:
    """Every bucket of the range with its runs, outcomes, cost and mean seconds; zeros where nothing ran."""
    own = in_range(runs, bucket, days, now).groupBy(F.date_trunc(bucket, "ts").cast("timestamp_ntz").alias("bucket")).agg(
        F.count("*").alias("runs"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES), F.sum(F.expr(COST)).cast("double").alias("cost"), F.sum("elapsed_ms").alias("ms")
    )
    out = calendar(runs, bucket, days, now).join(F.broadcast(own), "bucket", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(F.date_format("bucket", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("bucket"), zero("runs").alias("runs"), *(zero(o).alias(o) for o in OUTCOMES), F.round(zero("cost"), 6).alias("cost"), _rate(F.col("ms"), F.col("runs") * 1000, 3).alias("avg_seconds"))


def by_value(runs: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Runs, mean seconds, mean cost and success rate for each of ``values``, absent ones as zeros."""
    wanted = runs.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    own = runs.where(F.col(column).isin(values)).groupBy(column).agg(F.count("*").alias("n"), F.sum("elapsed_ms").alias("ms"), F.sum(F.expr(COST)).cast("double").alias("cost"), F.count_if(F.col("outcome") == "complete").alias("complete"))
    n = F.col("n")
    return wanted.join(F.broadcast(own), column, "left").select(column, F.coalesce(n, F.lit(0)).alias("runs"), _rate(F.col("ms"), n * 1000, 3).alias("avg_seconds"), _rate(F.col("cost"), n, 6).alias("avg_cost"), _rate(F.col("complete"), n, 4).alias("success_rate"))


def breakdown(runs: DataFrame) -> DataFrame:
    """dimension (all, kind, preset), value, runs, avg_seconds, avg_cost, success_rate: totals, kinds and presets from one
    pass over the runs; kinds and presets that no run has are zeros, unknown ones are left out."""
    wanted = runs.sparkSession.createDataFrame([("all", "")] + [("kind", v) for v in KINDS] + [("preset", v) for v in PRESETS], "dimension string, value string")
    slim = runs.select("kind", "preset", "elapsed_ms", "outcome", F.expr(COST).alias("cost"))
    sets = slim.groupingSets([[], ["kind"], ["preset"]], "kind", "preset").agg(
        F.grouping_id().alias("set"), F.count("*").alias("n"), F.sum("elapsed_ms").alias("ms"), F.sum("cost").cast("double").alias("cost"), F.count_if(F.col("outcome") == "complete").alias("complete")
    )
    named = F.when(F.col("set") == 3, "all").when(F.col("set") == 1, "kind").otherwise("preset")
    own = sets.select(named.alias("dimension"), F.when(F.col("set") == 3, "").when(F.col("set") == 1, F.col("kind")).otherwise(F.col("preset")).alias("value"), "n", "ms", "cost", "complete")
    own = own.where(F.col("value").isin("", *KINDS, *PRESETS))  # so it has as few rows as ``wanted``
    n = F.col("n")
    rates = [_rate(F.col("ms"), n * 1000, 3).alias("avg_seconds"), _rate(F.col("cost"), n, 6).alias("avg_cost"), _rate(F.col("complete"), n, 4).alias("success_rate")]
    return wanted.join(F.broadcast(own), ["dimension", "value"], "left").select("dimension", "value", F.coalesce(n, F.lit(0)).alias("runs"), *rates)


#: Size of a rank sketch: ranks are within 0.7 % (of all values) with 99 % certainty.
KLL_SIZE = 400


def latency_sketches(runs: DataFrame, by: list[str]) -> DataFrame:
    """A rank sketch of elapsed_ms for each group of ``by`` (a day, say): what is kept to tell percentiles of any union."""
    return runs.groupBy(*by).agg(F.kll_sketch_agg_bigint("elapsed_ms", KLL_SIZE).alias("ms"))


def merged_percentiles(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Approximate 50th and 90th percentile of seconds over the groups' unions."""
    merged = sketches.groupBy(*(by or [])).agg(F.kll_merge_agg_bigint("ms").alias("ms"))
    at = lambda p: (F.kll_sketch_get_quantile_bigint("ms", F.lit(p)) / 1000)
    return merged.select(*(by or []), at(0.5).alias("p50"), at(0.9).alias("p90"))


def all_time(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("runs"), F.round(F.coalesce(F.sum(F.expr(COST)), F.lit(0)).cast("double"), 6).alias("cost"), F.min("ts").alias("first_run"))


def stage_profile(stages: DataFrame) -> DataFrame:
    """Per stage: ms, calls, whole ms per call and share of wall clock (each run's slowest stage sum); with a row of totals."""
    wall = stages.groupBy("run").agg(F.max("ms").alias("wall")).agg(F.sum("wall").alias("wall"))
    own = stages.groupBy("stage").agg(F.sum("ms").alias("ms"), F.sum("calls").cast("bigint").alias("calls"))
    total = own.agg(F.lit("(all)").alias("stage"), F.sum("ms").alias("ms"), F.sum("calls").alias("calls"))
    return own.union(total).crossJoin(F.broadcast(wall)).select("stage", "ms", "calls", F.expr("ms div calls").alias("ms_per_call"), F.round(F.col("ms") / F.col("wall"), 4).alias("share"))


#: Component of a stage label: the first rule whose text the label holds.
COMPONENTS = [("llm", "llm"), ("plan", "llm"), ("extract", "llm"), ("search", "browser"), ("fetch", "browser"), ("triage", "judge"), ("screen", "judge")]


def component_rollup(stages: DataFrame) -> DataFrame:
    label = F.lower("stage")
    rule = F.coalesce(*(F.when(F.contains(label, F.lit(text)), F.lit(name)) for text, name in COMPONENTS), F.lit("other"))
    return stages.groupBy(rule.alias("component")).agg(F.round(F.sum("ms") / 1000, 3).alias("seconds"))


def cache_summary(lookups: DataFrame) -> DataFrame:
    return lookups.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("bytes"))), F.lit(0)).alias("bytes"))


def guard_totals(runs: DataFrame, guards: list[str]) -> DataFrame:
    """guard, fired for the guards that fired."""
    sums = runs.agg(*(F.coalesce(F.sum(g), F.lit(0)).cast("bigint").alias(g) for g in guards))
    return sums.unpivot([], guards, "guard", "fired").where("fired > 0")


def normalize_costs(usage: DataFrame, key: str, price: str) -> DataFrame:
    """Per key the reported cost in whole nano-dollars; NaN, infinite and negative prices are not reported."""
    p = F.col(price).cast("double")
    ok = F.when(~F.isnan(p) & (p >= 0) & (p < float("inf")), F.round(p * 1e9).cast("bigint"))
    return usage.groupBy(key).agg(F.sum(ok).alias("nanos"), F.count(ok).alias("reported"), (F.count("*") - F.count(ok)).alias("unreported"))


def recent_runs(runs: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n``; of one second the last logged first."""
    return runs.orderBy(F.desc("ts"), F.desc("id")).limit(n).select("id", "ts", "query", "outcome", "elapsed_ms")


def cumulative_spend(series: DataFrame) -> DataFrame:
    """Running cost over the buckets; the mean duration of an empty bucket is null. The series is one row a bucket."""
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return series.select("bucket", F.round(F.sum("cost").over(w), 6).alias("spent"), F.when(F.col("runs") > 0, F.col("avg_seconds")).alias("avg_seconds"))


def failure_streaks(events: DataFrame, key: str, n: int = 3) -> DataFrame:
    """Each failure with its place in the streak, whether ``n`` is reached, and the pause before a retry."""
    order = Window.partitionBy(key).orderBy("ts", "id")
    e = events.withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.where("failed").withColumn("streak", F.row_number().over(Window.partitionBy(key, "island").orderBy("ts", "id")))
    pause = F.when(F.col("streak") == 1, 8).when(F.col("streak") == 2, 30).otherwise(60)
    return e.select(key, "id", F.col("streak").cast("bigint").alias("streak"), (F.col("streak") >= n).alias("flagged"), pause.alias("pause_s"))


def failures_in_window(attempts: DataFrame, key: str, seconds: int = 60, most: int = 10) -> DataFrame:
    """Attempts whose trailing window holds ``most`` failures or more, itself included."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy("micros").rangeBetween(-seconds * 1_000_000, 0)
    return attempts.withColumn("micros", micros).withColumn("failures", F.count_if("failed").over(w)).where(F.col("failures") >= most).select(key, "id", "failures")


def bucket_times(df: DataFrame) -> DataFrame:
    text = lambda unit: F.date_format(F.date_trunc(unit, "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(unit)
    return df.select("id", text("hour"), text("day"), text("week"))


def clamped_ema(series: DataFrame, key: str, alpha: float = 0.3, seed: float = 2.0, lo: float = 2.0, hi: float = 3.5, block: int = 10_000) -> DataFrame:
    """Per key, over its values in time order: e becomes (1 - alpha) e + alpha x, held between lo and hi. Null values are
    no steps.

    A step is a map e -> min(h, max(l, a e + b)), and so is one step after another: each ``block`` values of a key
    become one map apart, blocks of maps again, until a key has one block; no task holds more than a block.
    """
    rows = positions(series.where(F.col("x").isNotNull()).select(key, "ts", "id", "x"), [key], ["ts", "id", "x"])
    num = lambda x: F.lit(x).cast("double")
    held = lambda e, low, high: F.least(high, F.greatest(low, e))
    c = num(1 - alpha)

    def step(m: Column, s: Column) -> Column:
        d = num(alpha) * s["x"]
        return F.struct(held(c * m["e"] + d, num(lo), num(hi)).alias("e"), (c * m["a"]).alias("a"), (c * m["b"] + d).alias("b"), held(c * m["l"] + d, num(lo), num(hi)).alias("l"), held(c * m["h"] + d, num(lo), num(hi)).alias("h"))

    def after(m: Column, s: Column) -> Column:
        n = s["m"]
        return F.struct(held(n["a"] * m["e"] + n["b"], n["l"], n["h"]).alias("e"), (n["a"] * m["a"]).alias("a"), (n["a"] * m["b"] + n["b"]).alias("b"), held(n["a"] * m["l"] + n["b"], n["l"], n["h"]).alias("l"), held(n["a"] * m["h"] + n["b"], n["l"], n["h"]).alias("h"))

    def blocks(df: DataFrame, *columns: str) -> DataFrame:
        by = F.floor(F.col("position") / block).cast("long").alias("position")
        return df.groupBy(key, by).agg(F.array_sort(F.collect_list(F.struct("position", *columns))).alias("s"))

    same = F.struct(num(seed).alias("e"), num(1).alias("a"), num(0).alias("b"), num(float("-inf")).alias("l"), num(float("inf")).alias("h"))
    maps = materialize(blocks(rows, "x").select(key, "position", F.aggregate("s", same, step).alias("m")), "ema_blocks")
    while (maps.agg(F.max("position")).first()[0] or 0) > 0:
        # The first map of a block has run from the seed; of the key's first block that is the mean so far.
        joined = blocks(maps, "m").select(key, "position", F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.col("s")[0]["m"], after).alias("m"))
        maps = materialize(joined, "ema_blocks")
    return maps.select(key, F.round("m.e", 9).alias("ema"))


def grade_outcome(runs: DataFrame, support: tuple[float, float] = (0.70, 0.35)) -> DataFrame:
    """run, outcome. Lists: by complete records against the target; answers: by support, an unsupported claim
    lowers complete to partial."""
    found = F.when(F.col("complete") >= F.col("target"), "complete").when(F.col("records") == 0, "empty").when(F.col("capped") & F.col("gaining"), "truncated").otherwise("partial")
    answer = F.when(F.col("support") >= support[0], F.when(F.col("unsupported") > 0, "partial").otherwise("complete")).when(F.col("support") >= support[1], "partial").otherwise("empty")
    return runs.select("run", F.when(F.col("is_answer"), answer).otherwise(found).alias("outcome"))
