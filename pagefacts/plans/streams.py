"""Streaming queries: ``events`` (or another table) replayed through a stream until it is exhausted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import work_path
from ..operators.hits import latest_cache_entry
from ..operators.run_stats import OUTCOMES
from ..sources import runlog
from ..streaming import jobs as J
from . import fixtures as X
from .hits import _LATEST, _NORMAL
from .registry import register, table

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = "case event_type when 'signup' then 'accepted' when 'view' then 'progress' when 'click' then 'usage' when 'purchase' then 'result' else 'error' end"


def _live(spark):
    """A session of its own for a stream, so that its state store is no other's."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if (value := spark.conf.get(name, None)) is not None:
            own.conf.set(name, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return own


def _replay(spark, d, name, select):
    """The table's files as a stream of the selected columns."""
    spark = _live(spark)
    like = table(spark, d, name)
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 64).parquet(f"{d}/{name}.parquet*")
    return stream.select(*(F.expr(c) if isinstance(c, str) and c != "*" else c for c in select))


def _drained(spark, stream, mode="append"):
    """Runs the stream to the end of its input and returns what its sink holds."""
    out, marks = work_path(spark, "stream"), work_path(spark, "marks")
    if mode == "append":
        query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    else:
        write = lambda batch, i: batch.withColumn("_batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/b={i}")
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def _latest(df, keys):
    """The last emitted row of each key, of an update-mode stream."""
    names = [c for c in df.columns if c not in ("_batch", "b", *keys)]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*names), "_batch").alias("x")).select(*keys, "x.*")


_TS = "cast(ts as timestamp) as ts"


@register("stream_activity", f"with {X.RUNS} select date_trunc('day', ts) as bucket, count(*) as runs, {', '.join(f'''count(*) filter (outcome = '{o}') as {o}''' for o in OUTCOMES)} from runs group by 1")
def stream_activity(spark, d):
    live = _replay(spark, d, "events", ["*"]).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    runs = X._columns(live, X._RUNS.format(query="concat('query ', user_id)")).select(F.expr(_TS), "outcome")
    counted = _drained(spark, J.stream_activity(runs), "update")
    return _latest(counted, ["bucket"]).select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "runs", *OUTCOMES)


@register("stream_run_durations", f"""with e as (select user_id as run_id, event_id as seq, ts, {_EVENT} as type from events), a as (select * from e where type='accepted'), b as (select * from e where type in ('result','error'))
  select a.run_id as run, a.seq as a_seq, b.seq as seq, coalesce(b.type, 'cancelled') as ended, round((epoch_us(b.ts)-epoch_us(a.ts))/1e6, 3) as seconds from a left join b on a.run_id=b.run_id and b.ts >= a.ts and b.ts <= a.ts + interval 2 hours""")
def stream_run_durations(spark, d):
    live = _replay(spark, d, "events", [F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), _TS, F.expr(_EVENT).alias("type")])
    ended = _drained(spark, J.stream_run_durations(live))
    events = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.expr(_EVENT).alias("type"))
    return ended.union(J.cancelled_runs(events, ended))


@register("stream_dedupe_hits", "select distinct user_id as query, event_type as key from events")
def stream_dedupe_hits(spark, d):
    live = _replay(spark, d, "events", [F.col("user_id").alias("query"), F.col("event_type").alias("key"), _TS])
    return _drained(spark, J.stream_dedupe_hits(live, "400 days")).select("query", "key")


@register("stream_cache_lookup", f"with {_LATEST}, w as (select put_id as id, lane, {_NORMAL} as query, max_hits+1 as max_hits from puts) select id, hits is not null as hit from w left join latest using (lane, query, max_hits)")
def stream_cache_lookup(spark, d):
    from ..functions.text import normalize_query

    live = X._columns(_replay(spark, d, "orders", ["*"]), X._CACHE).select(F.col("put_id").alias("id"), "lane", normalize_query(F.col("query")).alias("query"), (F.col("max_hits") + 1).alias("max_hits"))
    return _drained(spark, J.stream_cache_lookup(live, latest_cache_entry(X.puts(live.sparkSession, d)))).select("id", "hit")


@register("stream_usage_gauge", """with e as (select user_id as run_id, event_id as seq, ts, event_type, cast(json_extract_string(props, '$.k') as bigint) as k from events),
  done as (select * from e where event_type = 'purchase' qualify row_number() over (partition by run_id order by ts, seq) = 1),
  s as (select e.run_id, e.seq, e.ts, e.k, 0 as final from e left join done using (run_id) where e.event_type = 'click' and (done.ts is null or e.ts <= done.ts) union all select run_id, seq, ts, k, 1 from done)
  select run_id, time_bucket(interval 1 hour, ts) as tick, arg_max(seq, final*1000000000000 + seq) as seq, arg_max(k, final*1000000000000 + seq) as k, max(final) = 1 as final from s group by 1, 2""")
def stream_usage_gauge(spark, d):
    live = _replay(spark, d, "events", ["*"]).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.expr(_TS), F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")
    ticks = J.stream_usage_gauge(live.where("event_type = 'click'"), live.where("event_type = 'purchase'"), 3600)
    got = _latest(_drained(spark, ticks, "update"), ["run_id", "tick"])
    return got.select("run_id", F.col("tick").cast("timestamp_ntz").alias("tick"), "seq", "k", "final")


@register("stream_append_run_log", "select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 1")
def stream_append_run_log(spark, d):
    live = _replay(spark, d, "events", [F.col("event_id").cast("string").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("started_at"), F.col("event_type").alias("outcome")])
    path = work_path(spark, "runlog")
    for _ in range(2):  # a second stream brings the same runs again
        runlog.stream_append_run_log(live, path, work_path(spark, "marks")).awaitTermination()
    return spark.read.schema("id string, started_at long, outcome string, day string").json(path).groupBy("day").agg(F.count("*").alias("n"))


@register("stream_quarantine", "select event_id%10=0 or event_id%3=0 as bad, count(*) as n, case when event_id%10=0 or event_id%3=0 then count(distinct user_id) else 0 end as urls from events group by event_id%10=0 or event_id%3=0")
def stream_quarantine(spark, d):
    live = _replay(spark, d, "events", [F.col("event_id"), F.concat(F.lit("u"), "user_id").alias("url"), F.expr("case when event_id%10=0 then null when event_id%3=0 then 0.9D else 0.1D end as injection")])
    safe, bad, report = work_path(spark, "safe"), work_path(spark, "bad"), work_path(spark, "report")
    J.stream_quarantine(live, safe, bad, work_path(spark, "marks"), report).awaitTermination()
    urls = spark.read.parquet(report).select("url").distinct().select(F.lit(True), F.lit(0).cast("long"), F.lit(1).cast("long"))
    rows = spark.read.parquet(safe).select(F.lit(False).alias("bad")).union(spark.read.parquet(bad).select(F.lit(True)))
    return rows.select("bad", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("urls")).union(urls).groupBy("bad").agg(F.sum("n").alias("n"), F.sum("urls").alias("urls"))


@register("stream_run_state", f"""with e as (select user_id as run_id, event_id as seq, {_EVENT} as type from events), t as (select run_id, min(seq) filter (type in ('result','error')) as done from e group by run_id),
  p as (select run_id, seq, row_number() over (partition by run_id order by seq desc) as nr from e where type='progress'), l as (select run_id, string_agg(seq, '|' order by seq) as lines from p where nr <= 12 group by run_id)
  select e.run_id, coalesce(max(type) filter (seq = done), 'running') as status, arg_max(type, seq) filter (done is null or seq <= done) as stage, count(*) as events, max(seq) filter (done is null or seq <= done) as last_seq, coalesce(max(lines), '') as lines
  from e join t using (run_id) left join l using (run_id) group by e.run_id""")
def stream_run_state(spark, d):
    live = _replay(spark, d, "events", [F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.expr(_EVENT).alias("type"), _TS])
    return _latest(_drained(spark, J.stream_run_state(live), "update"), ["run_id"])


def _attempts(df):
    return df.select("user_id", F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"), (F.col("event_type") == "error").alias("failed"))


@register("stream_throttle")
def stream_throttle(spark, d):
    return _drained(spark, J.stream_throttle(_attempts(_replay(spark, d, "events", ["*"])), 2, 6 * 3600))


@register("throttle")
def throttle(spark, d):
    return J.throttle(_attempts(table(spark, d, "events")), 2, 6 * 3600)


@register("stream_clamped_ema", """with s as (select user_id, list(case when event_id%40 <> 0 then 2 + value/50 end order by ts, event_id) as xs from events group by user_id)
  select user_id, round(list_reduce(list_prepend(2.0e0, xs), lambda e, x: case when x is null then 2.0e0 else least(3.5e0, greatest(2.0e0, 0.7e0*e + 0.3e0*x)) end), 9) as ema from s""")
def stream_clamped_ema(spark, d):
    live = _replay(spark, d, "events", ["user_id", _TS, F.col("event_id").alias("id"), (2 + F.col("value") / 50).alias("x"), (F.col("event_id") % 40 == 0).alias("oversize")])
    return _latest(_drained(spark, J.stream_clamped_ema(live), "update"), ["user_id"])
