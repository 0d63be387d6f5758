"""Structured Streaming forms of the run jobs; each has a batch twin among the queries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.gates import is_quarantined, quarantined_urls
from ..operators.run_stats import BUCKETS, OUTCOMES

#: Monday weeks begin four days after the epoch's Thursday.
OFFSETS = {"week": "4 days"}


def stream_activity(runs: DataFrame, bucket: str = "day", late: str = "1 day") -> DataFrame:
    """Runs per outcome and bucket; rows later than ``late`` are left out."""
    window = F.window("ts", BUCKETS[bucket], None, OFFSETS.get(bucket, "0 seconds"))
    return runs.withWatermark("ts", late).groupBy(window.alias("w")).agg(F.count("*").alias("runs"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES)).select(F.col("w.start").alias("bucket"), "runs", *OUTCOMES)


def stream_run_durations(events: DataFrame, bound: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Each accepted run with the terminal events of its id within ``bound``; without one it counts as cancelled."""
    a = events.where("type = 'accepted'").select(F.col("run_id").alias("run"), F.col("seq").alias("a_seq"), F.col("ts").alias("a_ts")).withWatermark("a_ts", late)
    b = events.where("type in ('result', 'error')").select("run_id", "seq", "ts", "type").withWatermark("ts", late)
    on = F.expr(f"run = run_id and ts >= a_ts and ts <= a_ts + interval {bound}")
    return a.join(b, on, "left_outer").select("run", "a_seq", "seq", F.coalesce("type", F.lit("cancelled")).alias("ended"), F.round((F.unix_micros("ts") - F.unix_micros("a_ts")) / 1e6, 3).alias("seconds"))


def cancelled_runs(events: DataFrame, ended: DataFrame, bound: str = "2 hours") -> DataFrame:
    """Accepted runs of a finished log that the stream above has no row for: those within ``bound`` of its end, which
    no later event has declared over."""
    a = events.where("type = 'accepted'").select(F.col("run_id").alias("run"), F.col("seq").alias("a_seq"))
    open_ = a.join(ended.select("run", "a_seq").distinct().hint("merge"), ["run", "a_seq"], "left_anti")
    return open_.select("run", "a_seq", F.lit(None).cast("long").alias("seq"), F.lit("cancelled").alias("ended"), F.lit(None).cast("double").alias("seconds"))


def stream_dedupe_hits(hits: DataFrame, late: str = "7 days") -> DataFrame:
    """First arrival of each (query, key)."""
    return hits.withWatermark("ts", late).dropDuplicatesWithinWatermark(["query", "key"])


def stream_cache_lookup(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """Arriving queries against a table of stored entries."""
    keys = ["lane", "query", "max_hits"]
    return queries.join(cache.select(*keys, "hits"), keys, "left").withColumn("hit", F.coalesce(F.col("hits") > 0, F.lit(False)))


class UsageGauge(StatefulProcessor):
    """The latest sample of a run in each tick; the report of its end is the run's last row, and nothing comes after it."""

    def __init__(self, seconds: int, keep: int):
        self.seconds, self.keep = seconds, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("gauge", "tick long, ended boolean")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        last, ended = self.state.get() or (None, False)
        if ended:  # late samples of an ended run
            return
        # Plain tuples: a run has few samples at once, and frames cost milliseconds for each of its steps.
        samples = [x for f in rows for x in zip(*(f[c].tolist() for c in ("at", "final", "seq", "k")), strict=True)]
        samples.sort(key=lambda x: (x[0], x[1], x[2] != x[2], x[2]))
        latest: dict[int, tuple] = {}
        for at, ended, seq, k in samples:
            tick = int(at // self.seconds * self.seconds)
            if ended:  # A sample that came earlier may lie in a later tick: the report still is the last row.
                tick = tick if last is None else max(tick, last)
                self.handle.registerTimer(math.ceil((at + self.keep) * 1000))
            place = (ended, seq != seq, seq)
            if tick not in latest or place >= latest[tick][0]:
                latest[tick] = (place, k)
            if ended:
                break
        self.state.update((max([*latest] if last is None else [last, *latest]), bool(ended)))
        yield pd.DataFrame({"run_id": [key[0]] * len(latest), "tick": [*latest], "seq": [p[2] for p, _ in latest.values()], "k": [k for _, k in latest.values()], "final": [p[0] for p, _ in latest.values()]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


GAUGE = "run_id long, tick long, seq long, k long, final boolean"


def stream_usage_gauge(usage: DataFrame, reports: DataFrame | None = None, seconds: int = 1, keep: int = 3600, late: str = "1 hour") -> DataFrame:
    """run_id, tick, seq, k, final: the latest sample (run_id, ts, seq, k) of each run and tick, and, from its report (the
    same columns), the run's last row, in place of a sample of that tick. Samples after a report are left out; when time
    has gone ``keep`` seconds past it, the run leaves the state."""
    both = usage.select("run_id", "ts", "seq", "k", F.lit(False).alias("final"))
    if reports is not None:
        both = both.union(reports.select("run_id", "ts", "seq", "k", F.lit(True)))
    timed = both.withColumn("at", F.unix_micros("ts") / 1e6).withWatermark("ts", late)
    ticks = timed.groupBy("run_id").transformWithStateInPandas(UsageGauge(seconds, keep), GAUGE, "Update", "EventTime")
    return ticks.withColumn("tick", F.timestamp_seconds("tick"))


def start_gauge(ticks: DataFrame, path: str, checkpoint: str, every: str = "1 second"):
    """Writes what ``stream_usage_gauge`` gives once in each ``every``; a batch that runs again replaces its own files."""
    write = lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}")
    return ticks.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def stream_quarantine(passages: DataFrame, safe_path: str, bad_path: str, checkpoint: str, report_path: str | None = None):
    """Arriving passages parted into two folders, and the urls of quarantined ones in a third; a batch that is run
    again replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        bad = is_quarantined(F.col("injection"))
        for part, path in ((batch.where(~bad), safe_path), (batch.where(bad), bad_path)):
            part.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if report_path:
            quarantined_urls(batch.where(bad)).write.mode("overwrite").parquet(f"{report_path}/batch={batch_id}")

    return passages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RunState(StatefulProcessor):
    """Latest stage, events and last lines of a run; only the first terminal event settles it. A settled run leaves the
    state some time later, so what is kept in the end are the runs that go on."""

    LINES = 12

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "status string, stage string, events long, last_seq long")
        self.lines = handle.getListState("lines", "line string")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq")
        was, stage, events, last = self.state.get() if self.state.exists() else ("running", "", 0, -1)
        held, status = [x[0] for x in self.lines.get()] if self.lines.exists() else [], was
        for kind, seq in zip(frame["type"], frame["seq"], strict=True):
            events += 1
            if status == "running":
                status, stage, last = (kind if kind in ("result", "error") else status), kind, int(seq)
            if kind == "progress":
                held = (held + [str(int(seq))])[-self.LINES :]
        if status != was:
            self.handle.registerTimer(math.ceil((frame["ts"].max().timestamp() + self.keep) * 1000))
        self.state.update((status, stage, events, last))
        if held:
            self.lines.put([(x,) for x in held])
        yield pd.DataFrame({"run_id": [key[0]], "status": [status], "stage": [stage], "events": [events], "last_seq": [last], "lines": ["|".join(held)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        self.lines.clear()
        return iter([])

    def close(self) -> None:
        pass


RUN_STATE = "run_id long, status string, stage string, events long, last_seq long, lines string"


def stream_run_state(events: DataFrame, keep: int = 3600, late: str = "1 hour") -> DataFrame:
    """One row for each run with news: its status, stage, events, last event before it settled, and last lines. Events
    (run_id, seq, type, ts) of a settled run are still counted until time has gone ``keep`` seconds past its end; then the
    run leaves the state."""
    return events.withWatermark("ts", late).groupBy("run_id").transformWithStateInPandas(RunState(keep), RUN_STATE, "Update", "EventTime")


class Throttle(StatefulProcessor):
    """Exact limiter: failures of the last minute are remembered; at ``most`` an attempt is refused and not recorded."""

    def __init__(self, most: int = 10, seconds: int = 60):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getListState("failures", "at double")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "id"])
        held = [x[0] for x in self.failures.get()] if self.failures.exists() else []
        out, held = throttled(frame, held, self.most, self.seconds)
        self._keep(held)
        yield pd.DataFrame({"user_id": [key[0]] * len(frame), "id": frame["id"].to_numpy(), "refused": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Failures that no longer count go; with the last one the client leaves the state."""
        held = [x[0] for x in self.failures.get()] if self.failures.exists() else []
        now = timerValues.getCurrentWatermarkInMs() / 1000  # no attempt from before it comes any more
        self._keep([x for x in held if now - x < self.seconds])
        return iter([])

    def _keep(self, held: list[float]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.failures.put([(x,) for x in held])
            self.handle.registerTimer(math.ceil((min(held) + self.seconds) * 1000))
        else:
            self.failures.clear()

    def close(self) -> None:
        pass


def throttled(frame: pd.DataFrame, held: list[float], most: int, seconds: int) -> tuple[list[bool], list[float]]:
    """Refusals of attempts in time order, and the failures that count from then on."""
    out = []
    for at, failed in zip(frame["at"], frame["failed"], strict=True):
        held = [x for x in held if at - x < seconds]
        out.append(len(held) >= most)
        if failed and not out[-1]:
            held.append(float(at))
    return out, held


THROTTLED = "user_id long, id long, refused boolean"


def stream_throttle(attempts: DataFrame, most: int = 10, seconds: int = 60, late: str = "1 hour") -> DataFrame:
    """user_id, id, refused of attempts (user_id, id, at in seconds, failed). Attempts may come ``late``; when time has gone
    past the window of a client's failures, they leave the state."""
    timed = attempts.withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).withWatermark("ts", late)
    return timed.groupBy("user_id").transformWithStateInPandas(Throttle(most, seconds), THROTTLED, "Append", "EventTime")


def throttle(attempts: DataFrame, most: int = 10, seconds: int = 60) -> DataFrame:
    """Batch twin of the limiter: clients' attempts in order of time, batch by batch; of a client no more is kept than
    the failures that count. Attempts without a client have no row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, held = None, []
        for part in parts:
            for key, frame in part.groupby("user_id", sort=False):
                refused, held = throttled(frame, held if key == user else [], most, seconds)
                user = key
                yield frame[["user_id", "id"]].assign(refused=refused)

    ordered = attempts.where(F.col("user_id").isNotNull()).select("user_id", "id", "at", "failed").repartition("user_id").sortWithinPartitions("user_id", "at", "id")
    return ordered.mapInPandas(run, THROTTLED)


class ClampedEma(StatefulProcessor):
    """Running mean held between bounds; an oversize event sets it back to the seed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mean = handle.getValueState("ema", "e double")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "id"])
        e = self.mean.get()[0] if self.mean.exists() else 2.0
        for x, oversize in zip(frame["x"], frame["oversize"], strict=True):
            e = 2.0 if oversize else min(3.5, max(2.0, 0.7 * e + 0.3 * x))
        self.mean.update((e,))
        yield pd.DataFrame({"user_id": [key[0]], "ema": [round(e, 9)]})

    def close(self) -> None:
        pass


def stream_clamped_ema(series: DataFrame) -> DataFrame:
    return series.groupBy("user_id").transformWithStateInPandas(ClampedEma(), "user_id long, ema double", "Update", "None")
