"""State of the streaming jobs: what is kept, what leaves, and rows that come again."""

import pytest
from pyspark.sql import functions as F

from pagefacts.sources import runlog
from pagefacts.streaming import jobs as J

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def live(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "2")
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return own


class Feed:
    """A folder that a stream reads, one file a call, and the rows that a job gave for each."""

    def __init__(self, live, folder, schema, job, mode="update"):
        self.live, self.folder, self.schema, self.job, self.mode, self.n = live, folder, schema, job, mode, 0

    def __call__(self, rows):
        self.n += 1
        self.live.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.live.readStream.schema(self.schema).parquet(f"{self.folder}/in")
        out, got = f"{self.folder}/out{self.n}", []
        write = lambda batch, i: batch.write.mode("append").parquet(out)
        query = self.job(stream).writeStream.outputMode(self.mode).foreachBatch(write).option("checkpointLocation", f"{self.folder}/marks").trigger(availableNow=True).start()
        query.awaitTermination()
        got = [tuple(r) for r in self.live.read.parquet(out).collect()]
        return sorted(got, key=repr)


def test_settled_runs_leave(live, tmp_path):
    def job(s):
        return J.stream_run_state(s.withColumn("ts", F.timestamp_seconds("at")), 60, "0 seconds")

    feed = Feed(live, tmp_path, "run_id long, seq long, type string, at long", job)
    rows = [(1, i, "progress", 1000) for i in range(20)] + [(2, 100, "accepted", 1000), (3, 200, "progress", 1000)]
    assert feed(rows) == [(1, "running", "progress", 20, 19, "|".join(map(str, range(8, 20)))), (2, "running", "accepted", 1, 100, ""), (3, "running", "progress", 1, 200, "200")]
    lines = "|".join(map(str, range(8, 20)))
    # The first terminal event settles; later events count while the run is kept.
    assert feed([(1, 30, "result", 1010), (2, 130, "error", 1010)]) == [(1, "result", "result", 21, 30, lines), (2, "error", "error", 2, 130, "")]
    assert feed([(1, 31, "error", 1020)]) == [(1, "result", "result", 22, 30, lines)]
    feed([(9, 500, "accepted", 5000)])
    # Time has gone past the settled runs; the one that goes on stays.
    state = live.read.format("statestore").option("stateVarName", "run").load(f"{tmp_path}/marks")
    assert {r.key[0] for r in state.collect()} == {3, 9}
    assert feed([(1, 900, "progress", 5001), (3, 901, "result", 5001), (9, 902, "result", 5001)]) == [(1, "running", "progress", 1, 900, "900"), (3, "result", "result", 2, 901, "200"), (9, "result", "result", 2, 902, "")]
    feed([(1, 903, "error", 5002)])
    feed([(8, 904, "result", 9000)])
    feed([(8, 905, "progress", 9999)])
    assert live.read.format("statestore").option("stateVarName", "run").load(f"{tmp_path}/marks").count() == 0


def test_limiter_of_a_stream(live, tmp_path):
    job = lambda s: J.stream_throttle(s, 10, 60, "0 seconds")
    feed = Feed(live, tmp_path, "user_id long, id long, at double, failed boolean", job, "append")
    out = feed([(1, i, 1000.0 + i, True) for i in range(10)] + [(1, 10, 1010.0, False), (2, 50, 1000.0, False)])
    assert [r for r in out if r[2]] == [(1, 10, True)] and len(out) == 12
    assert feed([(1, 11, 1030.0, True), (1, 12, 1059.0, False)]) == [(1, 11, True), (1, 12, True)]
    assert feed([(1, 13, 1062.0, False), (3, 70, 1062.0, True)]) == [(1, 13, False), (3, 70, False)]
    # Time has gone past all windows: no client is left in the state but the one that failed last.
    feed([(4, 80, 2000.0, True)])
    feed([(5, 81, 2001.0, False)])
    held = [x for x in _list_state(live, tmp_path) if x]
    assert {u for u, _ in held} == {4}


def _list_state(live, folder):
    state = live.read.format("statestore").option("stateVarName", "failures").load(f"{folder}/marks")
    return [(r.key[0], r.list_element[0] if "list_element" in state.columns else r.list_value) for r in state.collect()]


def test_eleven_attempts_a_minute_are_one_too_many(spark):
    rows = [(7, i, float(i), True) for i in range(10)] + [(7, 10, 10.0, False), (8, 11, 10.0, False)]
    out = {r.id: r.refused for r in J.throttle(spark.createDataFrame(rows, "user_id long, id long, at double, failed boolean")).collect()}
    assert [i for i, x in out.items() if x] == [10] and len(out) == 12


def test_limiter_equals_a_plain_loop(spark, sf):
    from pagefacts.plans import streams

    attempts = streams._attempts(spark.read.parquet(f"{sf}/events.parquet"))
    held, want = {}, {}
    for r in sorted(attempts.collect(), key=lambda r: (r.at, r.id)):
        own = held[r.user_id] = [x for x in held.get(r.user_id, []) if r.at - x < 6 * 3600]
        want[r.id] = len(own) >= 2
        if r.failed and not want[r.id]:
            own.append(r.at)
    assert any(want.values())
    assert {r.id: r.refused for r in streams.throttle(spark, sf).collect()} == want == {r.id: r.refused for r in streams.stream_throttle(spark, sf).collect()}


def test_gauge_ends_with_the_report(live, tmp_path):
    def job(s):
        timed = s.withColumn("ts", F.timestamp_micros(F.col("us")))
        return J.stream_usage_gauge(timed.where("not report"), timed.where("report"), 1, 60, "5 seconds").select("run_id", F.unix_seconds("tick"), "seq", "k", "final")

    feed = Feed(live, tmp_path, "run_id long, us long, seq long, k long, report boolean", job)
    s = 1_000_000
    assert feed([(1, 10 * s, 1, 5, False), (1, 10 * s + 9, 2, 6, False), (1, 12 * s, 3, 7, False), (2, 10 * s, 1, 1, False)]) == [(1, 10, 2, 6, False), (1, 12, 3, 7, False), (2, 10, 1, 1, False)]
    # A request landed between the report and the next sample; a report may be older than the last sample.
    assert feed([(1, 13 * s, 4, 9, True), (1, 13 * s + 5, 5, 10, False), (2, 9 * s, 2, 3, True)]) == [(1, 13, 4, 9, True), (2, 10, 2, 3, True)]
    assert feed([(1, 20 * s, 6, 11, False), (3, 20 * s, 1, 1, False)]) == [(3, 20, 1, 1, False)]
    feed([(3, 200 * s, 2, 2, False)])
    state = live.read.format("statestore").option("stateVarName", "gauge").load(f"{tmp_path}/marks")
    assert {r.key[0] for r in state.collect()} == {3}


def test_gauge_each_second(live, tmp_path):
    schema = "run_id long, ts timestamp, seq long, k long, report boolean"
    live.sql("select 1L as run_id, timestamp'2026-01-01 00:00:01' as ts, 1L as seq, 5L as k, false as report union all select 1, timestamp'2026-01-01 00:00:02', 2, 8, true").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = live.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = J.start_gauge(J.stream_usage_gauge(stream.where("not report"), stream.where("report")), f"{tmp_path}/out", f"{tmp_path}/marks")
    try:
        query.processAllAvailable()
        assert sorted((r.seq, r.final) for r in live.read.parquet(f"{tmp_path}/out").collect()) == [(1, False), (2, True)]
    finally:
        query.stop()


def test_oversize_events_reset_the_mean(live, tmp_path):
    feed = Feed(live, tmp_path, "user_id long, ts long, id long, x double, oversize boolean", J.stream_clamped_ema)
    assert feed([(1, 1, 1, 3.5, False), (1, 2, 2, 3.5, False)]) == [(1, 2.765)]
    assert feed([(1, 3, 3, 3.5, True)]) == [(1, 2.0)]
    assert feed([(1, 4, 4, 3.0, False)]) == [(1, 2.3)]


def test_runs_are_appended_once(spark, tmp_path):
    schema = "id string, started_at long, outcome string"
    spark.createDataFrame([("a", 1_700_000_000, "x"), ("b", 1_700_000_000, "x"), ("b", 1_700_000_000, "x")], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    log = f"{tmp_path}/log"
    ids = lambda: sorted(r.id for r in spark.read.schema("id string").json(log).collect())
    runlog.stream_append_run_log(stream, log, f"{tmp_path}/marks").awaitTermination()
    assert ids() == ["a", "b"]
    # The batch comes again, as after a failure before its mark; then new runs.
    runlog.stream_append_run_log(stream, log, f"{tmp_path}/other-marks").awaitTermination()
    assert ids() == ["a", "b"]
    spark.createDataFrame([("c", 1_700_090_000, "x"), ("a", 1_700_000_000, "x")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    runlog.stream_append_run_log(stream, log, f"{tmp_path}/marks").awaitTermination()
    assert ids() == ["a", "b", "c"]


def test_a_log_that_cannot_be_written_fails_the_stream(spark, tmp_path):
    (tmp_path / "file").write_text("")
    spark.createDataFrame([("a", 1_700_000_000)], "id string, started_at long").write.parquet(f"{tmp_path}/in")
    query = runlog.stream_append_run_log(spark.readStream.schema("id string, started_at long").parquet(f"{tmp_path}/in"), f"{tmp_path}/file/log", f"{tmp_path}/marks")
    with pytest.raises(Exception, match="run log"):
        query.awaitTermination()
