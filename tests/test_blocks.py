"""Operators that take a large group block by block equal the plain rule on it."""

import random

from pyspark.sql import functions as F

from pagefacts.operators import page_jobs as P
from pagefacts.operators import records as R
from pagefacts.operators import run_stats as S
from pagefacts.operators.ranges import positions


def test_positions(spark):
    rows = [("hot", i * 7 % 5000) for i in range(5000)] + [(None, 3), (None, 1), ("z", 1), ("a", None), ("a", 2)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x int")
    out = positions(df, ["g"], ["x"]).collect()
    low = lambda v: (v is not None, v or 0)
    for g in {g for g, _ in rows}:
        own = sorted([x for h, x in rows if h == g], key=low)
        assert [r.x for r in sorted((r for r in out if r.g == g), key=lambda r: r.position)] == own and {r.position for r in out if r.g == g} == set(range(len(own)))
    every = sorted(positions(df, [], ["g", "x"]).collect(), key=lambda r: r.position)
    assert [r.position for r in every] == list(range(len(rows))) and [(r.g, r.x) for r in every] == sorted(rows, key=lambda r: ((r[0] is not None, r[0] or ""), low(r[1])))
    assert positions(df.limit(0), ["g"], ["x"]).count() == 0


def plain_mean(xs):
    e = 2.0
    for x in xs:
        e = min(3.5, max(2.0, 0.7 * e + 0.3 * x))
    return round(e, 9)


def test_long_series(spark):
    r = random.Random(2)
    series = {"hot": [r.uniform(0, 6) for _ in range(3000)], "mid": [r.uniform(2, 3.5) for _ in range(41)], "one": [0.1], "ten": [r.uniform(0, 6) for _ in range(10)]}
    rows = [(k, i // 2, i, x) for k, xs in series.items() for i, x in enumerate(xs)] + [("one", 9, 9, None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, ts int, id int, x double")
    for block in (10, 10_000):
        out = {x.k: x.ema for x in S.clamped_ema(df, "k", block=block).collect()}
        assert out.keys() == series.keys() and all(abs(out[k] - plain_mean(xs)) < 1e-8 for k, xs in series.items())
    assert S.clamped_ema(df.limit(0), "k").count() == 0


def plain_packs(items, most, chars):
    out, n, size, batch = {}, 0, 0, -1
    for i, c in sorted(items):
        if n == 0 or n + 1 > most or size + (c or 0) > chars:
            n, size, batch = 0, 0, batch + 1
        n, size, out[i] = n + 1, size + (c or 0), batch
    return out


def test_large_groups_are_packed_in_blocks(spark):
    r = random.Random(3)
    groups = {"hot": [(i, r.choice([0, 1, 5, 9, 40])) for i in range(3001)], "edge": [(i, 1) for i in range(101)], "even": [(i, 2) for i in range(100)], "small": [(5, 99), (2, None), (9, 3)], None: [(i, 3) for i in range(120)]}
    df = spark.createDataFrame([(g, i, c) for g, items in groups.items() for i, c in items], "g string, item_id long, chars long")
    for most, chars, block in ((7, 30, 50), (64, 100, 50), (3, 1, 50), (7, 30, 100_000)):
        got = {}
        for x in P.pack_batches(df, "g", most, chars, block).collect():
            got.setdefault(x.g, {})[x.item_id] = x.batch
        assert got == {g: plain_packs(items, most, chars) for g, items in groups.items()}, (most, chars, block)
    assert P.pack_batches(df.limit(0), "g").count() == 0


def test_packs_of_all_documents(spark, sf):
    """The query's own table, as one group and whole."""
    items = spark.read.parquet(f"{sf}/documents.parquet").select(F.lit("all").alias("g"), F.col("doc_id").alias("item_id"), F.length("text").alias("chars"))
    want = plain_packs([(r.item_id, r.chars) for r in items.collect()], 8, 20_000)
    for block in (20, 100_000):
        assert {r.item_id: r.batch for r in P.pack_batches(items, "g", 8, 20_000, block).collect()} == want


def test_worklist_of_one_beginning(spark):
    df = spark.createDataFrame([(f"Town of {i:04d}", None, "t") for i in range(300)], "name string, brand string, type string")
    out = R.enrich_worklist(df, ["brand", "type"], ["{entity} {field}"], 25).collect()
    assert {r.name: r.round for r in out} == {f"Town of {i:04d}": i // 25 + 1 for i in range(300)} and {r.query for r in out if r.name == "Town of 0007"} == {"Town of 0007 brand"}


def test_one_pass_over_runs(spark):
    rows = [(1, "harvest", "quick", 1000, "complete", 0.5), (2, "answer", None, 3000, "failed", None), (3, "unknown", "quick", 2000, "complete", 0.25)]
    runs = spark.createDataFrame(rows, "id int, kind string, preset string, elapsed_ms long, outcome string, judge_cost_usd double").withColumns({"llm_cost_usd": F.lit(None).cast("double"), "planner_cost_usd": F.lit(0.0)})
    out = {(r.dimension, r.value): (r.runs, r.avg_seconds, r.avg_cost, r.success_rate) for r in S.breakdown(runs).collect()}
    assert out[("all", "")] == (3, 2.0, 0.25, 0.6667) and out[("kind", "harvest")] == (1, 1.0, 0.5, 1.0) and out[("preset", "quick")] == (2, 1.5, 0.375, 1.0) and out[("preset", "thorough")] == (0, 0.0, 0.0, 0.0)
    assert set(out) == {("all", ""), *(("kind", k) for k in S.KINDS), *(("preset", p) for p in S.PRESETS)}
    assert {r.value: r.runs for r in S.breakdown(runs).where("dimension = 'kind'").collect()} == {r.kind: r.runs for r in S.by_value(runs, "kind", S.KINDS).collect()}
    assert {r.runs for r in S.breakdown(runs.limit(0)).collect()} == {0}


def test_one_scan_of_runs(spark, sf):
    from pagefacts.plans import fixtures

    plan = S.breakdown(fixtures.runs(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_sketches_of_days(spark):
    r = random.Random(4)
    rows = [(f"d{i % 30}", int(r.expovariate(1 / 4000)), f"u{i % 3}", f"n{r.randrange(5000)}") for i in range(60_000)]
    df = spark.createDataFrame(rows, "day string, elapsed_ms long, source_url string, name string")
    half = {f"d{i}" for i in range(15)}
    stored = S.latency_sketches(df, ["day"]).where(F.col("day").isin(*half))
    got, values = S.merged_percentiles(stored).first(), sorted(ms for d, ms, _, _ in rows if d in half)
    for p, seconds in ((0.5, got.p50), (0.9, got.p90)):
        below = sum(v < seconds * 1000 for v in values) / len(values)
        upto = sum(v <= seconds * 1000 for v in values) / len(values)
        assert below <= p + 0.01 and upto >= p - 0.01
    about = {x.source_url: x.entities for x in R.merged_yield(R.yield_sketches(df, "day")).collect()}
    for u in ("u0", "u1", "u2"):
        exact = len({n for _, _, v, n in rows if v == u})
        assert abs(about[u] - exact) <= 0.03 * exact


def test_retained_rows(spark, tmp_path):
    path, schema = f"{tmp_path}/kept", "k string, ts int, id int"
    rounds = [[("a", i, i) for i in range(4)] + [("b", 1, 1)], [("a", 9, 9), ("a", 9, 9), ("c", 5, 5)], [("a", 9, 9), ("a", 0, 77)]]
    for rows in rounds:
        R.retain_stored(spark.createDataFrame(rows, schema), path, "k", "ts", 3, "id", 4)
    assert sorted((r.k, r.ts, r.id) for r in spark.read.parquet(path).collect()) == [("a", 2, 2), ("a", 3, 3), ("a", 9, 9), ("b", 1, 1), ("c", 5, 5)]
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    R.retain_stored(spark.createDataFrame([("c", 6, 6)], schema), path, "k", "ts", 3, "id", 4)
    after = {p for p in tmp_path.rglob("*.parquet")}
    same = [p for p in before if p in after]
    part = {str(p.parent.name) for p in after - set(before)}
    assert len(part) == 1 and same and all(str(p.parent.name) not in part for p in same)
