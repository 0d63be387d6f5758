"""Queries and operators on inputs that the small tables lack."""

import duckdb
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from pagefacts.functions import text as T
from pagefacts.operators import hits as H
from pagefacts.operators import page_jobs as P
from pagefacts.operators.slices import by_slices
from pagefacts.plans import registry
from pagefacts.sources import export, runlog
from pagefacts.streaming import jobs as J


def test_score_with_leaves_out_what_is_too_long_as_its_sql_does(spark, tmp_path):
    texts = [(1, "x" * 64_000), (2, "x" * 64_001), (3, None), (4, ""), (5, "é" * 3_000), (6, "x" * 5_000)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.item_id, r.question_id): (r.score, r.choice, r.level) for r in registry.QUERIES["score_with"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {(i, q): (score, choice, level) for i, q, score, choice, level in c.sql(registry.ORACLES["score_with"]).fetchall()}
    assert got == want
    assert [k for k in got if k[0] == 2] == [(2, "plain")] and got[2, "plain"][0] is None
    assert got[3, "plain"][0] == 0.0 and got[1, "long"][0] == 1.0


def test_score_with_keeps_large_ids_beside_a_null_one_as_its_sql_does(spark, tmp_path):
    texts = [(2**53 + 1, "x" * 900), (None, "x" * 5_000), (2**63 - 1, "x" * 2_000), (-(2**53) - 1, "x" * 64_001)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, registry.QUERIES["score_with"](spark, str(tmp_path)).collect()), key=repr)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(c.sql(registry.ORACLES["score_with"]).fetchall(), key=repr) and len(got) == 13


def test_judges_take_many_items_of_a_large_batch_at_once(spark):
    df = spark.range(2_000).selectExpr("id as item_id", "case when id = 7 then repeat('x', 64001) else repeat('x', 1000) end as text").coalesce(1)
    sizes = {r.item_id: r.score for r in P.score_with(df, lambda t: pd.Series([float(len(t))] * len(t))).collect()}
    assert len(sizes) == 2_000 and sizes.pop(7) is None and all(4 <= n <= 64 for i, n in sizes.items() if i > 500)
    told = P.answer_with(df, [{"id": "y", "kind": "yes_no"}], lambda t, q: [{"score": float(len(t))}] * len(t)).collect()
    assert {r.item_id: r.score for r in told} == sizes


def test_run_log_is_parsed_once_and_written(spark):
    lines = ['{"id":"a","records":2,"my.scorer_requests":3,"my.scorer_input_tokens":4,"my.scorer_cost_usd":0.5}', '{"id":"b","judge_requests":1}', '{"id": 7', "  "]
    runs, bad = runlog.parse_run_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    for df in (runs, bad):
        assert "from_json" not in df._jdf.queryExecution().toString()
    assert {(r.id, r.judge_requests, r.judge_input_tokens, r.judge_cost_usd) for r in runs.collect()} == {("a", 3, 4, 0.5), ("b", 1, 0, None)}
    assert [r.value for r in bad.collect()] == ['{"id": 7']


def test_merging_hits_deals_them_out_once(spark):
    rows = [(q, lane, o, p, f"https://s{p % 3}.org/{p % 2}", "A title of four words", "s") for q in range(20) for o, lane in enumerate("ab") for p in range(1, 5)]
    out = H.merge_hits(spark.createDataFrame(rows, "query long, lane string, lane_ord int, pos int, url string, title string, snippet string"), 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "parquet" not in plan
    assert {(r.query, r.key, tuple(r.engines), r.place) for r in out.collect()} == {(q, key, ("a", "b"), place) for q in range(20) for key, place in (("s1.org/1", 1), ("s1.org/0", 2))}


def test_pages_are_tokenized_once_for_their_chunks(spark):
    pages = spark.createDataFrame([(1, "<p>" + "word &eacute;&#65; " * 30 + "<p>" + "other " * 40), (2, "<p>short"), (3, None)], "page_id long, html string")
    out = P.chunk_pages(pages.select("page_id", T.page_text(F.col("html")).alias("text")), "page_id", 400)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("<noscript(") == 1
    assert [(r.page_id, r.nr, r.n_chunks) for r in out.orderBy("page_id", "nr").collect()] == [(1, 1, 2), (1, 2, 2)]


def test_large_batches_are_taken_in_slices():
    batch = pa.record_batch({"id": pa.array(range(10)), "text": pa.array(["é" * 500_000] * 9 + [None])})
    run = by_slices("text", {"id": pa.int64(), "n": pa.int64()}, lambda i, text: [(i, len(text or ""))] * 2, "id", "text")
    out = list(run(iter([batch])))
    assert [b.num_rows for b in out] == [6, 6, 8] and pa.Table.from_batches(out).to_pylist()[::2] == [{"id": i, "n": 500_000 if i < 9 else 0} for i in range(10)]


def test_pages_are_decoded_in_slices(spark):
    rows = [("a", b"caf\xc3\xa9", None), ("b", b"caf\xe9", None), ("c", None, "utf-8"), (None, b"x", "utf-8")]
    out = export.decode_pages(spark.createDataFrame(rows, "url string, content binary, charset string"))
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.url, r.html) for r in out.collect()} == {("a", "café"), ("b", "café"), ("c", ""), (None, "x")}


def test_claims_and_links_are_found_in_slices(spark):
    df = spark.createDataFrame([(1, "One. Two [a](https://a.org)."), (2, None)], "id long, text string")
    claims, links = P.split_claims(df.withColumnRenamed("text", "answer")), P.markdown_links(df.withColumnRenamed("id", "doc_id"))
    for out in (claims, links):
        assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in claims.collect()] == [(1, 1, "One."), (1, 2, "Two [a](https://a.org).")]
    assert [tuple(r) for r in links.collect()] == [(1, 1, "https://a.org", "a")]


def test_gauge_asks_the_state_once_for_a_run():
    asked = []

    class State:
        held = None

        def exists(self):
            asked.append("exists")
            return self.held is not None

        def get(self):
            asked.append("get")
            return self.held

        def update(self, value):
            asked.append("update")
            self.held = value

    gauge = J.UsageGauge(10, 60)
    gauge.state = State()
    frames = lambda *rows: iter([pd.DataFrame([r], columns=["at", "final", "seq", "k"]) for r in rows])
    out = [x for f in gauge.handleInputRows((7,), frames((12.0, False, 2, 5), (11.0, False, 1, 4), (25.0, False, 3, 6)), None) for x in f.itertuples(index=False, name=None)]
    assert out == [(7, 10, 2, 5, False), (7, 20, 3, 6, False)]
    out = [x for f in gauge.handleInputRows((7,), frames((14.0, False, 4, 8)), None) for x in f.itertuples(index=False, name=None)]
    assert out == [(7, 10, 4, 8, False)] and gauge.state.held == (20, False)
    assert asked == ["get", "update"] * 2
