"""Run logs as JSON Lines, and the event stream of runs."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import materialize

log = logging.getLogger(__name__)

RUN_LOG = """id string, started_at long, elapsed_ms long, query string, kind string, source string, preset string, outcome string, error string,
  records long, pages long, rounds long, judge_requests long, judge_input_tokens long, judge_cost_usd double, llm_requests long, llm_prompt_tokens long,
  llm_completion_tokens long, llm_cost_usd double, planner_requests long, planner_prompt_tokens long, planner_completion_tokens long, planner_cost_usd double"""
#: Defaults of fields that a line leaves out; prices and the error stay null.
TEXTS = ["id", "query", "kind", "source", "preset", "outcome"]
COUNTS = ["started_at", "elapsed_ms", "records", "pages", "rounds", "judge_requests", "judge_input_tokens", "llm_requests", "llm_prompt_tokens", "llm_completion_tokens", "planner_requests", "planner_prompt_tokens", "planner_completion_tokens"]
#: The judge's fields, behind its name and an underscore.
JUDGE_FIELDS = {"requests": "long", "input_tokens": "long", "cost_usd": "double"}
EVENT_TYPES = ["accepted", "progress", "usage", "stats", "result", "error"]


def _judge_name() -> Column:
    """Names besides the writer's and the planner's under which a line (``fields``) has all of the judge's fields."""
    keys = F.map_keys("fields")
    named = F.transform(F.filter(keys, lambda k: F.endswith(k, F.lit("_requests"))), lambda k: F.regexp_replace(k, "_requests$", ""))
    whole = lambda n: F.forall(F.array(*map(F.lit, JUDGE_FIELDS)), lambda f: F.array_contains(keys, F.concat(n, F.lit("_"), f)))
    return F.filter(F.array_distinct(named), lambda n: ~n.isin("llm", "planner") & whole(n))


def parse_run_log(lines: DataFrame, schema: str = RUN_LOG, judge: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs and rejected lines of a table of lines (``value``). Blank lines are neither; unknown fields are
    ignored; an explicit null of a field with a default takes the default.

    The judge's fields are called judge_ in the result. A log may have them under another name: the caller's ``judge``, or
    else the one name, besides the writer's and the planner's, under which a line has all of them. A line with
    two such names is rejected: the caller has to tell which is the judge.

    Each line is parsed once, by the schema and as a map, and the result is written: filters over parsed columns would
    parse lines again, once for each mention, and so would both results.
    """
    read = lines.where(F.trim("value") != "").select("value", F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("r"))
    read = read.withColumn("fine", F.col("r").isNotNull() & F.col("r._corrupt").isNull())
    read = read.withColumn("fields", F.when(F.col("fine"), F.from_json("value", "map<string,string>")))
    names = F.array(F.lit(judge)) if judge else _judge_name()
    read = read.withColumn("names", names).withColumn("name", F.when(F.size("names") == 1, F.col("names")[0]))
    told = {f"judge_{f}": F.try_element_at("fields", F.concat("name", F.lit(f"_{f}"))) for f in JUDGE_FIELDS}
    typed = {c: F.expr(f"try_cast(_{c} as {t})") for c, t in zip(told, JUDGE_FIELDS.values(), strict=True)}
    read = read.withColumns({f"_{c}": F.when(F.col("name") != "judge", t) for c, t in told.items()})
    odd = F.coalesce(F.size("names") > 1, F.lit(False))
    for c, t in typed.items():
        odd |= F.col(f"_{c}").isNotNull() & t.isNull()
    read = read.withColumn("fine", F.col("fine") & ~odd).select(F.when(~F.col("fine"), F.col("value")).alias("value"), "r", "fine", *(F.col(f"_{c}") for c in told))
    if not lines.isStreaming:
        read = materialize(read, "parsed_lines")
    own = read.where("fine").select("r.*", *(F.col(f"_{c}") for c in told)).drop("_corrupt")
    runs = own.withColumns({c: F.coalesce(typed[c], F.col(c)) for c in told if c in own.columns}).drop(*(f"_{c}" for c in told))
    fill = {c: "" for c in TEXTS if c in runs.columns} | {c: 0 for c in COUNTS if c in runs.columns}
    runs = runs.fillna(fill)
    if "started_at" in runs.columns:
        runs = runs.withColumn("ts", F.timestamp_seconds("started_at"))
    return runs, read.where("not fine").select("value")


def read_run_log(spark: SparkSession, path: str, judge: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs and rejected lines of the JSON Lines files under ``path``."""
    return parse_run_log(spark.read.text(path), judge=judge)


def append_run_log(runs: DataFrame, path: str) -> bool:
    """Appends runs as JSON Lines by day; runs whose id the log has on the same day are left out, so a repeated
    batch adds nothing. A log that cannot be written gives a warning and False: a run does not fail for it."""
    new = runs.withColumn("day", F.date_format(F.timestamp_seconds("started_at"), "yyyy-MM-dd")).dropDuplicates(["day", "id"])
    try:
        try:
            days = F.broadcast(new.select("day").distinct())  # a row for each day of the batch
            seen = runs.sparkSession.read.schema("id string, day string").json(path).join(days, "day", "left_semi")
            new = new.join(seen.distinct(), ["day", "id"], "left_anti")
        except AnalysisException as e:  # the log's first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").partitionBy("day").json(path)
    except Exception as e:
        log.warning("could not write the run log %s: %s", path, str(e).split("\n")[0])
        return False
    return True


def stream_append_run_log(runs: DataFrame, path: str, checkpoint: str):
    """Appends arriving runs to the log, each once: a batch that runs again after a failure finds its runs in the log. The
    log must be there to tell, so a batch that cannot be written fails the stream, which takes it again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if not append_run_log(batch, path):
                raise OSError(f"batch {batch_id} of the run log could not be written")
        finally:
            batch.unpersist()

    return runs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def demux_event_log(events: DataFrame) -> dict[str, DataFrame]:
    """A table of each event type; rows of other types are in none."""
    return {t: events.where(F.col("type") == t).drop("type") for t in EVENT_TYPES}
