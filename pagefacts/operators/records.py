"""Extracted records: identity, merging, completeness order, profiles and conflicts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_entity
from .gates import BINDINGS
from .graph import components, materialize
from .ranges import positions


def drop_category_echo(records: DataFrame, entity_type: str) -> DataFrame:
    """Records whose name is more than words of the entity type; run before pairs are built."""
    words = lambda c: F.split(normalize_entity(c), " ")
    return records.where(F.size(F.array_except(words(F.col("name")), words(F.lit(entity_type)))) > 0)


#: Characters of the grams by which keys are found inside others; shorter keys are not looked for.
GRAM = 3


def name_pairs(keys: DataFrame, percent: int = 60) -> DataFrame:
    """(a, b, shared) of distinct keys of which one holds the other (as prefix, suffix or inside), or whose common
    words are ``percent`` of the smaller one's or more; ``shared`` counts common words.

    The smaller key's rarest words, as many as it may lack and one more, must hold a common word; only
    those are joined with all words, so frequent words meet rarely and none is capped. Likewise a key that
    lies inside another has its rarest gram there.
    """
    key = keys.select("key").distinct().withColumn("words", F.array_distinct(F.split("key", " "))).withColumn("n", F.size("words"))
    word = key.select("key", "n", F.explode("words").alias("word"))
    df = word.groupBy("word").agg(F.count("*").alias("df"))
    ranked = word.join(df.hint("shuffle_hash"), "word").withColumn("nr", F.row_number().over(Window.partitionBy("key").orderBy("df", "word")))
    head = ranked.where(F.col("nr") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select(F.col("key").alias("a"), F.col("n").alias("na"), "word")
    met = head.join(word.select(F.col("key").alias("b"), F.col("n").alias("nb"), "word").hint("merge"), "word").where("a != b and na <= nb").select("a", "b")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("key") - GRAM + 1), lambda i: F.substring("key", i, F.lit(GRAM))))
    gram = key.where(F.length("key") >= GRAM).select("key", F.explode(grams).alias("gram"))
    rare = gram.join(gram.groupBy("gram").agg(F.count("*").alias("df")).hint("shuffle_hash"), "gram").groupBy("key").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"))
    inside = rare.select(F.col("key").alias("a"), "gram").join(gram.select(F.col("key").alias("b"), "gram").hint("merge"), "gram").where(F.col("a") != F.col("b")).where(F.contains("b", "a")).select("a", "b")
    words = lambda c: key.select(F.col("key").alias(c), F.col("words").alias(f"w{c}")).hint("merge")
    both = met.union(inside).distinct().join(words("a"), "a").join(words("b"), "b").withColumn("shared", F.size(F.array_intersect("wa", "wb")))
    both = both.where((F.col("shared") * 100 >= F.least(F.size("wa"), F.size("wb")) * percent) | ((F.length("a") >= GRAM) & F.contains("b", "a")))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared").distinct()


def shared_email_pairs(records: DataFrame) -> DataFrame:
    """(a, b): each record and the smallest one with its e-mail address; n-1 pairs for n records."""
    low = records.groupBy("email").agg(F.min("id").alias("a"))
    return records.join(low, "email").where("id != a").select("a", F.col("id").alias("b")).distinct()


def merge_groups(pairs: DataFrame, name_floor: float = 1.5, email_floor: float = 1.0) -> DataFrame:
    """(node, component) under the accepted pairs (a, b, kind, score); component is the least member."""
    ok = F.when(F.col("kind") == "email", F.col("score") >= email_floor).otherwise(F.col("score") >= name_floor)
    return components(pairs.where(ok))


def best_binding(binding: Column) -> Column:
    """Aggregate: the binding of highest rank."""
    rank = F.array_position(F.array(*map(F.lit, BINDINGS)), binding)
    return F.max_by(binding, rank)


def field_source(records: DataFrame, field: str) -> Column:
    """Where a record has a field's value from, and how well it is grounded there: its own provenance of the field, else
    the record's page and grounding."""
    page = F.struct(F.col("source_url").cast("string").alias("source_url"), F.col("grounding").cast("double").alias("grounding"))
    if "provenance" not in records.columns:
        return page
    own = F.try_element_at("provenance", F.lit(field))
    return F.when(own.isNull(), page).otherwise(F.struct(own["source_url"].cast("string").alias("source_url"), own["grounding"].cast("double").alias("grounding")))


def merge_records(records: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """One record per group: each field's value of best grounding (then smallest id), with its source as
    ``provenance`` (field to source_url and grounding), all sources, the highest binding, and the constraint statuses one
    by one: ``supports`` if a record says so, else the first that was checked (by record_id); a longer list keeps its tail.

    Records may have ``provenance`` of their own, as merged ones do: it tells where a field's value was verified and
    how well, whatever the record's own page and grounding. So merges can be merged again.
    """
    records = records.withColumns({f"_{f}": field_source(records, f) for f in fields})
    best = lambda what, f: F.max_by(what, F.when(F.col(f).isNotNull() & (F.col(f) != ""), F.struct(f"_{f}.grounding", -F.col("record_id"))))
    sources = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), best(F.col(f"_{f}"), f).alias("source")) for f in fields)), lambda x: x["source"].isNotNull())
    own = records.groupBy(group).agg(*(best(f, f).alias(f) for f in fields), F.map_from_entries(sources).alias("provenance"), best_binding(F.col("binding")).alias("binding"), F.array_join(F.array_sort(F.collect_set("source_url")), "|").alias("sources"))
    each = records.select(group, "record_id", F.posexplode("statuses").alias("i", "status"))
    first = F.min_by("status", F.when(F.col("status") != "unchecked", F.col("record_id")))
    status = F.when(F.bool_or(F.col("status") == "supports"), "supports").otherwise(F.coalesce(first, F.lit("unchecked")))
    merged = each.groupBy(group, "i").agg(status.alias("status")).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "status"))), lambda x: x["status"]).alias("statuses"))
    return own.join(merged.hint("merge"), group, "left")


#: Rows that are shown of a list for which no number is given.
DEFAULT_ROWS = 50


def row_limit(limit: int | None = None, target: int | None = None) -> int | None:
    """How many rows to show: all for 0 (None), else the limit, the target, or DEFAULT_ROWS."""
    if limit is None:
        return max(1, target if target is not None else DEFAULT_ROWS)
    return limit or None


def complete_first(records: DataFrame, limit: int | None = None, target: int | None = None) -> DataFrame:
    """Per run the complete records first, then by grounding, then input order, as many as row_limit says; with the
    run's ``total`` and ``n_complete`` records and how many are ``shown``."""
    run = Window.partitionBy("run")
    out = records.withColumn("place", F.row_number().over(run.orderBy(F.desc("complete"), F.desc("grounding"), "seq")).cast("long"))
    out = out.withColumns({"total": F.count("*").over(run), "n_complete": F.count_if("complete").over(run)})
    most = row_limit(limit, target)
    out = out.withColumn("shown", F.col("total") if most is None else F.least("total", F.lit(most).cast("long")))
    return out.where(F.col("place") <= F.col("shown"))


def run_sources(records: DataFrame, floor: float = 0.6) -> DataFrame:
    """(run, source_url) of the grounded records of each run."""
    return records.where(F.col("grounding") >= floor).select("run", "source_url").distinct()


def field_fill_profile(records: DataFrame, fields: list[str]) -> DataFrame:
    """field, filled, rate over all records."""
    filled = lambda f: F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) != "").alias(f)
    counts = records.agg(F.count("*").alias("_n"), *(filled(f) for f in fields))
    return counts.unpivot(["_n"], fields, "field", "filled").select("field", "filled", F.round(F.col("filled") / F.col("_n"), 4).alias("rate"))


def set_summary(records: DataFrame, fields: list[str], rows: int = 5) -> DataFrame:
    """section, name, n, rate: how far each field is filled, records of each contributing ``domain``, and ``rows`` sample
    rows (those of smallest record_id) as JSON."""
    filled = field_fill_profile(records, fields).select(F.lit("field").alias("section"), F.col("field").alias("name"), F.col("filled").alias("n"), "rate")
    none = F.lit(None).cast("double").alias("rate")
    domains = records.groupBy("domain").agg(F.count("*").alias("n")).select(F.lit("domain"), "domain", "n", none)
    sample = records.orderBy("record_id").limit(rows).select(F.lit("sample"), F.to_json(F.struct(*fields)), "record_id", none)
    return filled.union(domains).union(sample)


def domain_productivity(records: DataFrame) -> DataFrame:
    return records.groupBy("domain").agg(F.count("*").alias("records"), F.count_if("complete").alias("complete"))


def page_yield(records: DataFrame, least: int = 2) -> DataFrame:
    """source_url and distinct entities of pages with ``least`` or more."""
    return records.groupBy("source_url").agg(F.count_distinct("name").alias("entities")).where(F.col("entities") >= least)


def conflict_report(records: DataFrame, entity: str, field: str, source: str) -> DataFrame:
    """Entities with several values of a field, and the sources of each value."""
    values = records.where(F.col(field).isNotNull()).groupBy(entity, field).agg(F.count_distinct(source).alias("sources"))
    return values.groupBy(entity).agg(F.count("*").alias("n_values"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", field, "sources"))), "; ").alias("seen")).where("n_values > 1")


def enrich_worklist(records: DataFrame, fields: list[str], templates: list[str], batch: int = 25) -> DataFrame:
    """(name, field, query, round) of missing fields: all entities that lack one, by name, ``batch`` a round.

    A name's rank is its place in its range of the sorted names plus the count of those before, so no task holds
    all names, nor all of one beginning.
    """
    missing = F.array_compact(F.array(*(F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.lit(f)) for f in fields)))
    lacking = records.groupBy("name").agg(*(F.max(f).alias(f) for f in fields)).withColumn("missing", missing).where(F.size("missing") > 0)
    ranked = positions(lacking.select("name", "missing"), [], ["name"])
    chosen = ranked.select("name", F.explode("missing").alias("field"), (F.floor(F.col("position") / batch) + 1).cast("long").alias("round"))
    return chosen.select("name", "field", F.explode(F.array(*(F.replace(F.replace(F.lit(t), F.lit("{entity}"), F.col("name")), F.lit("{field}"), F.col("field")) for t in templates))).alias("query"), "round")


def fact_rollup(records: DataFrame, by: str, metric: str, flag: str) -> DataFrame:
    """Per group: records, how many have the metric, share with the flag, median of the metric."""
    return records.groupBy(by).agg(F.count("*").alias("records"), F.count(metric).alias("with_metric"), F.round(F.avg(F.col(flag).cast("int")), 4).alias("share"), F.round(F.percentile(metric, 0.5), 4).alias("median"))


def retain_newest(df: DataFrame, key: str, ts: str, n: int, tie: str) -> DataFrame:
    """The newest ``n`` rows of each key."""
    order = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("_nr", F.row_number().over(order)).where(F.col("_nr") <= n).drop("_nr")


def retain_stored(new: DataFrame, path: str, key: str, ts: str, n: int, tie: str, parts: int = 64) -> None:
    """Adds rows to a table under ``path`` that holds the newest ``n`` rows of each key; a row that comes again (same
    key, ts and tie) counts once.

    The table is partitioned by the key's hash. Only partitions that get rows are read and written again, each
    replaced as a whole; ``parts`` is the table's for good.
    """
    spark = new.sparkSession
    new = new.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    try:
        stored = spark.read.schema(new.schema).parquet(path)
        touched = F.broadcast(new.select("part").distinct())  # ``parts`` rows at most
        both = new.unionByName(stored.join(touched, "part", "left_semi"))
    except AnalysisException as e:  # the first rows
        if "PATH_NOT_FOUND" not in str(e):
            raise
        both = new
    kept = materialize(retain_newest(both.dropDuplicates([key, ts, tie]), key, ts, n, tie), "retained")
    kept.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


#: Registers of a distinct count, as a power of two: a standard error of 1.04 / sqrt(2^14), 0.8 %.
LOG_REGISTERS = 14


def yield_sketches(records: DataFrame, day: str) -> DataFrame:
    """source_url, day and a sketch of the names seen: what is kept of each day to count any range of days."""
    return records.groupBy("source_url", day).agg(F.hll_sketch_agg("name", LOG_REGISTERS).alias("names"))


def merged_yield(sketches: DataFrame, least: int = 2) -> DataFrame:
    """source_url and about how many distinct entities of pages with ``least`` or more, over the days given."""
    return sketches.groupBy("source_url").agg(F.hll_sketch_estimate(F.hll_union_agg("names")).alias("entities")).where(F.col("entities") >= least)
