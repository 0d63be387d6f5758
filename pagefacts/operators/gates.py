"""Score gates: thresholds over input scores, each missing score with its own cautious default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERDICTS = ["supports", "contradicts", "not_addressed", "ambiguous", "mixed"]
BINDINGS = ["different", "unresolved", "related", "same"]  # by rank


def gate_triage(hits: DataFrame, keep: float = 0.35, slop: float = 0.75) -> DataFrame:
    """All rows with ``kept`` and ``drop_reason``; a missing relevance or slop drops the row."""
    reason = F.when(~F.coalesce(F.col("relevance") >= keep, F.lit(False)), "relevance").when(~F.coalesce(F.col("slop") <= slop, F.lit(False)), "slop")
    return hits.withColumn("drop_reason", reason).withColumn("kept", F.col("drop_reason").isNull())


def is_quarantined(score: Column, ceiling: float = 0.55) -> Column:
    return F.coalesce(score, F.lit(1.0)) >= ceiling


def gate_quarantine(passages: DataFrame, ceiling: float = 0.55) -> tuple[DataFrame, DataFrame]:
    """Safe and quarantined passages; a missing injection score is unsafe."""
    bad = is_quarantined(F.col("injection"), ceiling)
    return passages.where(~bad), passages.where(bad)


def quarantined_urls(quarantined: DataFrame) -> DataFrame:
    """Each url with a quarantined passage, once."""
    return quarantined.select("url").distinct()


def gate_extractable(chunks: DataFrame, floor: float = 0.12) -> DataFrame:
    return chunks.where(F.col("has_items") >= floor)


def gate_grounding(records: DataFrame, floor: float = 0.60) -> DataFrame:
    """All rows with ``grounded``; a missing score is not."""
    return records.withColumn("grounded", F.coalesce("grounding", F.lit(0.0)) >= floor)


def gate_support(passages: DataFrame, floor: float = 0.45) -> DataFrame:
    """Passages that support, or of which a separately asked part does."""
    part = F.coalesce(F.exists("part_support", lambda x: x >= floor), F.lit(False))
    return passages.where(F.coalesce(F.col("supports") >= floor, F.lit(False)) | part)


def gate_constraints(verdicts: DataFrame, floor: float = 0.5, page: float = 0.70, rescue: float = 0.25) -> DataFrame:
    """record, excluded, support (the least probability), statuses (in order of constraint).

    A contradiction excludes the record for good. Other verdicts become ``supports`` when the
    probability reaches ``floor``, or the page's score ``page`` and the record's ``rescue``; an unknown
    label counts as not addressed.
    """
    known = F.when(F.col("label").isin(VERDICTS), F.col("label")).otherwise("not_addressed")
    p = F.coalesce("p", F.lit(0.0))
    rescued = (F.coalesce("page_p", F.lit(0.0)) >= page) & (p >= rescue)
    status = F.when(known == "contradicts", known).when((p >= floor) | rescued, "supports").otherwise(known)
    status = F.when((known == "supports") & (p < floor) & ~rescued, "not_addressed").otherwise(status)
    return verdicts.withColumn("status", status).groupBy("record").agg(
        F.bool_or(F.col("status") == "contradicts").alias("excluded"), F.min(p).alias("support"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("constraint", "status"))), lambda x: x["status"]), ",").alias("statuses")
    )


def gate_binding(values: DataFrame, strict: float = 0.75) -> DataFrame:
    """All rows with ``accepted``: same yes, related and different no, unresolved by the stricter floor."""
    ok = F.when(F.col("binding") == "same", True).when(F.col("binding").isin("related", "different"), False).otherwise(F.coalesce(F.col("grounding") >= strict, F.lit(False)))
    return values.withColumn("accepted", ok)


def validate_scores(scores: DataFrame, columns: list[str], map_column: str | None = None) -> DataFrame:
    """Rows whose numbers, the map's values too, are all finite and within 0..1; null is no fault."""
    fine = lambda x: x.isNull() | (~F.isnan(x) & x.between(0, 1))
    ok = F.lit(True)
    for c in columns:
        ok &= fine(F.col(c).cast("double"))
    if map_column:
        ok &= F.coalesce(F.forall(F.map_values(map_column), fine), F.lit(True))
    return scores.where(ok)


def thin_pages(pages: DataFrame, text: int = 1200, html: int = 2000) -> DataFrame:
    """Pages to read again: little text in much html, or no record and not rendered."""
    shell = (F.length("text") < text) & (F.length("html") > html)
    return pages.where(shell | ((F.coalesce("records", F.lit(0)) == 0) & ~F.col("rendered"))).select("page_id", shell.alias("shell"))


def completeness(records: DataFrame, fields: list[str]) -> DataFrame:
    """record_id, complete, status (what is missing or unverified)."""
    missing = F.array_compact(F.array(*(F.when(F.coalesce(F.element_at("fields", f), F.lit("")) == "", F.lit(f)) for f in fields)))
    verified = F.forall("constraint_status", lambda s: s == "supports")
    related = F.col("binding") == "related"
    parts = F.array_compact(F.array(F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))), F.when(~verified, F.lit("unverified constraint")), F.when(related, F.lit("related entity"))))
    return records.select("record_id", ((F.size(missing) == 0) & verified & ~related).alias("complete"), F.array_join(parts, "; ").alias("status"))


def support_band(df: DataFrame, score: str = "p") -> DataFrame:
    s = F.col(score).cast("double")
    finite = ~F.isnan(s) & (F.abs(s) < float("inf"))
    return df.withColumn("band", F.when(finite, F.when(s >= 0.8, "strong").when(s >= 0.5, "medium").otherwise("weak")))


def determination(values: DataFrame, no_ceiling: float = 0.1, floor: float = 0.6) -> DataFrame:
    return values.withColumn("answer", F.when(F.col("p") >= floor, "yes").when(F.col("p") <= no_ceiling, "no").otherwise(""))


def gate_queries(queries: DataFrame, floor: float = 0.4, keep_min: int = 2) -> DataFrame:
    """Queries at the floor or among the round's best ``keep_min``."""
    rank = F.row_number().over(Window.partitionBy("round").orderBy(F.desc_nulls_last("score"), "query"))
    return queries.withColumn("rank", rank).where((F.col("rank") <= keep_min) | (F.col("score") >= floor)).drop("rank")


def gate_claims(claims: DataFrame, floor: float = 0.5) -> DataFrame:
    """run, claims_checked, unsupported_claims; a claim without a score is neither."""
    return claims.groupBy("run").agg(F.count("score").alias("claims_checked"), F.count_if(F.col("score") < floor).alias("unsupported_claims"))


def attach_scores(items: DataFrame, answers: DataFrame, keys: list[str], missing: float, option: str | None = None) -> DataFrame:
    """Left join of answers by key, with the question's cautious value where there is none. ``option``: a column
    that names an option; ``option_p`` is its probability in the answer's map, 0 where answer or option is absent."""
    out = items.join(answers, keys, "left").withColumn("score", F.coalesce("score", F.lit(missing)))
    return out.withColumn("option_p", F.coalesce(F.try_element_at("probabilities", F.col(option)), F.lit(0.0))) if option else out


def best_evidence(passages: DataFrame, stale: float = 0.25) -> DataFrame:
    """Passages ranked by support times currency within a query; stale ones are labelled, not dropped."""
    currency = F.coalesce("currency", F.lit(1.0))
    order = Window.partitionBy("query").orderBy(F.desc_nulls_last(F.col("supports") * currency), "item", currency)
    return passages.select("query", "item", F.row_number().over(order).cast("long").alias("rank"), F.when(currency < stale, "may be superseded").otherwise("").alias("note"))


def rank_with_agreement(candidates: DataFrame, read: int = 3) -> DataFrame:
    """The best ``read`` kept candidates of a query; each further engine adds 15 %, 30 % at most."""
    rank = F.round(F.col("rank") * (1 + F.least(0.15 * (F.col("engines") - 1), F.lit(0.30))), 9)
    order = Window.partitionBy("query").orderBy(F.desc("boosted"), F.desc("authority"), "item")
    return candidates.where("kept").withColumn("boosted", rank).withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= read).select("query", "item", "boosted", "place")


def enumeration_authorities(pages: DataFrame, floor: float = 0.80, least: int = 3, most: int = 3) -> DataFrame:
    """The first ``most`` pages read (by ``seq``) on the anchor's site that name ``least`` entities and are complete
    at ``floor`` or more; a missing completeness is 0."""
    ok = pages.where("on_anchor").where((F.col("entities") >= least) & (F.coalesce("completeness", F.lit(0.0)) >= floor))
    return ok.orderBy("seq").limit(most)


def drop_unmentioned(records: DataFrame, presence: DataFrame, authorities: DataFrame, ceiling: float = 0.20) -> DataFrame:
    """Records without an own-site source whose greatest presence over the authorities is at the ceiling or
    below go; a missing presence is 1. ``presence``: record, page, presence; ``authorities`` are few rows by
    definition (see above), so they are broadcast."""
    pages = F.broadcast(authorities.select("page").distinct())
    asked = F.broadcast(authorities.agg(F.count_distinct("page").alias("asked")))
    most = presence.join(pages, "page").groupBy("record").agg(F.max(F.coalesce("presence", F.lit(1.0))).alias("most"), F.count_distinct("page").alias("answered"))
    met = records.join(most, "record", "left").crossJoin(asked)
    top = F.when(F.coalesce("answered", F.lit(0)) < F.col("asked"), 1.0).otherwise(F.coalesce("most", F.lit(1.0)))
    return met.where(F.col("own_site") | (top > ceiling)).select(*records.columns)


def other_set_excluded(records: DataFrame) -> DataFrame:
    """Records that have a listing page of the wanted set, or support for its defining constraint, on some row."""
    kept = records.groupBy("record").agg((~F.bool_and("other_set") | F.bool_or("supported")).alias("kept"))
    return kept.where("kept").select("record")
