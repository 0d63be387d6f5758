"""Operator 3: mixing sources to target weights.

Each source's words, its documents in a fixed order, are packed into blocks of ``BLOCK`` words. The
mix is a row of slots dealt into shards; a shard's slots per source are a multinomial draw from the
quotas still open, so that the draws vary while totals come out exactly. Slot k of a source takes
block ``permutation(k mod blocks)`` of pass ``k div blocks``; each pass has its own pseudorandom
permutation, computed from the index. Slots and blocks then meet in a join by (source, block).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix, sized_hint, slices, words_of

#: Words of a block; slots of a shard and most shards (beyond it shards get larger).
BLOCK, SHARD_SLOTS, MOST_SHARDS = 128, 1024, 4096
#: Passes over a source at most; weights of the sources in order, repeating.
PASSES, WEIGHTS = 3, (5, 2, 1)
#: Documents of one source that share a chunk of the order, about.
CHUNK_ROWS = 4000
SEED = 20_240_101


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> dict[str | None, float]:
    """Words wanted of each source: shares of all words by weight, none above ``passes`` times its size."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    while True:
        open_ = [s for s in order if s not in out]
        rest, total = sum(sizes.values()) - math.fsum(out.values()), sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / total for s in open_}
        above = [s for s in open_ if share[s] > passes * sizes[s]]
        if not above:
            return out | share
        out |= {s: float(passes * sizes[s]) for s in above}


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at ``index``: four Feistel rounds, walked until inside."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & (2**64 - 1)))
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _key(*parts: int) -> int:
    out = np.uint64(SEED)
    for p in parts:
        out = mix(np.array([out ^ np.uint64(p)], np.uint64) + np.uint64(0x9E3779B97F4A7C15))[0]
    return int(out)


@dataclass
class Plan:
    """Quotas in words and slots of each source, and the slots per shard and source."""

    size: np.ndarray
    quota: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, sizes: list[int], wanted: list[float]) -> Plan:
        size = np.array(sizes, np.int64)
        quota = np.minimum(np.round(np.array(wanted)).astype(np.int64), PASSES * size)
        return cls(size, quota, _draw(cls.slots(size, quota)))

    @staticmethod
    def slots(size: np.ndarray, quota: np.ndarray) -> np.ndarray:
        whole, blocks = quota // np.maximum(size, 1), -(-size // BLOCK)
        return whole * blocks + -(-(quota - whole * size) // BLOCK)

    def shard(self, shard: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Slots of a shard, source after source: slot, source, pass, block, words."""
        place, total = 0, int(self.counts[shard].sum())
        before = self.counts[:shard].sum(axis=0)
        for s in np.flatnonzero(self.counts[shard]).tolist():
            end = int(self.counts[shard, s])
            for at in range(0, end, 1 << 20):
                k = np.arange(at, min(end, at + (1 << 20)))
                slot = permuted(place + k, total, _key(shard, 1 << 40))
                k = k + int(before[s])
                size, full, short = int(self.size[s]), int(self.size[s]) // BLOCK, int(self.size[s]) % BLOCK
                blocks = full + (short > 0)
                turn, j = k // blocks, k % blocks
                block = np.full(len(k), full, np.int64)
                for t in np.unique(turn):
                    on = (turn == t) & (j < full)
                    block[on] = permuted(j[on], full, _key(s, int(t)))
                words = np.minimum(np.where(j < full, BLOCK, short), np.maximum(int(self.quota[s]) - turn * size - j * BLOCK, 0))
                yield slot, np.full(len(k), s), turn, block, words
            place += end


def _draw(slots: np.ndarray) -> np.ndarray:
    """Multinomial counts per shard from the slots still open; their sums are the slots."""
    total = int(slots.sum())
    size = max(SHARD_SLOTS, -(-total // MOST_SHARDS))
    left, random, out = slots.astype(np.int64).copy(), np.random.default_rng(SEED), []
    for at in range(0, total, size):
        drawn = np.zeros_like(left)
        while (short := min(size, total - at) - int(drawn.sum())) > 0:
            rest = left - drawn
            drawn += np.minimum(random.multinomial(short, rest / rest.sum()), rest)
        out.append(drawn)
        left -= drawn
    return np.array(out, np.int64).reshape(len(out), len(slots))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        _, ends = words_of(part.column("text"))
        yield part.drop_columns(["text"]).append_column("size", pa.array(np.diff(ends, prepend=0), pa.int64()))


def _tie(docs: DataFrame):
    return F.xxhash64(F.col("doc_id").cast("long"), "text", F.col("source").cast("string"))


class Mix:
    """A drawn mix: ``rows`` (tie, nr, doc_id, source, source_nr, size, start), ``sources`` and ``spans``."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _tie(docs).alias("tie"), F.col("text"))
        light = materialize(light.mapInArrow(_sizes, "doc_id long, source string, tie long, size long"), "sizes")
        found = light.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        sizes = {r["source"]: r["size"] for r in found}
        wanted = targets(sizes)
        order = list(wanted)
        order.sort(key=lambda s: (s is None, s or ""))
        self.plan = Plan.of([sizes[s] for s in order], [wanted[s] for s in order])
        named = [(s, i, sizes[s], float(wanted[s])) for i, s in enumerate(order)]
        self.sources = spark.createDataFrame(named, "source string, source_nr int, source_size long, target double")

        chunks = max(1, sum(r["n"] for r in found) // CHUNK_ROWS)
        light = light.withColumn("chunk", F.pmod(F.xxhash64("tie"), F.lit(chunks)))
        before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        heads = light.groupBy("source", "chunk").agg(F.sum("size").alias("words")).select("source", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("head"))
        inside = Window.partitionBy("source", "chunk").orderBy("tie", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        same = Window.partitionBy("source", "chunk", "tie").orderBy("doc_id")
        light = light.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("within"), F.row_number().over(same).alias("nr"))
        null_safe = lambda a, b: a["source"].eqNullSafe(b["source"])
        heads = heads.hint("merge")
        light = light.join(heads, null_safe(light, heads) & (light["chunk"] == heads["chunk"])).select(light["doc_id"], light["source"], "tie", "nr", "size", (F.col("head") + F.col("within")).alias("start"))
        small = sized_hint(self.sources.select("source", "source_nr"), len(order))
        rows = light.join(small, null_safe(light, small)).select("tie", "nr", "doc_id", light["source"], "source_nr", "size", "start")
        self.rows = materialize(rows, "mixed")

    def slots(self) -> DataFrame:
        """shard, slot, source_nr, pass, block, words: the mix in order of (shard, slot)."""
        spark, plan = self.sources.sparkSession, self.sources.sparkSession.sparkContext.broadcast(self.plan)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    for slot, source, turn, block, words in plan.value.shard(shard):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), shard)), pa.array(slot), pa.array(source, pa.int32()), pa.array(turn, pa.int32()), pa.array(block), pa.array(words)], ["shard", "slot", "source_nr", "pass", "block", "words"])

        tasks = max(1, min(len(self.plan.counts), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        return spark.range(0, len(self.plan.counts), 1, tasks).mapInArrow(run, "shard long, slot long, source_nr int, pass int, block long, words long")

    def spans(self) -> DataFrame:
        """Each slot's pieces of documents: shard, slot, pass, source_nr, start (the document), from_word, to_word."""
        first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
        pieces = self.rows.where("size > 0").select("source_nr", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
        lo = F.greatest(F.col("block") * BLOCK, "start")
        pieces = pieces.select("source_nr", "block", "start", lo.alias("lo"), F.least((F.col("block") + 1) * BLOCK, F.col("start") + F.col("size")).alias("hi"))
        met = self.slots().hint("merge").join(pieces, ["source_nr", "block"])
        to = F.least("hi", F.col("block") * BLOCK + F.col("words"))
        met = met.select("shard", "slot", "pass", "source_nr", "start", (F.col("lo") - F.col("start")).alias("from_word"), (to - F.col("start")).alias("to_word"))
        return met.where("from_word < to_word")


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of ``docs`` (doc_id, text, source).

    A null text has no words; a null source is a source of its own, the last one. Rows with one doc_id
    are taken each for itself. A source gives its target, rounded, to the word; the table of sources
    (a row each) is on the driver. Other columns are ignored.
    """
    mixed = Mix(docs)
    taken = mixed.spans().groupBy("source_nr", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    rows = mixed.rows.withColumn("start", F.when(F.col("size") > 0, F.col("start")))
    out = rows.join(taken.hint("merge"), ["source_nr", "start"], "left")
    return out.join(sized_hint(mixed.sources.drop("source"), len(mixed.plan.size)), "source_nr").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """What the mix takes, as documents with the columns of ``docs``: a row for each document and pass.

    A row's text is the document's, or the words taken of it where the pass takes only some; ``n_chars``,
    where there is one, follows the text. Documents without words are not in the mix.
    """
    mixed = Mix(docs)
    parts = mixed.spans().groupBy("source_nr", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("spans"), F.sum(F.col("to_word") - F.col("from_word")).alias("words"))
    rows = mixed.rows.where("size > 0").join(parts.hint("merge"), ["source_nr", "start"]).select(F.struct("tie", "nr").alias("row"), F.when(F.col("words") < F.col("size"), F.col("spans")).alias("spans"))
    rows = rows.select("row.tie", "row.nr", "spans").groupBy("tie", "nr").agg(F.collect_list(F.struct("spans")).alias("taken_parts"))
    own = docs.select(F.struct("*").alias("doc"), _tie(docs).alias("tie"))
    own = own.withColumn("nr", F.row_number().over(Window.partitionBy("tie").orderBy("doc.doc_id")))
    out = own.join(rows.hint("merge"), ["tie", "nr"]).select("doc", F.explode("taken_parts").alias("part"))
    words = F.array_remove(F.split("doc.text", "[\\x20\\x09-\\x0D]+"), "")
    cut = F.array_join(F.flatten(F.transform("part.spans", lambda s: F.slice(F.col("words"), s["from_word"].cast("int") + 1, (s["to_word"] - s["from_word"]).cast("int")))), " ")
    out = out.withColumn("words", F.when(F.col("part.spans").isNotNull(), words)).withColumn("taken_text", F.coalesce(cut, F.col("doc.text")))
    new = {"text": F.col("taken_text"), "n_chars": F.char_length("taken_text")}
    return out.select(*(new[c].cast(t).alias(c) if c in new else F.col(f"doc.`{c}`").alias(c) for c, t in docs.dtypes))
