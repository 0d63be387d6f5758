"""Operator 6: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, word pairs and pairs with one word between, each a 64-bit
hash; words are lower-cased and lose punctuation at their ends. Training uses a bounded sample of
labelled rows in one task; L1 leaves few weights, which every scoring task gets by broadcast. Weights
are not negative: a text is toxic by what it holds, and ordinary words around an insult, however many,
do not outvote it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, mix, slices

#: The sample that training reads: labelled rows of smallest hash of doc_id, so many at most, and of those as many as
#: hold so many features together.
SAMPLE_ROWS, SAMPLE_FEATURES = 8_000, 12_000_000
#: Rates and regularisation. L1 grows with the root of the number of rows and of a feature's own squared gradients
#: (times NOISE), as the noise of summed gradients does.
ALPHA, BETA, L1, NOISE, L2, EPOCHS = 1.0, 1.0, 0.1, 0.25, 1.0, 6
#: Added to the log odds of all texts: a toxic text missed is worse than a false alarm. This, L1 and NOISE were chosen by
#: four folds of training rows (crc32 mod 5 from 1 to 4), for a recall of 0.9 with few false alarms.
SHIFT = 2.0
BIAS = np.uint64(1)
ENDS = ".,;:!?\"'()[]{}<>*#$%&|-_~`"


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of each occurrence, ordered by text."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    values = pc.utf8_trim(coded.dictionary, characters=ENDS).to_pylist()
    owner = np.repeat(np.arange(len(counts)), counts)
    if not values:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    empty = np.array([not x for x in values])
    index = coded.indices.to_numpy(zero_copy_only=False)
    full = ~empty[index]
    words, owner = pd.util.hash_array(np.array(values, dtype=object), categorize=False)[index[full]], owner[full]
    texts_of, found = [owner], [words]
    for gap in (1, 2):
        same = owner[:-gap] == owner[gap:] if len(owner) > gap else np.zeros(0, bool)
        pair = mix(words[:-gap] * np.uint64(0x9E3779B97F4A7C15) + words[gap:] + np.uint64(gap)) if len(owner) > gap else np.empty(0, np.uint64)
        texts_of.append(owner[: len(same)][same])
        found.append(pair[same])
    return np.concatenate(texts_of), np.concatenate(found)


def train(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights that L1 leaves, after EPOCHS passes in the order given. The bias has no L1, may be
    negative and begins at the log odds of the labels, so that words common to all texts start out neutral.

    A gradient is below 1, so a feature of n rows cannot pass L1 unless n times EPOCHS does: others are left out."""
    if not rows:
        return np.empty(0, np.uint64), np.empty(0)
    names, counts = np.unique(np.concatenate([x for x, _ in rows]), return_counts=True)
    least = L1 * np.sqrt(len(rows))
    names = names[counts * EPOCHS > least]
    at = []
    for x, _ in rows:
        k = np.minimum(np.searchsorted(names, x), max(len(names) - 1, 0))
        at.append(k[names[k] == x] if len(names) else k[:0])
    toxic = sum(label for _, label in rows)
    prior = np.log((toxic + 0.5) / (len(rows) - toxic + 0.5))
    z, n, z0, n0 = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        root = np.sqrt(ni)
        return np.maximum(-zi - least - NOISE * root, 0.0) / ((BETA + root) / ALPHA + L2)

    def shift(z0: float, n0: float) -> float:
        return -z0 / ((BETA + np.sqrt(n0)) / ALPHA + L2)

    for _ in range(EPOCHS):
        for k, (_, label) in zip(at, rows, strict=True):
            w, w0 = weights(z[k], n[k]), shift(z0, n0)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + prior + w0, -35, 35))) - label
            z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / ALPHA * w
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / ALPHA * w0
            n[k] += g * g
            n0 += g * g
    w = weights(z, n)
    return np.append(BIAS, names[w > 0]), np.append(prior + shift(z0, n0), w[w > 0])


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights learnt from rows of ``labels`` (doc_id, toxic) whose crc32(doc_id as text) mod 5 is not 0.

    A doc_id with several labels counts as toxic if one says so; one with several texts gives that of
    smallest hash. Null ids and labels are left out; without any row the weights are empty
    and every score is 0. Of the sample, rows are taken in order of that hash until SAMPLE_FEATURES are reached.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    chosen = chosen.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            owner, found = features(part.column("text"))
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], np.arange(part.num_rows), side="right")
            sets = [np.unique(x) for x in np.split(found[order], ends[:-1])]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)], dtype=np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([len(x) for x in sets], pa.int64()), lists], ["doc_id", "label", "n", "features"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            flat, ends = batch.column("features").flatten().to_numpy().view(np.uint64), np.cumsum(pc.list_value_length(batch.column("features")).to_numpy())
            rows += zip(np.split(flat, ends[:-1]), batch.column("label").to_pylist(), strict=True)
        names, weights = train(rows)
        flat = batch = None
        rows.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(weights)], ["feature", "weight"])

    order = Window.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sample = texts.mapInArrow(extract, "doc_id long, label int, n long, features array<long>")
    sample = sample.withColumn("before", before).where(F.col("before") + F.col("n") <= SAMPLE_FEATURES).select("label", "features")
    model = sample.mapInArrow(fit, "feature long, weight double").toPandas()
    names = model["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], model["weight"].to_numpy(float)[order]


class Scorer:
    def __init__(self, names: np.ndarray, weights: np.ndarray):
        self.names, self.weights = names, weights
        self.bias = float(weights[names == BIAS].sum()) + SHIFT if len(names) else -35.0
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(names >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Probability that a text is toxic; a text without words gets the bias alone."""
        owner, found = features(texts)
        at = np.flatnonzero(self.maybe[(found >> np.uint64(42)).astype(np.int64)])
        total = np.full(len(texts), self.bias)
        if len(at):
            k = np.minimum(np.searchsorted(self.names, found[at]), len(self.names) - 1)
            at, k = at[self.names[k] == found[at]], k[self.names[k] == found[at]]
            once = np.unique(np.stack([owner[at], k]), axis=1)
            np.add.at(total, once[0], self.weights[once[1]])
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def toxicity_score(docs: DataFrame, labels: DataFrame) -> Callable[[Column], Column]:
    """Learns from ``docs`` and ``labels``; the result scores a text column."""
    model, held = docs.sparkSession.sparkContext.broadcast(learn(docs, labels)), {}

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if "scorer" not in held:
            held["scorer"] = Scorer(*model.value)
        for part in parts:
            texts = pa.RecordBatch.from_arrays([part], ["text"])
            yield pa.array(np.concatenate([np.empty(0), *(held["scorer"](x.column(0)) for x in slices(iter([texts]), "text"))]))

    return score


def with_toxicity(docs: DataFrame, labels: DataFrame, column: str = "toxicity") -> DataFrame:
    """``docs`` with all its columns and the score in ``column`` (which replaces one of that name).

    Scores depend on the text alone. A null text scores as an empty one; repeated rows score alike.
    """
    docs = docs.drop(column)
    return docs.withColumn(column, toxicity_score(docs, labels)(F.col("text")))


def without_toxicity(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with their columns whatever these are called, that score under ``most``."""
    return docs.where(toxicity_score(docs, labels)(F.col("text")) < most)
