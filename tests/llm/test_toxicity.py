import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pagefacts.llm import toxicity as X
from pagefacts.llm.queries import op6_toxicity

SCHEMA = "doc_id long, text string, toxicity string, label int"


def test_learns_words_and_pairs(spark):
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        docs.append((i, f"the day {i % 7} was fine and we {'saw a wretch, here' if bad else 'saw a friend here'} at noon {i}", "x", 1))
        labels.append((i, int(bad)))
    odd = [(1000, None, "x", 1), (1001, "", "x", 1), (1002, "A WRETCH!!", "x", 1), (None, "calm words", "x", 1), (1002, "A WRETCH!!", "x", 1), (1003, "quiet sea " * 50_000, "x", 1)]
    df = spark.createDataFrame(docs + odd, SCHEMA)
    out = X.with_toxicity(df, spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int"))
    assert sorted(out.columns) == sorted(df.columns)
    score = {}
    for r in out.collect():
        assert 0 <= r.toxicity <= 1 and score.setdefault(r.doc_id, r.toxicity) == r.toxicity
    assert score[1000] == score[1001] < 0.5 and score[1002] > score[1003]
    assert all((score[i] >= 0.5) == (i % 4 == 0) for i in range(400))


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x", 1)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.with_toxicity(df, none).first().toxicity < 1e-9
    assert X.with_toxicity(df.limit(0), none).count() == 0


@pytest.mark.parametrize(("scale", "recall"), [("/root/testdata/sf0.01", 0.6), ("/root/testdata/sf0.1", 0.9)])
def test_held_out_rows(spark, scale, recall):
    """By the labels of held-out rows; the README has the figures."""
    out = {r.doc_id: r for r in op6_toxicity(spark, scale).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{scale}/labels.parquet").collect()}
    held = [(out[d].predicted, t) for d, t in labels.items() if out[d].held_out]
    clean, toxic = [p for p, t in held if not t], [p for p, t in held if t]
    print("held out:", sum(toxic), len(toxic), sum(clean), len(clean))
    assert sum(clean) <= 0.03 * len(clean) and sum(toxic) >= recall * len(toxic)
    insults = ("idiot", "moron", "scum", "clown", "pathetic", "worthless")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{scale}/documents.parquet").collect()}
    plain = [d for d in out if sum(w in texts[d].lower() for w in insults) >= 2]
    assert plain and sum(out[d].predicted for d in plain) >= 0.9 * len(plain)


def plain_ftrl(rows):
    """The update rule, coordinate by coordinate, over all features."""
    least = X.L1 * len(rows) ** 0.5
    toxic = sum(y for _, y in rows)
    prior = math.log((toxic + 0.5) / (len(rows) - toxic + 0.5))
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        if f == int(X.BIAS):
            return -z[f] / ((X.BETA + n[f] ** 0.5) / X.ALPHA + X.L2)
        return max(0.0, -z[f] - least - X.NOISE * n[f] ** 0.5) / ((X.BETA + n[f] ** 0.5) / X.ALPHA + X.L2)

    for _ in range(X.EPOCHS):
        for found, y in rows:
            w = {f: weight(f) for f in [*found.tolist(), int(X.BIAS)]}
            g = 1 / (1 + math.exp(-(sum(w.values()) + prior))) - y
            for f, v in w.items():
                z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / X.ALPHA * v
                n[f] += g * g
    return {f: weight(f) + (prior if f == int(X.BIAS) else 0) for f in list(z) if f == int(X.BIAS) or weight(f) > 0}


def test_training_equals_the_plain_rule():
    r = np.random.default_rng(6)
    rows = [(np.unique(np.append(r.zipf(1.4, 40) % 500 + 2, [900] if i % 3 == 0 else [])).astype(np.uint64), int(i % 3 == 0)) for i in range(120)]
    names, weights = X.train(rows)
    want = plain_ftrl(rows)
    assert set(names.tolist()) == set(want) and len(want) > 2
    assert all(abs(w - want[f]) < 1e-9 for f, w in zip(names.tolist(), weights.tolist(), strict=True))


def test_bound_of_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"plain words {i} " + ("wretch" if i % 2 else "friend")) for i in range(100)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    assert len(X.learn(docs, labels)[0]) > 1
    monkeypatch.setattr(X, "SAMPLE_FEATURES", 0)
    assert len(X.learn(docs, labels)[0]) == 0


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a wretch", "x", 0.5), (2, "fine", None, None)], "doc_id long, text string, _toxicity string, toxicity double")
    out = X.without_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert out.schema == docs.schema and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


def test_scores_equal_a_plain_sum():
    texts = ["You IDIOT, you moron!", "", None, "a b a b", "idiot idiot"]
    arrow = pa.array(texts)
    owner, found = X.features(arrow)
    weight = {int(f): 0.25 * (k % 5) for k, f in enumerate(sorted(set(found.tolist())))}
    names = np.array(sorted([int(X.BIAS), *weight]), np.uint64)
    got = X.Scorer(names, np.array([weight.get(int(f), -1.5) for f in names]))(arrow)
    for i in range(len(texts)):
        total = -1.5 + X.SHIFT + sum(weight[f] for f in {f for o, f in zip(owner.tolist(), found.tolist(), strict=True) if o == i})
        assert abs(got[i] - 1 / (1 + math.exp(-total))) < 1e-12
