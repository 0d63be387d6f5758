import re
from collections import defaultdict

import numpy as np
import pytest

from pagefacts.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string"


def rows(sizes):
    return [(i, " ".join(f"d{i}w{k}" for k in range(n)) if n is not None else None, "en", s, n, "x") for i, (s, n) in enumerate(sizes)]


def test_targets():
    assert M.targets({"a": 100, "b": 100, "c": 100}) == pytest.approx({"a": 187.5, "b": 75.0, "c": 37.5})
    out = M.targets({"a": 10, "b": 500, None: 90, "c": 0})
    assert out["a"] == 30 and out["c"] == 0 and sum(out.values()) == pytest.approx(600)
    assert out["b"] == pytest.approx(570 * 2 / 7) or out[None] == 270
    assert M.targets({"z": 5}) == {"z": 5.0} and M.targets({}) == {}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    for key in (0, 1, 99):
        assert sorted(M.permuted(np.arange(n), n, key).tolist()) == list(range(n))


def test_drawn_counts_are_exact():
    slots = np.array([5000, 0, 1, 700])
    drawn = M._draw(slots)
    assert (drawn.sum(axis=0) == slots).all() and (drawn.sum(axis=1)[:-1] == M.SHARD_SLOTS).all() and (drawn >= 0).all()


def test_every_slot_once():
    plan = M.Plan.of([1000, 129, 5], [2500.0, 387.0, 3.0])
    taken, places = defaultdict(int), 0
    for shard in range(len(plan.counts)):
        slots = [np.concatenate(x) for x in zip(*plan.shard(shard), strict=True)]
        assert sorted(slots[0].tolist()) == list(range(len(slots[0])))
        places += len(slots[0])
        for s, turn, block, words in zip(*[x.tolist() for x in slots[1:]], strict=True):
            taken[s, turn, block] += words
            assert 0 <= words <= M.BLOCK
    assert [sum(w for (s, _, _), w in taken.items() if s == k) for k in range(3)] == plan.quota.tolist() == [2500, 387, 3]
    assert places == len(taken)


def test_taken_words(spark):
    sizes = [("b", 700), ("a", 900), ("a", 0), ("a", None), (None, 50), ("c", 3), ("b", 1), ("c", 2000), (None, 1)] + [("a", 40)] * 30
    data = rows(sizes)
    data += [data[0], (None, "null id words here", "en", "b", 4, "x")]
    df = spark.createDataFrame(data, SCHEMA)
    out = M.taken_words(df.repartition(3)).collect()
    assert len(out) == len(data)
    by = defaultdict(lambda: [0, 0, set()])
    names = {r[0]: r[3] for r in data}
    for r in out:
        s = by[names[r.doc_id]]
        s[0], s[1] = s[0] + r.size, s[1] + r.taken
        s[2].add((r.source_size, r.target))
        assert r.taken <= 3 * r.size
    want = M.targets({k: v[0] for k, v in by.items()})
    for k, (size, taken, told) in by.items():
        assert told == {(size, want[k])} and abs(taken - want[k]) <= 1
    again = M.taken_words(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert M.taken_words(df.limit(0)).count() == 0


def test_mixed_documents(spark):
    df = spark.createDataFrame(rows([("a", 300), ("a", 500), ("b", 700), ("b", 20), ("c", 4000), (None, 10), ("a", 0)]), SCHEMA)
    taken = {r.doc_id: r.taken for r in M.taken_words(df).collect()}
    out = M.mixed_documents(df)
    assert out.schema == df.schema
    words = defaultdict(int)
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in out.collect():
        own = re.findall(r"\S+", r.text)
        assert set(own) <= set(texts[r.doc_id].split()) and len(set(own)) == len(own) and r.n_chars == len(r.text)
        words[r.doc_id] += len(own)
    assert words == {d: n for d, n in taken.items() if n}


def test_whole_table(spark, sf):
    out = M.taken_words(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    texts = {r.doc_id: len(re.findall("[^\x20\t-\r]+", r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.size for r in out} == texts
