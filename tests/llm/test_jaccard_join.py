import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagefacts.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {(d, len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}


def got(df, **how):
    return {tuple(r) for r in J.jaccard_components(df, **how).select("doc_id", "n_shingles", "component_id").collect()}


def made(seed, docs=150):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice((3, 5, 7, 9, 14, 18, 30, 60, 200)))] for _ in range(25)]
    rows = []
    for i in range(docs):
        words = list(r.choice(bases)) if r.random() < 0.7 else [r.choice(vocabulary) for _ in range(r.choice((2, 9, 40)))]
        for _ in range(r.choice((0, 0, 1, 2, 4))):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        if r.random() < 0.4:
            words[len(words) // 2 : len(words) // 2] = passage
        rows.append((i * 3, r.choice((" ", "\n", "  ")).join(words).title()))
    return rows


@pytest.mark.parametrize(("seed", "frequent", "very"), [(1, 16, 4096), (2, 3, 8)])
def test_equals_brute_force(spark, seed, frequent, very):
    rows = made(seed)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), frequent=frequent, very_frequent=very) == brute(rows)


def test_hot_signatures_meet_block_by_block(spark, monkeypatch):
    """300 texts of one template, of which only some link: signatures with many components, in blocks of 7 members."""
    monkeypatch.setattr(J, "BLOCK_MEMBERS", 7)
    r = random.Random(11)
    template, rows = [f"t{i}" for i in range(90)], []
    for i in range(300):
        words = list(template)
        at = r.randrange(60)
        words[at : at + r.choice((14, 20, 26))] = [f"u{r.randrange(40)}x{i % 60}" for _ in range(r.randrange(10, 40))]
        rows.append((i, " ".join(words)))
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), frequent=8, very_frequent=40) == brute(rows)


def test_signatures_of_links_meet():
    r = np.random.default_rng(5)
    tokens = np.unique(r.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2))
    df = dict(zip(tokens.tolist(), r.choice([2, 5, 30, 900], len(tokens)).tolist(), strict=True))
    sign = J.Signatures(75, 5, 30)

    def signs(x, unshared):
        return set(sign.of(len(x) + unshared, x, np.array([df[t] for t in x.tolist()], np.int64)).tolist())

    for n in [*range(1, 80), 100, 255, 256, 400, 900]:
        for lost in range(5):
            keep = -(-3 * n // 4)
            x = np.sort(r.choice(tokens, n, replace=False))
            lost = min(lost, n - keep)
            assert signs(x[lost:] if lost else x, lost) & signs(np.sort(x[lost:][r.permutation(n - lost)[:keep]]), 0)


def test_parity_bounds_the_difference():
    r = np.random.default_rng(3)
    for n in (3, 200, 2000):
        x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[n // 3 :], r.integers(0, 2**63, n // 4, dtype=np.uint64)]))
        apart = sum(int(a ^ b).bit_count() for a, b in zip(J._parity(x).tolist(), J._parity(y).tolist(), strict=True))
        assert len(J._parity(x)) == J.PARITY and 0 < apart <= len(set(x.tolist()) ^ set(y.tolist()))


def test_nulls_empty_tables_and_clashing_columns(spark):
    schema = "doc_id long, text string, rep long, sign string"
    rows = [(1, None, 1, ""), (2, "", 1, ""), (3, "one two", 1, ""), (None, "One  two", 1, ""), (3, "one two", 2, ""), (9, "É é x y z " * 2000, 1, None)]
    out = J.jaccard_components(spark.createDataFrame(rows, schema)).orderBy("doc_id").collect()
    assert [tuple(r)[:3] for r in out] == [(None, 1, 3), (1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (9, 5, 9)]
    assert J.jaccard_components(spark.createDataFrame([], schema)).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 3000)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(docs) == brute(rows)
