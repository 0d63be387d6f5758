import random
import tracemalloc

import numpy as np

from pagefacts.llm import decontamination as D

SCHEMA = "doc_id long, text string, score string, item_id int"


def slow_align(item, passage):
    best, table = 0, [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (D.MATCH if a == b else D.MISMATCH), table[i - 1][j] + D.GAP, table[i][j - 1] + D.GAP)
            best = max(best, table[i][j])
    return best


def test_alignment_equals_the_plain_table():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randrange(1, 20))] for _ in range(2))
        score, lo, hi, x, y = D.align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == slow_align(a, b) == slow_align(a[x:y], b[lo:hi])


def made():
    r = random.Random(7)
    vocabulary = [f"v{i}" for i in range(800)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(r.choice((16, 25, 40))))) for i in range(12)] + [(90, None), (91, "two words"), (92, "")]
    items.append((99, items[0][1]))
    docs, leaks = [], set()
    for d in range(150):
        words = text(r.choice((3, 60, 200)))
        if d % 5 == 0:
            i = r.randrange(12)
            copy = items[i][1].split()
            if d % 10 == 0:
                for _ in range(len(copy) // 8):
                    copy[r.randrange(len(copy))] = "other"
            words[len(words) // 2 : len(words) // 2] = copy
            leaks |= {(d, i)} | ({(d, 99)} if i == 0 else set())
        docs.append((d, " ".join(words).upper(), "x", 0))
    return docs, items, leaks


def test_copies_and_clean_documents(spark):
    docs, items, leaks = made()
    odd = [(1000, None, "x", 0), (1001, "", "x", 0), (None, items[3][1], "x", 0), (1002, "filler " * 60_000 + items[4][1], "x", 0), (1002, "plain", "x", 0)]
    df, bench = spark.createDataFrame(docs + odd, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    out = D.benchmark_copies(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == leaks | {(None, 3), (1002, 4)}
    texts, wanted = {d: t for d, t, _, _ in docs}, dict(items)
    for r in out:
        if r.doc_id in texts and r.score == 1:
            assert texts[r.doc_id].lower().split()[r.doc_from : r.doc_to] == wanted[r.item_id].split()
    kept = D.without_copies(df, bench)
    assert kept.schema == df.schema
    gone = {d for d, _ in leaks} | {1002}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([d for d, *_ in docs + odd[:2] if d not in gone] + [1002], key=str)


def test_blocks_and_empty_tables(spark, monkeypatch):
    docs, items, leaks = made()
    monkeypatch.setattr(D, "BLOCK_WORDS", 60)
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.benchmark_copies(df, bench).collect()} == leaks
    assert D.benchmark_copies(df, bench.limit(0)).count() == 0 and D.without_copies(df, bench.limit(0)).count() == len(docs)
    assert D.benchmark_copies(df.limit(0), bench).count() == 0


def test_hot_item_equals_brute_force(spark):
    r = random.Random(5)
    text = lambda n: [f"v{r.randrange(3000)}" for _ in range(n)]
    items = [text(40), text(40), text(3)]
    docs = []
    for d in range(600):
        copy = list(items[0]) if d % 10 == 0 else items[0][16:] if d % 10 == 1 else items[2] if d % 10 == 2 else items[1][:20] if d % 97 == 3 else []
        if d % 20 == 11:
            copy = list(items[0][10:])
            copy[6::7] = ["other"] * len(copy[6::7])
        words = text(60)
        words[30:30] = copy
        docs.append((d, words))
    number = {w: i for i, w in enumerate(sorted({w for x in [*items, *(w for _, w in docs)] for w in x}))}
    coded = lambda words: np.array([number[w] for w in words], np.uint64)
    whole = lambda i, w: len(items[i]) >= D.SEED or " ".join(items[i]) in " ".join(w)
    want = {(d, i) for d, w in docs for i, x in enumerate(items) if D.align(coded(x), coded(w))[0] >= D.LEAST_SCORE * D.MATCH * len(x) and whole(i, w)}
    assert sum(i == 0 for _, i in want) == 120 and sum(i == 2 for _, i in want) == 60
    df, bench = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in D.benchmark_copies(df, bench).collect()} == want
    assert {x.doc_id for x in D.without_copies(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_long_items_need_little_memory():
    r = np.random.default_rng(3)
    item = r.integers(0, 2**62, 10_000).astype(np.uint64)
    passage = np.concatenate([r.integers(0, 2**62, 4000).astype(np.uint64), item[1000:9000], r.integers(0, 2**62, 4000).astype(np.uint64)])
    tracemalloc.start()
    assert D.align(item, passage) == (16_000, 4000, 12_000, 1000, 9000)
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def test_edited_copies_are_found(spark):
    """Copies with a tenth of their words replaced, left out or added: nine in ten at least are found."""
    r = random.Random(17)
    text = lambda n: [f"v{r.randrange(5000)}" for _ in range(n)]
    items = [text(r.choice((20, 30, 60))) for _ in range(100)]
    docs = []
    for d in range(400):
        copy = []
        for w in items[d % 100] if d < 200 else text(40):
            what = r.random()
            copy += [w] if what > 0.1 else [] if what > 0.066 else ["new"] if what > 0.033 else [w, "more"]
        docs.append((d, " ".join(text(50) + copy + text(50))))
    found = {(x.doc_id, x.item_id) for x in D.benchmark_copies(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()}
    assert len(found & {(d, d % 100) for d in range(200)}) >= 180 and not found - {(d, d % 100) for d in range(200)}


def found_in(item, passage):
    """Is the item found in the passage with other words around it?"""
    seeds = D.Seeds([0], [item])
    words = np.concatenate([np.arange(10_000, 10_040, dtype=np.uint64), passage, np.arange(20_000, 20_040, dtype=np.uint64)])
    hits = [D.seed_hashes(words, p) for p in seeds.patterns]
    at, k = (np.concatenate(x) for x in zip(*(seeds.found(h) for h in hits), strict=True))
    return bool(len(at)) and bool(list(seeds.copies(words, at, k)))


def edited(item, change):
    """``change`` gives what stands in place of word i."""
    return np.array([w for i, word in enumerate(item.tolist()) for w in change(i, word)], np.uint64)


def test_regular_edits_are_found():
    other = 5_000_000
    edits = {
        "every fourth replaced": lambda i, w: [other + i] if i % 4 == 3 else [w], "every third replaced": lambda i, w: [other + i] if i % 3 == 2 else [w], "two of six replaced": lambda i, w: [other + i] if i % 6 in (1, 5) else [w],
        "one in after three": lambda i, w: [w, other + i] if i % 3 == 2 else [w], "one in after two": lambda i, w: [w, other + i] if i % 2 else [w], "every fourth left out": lambda i, w: [] if i % 4 == 3 else [w], "every third left out": lambda i, w: [] if i % 3 == 2 else [w],
    }
    for length in (16, 40, 120):
        item = np.arange(1, length + 1, dtype=np.uint64) * np.uint64(977)
        for name, change in edits.items():
            passage = edited(item, change)
            assert D.align(item, passage)[0] >= D.LEAST_SCORE * D.MATCH * length and found_in(item, passage), (name, length)


def test_recall_of_edited_copies():
    """Against the alignment of all pairs, at 10 to 40 % of words replaced, put in or left out."""
    r, total, missed = random.Random(11), 0, 0
    for trial in range(1200):
        item = np.array([r.randrange(1, 1 << 40) for _ in range(r.choice((20, 40, 80)))], np.uint64)
        rate = (0.1, 0.2, 0.3, 0.4)[trial % 4]

        def change(i, w, rate=rate):
            return [w] if r.random() >= rate else r.choice([[r.randrange(1 << 41, 1 << 42)], [w, r.randrange(1 << 41, 1 << 42)], []])

        passage = edited(item, change)
        if D.align(item, passage)[0] >= D.LEAST_SCORE * D.MATCH * len(item):
            total += 1
            missed += not found_in(item, passage)
    assert total > 800 and missed <= 0.01 * total
