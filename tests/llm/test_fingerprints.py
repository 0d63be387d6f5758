import hashlib
import re
import time

from pyspark.sql import functions as F

from pagefacts.llm import fingerprints as P

SCHEMA = "doc_id long, text string, own string, cell int"


def edited(rows):
    """(doc_id, n_chars, edited text) in order, the plain way."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for i, (d, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(text) // 4
        out.append((d, len(text), text[: len(text) - q] + after[:q]))
    return out


def check(spark, rows, parts=None):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    out = {r.doc_id: r for r in P.fingerprints(df.repartition(parts) if parts else df).collect()}
    for d, n, text in edited(rows):
        assert out[d].n_chars == n and out[d].edited_sha256 == hashlib.sha256(text.encode()).hexdigest(), d
        assert 0 <= out[d].near_edited <= 1 and 0 <= out[d].near_next <= 1
    return out


def test_edited_texts_and_odd_rows(spark):
    rows = [(5, None), (1, ""), (9, "héllo wörld 😀😀😀😀 " * 40), (2, " \n "), (40_000, "one"), (-3, "a b c d e f g h"), (7, "x " * 30_000), (None, "last one of all")]
    out = check(spark, rows, 4)
    assert out[1].fingerprint == out[5].fingerprint and out[1].near_edited == 1.0


def test_one_document_and_no_document(spark):
    out = check(spark, [(3, "just this one text")])
    assert out[3].near_next == 1.0
    assert P.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_texts_and_order(spark):
    words = [f"w{i % 97}x{i % 31}" for i in range(400)]
    same, swapped = " ".join(words), " ".join(words[200:] + words[:200])
    out = check(spark, [(1, same), (2, same), (3, swapped), (4, " ".join(f"z{i}" for i in range(300)))])
    assert out[1].fingerprint == out[2].fingerprint and out[1].near_next == 1.0
    assert out[2].near_next < 0.98 and out[3].near_next < 0.05


def plain_fingerprint(spark, text):
    """Signatures by the definition: k-mers, occurrence numbers, bins, two smallest in text order."""
    words = [w for w in re.split("[\x20\t-\r]+", text) if w]
    h = lambda *xs: spark.sql(f"select {', '.join(f'xxhash64({a})' for a in xs)}").first()
    quoted = [f"'{a}', '{b}'" if b else f"'{a}', cast(null as string)" for a, b in zip(words, words[1:] + [None], strict=True)]
    upper = lambda x: x & (-1 << P.PLACE)
    kmers = [upper(x) for x in h(*quoted)] if words else []
    seen, items = {}, []
    for i, k in enumerate(kmers):
        items.append((k, seen.setdefault(k, 0), i))
        seen[k] += 1
    marks = [upper(x) for x in h(*(f"{k}L, {n}L" for k, n, _ in items))] if items else []
    bins = {}
    for (_, _, i), m in zip(items, marks, strict=True):
        bins.setdefault((m % 2**64) >> 58, []).append((m, i))
    out = ["...."] * P.BINS
    for b, found in bins.items():
        pair = [m for m, _ in sorted(sorted(found)[:2], key=lambda x: x[1])]
        out[b] = f"{(h(', '.join(f'{m}L' for m in pair))[0] % 2**64) >> 48:04x}"
    return "".join(out)


def test_signatures_by_definition(spark):
    texts = ["a b a b a b c a b", "only", "so " * 40 + "la so " * 30, " ".join(f"w{i * i % 53}" for i in range(150)), " ".join(f"v{i}" for i in range(500))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.f for r in df.select("i", P.as_text(P.order_minhash(F.col("text"))).alias("f")).collect()}
    assert got == {i: plain_fingerprint(spark, t) for i, t in enumerate(texts)}


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = check(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 3)
    far = [r for r in out.values() if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in far) > 0.95 * len(far)


def test_repeated_and_missing_ids(spark):
    """Ids that hold many rows are parted by their texts' hashes; each text still meets the next one."""
    rows = [(5, f"five {i} words in here {i * 7}") for i in range(300)] + [(None, f"no id at all {i}") for i in range(300)] + [(i, f"text number {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [(r.doc_id, r.text) for r in df.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).collect()]
    want = []
    for i, (d, text) in enumerate(order):
        after, q = order[(i + 1) % len(order)][1], len(text) // 4
        want.append((d, hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()))
    got = [(r.doc_id, r.edited_sha256) for r in P.fingerprints(df.repartition(5)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_time_grows_with_the_text(spark):
    def seconds(n):
        df = spark.createDataFrame([(" ".join(f"w{i * i % 15}" for i in range(n)),)], "text string")
        began = time.monotonic()
        df.select(P.as_text(P.order_minhash(F.col("text")))).collect()
        return time.monotonic() - began

    seconds(1000)
    assert seconds(40_000) < 4 * seconds(20_000) + 1


def test_order_and_edits_change_the_likeness(spark):
    words = [f"w{i}" for i in range(1000)]
    few = [w if i % 50 else "x" for i, w in enumerate(words)]
    many = [w if i % 5 else f"y{i}" for i, w in enumerate(words)]
    out = check(spark, [(1, " ".join(words)), (2, " ".join(few)), (3, " ".join(words)), (4, " ".join(many)), (5, " ".join(words)), (6, " ".join(reversed(words)))])
    assert out[1].near_next > 0.8 > out[3].near_next > out[5].near_next
