"""Operator 2: Order MinHash fingerprints of documents, in DataFrame functions only.

A k-mer is a word and the word after it. All occurrences of all k-mers are numbered and hashed with
their numbers; the hash's leading bits deal them into ``BINS`` bins (one permutation in place of
many). The two smallest of a bin, put back in text order, hash to the bin's signature. Swapped, moved
or replaced words change signatures that plain MinHash would keep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BINS = 64
#: Bits of a number that hold a place in the text.
PLACE = 24
#: Ranges of doc_id for each shuffle partition, so that hashing the ranges deals evenly; most ranges.
RANGES, MOST_RANGES = 8, 8192


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def order_minhash(text: Column) -> Column:
    """Signatures of a text: an array of BINS numbers of 16 bits, -1 for an empty bin.

    Hashes keep their upper 40 bits and carry a place in the text in the lower 24, so that one sort of plain
    numbers orders both; beyond 2**24 words places are counted in steps of 2, 4 and so on.
    """
    bits = BINS.bit_length() - 1
    upper, lower = F.lit(-1 << PLACE), F.lit((1 << PLACE) - 1)
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - bits)
    hash_of, place_of = (lambda x: x.bitwiseAND(upper)), (lambda x: x.bitwiseAND(lower))

    def placed(kmers: Column) -> Column:
        step = F.greatest(F.ceil(F.log2(F.size(kmers) + 1)).cast("int") - PLACE, F.lit(0))
        return let(step, lambda k: F.sort_array(F.transform(kmers, lambda h, i: hash_of(h).bitwiseOR(F.call_function("shiftright", i, k).cast("long")))))

    def first(all_: Column, h: Column, j: Column) -> Column:
        """Place among all sorted ones of the first that has the hash ``h``, which the one at ``j`` has, by halving."""
        start = F.struct(F.lit(0).alias("lo"), j.alias("hi"))

        def halve(s: Column, _: Column) -> Column:
            mid = F.shiftright(s["lo"] + s["hi"], 1)
            return F.when(s["lo"] >= s["hi"], s).when(F.get(all_, mid) < h, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

        return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(j + 1)).cast("int")), start, halve, lambda s: s["lo"])

    def numbered(all_: Column) -> Column:
        """Each k-mer hashed with the number of equal ones before it. Equal ones lie side by side; the first of them is
        searched for only where the one before is equal."""

        def one(x: Column, j: Column) -> Column:
            again = (j > 0) & (hash_of(F.get(all_, j - 1)) == hash_of(x))
            before = F.when(again, j - first(all_, hash_of(x), j)).otherwise(0)
            return hash_of(F.xxhash64(hash_of(x), before.cast("long"))).bitwiseOR(place_of(x))

        return F.transform(all_, one)

    def signatures(items: Column) -> Column:
        def signature(j: Column) -> Column:
            x, after = F.get(items, j), F.get(items, j + 1)
            single = after.isNull() | (bin_of(after) != bin_of(x))
            pair = F.when(single, F.xxhash64(hash_of(x))).when(place_of(x) < place_of(after), F.xxhash64(hash_of(x), hash_of(after))).otherwise(F.xxhash64(hash_of(after), hash_of(x)))
            return F.struct(bin_of(x).cast("int").alias("bin"), F.shiftrightunsigned(pair, 48).cast("int").alias("v"))

        heads = F.filter(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0))), lambda j: (F.size(items) > 0) & ((j == 0) | (bin_of(F.get(items, j - 1)) != bin_of(F.get(items, j)))))
        found = F.map_from_entries(F.transform(heads, signature))
        return let(found, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.try_element_at(m, b), F.lit(-1))))

    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    kmers = let(words, lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda x, y: F.xxhash64(x, y)))
    return let(kmers, lambda k: let(placed(k), lambda x: let(F.sort_array(numbered(x)), signatures)))


def as_text(signatures: Column) -> Column:
    """Four hexadecimal digits for each bin, dots for an empty one."""
    return F.array_join(F.transform(signatures, lambda v: F.when(v < 0, "....").otherwise(F.lpad(F.lower(F.hex(v)), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of bins with equal signatures among those that either text fills; 1 for two empty texts."""
    filled = F.zip_with(a, b, lambda x, y: F.when((x >= 0) | (y >= 0), (x == y).cast("int")))
    return let(F.array_compact(filled), lambda c: F.when(F.size(c) == 0, F.lit(1.0)).otherwise(F.size(F.filter(c, lambda v: v == 1)) / F.size(c)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (see ``op2``): doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter replaced by the beginning of the next document's text. A null
    text is empty. Documents with equal ids follow each other by a hash of their texts; null ids come
    last. Other columns are ignored. One shuffle carries the texts: documents are dealt by ranges that
    hold about as many rows each (quantiles of doc_id; an id, or null, with more rows than a range is
    parted by the hash of the text), the next document is the next row of a range, and the few last rows
    of ranges meet the head of the range after theirs. Only the heads' texts are read a second time.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cells = min(MOST_RANGES, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = F.array(*(F.lit(k / cells) for k in range(1, cells)))
    rows_, known, bounds = docs.agg(F.count("*"), F.count("doc_id"), F.percentile_approx("doc_id", shares, 10 * cells)).first()
    tie = F.xxhash64("text")
    share = tie.cast("double") / 2.0**64 + 0.5
    lower = lambda keep: F.size(F.filter(F.array(*map(F.lit, bounds)), keep)) if bounds else F.lit(0)
    lo, hi = lower(lambda b: b < F.col("doc_id")), lower(lambda b: b <= F.col("doc_id"))
    spread = max(1, cells * (rows_ - known) // max(1, rows_))
    part_of = lambda n: F.least(F.floor(share * n), n - 1).cast("int")
    cell = F.when(F.col("doc_id").isNull(), F.lit(cells) + part_of(F.lit(spread))).otherwise(let(F.struct(lo.alias("lo"), hi.alias("hi")), lambda x: x["lo"] + F.when(x["hi"] > x["lo"] + 1, part_of(x["hi"] - x["lo"])).otherwise(0)))
    placed = docs.select("doc_id", "text", cell.alias("cell"), tie.alias("tie"))

    rows = Window.partitionBy("cell").orderBy(F.col("doc_id").asc_nulls_last(), "tie")
    main = placed.select("*", order_minhash(F.col("text")).alias("own"))
    main = main.select("*", F.lead("text").over(rows).alias("after"), F.lead("own").over(rows).alias("after_own"))
    heads = placed.select("cell", "text", F.row_number().over(rows).alias("nr")).where("nr = 1").select(F.col("cell").alias("next"), F.col("text").alias("head"))
    everything = Window.orderBy("cell")
    follows = heads.select(F.col("next").alias("cell")).select("cell", F.coalesce(F.lead("cell").over(everything), F.min("cell").over(Window.partitionBy())).alias("next"))
    heads = materialize(follows.join(heads.hint("merge"), "next").select(F.col("cell").alias("of"), "head"), "heads")
    heads = heads.select("*", order_minhash(F.col("head")).alias("head_own"))
    main = main.join(heads.hint("merge"), (F.col("cell") == F.col("of")) & F.col("after").isNull(), "left")

    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    after = F.coalesce("after", "head")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(after, F.lit(1), quarter))
    main = main.select("doc_id", n.cast("long").alias("n_chars"), "own", F.coalesce("after_own", "head_own").alias("next_own"), edited.alias("edited"))
    main = main.select("*", order_minhash(F.col("edited")).alias("edited_own"))
    return main.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited_own")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_own")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
