"""Operator 9: substring dedup by content-defined chunks: cuts are the words of locally least gear hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix, slices

#: Words (or wide characters) on either side that a cut's hash is least among, which makes chunks of about 7; least and most bytes of a chunk.
BESIDE, LEAST, MOST = 3, 1, 256
#: Bytes of the hash that a cut is chosen by; bytes without white space after which places inside of a word count too (one in 2**BITS).
WINDOW, LONG, BITS = 8, 16, 3
#: Least bytes, or words, of neighbouring repeated chunks that are reported. A passage of 50 words loses up to a chunk and ``BESIDE`` words at either end.
LEAST_RUN, LEAST_WORDS = 160, 18
#: Least words of a passage that a document repeats within itself; most digests that are broadcast.
LEAST_WITHIN, MOST_HEAVY = 50, 200_000
GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_starts(data: np.ndarray) -> np.ndarray:
    """Whether a word starts at each byte."""
    white = (data == 32) | ((data >= 9) & (data <= 13))
    starts = ~white
    starts[1:] &= white[:-1]
    return starts


def cuts(data: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Ends of the chunks of a text's UTF-8 bytes, which never part a character. Equal words in a row are a
    chunk each, so that they match wherever the row starts."""
    size, span = len(data), 1
    hashed = GEAR[np.append(data, np.zeros(WINDOW, np.uint8))]
    while span < WINDOW:
        hashed[span:] += hashed[:-span] << np.uint64(span)
        span *= 2
    starts = word_starts(data) if starts is None else starts
    place = starts | (data >= 0xE0)
    if size > LONG:
        word = np.cumsum(starts)
        inside = (word[LONG:] == word[:-LONG]) & (hashed[WINDOW - 1 + LONG : WINDOW - 1 + size] >> np.uint64(64 - BITS) == 0)
        place[LONG:] |= inside & (data[LONG:] & 0xC0 != 0x80)
    at = np.flatnonzero(place)
    ahead, equal = hashed[at + WINDOW - 1], starts[at]
    least = np.ones(len(at), bool)
    for k in range(1, BESIDE + 1):
        least[k:] &= (ahead[k:] < ahead[:-k]) | (equal[k:] & (ahead[k:] == ahead[:-k]))
        least[:-k] &= ahead[:-k] <= ahead[k:]
    out, last = [], 0
    for end in [*at[least].tolist(), size]:
        while end - last > MOST:
            cut = last + MOST
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append(cut)
            last = cut
        if end - last >= LEAST or end == size:
            out.append(end)
            last = end
    return np.array(out[: len(out) - (len(out) > 1 and out[-1] == out[-2])], np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row", "doc_id", "tie", "from_char", "to_char", "n_bytes", "n_words", "again", "d1", "d2"]
    row = TaskContext.get().partitionId() << 36
    for part in slices(batches, "text"):
        columns, again, digests = [[] for _ in names[:7]], [], []
        for doc_id, text in zip(part.column("doc_id").to_pylist(), pc.fill_null(part.column("text"), "").cast(pa.binary()).to_pylist(), strict=True):
            row += 1
            if not text:
                continue
            data, tie = np.frombuffer(text, np.uint8), int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)
            begun = word_starts(data)
            ends = cuts(data, begun)
            starts = np.concatenate([[0], ends[:-1]])
            found = [hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            first = np.array([True, *(a != b for a, b in zip(found, found[1:], strict=False))])
            at, lengths = np.flatnonzero(first), ends - starts
            repeats = np.diff(np.append(at, len(found)))
            starts, ends = starts[first], np.append(starts[first][1:], len(text))
            chars = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
            words = np.concatenate([[0], np.cumsum(begun)])
            for column, values in zip(columns, ([row] * len(ends), [doc_id] * len(ends), [tie] * len(ends), chars[starts], chars[ends], ends - starts, words[ends] - words[starts]), strict=True):
                column.extend(values)
            seen = set()
            for k, a, size, n in zip(at.tolist(), starts.tolist(), lengths[at].tolist(), repeats.tolist(), strict=True):
                once = text[a : a + size]
                digests.append(found[k] if n == 1 else hashlib.blake2b(once * min(n, -(-LEAST_WORDS // max(1, len(once.split())))), digest_size=16).digest())
                again.append(digests[-1] in seen)
                seen.add(digests[-1])
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array(again, pa.bool_()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
        yield pa.RecordBatch.from_arrays(arrays, names)


def _met(chunks: DataFrame, keepers: DataFrame) -> DataFrame:
    """Chunks with their keepers. The digests of most copies, MOST_HEAVY at most, are broadcast, so that a digest with a
    large share of all rows is no shuffle key; the rest is shuffled."""
    sizes = {r.size: r.n for r in keepers.groupBy(F.floor(F.log2("copies")).alias("size")).agg(F.count("*").alias("n")).collect()}
    least, held = 64, 0
    for size in sorted(sizes, reverse=True):
        held += sizes[size]
        if held > MOST_HEAVY:
            break
        least = size
    heavy = keepers.where(F.floor(F.log2("copies")) >= least)
    if held <= MOST_HEAVY:
        return chunks.join(F.broadcast(keepers), ["d1", "d2"])
    rest = keepers.where(F.floor(F.log2("copies")) < least)
    light = chunks.join(F.broadcast(heavy.select("d1", "d2")), ["d1", "d2"], "left_anti").join(rest.hint("shuffle_hash"), ["d1", "d2"])
    return chunks.join(F.broadcast(heavy), ["d1", "d2"]).unionByName(light)


def repeated_passages(docs: DataFrame, least: int = LEAST_RUN, words: int = LEAST_WORDS, within: int = LEAST_WITHIN) -> DataFrame:
    """doc_id, from_char, to_char, n_bytes, n_chunks, keeper_id of each passage that is kept elsewhere.

    A chunk stays in the document of smallest doc_id that holds it (null ids come last; rows that share an id, or
    have none, are documents of their own, in order of their texts' hashes); every other document's neighbouring
    chunks of that kind form a passage, reported from ``least`` bytes or ``words`` words on with the smallest of its
    keepers. Where a document holds a chunk again that it keeps itself, neighbouring ones are a passage from ``within``
    words on, with the document as its own keeper; the first occurrence stays. Null and empty texts hold nothing;
    other columns are ignored. A chunk's copies are only counted and joined, never gathered; equal chunks in a row
    count as one, which others match that repeat it as often or ``LEAST_WORDS`` words long.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = materialize(docs.mapInArrow(_chunks, "row long, doc_id long, tie long, from_char long, to_char long, n_bytes long, n_words long, again boolean, d1 long, d2 long"), "chunks")
    plain = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count() == 0
    # Where ids tell documents apart, the least id does; the comparison of structs costs a sort.
    first = F.min("doc_id") if plain else F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "row"))
    keepers = chunks.groupBy("d1", "d2").agg(first.alias("first"), F.count("*").alias("copies")).where("copies > 1")
    keepers = materialize(keepers.select("d1", "d2", "copies", F.col("first" if plain else "first.doc_id").alias("keeper_id"), *([] if plain else [F.col("first.row").alias("keeper_row")])), "keepers")
    same = F.col("doc_id") == F.col("keeper_id") if plain else F.col("row") == F.col("keeper_row")
    met = _met(chunks, keepers).withColumn("own", same)
    gone = met.where("not own or again")  # in its keeper a chunk stays where it comes first
    order = Window.partitionBy("row", "own").orderBy("from_char")
    gone = gone.withColumn("starts", F.when(F.lag("to_char").over(order) == F.col("from_char"), 0).otherwise(1))
    gone = gone.withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = gone.groupBy("row", "own", "run").agg(F.first("doc_id").alias("doc_id"), F.min("from_char").alias("from_char"), F.max("to_char").alias("to_char"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_words").alias("n_words"), F.count("*").alias("n_chunks"), F.min("keeper_id").alias("keeper_id"))
    long_ = F.when(F.col("own"), F.col("n_words") >= within).otherwise((F.col("n_bytes") >= least) | (F.col("n_words") >= words))
    return runs.where(long_).select("doc_id", "from_char", "to_char", "n_bytes", "n_chunks", "keeper_id")


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the passages cut out of their texts; all columns stay, whatever they are called. A passage belongs to
    the rows of its doc_id, so ids must be unique; rows with a null id keep their texts."""
    spans = passages.where("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("from_char", "to_char"))).alias("spans")).hint("merge")
    met = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id")).join(spans, "doc_id", "left")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["to_char"]))
    starts = F.concat(F.transform("spans", lambda s: s["from_char"]), F.array(F.char_length("doc.text").cast("long")))
    kept = F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    text = F.array_join(F.transform(kept, lambda x: F.substring("doc.text", x["a"].cast("int") + 1, F.greatest(x["b"] - x["a"], F.lit(0)).cast("int"))), "")
    text = F.when(F.col("spans").isNull(), F.col("doc.text")).otherwise(text)
    return met.select(*((text if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
