"""Operator 7: documents that hold copies of benchmark items, edited ones too.

All word n-grams of the items are seeds; where a document holds one, the passage around it and the item
meet in a Smith-Waterman alignment, unless the passage holds too few of the item's words for the least
score. Items come to the tasks in blocks of bounded size, so a block's seeds are broadcast and no
document's text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, word_hashes

#: Words of a seed (a shorter item is one seed); words of the items in one block, which bounds what is broadcast.
SEED, BLOCK_WORDS = 4, 2_000_000
#: Places of a seed's words, in item and text alike. A copy with words replaced that still scores LEAST_SCORE lacks at most
#: a third of them; then four words stand in a row, or three and one, or two and two, with one between. As a seed is
#: its words, whatever their places, words put in or left out between them do not hide it either.
PATTERNS = [(0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 2, 4), (0, 2, 3, 4)]
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least score as a share of the item's own.
LEAST_SCORE = 0.5


def _extent(item: np.ndarray, passage: np.ndarray, local: bool) -> tuple[int, int, int]:
    """Best score and where it ends in item and passage, row by row: ``local`` alignments begin anywhere, others at
    the beginning of both. Memory is a row of the passage."""
    steps = np.arange(len(passage) + 1, dtype=np.int32) * np.int32(-GAP)
    last = np.zeros(len(passage) + 1, np.int32) if local else -steps
    best, at = 0, (0, 0)
    for i, word in enumerate(item, 1):
        now = last + GAP
        if local:
            np.maximum(now, 0, out=now)
        np.maximum(now[1:], last[:-1] + np.where(passage == word, MATCH, MISMATCH).astype(np.int32), out=now[1:])
        last = np.maximum.accumulate(now + steps) - steps
        j = int(last.argmax())
        if last[j] > best:
            best, at = int(last[j]), (i, j)
    return best, *at


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int, int]:
    """Best local alignment (Smith-Waterman): score, start and end in the passage, start and end in the item. The start
    is the end of the best alignment of what lies before the end, read backwards."""
    score, i, j = _extent(item, passage, True)
    _, back_i, back_j = _extent(item[:i][::-1], passage[:j][::-1], False)
    return score, j - back_j, j, i - back_i, i


def seed_hashes(words: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at ``places`` behind each position; the last positions have none."""
    n, count = len(places), max(0, len(words) - places[-1])
    out = np.zeros(count, np.uint64)
    for k, p in enumerate(places):
        out += words[p : p + count] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) + n) & (2**64 - 1) | 1)
    return mix(out)


def _patterns(length: int) -> list[tuple[int, ...]]:
    return [p for p in PATTERNS if p[-1] < length] if length >= SEED else [tuple(range(length))]


class Seeds:
    """Seeds of a block of items, by number, with their places in the items."""

    def __init__(self, ids: list[int], items: list[np.ndarray]):
        self.ids, self.items = ids, items
        self.lengths = np.array([len(x) for x in items], np.int64)
        self.patterns = sorted({p for n in set(self.lengths.tolist()) for p in _patterns(n)})
        seeds = [[seed_hashes(x, p) for p in _patterns(len(x))] for x in items]
        grams = [np.concatenate(x) for x in seeds]
        self.names, number = np.unique(np.concatenate([np.empty(0, np.uint64), *grams]), return_inverse=True)
        order = np.argsort(number, kind="stable")
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), [len(x) for x in grams])[order]
        self.position = np.concatenate([np.empty(0, np.int32), *(np.arange(len(g), dtype=np.int32) for x in seeds for g in x)])[order]
        self.first = np.searchsorted(number[order], np.arange(len(self.names) + 1))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.names >> np.uint64(44)).astype(np.int64)] = True

    def found(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``grams`` that are seeds, and the seeds' numbers."""
        at = np.flatnonzero(self.maybe[(grams >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.names, grams[at]), len(self.names) - 1)
        same = self.names[k] == grams[at]
        return at[same], k[same]

    def near(self, items: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Those of ``items`` of whose words the text holds enough: a score is no more than its matches give."""
        ends = np.cumsum(self.lengths[items])
        held = np.isin(np.concatenate([self.items[i] for i in items.tolist()]), words)
        return items[np.add.reduceat(held, ends - self.lengths[items], dtype=np.int64) >= LEAST_SCORE * self.lengths[items]]

    def copies(self, words: np.ndarray, at: np.ndarray, seeds: np.ndarray) -> Iterator[tuple]:
        """(item number, score, word range in the text, word range in the item) of the best passage per item."""
        n = self.first[seeds + 1] - self.first[seeds]
        place = np.repeat(self.first[seeds] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        hit, begin = self.item[place], np.repeat(at, n) - self.position[place]
        order = np.lexsort((begin, hit))
        hit, begin = hit[order], begin[order]
        for item in self.near(np.unique(hit), words).tolist():
            length, best = len(self.items[item]), None
            starts = np.unique(begin[np.searchsorted(hit, item) : np.searchsorted(hit, item, side="right")]).tolist()
            pad, k = length // 4 + 4, 0
            while k < len(starts):
                first = starts[k]
                while k + 1 < len(starts) and starts[k + 1] - first <= length:
                    k += 1
                lo, hi = max(0, first - pad), min(len(words), starts[k] + length + pad)
                k += 1
                if np.isin(self.items[item], words[lo:hi]).sum() < LEAST_SCORE * length:
                    continue
                score, a, b, c, d = align(self.items[item], words[lo:hi])
                best = max(best or (0,), (score / (MATCH * length), -(lo + a), -(lo + b), c, d))
            if best and best[0] >= LEAST_SCORE:
                yield item, best[0], -best[1], -best[2], best[3], best[4]


def _documents(part: pa.RecordBatch, seeds: Seeds) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, its words, positions, seeds) of the rows of a slice that hold seeds."""
    words, ends = word_hashes(part.column("text"))
    found = []
    for places in seeds.patterns:
        at, k = seeds.found(seed_hashes(words, places))
        row = np.searchsorted(ends, at, side="right")
        inside = at + places[-1] < ends[row] if len(at) else np.zeros(0, bool)
        found.append((at[inside], k[inside], row[inside]))
    at, k, row = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(row, kind="stable")
    at, k, row = at[order], k[order], row[order]
    for r in np.unique(row):
        lo, hi = np.searchsorted(row, r), np.searchsorted(row, r, side="right")
        start = int(ends[r - 1]) if r else 0
        yield int(r), words[start : int(ends[r])], at[lo:hi] - start, k[lo:hi]


def _blocks(benchmark: DataFrame) -> Iterator[Seeds]:
    """Items in blocks; only one block is on the driver. Items without words are left out."""
    ids, items, words = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna(subset=["text"]).toLocalIterator():
        item, _ = word_hashes(pa.array([r.text]))
        if len(item):
            ids.append(r.item_id)
            items.append(item)
            words += len(item)
        if words >= BLOCK_WORDS:
            yield Seeds(ids, items)
            ids, items, words = [], [], 0
    if items:
        yield Seeds(ids, items)


def benchmark_copies(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, doc_from, doc_to, item_from, item_to (words) of each copy found.

    ``score`` is the alignment's as a share of the item's alignment with itself; pairs of LEAST_SCORE or
    more are returned, the best passage of each. Words are lower-cased (A-Z) runs without white space.
    Null and empty texts hold nothing; equal items are found each; repeated rows give repeated results,
    with a null doc_id where it is null. An edited copy is found if four words of the item stand in it by one
    of PATTERNS; items under SEED words are found where they are whole. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    names = ["doc_id", "item_id", "score", "doc_from", "doc_to", "item_from", "item_to"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 4]
    schema = "doc_id long, item_id long, score double, doc_from long, doc_to long, item_from long, item_to long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in map(docs.sparkSession.sparkContext.broadcast, _blocks(benchmark)):

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                rows = [(part.column("doc_id")[r].as_py(), block.value.ids[i], *x) for r, words, at, k in _documents(part, block.value) for i, *x in block.value.copies(words, at, k)]
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        out = out.union(docs.mapInArrow(search, schema))
    return out


def without_copies(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no copy of an item."""
    for block in map(docs.sparkSession.sparkContext.broadcast, _blocks(benchmark)):

        def keep(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                hit = {r for r, words, at, k in _documents(part, block.value) for _ in block.value.copies(words, at, k)}
                yield part.filter(pa.array([r not in hit for r in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
