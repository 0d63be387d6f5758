"""Operator 13: hard negatives by an inverted multi-index.

Each half of the vectors has a codebook; a pair of codes is a cell. For an anchor q and a code c with
radius R (the farthest half-vector of that code), q.c + |q| R bounds the score of any half-vector of the
code, and the sum of two such bounds that of any row of a cell. A heap visits an anchor's cells in
falling order of that sum: first as many as hold FIRST_ROWS rows, then all whose bound still reaches
the weakest row that the anchor would keep. What is left out is proven to be too low, so results
are exact whatever the codebooks.

Rows are dealt to slabs of about SLAB_ROWS rows, a large cell to several and small cells together, and
anchors to blocks; a task scores one block against one slab. Nothing larger than a slab, a block or the
table of cells is held in one place.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, sized_hint

#: Codes of a half; rows with the smallest hash of vec_id that the codebooks are fitted on; rounds of that fit.
CODES, SAMPLE_ROWS, FIT_ROUNDS = 32, 16_384, 10
#: Rows of a slab and anchors of a block, about; rows that an anchor's first visit covers at least.
SLAB_ROWS, BLOCK_ROWS, FIRST_ROWS = 2048, 512, 2048
#: Components of a vector lie within this bound; farther ones are taken to be at it.
MOST = 1 << 27
_FOUND = "anchor_id long, slot int, vec_id long, score long"


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vector (floor(scale * x) of each component as a double).

    Rows with a null vec_id, label or vector, or with a null or non-finite component take no part. Of
    rows that share a vec_id the least (label, vector) counts. Other columns are ignored.
    """
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-MOST)), F.lit(MOST))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fine))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), F.transform("embedding", whole).alias("vector")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v.label", "v.vector")


def _matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; short ones end in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a and b; doubles are exact while sums stay below 2^53."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _nearest(x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest code of each row, and its distance."""
    code = ((codes**2).sum(1) - 2 * (x @ codes.T)).argmin(1)
    return code, np.sqrt(((x - codes[code]) ** 2).sum(1))


def _codebook(x: np.ndarray) -> np.ndarray:
    """Lloyd's rounds from the first distinct rows of the sample."""
    if not x.size:
        return np.zeros((1, x.shape[1]))
    codes = np.unique(x, axis=0)
    codes = codes[np.linspace(0, len(codes) - 1, min(CODES, len(codes))).astype(int)]
    for _ in range(FIT_ROUNDS):
        code, _ = _nearest(x, codes)
        count = np.bincount(code, minlength=len(codes))
        sums = np.stack([np.bincount(code, x[:, d], len(codes)) for d in range(x.shape[1])], 1)
        codes = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], codes)
    return codes


def _layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First slab of each cell, and how many it has; small neighbours share one."""
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // SLAB_ROWS))
    slab = used = 0
    for cell in np.flatnonzero(sizes):
        if used and used + sizes[cell] > SLAB_ROWS:
            slab, used = slab + 1, 0
        first[cell] = slab
        used += sizes[cell]
        if parts[cell] > 1:
            slab, used = slab + int(parts[cell]), 0
    return first, parts


@dataclass
class Index:
    """Codebooks, radii, rows and slabs of the cells: at most CODES^2 entries."""

    width: int
    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    sizes: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    first_rows: int

    def bounds(self, anchor: np.ndarray) -> list[np.ndarray]:
        """For each half, the most that a half-vector of each code can score; a little more for rounding."""
        half = (self.width + 1) // 2
        out = []
        for q, codes, radius in zip((anchor[:half], anchor[half:]), self.books, self.radii, strict=True):
            exact = codes @ q + np.sqrt((q**2).sum()) * radius
            out.append(exact + 1e-9 * (np.abs(exact) + np.abs(codes) @ np.abs(q)) + 1e-3)
        return out

    def visits(self, anchor: np.ndarray) -> Iterator[tuple[float, int]]:
        """Cells that have rows, in falling order of their bounds, from a heap over the two sorted halves."""
        one, two = self.bounds(anchor.astype(np.float64))
        a, b = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
        heap = [(-(one[a[0]] + two[b[0]]), 0, 0)]
        while heap:
            low, i, j = heapq.heappop(heap)
            cell = int(a[i]) * len(b) + int(b[j])
            if self.sizes[cell]:
                yield -low, cell
            if j + 1 < len(b):
                heapq.heappush(heap, (-(one[a[i]] + two[b[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(one[a[i + 1]] + two[b[0]]), i + 1, 0))

    def chosen(self, anchor: np.ndarray, floor: float, later: bool) -> Iterator[int]:
        """Cells of an anchor's first visit, or those after it; none whose bound is below ``floor``."""
        rows = 0
        for bound, cell in self.visits(anchor):
            if bound < floor or rows >= self.first_rows and not later:
                return
            if rows >= self.first_rows or not later:
                yield cell
            rows += int(self.sizes[cell])


def build_index(rows: DataFrame) -> tuple[DataFrame, Index]:
    """The rows with ``cell`` and ``slab``, written to the shared folder, and the index over all of them."""
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    order = F.xxhash64("vec_id", F.lit(13))
    sample = rows.orderBy(order, "vec_id").limit(SAMPLE_ROWS).select("vector").toArrow().column(0)
    x, half = _matrix(sample, width).astype(np.float64), (width + 1) // 2
    books = (_codebook(x[:, :half]), _codebook(x[:, half:]))
    codes = len(books[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), width).astype(np.float64)
            (a, far_a), (b, far_b) = _nearest(x[:, :half], books[0]), _nearest(x[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a * codes + b), pa.array(far_a), pa.array(far_b)], [*batch.schema.names, "cell", "far_a", "far_b"])

    placed = materialize(rows.select("vec_id", "label", "vector").mapInArrow(place, "vec_id long, label long, vector array<long>, cell long, far_a double, far_b double"), "cells")
    sizes, radii = np.zeros(len(books[0]) * codes, np.int64), (np.zeros(len(books[0])), np.zeros(codes))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far_a").alias("a"), F.max("far_b").alias("b")).collect():  # CODES^2 rows at most
        sizes[r.cell] = r.n
        radii[0][r.cell // codes], radii[1][r.cell % codes] = max(radii[0][r.cell // codes], r.a), max(radii[1][r.cell % codes], r.b)
    index = Index(width, books, radii, sizes, *_layout(sizes), FIRST_ROWS)
    places = rows.sparkSession.createDataFrame([(int(c), int(index.first[c]), int(index.parts[c])) for c in np.flatnonzero(sizes)] or [(0, 0, 1)], "cell long, first long, parts long")
    dealt = placed.join(F.broadcast(places), "cell").withColumn("slab", F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts"))
    return materialize(dealt.select("vec_id", "label", "vector", "cell", "slab"), "slabs"), index


def _best(score: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of each row's n highest allowed scores, earlier columns first among equals."""
    low = np.iinfo(np.int64).min
    held = np.where(allowed, score, low)
    least = np.partition(held, -n, axis=1)[:, -n] if held.shape[1] > n else np.full(len(held), low)
    row, column = np.nonzero(allowed & (held >= least[:, None]))
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < n], column[rank < n]


def _search(anchors: DataFrame, slabs: DataFrame, index: Index, later: bool, n: int, low: int, high: int) -> DataFrame:
    """anchor_id, slot, vec_id, score: the best of each slab that an anchor visits. An anchor with null ``windows`` asks
    for rows of its label (slot -1), others for rows of other labels in the window of each positive's score."""
    kept = slabs.sparkSession.sparkContext.broadcast(index)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = kept.value
        for batch in batches:
            vectors = _matrix(batch.column("vector"), at.width)
            for k, floor in enumerate(batch.column("floor").to_pylist()):
                asked: dict[int, list[int]] = {}
                for cell in at.chosen(vectors[k], -np.inf if floor is None else floor, later):
                    for slab in range(at.first[cell], at.first[cell] + at.parts[cell]):
                        asked.setdefault(slab, []).append(cell)
                if asked:
                    same = batch.slice(k, 1).take(pa.array([0] * len(asked)))
                    yield pa.RecordBatch.from_arrays([pa.array(list(asked), pa.int64()), pa.array(list(asked.values()), pa.list_(pa.int64())), *(same.column(c) for c in ("block", "vec_id", "label", "vector", "windows"))], ["slab", "cells", "block", "vec_id", "label", "vector", "windows"])

    def score(asking: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)] for _ in range(4)]
        if asking.num_rows and rows.num_rows:
            rows, width = rows.sort_by("vec_id"), kept.value.width
            ids, labels, cells = (rows.column(c).to_numpy() for c in ("vec_id", "label", "cell"))
            own, own_label = asking.column("vec_id").to_numpy(), asking.column("label").to_numpy()
            scores = _products(_matrix(asking.column("vector"), width), _matrix(rows.column("vector"), width))
            known, code = np.unique(cells, return_inverse=True)
            seen = np.zeros((len(own), len(known)), bool)
            for k, asked in enumerate(asking.column("cells").to_pylist()):
                seen[k, np.searchsorted(known, np.intersect1d(asked, known))] = True
            seen = seen[:, code]
            same = own_label[:, None] == labels
            windows = asking.column("windows").to_pylist()
            if windows[0] is None:
                jobs = [(-1, seen & same & (own[:, None] != ids))]
            else:
                most = max(map(len, windows))
                edge = np.array([[*w, *[-1] * (most - len(w))] for w in windows], np.int64).reshape(len(own), most)
                jobs = ((k, seen & ~same & (high * scores <= high * edge[:, k, None]) & (high * scores >= low * edge[:, k, None])) for k in range(most))
            for slot, allowed in jobs:
                a, r = _best(scores, allowed, n)
                for column, values in zip(out, (own[a], np.full(len(a), slot), ids[r], scores[a, r]), strict=True):
                    column.append(values)
        return pa.table([np.concatenate(x).astype(t) for x, t in zip(out, ("i8", "i4", "i8", "i8"), strict=True)], ["anchor_id", "slot", "vec_id", "score"])

    asked = materialize(anchors.select("block", "vec_id", "label", "vector", "windows", "floor").mapInArrow(visits, "slab long, cells array<long>, block long, vec_id long, label long, vector array<long>, windows array<long>"), "visits")
    pairs = materialize(asked.select("slab", "block").distinct(), "visited")
    rows = slabs.join(sized_hint(pairs, pairs.count()), "slab")
    return asked.groupBy("slab", "block").cogroup(rows.groupBy("slab", "block")).applyInArrow(score, _FOUND)


def _top(found: DataFrame, n: int) -> DataFrame:
    by = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def _certified(anchors: DataFrame, slabs: DataFrame, index: Index, n: int, low: int, high: int) -> DataFrame:
    """The n best of each anchor and slot over all rows: a first visit, then every cell that could still change it."""
    begun = materialize(_top(_search(anchors, slabs, index, False, n, low, high), n), "first_visit")
    full = begun.where(F.col("rank") == n).select(F.col("anchor_id").alias("vec_id"), "slot", "score")
    edges = F.expr("case when windows is null then array(named_struct('slot', -1, 'least', cast(null as double))) else "
                   f"transform(windows, (w, k) -> named_struct('slot', k, 'least', cast(w as double) * {low} / {high})) end")  # fmt: skip
    # A slot's floor: its n-th score once it has n, else its window's edge; the anchor goes on down to its lowest.
    slots = anchors.select("vec_id", F.explode(edges).alias("e")).select("vec_id", "e.slot", "e.least").join(full.hint("shuffle_hash"), ["vec_id", "slot"], "left")
    floors = slots.groupBy("vec_id").agg(F.min(F.coalesce(F.col("score").cast("double"), F.col("least"), F.lit(float("-inf")))).alias("floor"))
    again = anchors.drop("floor").join(floors.hint("shuffle_hash"), "vec_id")
    return _top(begun.drop("rank").unionByName(_search(again, slabs, index, True, n, low, high)), n)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id (unique), label, vector (integers; short vectors end in zeros), as ``integer_vectors``
    gives them; ``anchor``: which rows are anchors. Positives are an anchor's ``positives`` best other rows
    of its label; negatives the ``negatives`` best rows of other labels that score at most the positive and
    at least low/high of it, so a positive below zero has none. Equal scores go by vec_id. A label with one
    row has no positive and no result; an empty table gives none. Equal vectors are rows like others: a cell
    of them is dealt to as many slabs as it needs.
    """
    rows = materialize(rows, "vectors")
    slabs, index = build_index(rows)
    chosen = rows.where(anchor)
    blocks = max(1, -(-chosen.count() // BLOCK_ROWS))
    anchors = materialize(chosen.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks))).withColumn("windows", F.lit(None).cast("array<long>")).withColumn("floor", F.lit(None).cast("double")), "anchors")
    found = materialize(_certified(anchors, slabs, index, positives, low, high).select("anchor_id", F.col("vec_id").alias("positive_id"), (F.col("rank") - 1).alias("slot"), F.col("score").alias("positive_score")), "positives")
    windows = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x.positive_score).alias("windows"))
    lowest = F.array_min("windows").cast("double") * low / high
    asking = materialize(anchors.drop("windows", "floor").join(windows.hint("shuffle_hash"), "vec_id").withColumn("floor", lowest), "asking")
    mined = _certified(asking, slabs, index, negatives, low, high).select("anchor_id", "slot", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("rank").cast("int").alias("rank"))
    return mined.join(found.hint("shuffle_hash"), ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined_negatives(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of all rows whose vec_id is divisible by 100, at 256 steps a unit; where vec_id is divisible by 7
    the label is the next one of ten. Nulls, repeats and ties as in ``integer_vectors`` and ``hard_negatives``."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(integer_vectors(embeddings.withColumn("label", moved)), F.col("vec_id") % 100 == 0)


SQL = """
with v as (
  select vec_id, min({'label': cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint),
                      'q': [floor(256 * cast(x as double)) for x in embedding]}) as r
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
  group by vec_id),
s as (
  select a.vec_id as anchor_id, b.vec_id as other, a.r.label = b.r.label as same, cast(list_inner_product(a.r.q, b.r.q) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (
  select *, row_number() over (partition by anchor_id order by score desc, other) as k from s where same qualify k <= 5)
select p.anchor_id, p.other as positive_id, cast(row_number() over (partition by p.anchor_id, p.other order by s.score desc, s.other) as integer) as rank,
       s.other as negative_id, p.score as positive_score, s.score as negative_score
from p join s on p.anchor_id = s.anchor_id and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score
qualify rank <= 5
"""
