"""Operator 1: word-shingle Jaccard self-join by token-combination prefixes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialize, mix, scratch, shingle_sets, sized_hint, slices

#: Share of all shingles, by hash, that the first count over all documents takes. It steers cost alone.
SHARE = 0.35
#: Rounds after the first leaders: the last one takes all pairs between different components of a signature.
STAR_ROUNDS = 2
#: Members of a signature in one block: larger ones meet block by block, so that no task owns a signature.
BLOCK_MEMBERS = 2_000
#: 64-bit words of a set's parity bits, first signatures that go with them, and most sets for which both are broadcast.
PARITY, FIRST_SIGNS, PARITY_ROWS = 8, 6, 60_000


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _unshared(n: int, percent: int) -> int:
    """Most shingles that a set of n may lack in a set that it links with."""
    return n - -(-percent * n // 100)


class Signatures:
    """Signatures of one shingle set, such that two sets that link share one at least.

    Shingles are ordered: those that no other candidate holds, rare ones, frequent ones, very frequent
    ones; by hash within a class. A set's prefix is extended until it covers more shingles than a linked
    set may lack. An unshared shingle covers one and needs no signature; a rare one covers one and is a
    signature; k or more shingles of one frequent class (k = 2, or 3 for very frequent) and cell (a range
    of hashes) cover all but k-1 of them, and their k-combinations are the signatures. Cells narrow with
    the size's power of two; a set also signs at the next power where a partner can have it. Sets below
    16 shingles sign by single shingles, whatever their class.
    """

    def __init__(self, percent: int, frequent: int, very_frequent: int):
        self.percent, self.frequent, self.very_frequent = percent, frequent, very_frequent

    def of(self, n: int, shared: np.ndarray, df: np.ndarray) -> np.ndarray:
        """``n``: the set's size; ``shared``: its shingles that others hold, and how many documents do."""
        order = np.argsort(shared)
        shared, df = shared[order], df[order]
        need = _unshared(n, self.percent) + 1 - (n - len(shared))
        level = n.bit_length() - 1
        levels = [level] + [level + 1] * (n * 100 >= (1 << level + 1) * self.percent)
        out = [mix(shared[: max(0, need)] ^ np.uint64(0xA5A5))] if level < 4 else []
        if levels[-1] >= 4 and need > 0:
            rare = shared[df < self.frequent]
            out.append(rare[:need])
            classes = [(2, shared[(df >= self.frequent) & (df < self.very_frequent)]), (3, shared[df >= self.very_frequent])]
            for k in levels if len(rare) < need else []:
                if k >= 4:
                    out += self._combined(classes, need - len(rare), k)
        return np.unique(np.concatenate([np.empty(0, np.uint64), *out]))

    @staticmethod
    def _combined(classes: list, need: int, level: int) -> list[np.ndarray]:
        out = []
        for k, own in classes:
            if need <= 0 or not len(own):
                continue
            cell = own >> np.uint64(64 - (level - k))
            first = np.searchsorted(cell, cell)
            covered = np.cumsum(np.arange(len(own)) - first >= k - 1)
            end = min(len(own), int(np.searchsorted(covered, need)) + 1)
            for lo in np.unique(first[:end]):
                hi = min(end, int(np.searchsorted(cell, cell[lo], side="right")))
                if hi - lo >= k:
                    picked = np.array(list(combinations(range(lo, hi), k)))
                    total = np.full(len(picked), (level << 8) + k, np.uint64)
                    for j in range(k):
                        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + own[picked[:, j]])
                    out.append(total)
            need -= int(covered[end - 1])
        return out


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)))


def _arrays(column: pa.ListArray, kind: type) -> list[np.ndarray]:
    """The lists of a column as views of its values; a null list is empty."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy().view(kind), ends[:-1])


def _read(n: int, cut: int):
    """Row number, size and digest of each document; the counted shingles of a set's first row in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, seen = TaskContext.get().partitionId() << 36, set()
        for part in slices(batches, "text"):
            rows, sizes, digests, first, counted = [], [], [], [], []
            for tokens in shingle_sets(part.column("text"), n):
                d = _digest(tokens)
                row += 1
                rows.append(row)
                sizes.append(len(tokens))
                digests.append(d)
                first.append(len(tokens) > 0 and d not in seen)
                counted.append(tokens[: np.searchsorted(tokens, np.uint64(cut))] if first[-1] else tokens[:0])
                if len(seen) < 1_000_000:
                    seen.add(d)
            d1, d2 = zip(*digests, strict=True)
            columns = [pa.array(rows, pa.int64()), part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(first), _lists(counted)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_shingles", "d1", "d2", "first", "counted"])

    return run


def _signed(sign: Signatures):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column("n").to_pylist(), _arrays(batch.column("shared"), np.uint64), _arrays(batch.column("df"), np.int64)
            signs = [sign.of(*x) for x in zip(*columns, strict=True)]
            held = pc.list_value_length(batch.column("shared")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), held, _lists(signs)], ["rep", "n", "held", "signs"])

    return run


def _parity(tokens: np.ndarray) -> np.ndarray:
    """Bits that tell of each range of hashes whether a set holds an odd number. Two sets differ by as many
    shingles at least as their bits differ."""
    odd = np.bincount((tokens >> np.uint64(64 - 6 - PARITY.bit_length() + 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _sets(n: int):
    """Digests, shingle sets and their parity bits, each set once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for part in slices(batches, "text"):
            new = []
            for tokens in shingle_sets(part.column("text"), n):
                if (d := _digest(tokens)) not in seen:
                    new.append((d, tokens))
                    if len(seen) < 1_000_000:
                        seen.add(d)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d, _ in new], pa.int64()), pa.array([d[1] for d, _ in new], pa.int64()), _lists([x for _, x in new]), _lists([_parity(x) for _, x in new])], ["d1", "d2", "tokens", "bits"])

    return run


def jaccard_components(docs: DataFrame, **how) -> DataFrame:
    """The columns of ``_components`` without the digests."""
    with scratch(docs.sparkSession):
        return materialize(_components(docs, **how).drop("d1", "d2"), "components", keep=True)


def _components(docs: DataFrame, n: int = 5, percent: int = 75, frequent: int = 16, very_frequent: int = 4096) -> DataFrame:
    """doc_id, n_shingles, component_id and class_size (documents with the same shingle set), d1, d2 (digest of that set) of each row.

    Rows link when their sets of n-word shingles have Jaccard ``percent``/100 or more; component_id is
    the smallest doc_id of a component. No text, a null text or one without words has no shingles and
    links with nothing. Rows with one doc_id are separate rows; a null doc_id gives a row whose
    component_id is the smallest doc_id of its component, or null. Other columns are ignored.

    Links are exact up to equality of 64-bit shingle hashes. Equal sets become one class. Documents
    that hold more unshared shingles than a link allows are done: first by the share of all shingles
    that is counted over all documents, then, among those left, by all their shingles. The rest sign.
    Each signature's members are verified against a leader, then (where a signature still spans several
    components) against other leaders, at last against every member of another component. A pair is
    verified only if the shingles that each shares with anyone suffice for a link.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    lacking = F.col("n") - F.ceil(F.col("n") * percent / 100)
    read = materialize(docs.mapInArrow(_read(n, int(SHARE * 2**64)), "row long, doc_id long, n_shingles long, d1 long, d2 long, first boolean, counted array<long>"), "read")
    rows = read.where("n_shingles > 0")
    classes = materialize(rows.groupBy("d1", "d2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), F.count("*").alias("class_size")), "classes")

    spread = rows.where("first").select("row", F.explode("counted").alias("token"))
    common = spread.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    held = spread.join(common.hint("shuffle_hash"), "token").groupBy("row").agg(F.count("*").alias("held"))
    sized = rows.where("first").select("row", F.size("counted").alias("counted")).join(classes.select(F.col("rep").alias("row"), "n", "d1", "d2").hint("merge"), "row")
    able = sized.join(held.hint("merge"), "row", "left").where(F.col("counted") - F.coalesce("held", F.lit(0)) <= lacking)
    able = materialize(able.select(F.col("row").alias("rep"), "n", "d1", "d2"), "able")
    sets = docs.select("text").mapInArrow(_sets(n), "d1 long, d2 long, tokens array<long>, bits array<long>").join(sized_hint(able, able.count()), ["d1", "d2"])
    sets = materialize(sets.select("rep", "n", "tokens", "bits").dropDuplicates(["rep"]), "sets")

    spread = sets.select("rep", "n", F.explode("tokens").alias("token"))
    common = spread.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = spread.join(common.hint("shuffle_hash"), "token").groupBy("rep", "n").agg(F.collect_list("token").alias("shared"), F.collect_list("df").alias("df")).where(F.col("n") - F.size("shared") <= lacking)
    signed = materialize(shared.mapInArrow(_signed(Signatures(percent, frequent, very_frequent)), "rep long, n long, held long, signs array<long>"), "signed")
    spread = signed.select("rep", "n", "held", F.explode("signs").alias("sign"))
    lead = spread.groupBy("sign").agg(F.count("*").alias("members"), F.min("rep").alias("y")).where("members > 1").select("sign", "y")
    members = materialize(spread.join(lead.hint("shuffle_hash"), "sign"), "members")
    sizes = signed.select(F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("held").alias("hy")).hint("merge")
    pairs = members.where("rep != y").select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("held").alias("hx"), "y").distinct().join(sizes, "y")
    done = _verified(_fitting(pairs, percent), sets, percent)
    for turn in range(1, STAR_ROUNDS + 1):
        labels = materialize(components(done.where("linked"), "x", "y"), "labels")
        members = _unresolved(members, labels)
        if not members.head(1):
            break
        mine = members.select("sign", "label", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("held").alias("hx"))
        if turn < STAR_ROUNDS:
            lead = members.groupBy("sign").agg(F.min_by(F.struct("rep", "n", "held", "label"), F.xxhash64("rep", F.lit(turn))).alias("lead"))
            pairs = mine.join(lead.hint("shuffle_hash"), "sign").where("label != lead.label").select("*", F.col("lead.rep").alias("y"), F.col("lead.n").alias("ny"), F.col("lead.held").alias("hy"))
        else:
            pairs = _across(members, sets, signed, percent)
        new = _fitting(pairs, percent).join(done.select("x", "y").hint("merge"), ["x", "y"], "left_anti")
        done = materialize(done.union(_verified(new, sets, percent)), "links")
    labels = components(done.where("linked"), "x", "y")
    named = classes.join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    low = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = materialize(named.join(low.hint("shuffle_hash"), "component").select("d1", "d2", "component_id", "class_size"), "named")
    out = rows.select("doc_id", "n_shingles", "d1", "d2").join(named.hint("merge"), ["d1", "d2"]).select("doc_id", "n_shingles", "component_id", "class_size", "d1", "d2")
    return out.union(read.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size"), "d1", "d2"))


def _across(members: DataFrame, sets: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs between the components of a signature, without those whose sizes, shared shingles or parity
    bits rule out a link. A pair whose sets have first signatures in common comes at the least of them only.

    A signature's members are dealt into blocks by hash, and each pair of blocks is a key of its own; sets meet only
    where their sizes' steps (each a third above the last) are equal or next to each other, as sizes of linked sets are."""
    reps = members.select("rep").distinct()
    count = reps.count()
    known = reps.hint("merge").join(sets.select("rep", "bits"), "rep").join(signed.select("rep", F.slice("signs", 1, FIRST_SIGNS).alias("signs")).hint("merge"), "rep")
    rows = members.join(sized_hint(materialize(known, "parity"), count, PARITY_ROWS), "rep")
    rows = rows.join(members.groupBy("sign").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("blocks")).hint("shuffle_hash"), "sign")
    step = F.floor(F.log(F.col("n")) / math.log(100 / percent * (1 + 1e-9))).cast("long")
    rows = rows.withColumns({"block": F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), "step": step})
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    side = lambda c: rows.select("sign", "block", "step", every.alias("every"), *(F.col(a).alias(f"{b}{c}") for a, b in (("rep", ""), ("n", "n"), ("held", "h"), ("label", "l"), ("bits", "b"), ("signs", "s"))))
    apart = sum((F.bit_count(F.col("bx")[i].bitwiseXOR(F.col("by")[i])) for i in range(PARITY)), F.lit(0))
    total = F.col("nx") + F.col("ny")
    fits = (F.col("lx") < F.col("ly")) & (F.least("hx", "hy") * (100 + percent) >= total * percent) & ((total - apart) * (100 + percent) >= 2 * total * percent)
    common = F.array_intersect("sx", "sy")
    once = (F.size(common) == 0) | (F.array_min(common) == F.col("sign"))
    x = side("x").withColumn("to", F.explode("every")).withColumnRenamed("block", "from")
    y = side("y").withColumn("from_y", F.explode("every")).withColumn("step_y", F.explode(F.array(*(F.col("step") + k for k in (-1, 0, 1)))))
    y = y.select(F.col("sign").alias("other"), "from_y", F.col("block").alias("to_y"), "step_y", *(f"{b}y" for b in ("", "n", "h", "l", "b", "s"))).hint("merge")
    same = (F.col("sign") == F.col("other")) & (F.col("from") == F.col("from_y")) & (F.col("to") == F.col("to_y")) & (F.col("step") == F.col("step_y"))
    return x.join(y, same & fits & once).select("x", "y", "nx", "ny", "hx", "hy")


def _fitting(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct ordered pairs of different classes whose sizes and shared shingles allow the similarity."""
    fits = pairs.where("x != y").where(F.least("hx", "hy") * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent)
    return fits.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda c: sets.select(F.col("rep").alias(c), F.col("tokens").alias(f"t{c}")).hint("merge")
    both = pairs.join(side("x"), "x").join(side("y"), "y").withColumn("common", F.size(F.array_intersect("tx", "ty")))
    linked = F.col("common") * 100 >= (F.size("tx") + F.size("ty") - F.col("common")) * percent
    return materialize(both.select("x", "y", linked.alias("linked")), "verified")


def _unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of signatures that span more than one component, with their component."""
    label = labels.select(F.col("node").alias("rep"), F.col("component").alias("new")).hint("merge")
    now = members.select("sign", "rep", "n", "held").join(label, "rep", "left").select("sign", "rep", "n", "held", F.coalesce("new", "rep").alias("label"))
    open_ = now.groupBy("sign").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("sign")
    return materialize(now.join(open_.hint("shuffle_hash"), "sign"), "members")


def one_of_each_group(docs: DataFrame, n: int = 5, **how) -> DataFrame:
    """The rows of ``docs``, with all columns whatever they are called, that stay when each component keeps its smallest
    doc_id.

    Rows without words and rows with a null doc_id all stay. Where rows share the doc_id that a component
    keeps, the one of smallest digest stays; ids that occur once need no second look at the texts.
    """
    with scratch(docs.sparkSession):
        found = _components(docs, n=n, **how).where("n_shingles > 0 and doc_id is not null")
        found = materialize(found.select("doc_id", "component_id", "d1", "d2"), "components", keep=True)
    twice = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    several = twice.count()
    own = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"))
    if not several:
        return own.join(sized_hint(gone, gone.count()), "doc_id", "left_anti").select("doc.*")
    twice = materialize(twice, "repeated")
    gone = gone.join(twice.hint("merge"), "doc_id", "left_anti")
    once = own.join(sized_hint(gone.union(twice), gone.count() + several), "doc_id", "left_anti").select("doc.*")
    stays = found.where("doc_id = component_id").join(twice.hint("merge"), "doc_id").groupBy("doc_id", "component_id").agg(F.min(F.struct("d1", "d2")).alias("digest")).select("doc_id", "digest")

    @F.arrow_udf("d1 long, d2 long")
    def digest(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            batch = pa.RecordBatch.from_arrays([part], ["text"])
            found = [_digest(x) if len(x) else (None, None) for y in slices(iter([batch]), "text") for x in shingle_sets(y.column(0), n)]
            yield pa.StructArray.from_arrays([pa.array([d[k] for d in found], pa.int64()) for k in (0, 1)], ["d1", "d2"])

    again = own.join(sized_hint(twice, several), "doc_id", "left_semi").withColumn("digest", digest("doc.text"))
    empty = again.where("digest.d1 is null").select("doc.*")
    again = again.join(stays.hint("merge"), ["doc_id", "digest"])
    again = again.withColumn("nr", F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy(F.lit(0)))).where("nr = 1")
    return once.unionByName(again.select("doc.*")).unionByName(empty)
