"""Operator 12: how two tokenizers cut the same bytes, with corpus-wide counts of id pairs.

Links are counted in dense vectors that a minimal perfect hash of the distinct id pairs indexes: pairs
are dealt to shards, each shard's hash is built by one task from its distinct pairs, each group of tasks
sums a vector for each shard, and the vectors are added up as a tree. A second pass aligns the
documents again and looks counts up; a stored key at each place tells known pairs from others. The most
frequent pairs, MOST_PAIRS at most, are broadcast; where there are more, the links of the others are
joined to their counts.

Where a space stands between two characters that are not white space, a token of either tokenizer begins:
byte-level pre-tokens begin there, and no piece of the other vocabulary has a space after another character
(``Tokenizers`` refuses vocabularies that do). So a document's alignment is that of its units in a row, and the
distinct units of a slice of documents are encoded and aligned once for all of them.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, slices
from .tokens import _AT_END, _BESIDE, _ODD, _SPACES, _ragged

#: A slice of documents has about so many bytes; units that the libraries get as one text, and texts at once.
ALIGN_BYTES, JOINED, AT_ONCE = 8_000_000, 1000, 16
#: Pairs that a task sums before it writes them, of a shard, and of the broadcast table at most (16 bytes and some bits each).
TASK_PAIRS, SHARD_PAIRS, MOST_PAIRS = 500_000, 1 << 18, 4_000_000
#: Leaves and branching of the tree of sums, and slots for each key that a level of the hash is given.
LEAVES, BRANCH, SLOTS = 16, 4, 2
_SAFE = re.compile(f"(?<=[^{_SPACES}▁]) (?=[^{_SPACES}▁])")
_SPREAD = 50_021


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others
    for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """The two libraries and the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        table, vocabulary = _byte_level(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in x.lstrip("▁") for x in pieces):
            raise ValueError("a piece that goes on after a space: texts cannot be cut at spaces")
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.tables = [(np.frombuffer(b"".join(t), np.uint8), np.cumsum(n) - n, n) for t, n in ((self.a_bytes, self.a_size), (self.b_bytes, self.b_size))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All A and B ids of texts that begin with a space, which B adds itself."""
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(0, len(texts), AT_ONCE):
            part = texts[i : i + AT_ONCE]
            a += [np.array(x.ids, np.int64) for x in self.a.encode_batch_fast(part, add_special_tokens=False)]
            b += [np.array(x, np.int64) for x in self.b.encode([x[1:] for x in part], num_threads=1)]
        return np.concatenate(a), np.concatenate(b)

    def spell(self, ids: tuple[np.ndarray, np.ndarray], data: bytes) -> bool:
        """Do both tokenizers' ids stand for these bytes?"""
        want = np.frombuffer(data, np.uint8)
        return all(np.array_equal(table[_ragged(start[x], size[x])], want) for x, (table, start, size) in zip(ids, self.tables, strict=True))


def units_of(text: str) -> list[str]:
    """Pieces between the spaces at which both tokenizers cut."""
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _ODD.search(text) and _BESIDE.search(text):
        return _SAFE.split(text)
    return text.split(" ")


@lru_cache(1)
def worker_tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


class Slice:
    """The distinct units of some texts, aligned, and which units each text has; texts without tokens have none."""

    def __init__(self, texts: list[str | None], library: Tokenizers):
        parts = [units_of(x) if x and "▁" not in x else [] for x in texts]
        flat = pa.array([u for p in parts for u in p], pa.string()).dictionary_encode()
        # Units with white space at an end cannot stand beside others: they come last.
        alone = pc.match_substring_regex(flat.dictionary, _AT_END).to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(alone, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.codes, units, side = place[flat.indices.to_numpy(zero_copy_only=False)], flat.dictionary.take(pa.array(order)).to_pylist(), int((~alone).sum())
        sizes = np.array([len(p) for p in parts], np.int64)
        del parts
        ids, data = self._encoded(units, side, library)
        if not library.spell(ids, data):
            fine = np.array([library.spell(library.encode([x]), x.encode()) for x in (f" {u}" for u in units)], bool)
            text = np.repeat(np.arange(len(texts)), sizes)
            lost = np.zeros(len(texts), bool)
            lost[text[~fine[self.codes]]] = True
            self.codes, sizes = (np.cumsum(fine) - 1)[self.codes[~lost[text]]], np.where(lost, 0, sizes)
            units, side = [u for u, ok in zip(units, fine, strict=True) if ok], int(fine[:side].sum())
            ids, data = self._encoded(units, side, library)
        self.ends = np.cumsum(sizes)
        self.a, self.b = ids
        self._align(np.cumsum([len(u.encode()) + 1 for u in units], dtype=np.int64), len(data), library)

    @staticmethod
    def _encoded(units: list[str], side: int, library: Tokenizers) -> tuple[tuple[np.ndarray, np.ndarray], bytes]:
        """Ids of all units in order, the first ``side`` of them side by side, and the bytes they stand for."""
        joined = [" " + " ".join(units[i : min(side, i + JOINED)]) for i in range(0, side, JOINED)] + [f" {u}" for u in units[side:]]
        return library.encode(joined), "".join(joined).encode()

    def _align(self, unit_end: np.ndarray, n: int, library: Tokenizers) -> None:
        """Tokens, groups and links of each unit, and the key of each link (A id in the upper half)."""
        end_a, end_b, mark = np.cumsum(library.a_size[self.a]), np.cumsum(library.b_size[self.b]), np.zeros(n + 1, np.uint8)
        mark[end_a] |= 1
        mark[end_b] |= 2
        # Between two neighbouring ends lies the overlap of one A and one B token.
        ends = np.flatnonzero(mark)
        at = mark[ends]
        ends_a, ends_b = np.cumsum(at & 1, dtype=np.int64), np.cumsum(at >> 1, dtype=np.int64)
        self.keys = (self.a[ends_a - (at & 1)] << 32) | self.b[ends_b - (at >> 1)]
        both = at == 3
        last = np.searchsorted(ends, unit_end, side="right") - 1
        each = lambda upto: np.diff(upto[last], prepend=0)
        self.links, self.n_a, self.n_b, self.n_groups = np.diff(last + 1, prepend=0), each(ends_a), each(ends_b), each(np.cumsum(both))
        self.to_a, self.to_b = ends_a[both], ends_b[both]

    def groups(self) -> list[str]:
        """Each unit's groups as text."""
        a, b, to_a, to_b = list(map(str, self.a.tolist())), list(map(str, self.b.tolist())), self.to_a.tolist(), self.to_b.tolist()
        of = [f"{a[p]}|{b[r]}" if q == p + 1 and t == r + 1 else f"{','.join(a[p:q])}|{','.join(b[r:t])}" for p, q, r, t in zip([0, *to_a], to_a, [0, *to_b], to_b)]  # noqa: B905
        upto = np.cumsum(self.n_groups).tolist()
        return [";".join(of[i:j]) for i, j in zip([0, *upto], upto)]  # noqa: B905

    def per_text(self, of_unit: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(of_unit[self.codes])])[np.concatenate([[0], self.ends])]
        return np.diff(total)

    def per_unit(self, of_link: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(of_link)])[np.concatenate([[0], np.cumsum(self.links)])])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and how often they are linked."""
        return summed(self.keys, np.repeat(np.bincount(self.codes, minlength=len(self.links)), self.links))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(keys, return_inverse=True)
    out = np.zeros(len(distinct), np.int64)
    np.add.at(out, at, n)
    return distinct[out > 0], out[out > 0]


def _slots(keys: np.ndarray, level: int, slots: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64) ^ mix(np.full(1, level + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(slots)).astype(np.int64)


class PerfectHash:
    """Maps n distinct keys one to one to 0..n-1: on each level keys that are alone in their slot set its bit, the others
    go on to the next; a key's place is the number of bits before its own. The stored keys tell others apart."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        self.words, self.sizes, self.keys, self.counts = words, sizes, keys, counts
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, bits, sizes = keys, [], []
        while len(left):
            slots = SLOTS * len(left)
            at = _slots(left, len(sizes), slots)
            alone = np.bincount(at, minlength=slots) == 1
            bits.append(alone)
            sizes.append(slots)
            left = left[~alone[at]]
        packed = np.packbits(np.concatenate([np.zeros(0, bool), *bits]), bitorder="little")
        words = np.frombuffer(np.pad(packed, (0, -len(packed) % 8)).tobytes(), "<u8")
        out = cls(words, np.array(sizes, np.int64), keys, np.zeros(len(keys), np.int64))
        placed = np.empty(len(keys), np.int64)
        placed[out._place(keys)] = keys
        out.keys = placed
        return out

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 where no level has a bit for it."""
        out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, slots in enumerate(self.sizes.tolist()):
            at = base + _slots(keys[todo], level, slots)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (self.before[at >> 6] + below)[hit]
            todo, base = todo[~hit], base + slots
            if not len(todo):
                break
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each known key, -1 for others."""
        at = self._place(keys)
        known = at >= 0
        known[known] = self.keys[at[known]] == keys[known]
        return np.where(known, at, -1)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> 32) * _SPREAD + (keys & 0xFFFFFFFF)) % shards


def _sharded(pairs: DataFrame, shards: int) -> DataFrame:
    a, b = F.shiftright("key", 32), F.col("key").bitwiseAND(0xFFFFFFFF)
    return pairs.withColumn("shard", F.pmod(a * _SPREAD + b, F.lit(shards)))


class Pairs:
    """Counts of id pairs, by shard, with the highest count of each B id."""

    def __init__(self, shards: list[PerfectHash], best: np.ndarray):
        self.shards, self.best = shards, best

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The count of each pair, -1 where it is not in the table."""
        out, shard = np.full(len(keys), -1, np.int64), _shard(keys, max(1, len(self.shards)))
        for k, part in enumerate(self.shards):
            mine = np.flatnonzero(shard == k)
            at = part.find(keys[mine])
            out[mine[at >= 0]] = part.counts[at[at >= 0]]
        return out


_HASH = "shard long, words binary, sizes array<long>, keys binary"


def _hash_row(shard: int, h: PerfectHash) -> pa.Table:
    return pa.table([pa.array([shard], pa.int64()), pa.array([h.words.tobytes()]), pa.array([h.sizes.tolist()], pa.list_(pa.int64())), pa.array([h.keys.astype("<i8").tobytes()])], ["shard", "words", "sizes", "keys"])


def _hash_of(words: bytes, sizes: list[int], keys: bytes, counts: bytes = b"") -> PerfectHash:
    return PerfectHash(np.frombuffer(words, "<u8"), np.array(sizes, np.int64), np.frombuffer(keys, "<i8"), np.frombuffer(counts, "<i8"))


def hash_shards(keys: DataFrame, shards: int) -> DataFrame:
    """A perfect hash for each shard of distinct ``key``."""

    def build(part: pa.Table) -> pa.Table:
        return _hash_row(part.column("shard")[0].as_py(), PerfectHash.build(part.column("key").to_numpy()))

    return materialize(_sharded(keys, shards).groupBy("shard").applyInArrow(build, _HASH), "pair_hashes")


def dense_counts(parts: DataFrame, hashes: DataFrame, shards: int) -> DataFrame:
    """shard, words, sizes, keys, counts: a vector for each shard and group of ``node``, then the tree of their sums."""

    def leaf(key: tuple, part: pa.Table, own: pa.Table) -> pa.Table:
        h = _hash_of(*(own.column(c)[0].as_py() for c in ("words", "sizes", "keys")))
        total = np.zeros(len(h.keys), np.int64)
        np.add.at(total, h.find(part.column("key").to_numpy()), part.column("n").to_numpy())
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int64()), pa.array([total.astype("<i8").tobytes()])], ["shard", "node", "counts"])

    def add(key: tuple, part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<i8") for x in part.column("counts"))
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int64()), pa.array([total.astype("<i8").tobytes()])], ["shard", "node", "counts"])

    dealt = _sharded(parts.withColumn("node", F.pmod("node", F.lit(LEAVES))), shards)
    there = materialize(dealt.select("shard", "node").distinct(), "pair_nodes").join(hashes.hint("merge"), "shard")
    now = dealt.groupBy("shard", "node").cogroup(there.groupBy("shard", "node")).applyInArrow(leaf, "shard long, node long, counts binary")
    left = LEAVES
    while left > 1:
        left = -(-left // BRANCH)
        now = now.withColumn("node", F.floor(F.col("node") / BRANCH)).groupBy("shard", "node").applyInArrow(add, "shard long, node long, counts binary")
    return materialize(hashes.join(now.drop("node").hint("merge"), "shard"), "pair_counts")


def counted_pairs(counts: DataFrame) -> DataFrame:
    """key, count of every pair."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, found in zip(batch.column("keys"), batch.column("counts"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), "<i8")) for x in (keys, found)], ["key", "count"])

    return counts.select("keys", "counts").mapInArrow(rows, "key long, count long")


def _broadcast_table(counts: DataFrame, pairs: DataFrame, total: int, b_ids: int) -> tuple[Pairs, bool]:
    """The table to broadcast and whether it holds all pairs; else those whose count reaches a power of two that
    MOST_PAIRS pairs at most do."""
    best = np.zeros(b_ids, np.int64)
    for r in pairs.groupBy(F.col("key").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("count").alias("n")).collect():  # a row for each B id at most
        best[r.b] = r.n
    if total <= MOST_PAIRS:
        return Pairs([_hash_of(r.words, r.sizes, r.keys, r.counts) for r in counts.orderBy("shard").toLocalIterator()], best), True
    power, seen = 64, 0
    for r in pairs.groupBy(F.floor(F.log2("count")).alias("power")).count().orderBy(F.desc("power")).collect():  # 63 rows at most
        if seen + r["count"] > MOST_PAIRS:
            break
        power, seen = r.power, seen + r["count"]
    held = pairs.where(F.floor(F.log2("count")) >= power).select("key", "count").toArrow()
    keys, n = (held.column(c).to_numpy() for c in ("key", "count"))
    h = PerfectHash.build(keys)
    h.counts = np.zeros(len(keys), np.int64)
    h.counts[h.find(keys)] = n
    return Pairs([h], best), False


def link_counts(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, int]:
    """The table of pair counts (a row for each shard) and the number of distinct pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, held, node = worker_tokenizers(path_a, path_b), [], TaskContext.get().partitionId()
        row = lambda k, n: pa.RecordBatch.from_arrays([pa.array(np.full(len(k), node)), pa.array(k), pa.array(n)], ["node", "key", "n"])
        for part in slices(batches, "text", ALIGN_BYTES):
            held.append(Slice(part.column("text").to_pylist(), library).pairs())
            if len(held) > 8 or sum(len(k) for k, _ in held) > TASK_PAIRS:
                held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                if len(held[0][0]) > TASK_PAIRS:
                    yield row(*held.pop())
        if held:
            yield row(*summed(*(np.concatenate(x) for x in zip(*held, strict=True))))

    parts = materialize(docs.select("text").mapInArrow(count, "node long, key long, n long"), "pair_parts")
    keys = materialize(parts.select("key").distinct(), "pair_keys")
    total = keys.count()
    shards = max(1, -(-total // SHARD_PAIRS))
    return dense_counts(parts, hash_shards(keys, shards), shards), total


_OWN = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    A reads a space and the text, byte-level (tokenizers, .json), B the text (sentencepiece, .model), both
    without special tokens. A text that is null, empty or does not come back byte for byte from both has no
    tokens: zeros and ''. Texts are whole, however long. Rows are independent: repeated rows and ids give repeated
    results, and each counts; other columns are ignored; an empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts, total = link_counts(docs, path_a, path_b)
    pairs = materialize(counted_pairs(counts), "counted_pairs")
    table, whole = _broadcast_table(counts, pairs, total, len(Tokenizers(path_a, path_b).b_bytes))
    kept = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, at, row = worker_tokenizers(path_a, path_b), kept.value, TaskContext.get().partitionId() << 40
        for part in slices(batches, "text", ALIGN_BYTES):
            s = Slice(part.column("text").to_pylist(), library)
            found = at(s.keys)
            known, best = found >= 0, at.best[s.keys & 0xFFFFFFFF]
            codes, texts, begin, digest = s.codes.tolist(), s.groups(), 0, []
            for end in s.ends.tolist():
                digest.append(hashlib.sha256(";".join([texts[c] for c in codes[begin:end]]).encode()).hexdigest() if end > begin else "")
                begin = end
            of_unit = [s.n_a, s.n_b, s.n_groups, s.links, s.per_unit(known & (found == best)), s.per_unit(np.where(known, found, 0))]
            columns = [part.column("doc_id"), *(pa.array(s.per_text(x)) for x in of_unit), pa.array(digest, pa.string())]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            if not whole:
                columns += [pa.array(np.arange(row, row + part.num_rows)), pa.array(_unknown(s, known), pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())])))]
                names += ["row", "rest"]
                row += part.num_rows
            yield pa.RecordBatch.from_arrays(columns, names)

    if whole:
        return docs.mapInArrow(run, _OWN)
    out = materialize(docs.mapInArrow(run, f"{_OWN}, row long, rest array<struct<key: long, n: long>>"), "aligned")
    best = pairs.groupBy(F.col("key").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("count").alias("best"))
    rare = pairs.withColumn("b", F.col("key").bitwiseAND(0xFFFFFFFF)).join(best.hint("shuffle_hash"), "b").select("key", "count", "best")
    more = out.select("row", F.explode("rest").alias("r")).select("row", "r.key", "r.n").join(rare.hint("merge"), "key").groupBy("row")
    more = more.agg(F.sum(F.col("n") * F.col("count")).alias("more_sum"), F.sum(F.when(F.col("count") == F.col("best"), F.col("n"))).alias("more_best"))
    add = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    return out.join(more.hint("merge"), "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", add("n_best", "more_best"), add("count_sum", "more_sum"), "groups_sha256")


def _unknown(s: Slice, known: np.ndarray) -> list[list[dict]]:
    """Per text its links whose pairs are not in the table."""
    of_unit, begin, out = np.repeat(np.arange(len(s.links)), s.links), 0, []
    rare = [[] for _ in s.links]
    for u, key in zip(of_unit[~known].tolist(), s.keys[~known].tolist(), strict=True):
        rare[u].append(key)
    for end in s.ends.tolist():
        n: dict[int, int] = {}
        for c in s.codes[begin:end].tolist():
            for key in rare[c]:
                n[key] = n.get(key, 0) + 1
        out.append([{"key": k, "n": v} for k, v in n.items()])
        begin = end
    return out
