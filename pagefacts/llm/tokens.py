"""Operator 10: token counts by a two-tier map-side lookup; the encoder that operator 4 shares.

A text splits into units at single spaces: a space between two characters that are not white space
always starts a new pre-token of a byte-level tokenizer, so the text's ids are its units' ids in a
row. The first tier is a broadcast table of frequent units, the second a worker's cache of bounded
size; both hold short units' bytes or long ones' digests, lengths and ids in arrays. Texts for which the rule does not hold (spaces
beside white space, added tokens) go to the library whole, as do tokenizers of another kind.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices

#: Units of a worker's cache (about 30 bytes each), runs it is kept in, and most ids of a unit that is kept.
CACHE_UNITS, CACHE_RUNS, CACHE_IDS = 1_000_000, 8, 64
#: Units of the broadcast table; unknown units that the library gets as one text.
TABLE_UNITS, JOINED = 20_000, 1000
_SPACES = "\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
_ODD = re.compile(f"[{_SPACES.replace(chr(10), '').replace(' ', '')}]")
_BESIDE = re.compile(f"[{_SPACES}] | [{_SPACES}]")
_AT_END = f"^[{_SPACES}]|[{_SPACES}]$|^$"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of pieces that begin at ``starts``, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def unit_hashes(units: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that tell units apart, those that begin a text (``first``) too: of up to 15 bytes by the bytes themselves
    and their number, of more by a 120-bit BLAKE2b digest. The first number is well spread."""
    units = units.cast(pa.large_string())
    offsets = np.frombuffer(units.buffers()[1], np.int64)[units.offset : units.offset + len(units) + 1] if len(units) else np.zeros(1, np.int64)
    data = np.frombuffer(units.buffers()[2] or b"", np.uint8) if len(units) else np.empty(0, np.uint8)
    start, size = offsets[:-1], np.diff(offsets)
    short = np.flatnonzero(size < 16)
    out = np.zeros((len(units), 16), np.uint8)
    for i in range(0, len(short), 20_000):  # which bounds the indices
        part = short[i : i + 20_000]
        out.ravel()[_ragged(part * 16, size[part])] = data[_ragged(start[part], size[part])]
    for i in np.flatnonzero(size >= 16).tolist():
        out[i] = np.frombuffer(blake2b(data[start[i] : start[i] + size[i]], digest_size=16).digest(), np.uint8)
    out[:, 15] = np.minimum(size, 16) * 2 + first
    low, high = (out.view("<u8")[:, k].copy() for k in (0, 1))
    return mix(low) ^ mix(high ^ np.uint64(0x94D049BB133111EB)), high


@dataclass
class Run:
    """Units in order of the first of their two numbers: both, number of ids, and the ids' place in ``ids`` (none when counting)."""

    key: np.ndarray
    check: np.ndarray
    size: np.ndarray
    start: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, check: np.ndarray, size: np.ndarray, start: np.ndarray, ids: np.ndarray) -> Run:
        order = np.argsort(key, kind="stable")
        return cls(key[order], check[order], size[order], start[order], ids)

    @classmethod
    def merged(cls, runs: list[Run]) -> Run:
        base = np.cumsum([0, *(len(r.ids) for r in runs)])
        start = np.concatenate([r.start + b for r, b in zip(runs, base, strict=False)])
        return cls.of(*(np.concatenate([getattr(r, c) for r in runs]) for c in ("key", "check", "size")), start, np.concatenate([r.ids for r in runs]))

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the units are in the run, and where."""
        if not len(self.key):
            return np.zeros(len(key), bool), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        same = (self.key[at] == key) & (self.check[at] == check)
        return same, at[same]


class Units:
    """Tells which texts split into units at single spaces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        pre = model.get("pre_tokenizer") or {}
        self.fit = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("normalizer") and not model.get("post_processor")
        self.added = [x["content"] for x in model.get("added_tokens") or []]

    def fits(self, text: str) -> bool:
        if not self.fit or "  " in text or " \n" in text or "\n " in text or any(x in text for x in self.added):
            return False
        return not (_ODD.search(text) and _BESIDE.search(text))


@lru_cache(1)
def _library(path: str) -> tuple:
    """The tokenizer, the type that holds its ids, and which ids' tokens begin with a space."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    vocabulary = library.get_vocab()
    opens = np.zeros(max(vocabulary.values()) + 1, bool)
    opens[[i for x, i in vocabulary.items() if x[:1] == "Ġ"]] = True
    return library, np.dtype("<u2") if len(opens) <= 1 << 16 else np.dtype("<u4"), opens


class Encoder:
    """Ids of texts from the tokenizers library, or their counts; each unit is encoded once while remembered."""

    def __init__(self, path: str, table: Run | None = None, counts: bool = False):
        self.library, self.dtype, self.opens = _library(path)
        self.units, self.counts = Units(path), counts
        empty = [np.empty(0, t) for t in (np.uint64, np.uint64, np.int32, np.int64, self.dtype)]
        self.table, self.runs = table or Run(*empty), []

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's number of ids of whole texts, and all ids in a row."""
        found = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        return np.array([len(x) for x in found], np.int64), np.concatenate([np.empty(0, self.dtype), *(np.array(x, self.dtype) for x in found)])

    def _new(self, units: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of units in order. Those that can stand side by side go as long texts: a unit then begins
        at each id whose token begins with a space."""
        alone = first | pc.match_substring_regex(units, _AT_END).to_numpy(zero_copy_only=False)
        joined, rest = units.filter(pa.array(~alone)).to_pylist(), units.filter(pa.array(alone)).to_pylist()
        _, ids = self.encoded([" " + " ".join(joined[i : i + JOINED]) for i in range(0, len(joined), JOINED)])
        size = np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))
        if len(size) != len(joined):
            size, ids = self.encoded([" " + x for x in joined])
        own, own_ids = self.encoded([x if f else " " + x for x, f in zip(rest, first[alone].tolist(), strict=True)])
        sizes, starts = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
        sizes[~alone], sizes[alone] = size, own
        starts[~alone], starts[alone] = np.cumsum(size) - size, len(ids) + np.cumsum(own) - own
        return sizes, np.concatenate([ids, own_ids])[_ragged(starts, sizes)]

    def _values(self, units: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Size of each unit, its place in an array of ids, and that array."""
        key, check = unit_hashes(units, first)
        size, start, ids, base, todo = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), [], 0, np.arange(len(units))
        for run in (self.table, *self.runs):
            same, at = run.find(key[todo], check[todo])
            size[todo[same]], start[todo[same]] = run.size[at], run.start[at] + base
            ids.append(run.ids)
            base, todo = base + len(run.ids), todo[~same]
        if len(todo):
            new, new_ids = self._new(units.take(pa.array(todo)), first[todo])
            begun = np.cumsum(new) - new
            size[todo], start[todo] = new, begun + base
            kept = new <= CACHE_IDS
            own = np.empty(0, self.dtype) if self.counts else new_ids[_ragged(begun[kept], new[kept])]
            self._keep(Run.of(key[todo][kept], check[todo][kept], new[kept].astype(np.int32), np.zeros(int(kept.sum()), np.int64) if self.counts else np.cumsum(new[kept]) - new[kept], own))
            ids.append(new_ids)
        return size, start, np.concatenate(ids)

    def _keep(self, run: Run) -> None:
        """Adds a run; the oldest goes when the cache is full."""
        self.runs.append(run)
        if len(self.runs) > CACHE_RUNS:
            if sum(len(r.key) for r in self.runs) > CACHE_UNITS:
                del self.runs[0]
            self.runs = [Run.merged(self.runs)]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids in a row (none when only counting)."""
        fits = np.array([self.units.fits(x) for x in texts], bool)
        n, ids = self._by_units([x for x, ok in zip(texts, fits, strict=True) if ok])
        if fits.all():
            return n, ids
        whole, whole_ids = self.encoded([x for x, ok in zip(texts, fits, strict=True) if not ok])
        total, start = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        total[fits], total[~fits] = n, whole
        if self.counts:
            return total, ids
        start[fits], start[~fits] = np.cumsum(n) - n, len(ids) + np.cumsum(whole) - whole
        return total, np.concatenate([ids, whole_ids])[_ragged(start, total)]

    def _by_units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.empty(0, np.int64), np.empty(0, self.dtype)
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded, ends = lists.flatten().dictionary_encode(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        # A text's first unit has no space before it: it is a unit of its own, beyond the others.
        at, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
        at[np.concatenate([[0], ends[:-1]])] += distinct
        used, at = np.unique(at, return_inverse=True)
        size, start, ids = self._values(coded.dictionary.take(pa.array(used % distinct)), used >= distinct)
        n = size[at]
        of_text = np.diff(np.cumsum(n)[ends - 1], prepend=0)
        return of_text, np.empty(0, self.dtype) if self.counts else ids[_ragged(start[at], n)]


_ENCODERS: dict[tuple, Encoder] = {}


def worker_encoder(path: str, table: Run | None = None, counts: bool = False, key: int = 0) -> Encoder:
    """The encoder of this Python worker, kept between its tasks."""
    if (k := (path, counts, key)) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[k] = Encoder(path, table, counts)
    return _ENCODERS[k]


def frequent_units(path: str, units: int = TABLE_UNITS) -> Run:
    """Token counts of the units that the tokenizer itself holds frequent: the first of its vocabulary, which is in
    order of merges, that are a space and characters without white space. No pass over the documents is needed."""
    encode = Encoder(path, counts=True)
    texts = encode.library.decode_batch([[i] for i in range(len(encode.opens))], skip_special_tokens=False)
    found = pa.array(list(dict.fromkeys(x[1:] for x in texts if x[:1] == " " and "\ufffd" not in x and not re.search(_AT_END, x[1:])))[:units], pa.string())
    size, _ = encode.encoded([" " + x for x in found.to_pylist()])
    return Run.of(*unit_hashes(found, np.zeros(len(found), bool)), size.astype(np.int32), np.zeros(len(found), np.int64), np.empty(0, encode.dtype))


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of each row; a null text counts as empty.

    ``path``: a tokenizers file (.json) or a sentencepiece model (.model). Counts are what the library
    gives for the whole text without special tokens, truncation or padding. Rows are independent, so
    repeated rows and ids give repeated results; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    json_file = path.endswith(".json")
    table = docs.sparkSession.sparkContext.broadcast(frequent_units(path) if json_file and Units(path).fit else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if json_file:
            encode = worker_encoder(path, table.value, True, id(table.value))
            count = lambda texts: encode(texts)[0]
        else:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        for part in slices(batches, "text"):
            texts = pc.fill_null(part.column("text"), "")
            n = pa.array(count(texts.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
