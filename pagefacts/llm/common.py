"""Slices of batches, word hashing and join hints.

Every intermediate table goes to the folder named by ``spark.checkpoint.dir``, which driver and
executors share, so a lost executor costs a retry of its tasks and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, materialize, scratch, shared_dir, work_path
from ..operators.slices import SLICE_BYTES, give_back, slices

__all__ = ["SLICE_BYTES", "components", "give_back", "materialize", "mix", "ngram_hashes", "scratch", "shared_dir", "shingle_sets", "sized_hint", "slices", "word_hashes", "words_of", "work_path"]

#: Most rows of a list that is broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 500_000


def sized_hint(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a counted side while it is small, otherwise shuffle it."""
    return F.broadcast(df) if rows <= most else df.hint("merge")


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` of all texts, and each text's end in that list."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(counts)), counts)[full.to_numpy(zero_copy_only=False)]
    return flat.filter(full), np.cumsum(np.bincount(owner, minlength=len(counts)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, each distinct word hashed once, and each text's end."""
    flat, ends = words_of(texts)
    coded = flat.dictionary_encode()
    values = np.array(coded.dictionary.to_pylist() or [""], dtype=object)
    hashes = pd.util.hash_array(values, categorize=False)
    return hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.uint64), ends


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each position; the last n-1 positions have none."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out += words[k : k + count] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) + n) & (2**64 - 1) | 1)
    return mix(out)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Per text its sorted distinct n-word shingle hashes; a shorter text is one shingle, none if empty."""
    words, ends = word_hashes(texts)
    grams, start = ngram_hashes(words, n), 0
    for end in ends:
        if end - start >= n:
            yield np.unique(grams[start : end - n + 1])
        elif end > start:
            yield ngram_hashes(words[start:end], int(end - start))
        else:
            yield np.empty(0, np.uint64)
        start = end
