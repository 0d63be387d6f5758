"""Operator 4: token ids in Arrow stream files of equal-length sequences.

A file is an Arrow IPC stream whose record batches hold fixed-size lists: ``ids`` (uint16 or uint32),
``mask`` (true for a token, false for padding after the file's last one) and ``ends`` (true for the
last token of a document). All batches but the last have the same number of sequences, so sequence i
lies at a known batch and row and is read from a memory map without a copy. Beside each file,
``.docs`` is a stream of its doc_ids in order.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, slices, work_path
from .tokens import worker_encoder

#: Tokens of a sequence, and sequences of a record batch.
LENGTH, ROWS = 2048, 64
#: Bytes of text that go to one file, about.
FILE_BYTES = 512 << 20


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.bool_(), length))])


class _Writer:
    """Packs ids into full batches as they come; holds one batch at most."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows: int):
        self.schema, self.length, self.full = _schema(dtype, length), length, length * rows
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.ids, self.ends, self.held = [], [], 0

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        self.ids.append(ids)
        self.ends.append(ends)
        self.held += len(ids)
        if self.held >= self.full:
            ids, ends = np.concatenate(self.ids), np.concatenate(self.ends)
            whole = self.held // self.full * self.full
            for at in range(0, whole, self.full):
                self._write(ids[at : at + self.full], ends[at : at + self.full], self.full)
            self.ids, self.ends, self.held = [ids[whole:]], [ends[whole:]], self.held - whole

    def _write(self, ids: np.ndarray, ends: np.ndarray, real: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, np.arange(len(ids)) < real, ends)]
        self.stream.write_batch(pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(lists, self.schema.types, strict=True)], schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids, ends, pad = np.concatenate(self.ids), np.concatenate(self.ends), -self.held % self.length
            self._write(np.pad(ids, (0, pad)), np.pad(ends, (0, pad)), self.held)
        self.stream.close()


def write_sequences(docs: DataFrame, folder: str, path: str, end_id: int = 2, length: int = LENGTH, rows: int = ROWS) -> list[tuple[str, int, int]]:
    """Encode all texts in ascending doc_id order into files under ``folder``; returns (file, documents,
    tokens) of each file, in order. Null ids come first, equal ids in the order of their texts' hashes.

    A task writes under a name of its own attempt and renames it when complete, so a retry replaces
    whole files. What reaches the driver is one row for each file.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).repartitionByRange(parts, "doc_id", tie).sortWithinPartitions("doc_id", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = worker_encoder(path), TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        name = f"part-{context.partitionId():06d}.arrow"
        own = f"{root}/.{name}-{context.taskAttemptId()}"
        n = tokens = 0
        with store.open_output_stream(own) as sink, store.open_output_stream(f"{own}.docs") as beside:
            writer, ids_of = _Writer(sink, encode.dtype, length, rows), pa.ipc.new_stream(beside, pa.schema([("doc_id", pa.int64())]))
            for part in slices(batches, "text"):
                counts, coded = encode(pc.fill_null(part.column("text"), "").to_pylist())
                last = np.cumsum(counts + 1) - 1
                ends = np.zeros(len(coded) + len(counts), bool)
                ends[last] = True
                ids = np.full(len(ends), end_id, encode.dtype)
                ids[~ends] = coded
                writer.add(ids, ends)
                ids_of.write_batch(pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64())], ["doc_id"]))
                n, tokens = n + part.num_rows, tokens + len(ids)
            writer.close()
            ids_of.close()
        give_back()
        store.move(f"{own}.docs", f"{root}/{name}.docs")
        store.move(own, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([tokens])], ["file", "docs", "tokens"])

    written = ordered.mapInArrow(run, "file string, docs long, tokens long").collect()
    return sorted((r.file, r.docs, r.tokens) for r in written)


class SequenceFile:
    """Random access to one file's sequences; on a local path the arrays point into the memory map."""

    def __init__(self, uri: str):
        store, name = fs.FileSystem.from_uri(uri)
        source = pa.memory_map(name) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(name)
        self.batches = list(pa.ipc.open_stream(source))
        self.rows = self.batches[0].num_rows if self.batches else 1

    def __len__(self) -> int:
        return sum(x.num_rows for x in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``."""
        batch, row = self.batches[i // self.rows], i % self.rows
        column = batch.column("ids")
        width = column.type.list_size
        ids = column.flatten().to_numpy()[row * width : (row + 1) * width]
        return ids, batch.column("mask").flatten()[row * width : (row + 1) * width].to_numpy(zero_copy_only=False)


def _documents(store, name: str) -> Iterator[pa.RecordBatch]:
    """Documents of a file with start in the file, length and checksum; reads batch after batch."""
    with store.open_input_stream(name) as source, store.open_input_stream(f"{name}.docs") as beside:
        doc_ids = (x for batch in pa.ipc.open_stream(beside) for x in batch.column(0).to_pylist())
        start = n = crc = 0
        for batch in pa.ipc.open_stream(source):
            real = batch.column("mask").flatten().to_numpy(zero_copy_only=False)
            ids = batch.column("ids").flatten().to_numpy()[real].astype("<u4")
            at, found = 0, []
            for end in np.flatnonzero(batch.column("ends").flatten().to_numpy(zero_copy_only=False)[real]) + 1:
                n, crc = n + int(end) - at, zlib.crc32(ids[at:end], crc)
                found.append((next(doc_ids), start, n, crc))
                start, n, crc, at = start + n, 0, 0, int(end)
            n, crc = n + len(ids) - at, zlib.crc32(ids[at:], crc)
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, folder: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone (one task a file)."""
    base = dict(zip([x for x, _, _ in files], np.cumsum([0, *(n for _, _, n in files)]).tolist(), strict=False))
    listed = spark.sparkContext.broadcast(base)
    names = sorted(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for x in _documents(store, posixpath.join(root, names[i])):
                    yield x.set_column(1, "start", pc.add(x.column("start"), listed.value[names[i]]))

    return spark.range(0, len(names), 1, max(1, len(names))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write all documents and read the files back: doc_id, start (ids before it), n_tokens, ids_crc32.

    A null text is empty and has the end id alone. Repeated rows and ids are written each; other
    columns are ignored; an empty table gives empty files and no rows.
    """
    spark = docs.sparkSession
    folder = work_path(spark, "sequences")
    return read_documents(spark, folder, write_sequences(docs, folder, path, end_id))
