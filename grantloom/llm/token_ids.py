"""Token ids in binary files with a fixed number of bits per id.

A file holds the ids of consecutive documents (ascending doc_id; null first). Each id takes the fewest bits that tell
the vocabulary's ids apart. Ids are packed in blocks of BLOCK ids; each block begins on a byte offset that the file
lists, so any id is found by one look-up, and a block is unpacked by a few numpy operations.

    blocks | doc_ids i64 | is_null u8 | ends u64 (ids up to and with each document) | block offsets u64 | trailer
    trailer: documents, ids, bytes before the footer (u64 each), bits, ids a block (u32 each), magic

Texts are range-partitioned and sorted by id before they are encoded, so that ids are made where they are written, and
only texts are shuffled, once. Null texts are empty and have the end id alone. Rows that repeat an id follow each other
in an order that their texts decide. An empty table gives one file without documents, or none. Extra columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from grantloom.llm import files
from grantloom.llm.bits import pack, unpack, width_for
from grantloom.llm.common import saved, scratch, texts_of
from grantloom.llm.tokens import WordTokenizer, in_groups

MAGIC = b"GLTOKID1"
TRAILER = struct.Struct("<QQQII8s")
BLOCK = 8192


class IdFileWriter:
    """Streams documents into a file; memory: the documents' table and one block."""

    def __init__(self, uri: str, width: int):
        self.out, self.width = files.writer(uri), width
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = self.at = 0
        self.doc_ids: list[int | None] = []
        self.ends: list[int] = []
        self.offsets: list[int] = []

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.width).astype("<u8").tobytes()
        self.offsets.append(self.at)
        self.out.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.n_ids += len(ids)
        self.ends.append(self.n_ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            rest = np.concatenate(self.waiting)
            while len(rest) >= BLOCK:
                self._block(rest[:BLOCK])
                rest = rest[BLOCK:]
            self.waiting, self.n_waiting = [rest], len(rest)

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        for values, kind in (([x or 0 for x in self.doc_ids], "<i8"), ([x is None for x in self.doc_ids], "u1"), (self.ends, "<u8"), (self.offsets, "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(TRAILER.pack(len(self.doc_ids), self.n_ids, self.at, self.width, BLOCK, MAGIC))
        self.out.close()


class IdFile:
    """A memory-mapped file of ids: document(i) and ids(begin, end) at random."""

    def __init__(self, uri: str):
        self.raw = files.mapped(uri)
        n, self.n_ids, at, self.width, self.block, magic = TRAILER.unpack(self.raw[-TRAILER.size :].tobytes())
        if magic != MAGIC:
            raise ValueError(f"{uri} is no file of token ids")
        tables = []
        for kind, size in (("<i8", n), ("u1", n), ("<u8", n), ("<u8", -(-self.n_ids // self.block))):
            bytes_ = np.dtype(kind).itemsize * size
            tables.append(self.raw[at : at + bytes_].view(kind) if at % 8 == 0 else np.frombuffer(self.raw[at : at + bytes_].tobytes(), kind))
            at += bytes_
        self.doc_ids, self.nulls, self.ends, self.offsets = tables

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids number begin to end (exclusive)."""
        found = [np.zeros(0, np.uint32)]
        while begin < end:
            block = begin // self.block
            upto = min(end, (block + 1) * self.block)
            size = min(self.block, self.n_ids - block * self.block)
            at = int(self.offsets[block])
            words = np.frombuffer(self.raw[at : at + ((size * self.width + 63) // 64 + 1) * 8].tobytes(), "<u8")
            found.append(unpack(words, np.arange(begin, upto) - block * self.block, self.width).astype(np.uint32))
            begin = upto
        return np.concatenate(found)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def write_ids(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes all documents and returns the manifest, one row per file: part, path, n_docs, n_ids."""
    folder = folder or scratch(docs.sparkSession, "token-ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end, out = WordTokenizer.at(vocabulary), np.array([end_id], np.uint32), None
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for begin, to in in_groups(texts):
                for doc_id, ids in zip(ids_of[begin:to], tokenizer.ids(texts[begin:to]), strict=True):
                    if out is None:
                        path = files.fresh_name(folder, f"part-{TaskContext.get().partitionId():06d}", ".ids")
                        out = IdFileWriter(path, width_for(max(tokenizer.size, end_id + 1)))
                    out.add(doc_id, np.concatenate([ids.astype(np.uint32), end]))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [path], "n_docs": [len(out.doc_ids)], "n_ids": [out.n_ids]})

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumn("place", F.xxhash64("text"))
    # The texts' hashes split an id that very many rows repeat, or that is null.
    sorted_ = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place", "text").select("doc_id", "text")
    return saved(sorted_.mapInArrow(write, "part long, path string, n_docs long, n_ids long"), "token-ids-manifest")


def read_ids(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32 (and ids, little-endian 32-bit)."""
    # One row per file.
    placed = manifest.withColumn("first", F.sum("n_ids").over(W.orderBy("part")) - F.col("n_ids"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                file = IdFile(path)
                ends = file.ends.astype(np.int64)
                starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
                begin = 0
                while begin < len(file):
                    to = max(begin + 1, int(np.searchsorted(ends, starts[begin] + 2_000_000, side="right")))
                    ids = file.ids(int(starts[begin]), int(ends[to - 1])).astype("<u4").tobytes()
                    cuts = [ids[4 * int(a - starts[begin]) : 4 * int(b - starts[begin])] for a, b in zip(starts[begin:to], ends[begin:to], strict=True)]
                    columns = {
                        "doc_id": pa.array(file.doc_ids[begin:to].astype(np.int64), mask=file.nulls[begin:to].astype(bool)),
                        "start": pa.array(starts[begin:to] + first),
                        "n_tokens": pa.array(ends[begin:to] - starts[begin:to]),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in cuts], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array(cuts, pa.binary())
                    yield pa.RecordBatch.from_pydict(columns)
                    begin = to

    files_ = max(1, manifest.count())
    return placed.select("path", "first").repartition(files_, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
