"""Best-fit packing of tokenised documents into sequences, large items by matching.

A document longer than a sequence is cut into full pieces and a rest. What has to be decided depends on lengths only,
and there are at most as many of them as tokens in a sequence, so the packing is planned on the counts of each length:
pieces above a third of the capacity are matched greedily, longest first, with the longest one that still fits (two of
them a sequence at most, as a third can't fit); smaller ones, longest first, go to the sequences with the least room
that takes them. The plan is exact for all pieces however many there are, and its size is bounded by the square of the
capacity. Pieces then find their places by their rank among the pieces of their length.

Ranks are counted in two steps, totals of chunks and then within a chunk, so that a length that a third of all pieces
share is not sorted in one task. Null and empty texts are one piece (the end id alone). Rows that repeat an id are
packed each. An empty table gives no pieces. Extra columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from grantloom.llm.common import saved, texts_of
from grantloom.llm.tokens import WordTokenizer, in_groups

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, place long"
ROWS_A_CHUNK = 50_000


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """The documents' ids, cut into pieces; with_ids: the ids themselves too, as little-endian 32-bit numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.at(vocabulary)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for begin, to in in_groups(texts):
                rows: list[tuple] = []
                for doc_id, ids in zip(ids_of[begin:to], tokenizer.ids(texts[begin:to]), strict=True):
                    ids = np.concatenate([ids.astype(np.uint32), end])
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity].tobytes()
                        crc = zlib.crc32(part)
                        # Where a piece falls among those of its length: scattered, and the same in every run.
                        rows.append((doc_id, k, at, len(part) // 4, crc, zlib.crc32(b"%r %d" % (doc_id, k), crc), *([part] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "place", "ids"][: 7 if with_ids else 6])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where pieces go: (length, first rank, number, first sequence, offset), for pieces of consecutive ranks, each in a
    sequence of its own, one after the other."""
    found: list[tuple[int, int, int, int, int]] = []
    left, rank, new = {n: c for n, c in counts.items() if c}, defaultdict(int), 0
    rooms: dict[int, deque] = defaultdict(deque)  # by what is left of a sequence: (first sequence, number)
    open_: list[int] = []  # the rooms there are, ascending

    def put(length: int, number: int, sequence: int, offset: int) -> None:
        found.append((length, rank[length], number, sequence, offset))
        rank[length] += number
        left[length] -= number

    def keep(room: int, sequence: int, number: int) -> None:
        if room:
            if not rooms[room]:
                insort(open_, room)
            rooms[room].append((sequence, number))

    large = sorted(n for n in left if 3 * n > capacity)
    waiting = list(large)
    while waiting:
        a = waiting[-1]
        if not left[a]:
            waiting.pop()
            continue
        # The longest partner that fits, of those not above a.
        k = bisect_left(waiting, capacity - a + 1) - 1
        while k >= 0 and not left[waiting[k]]:
            del waiting[k]
            k = min(k, len(waiting)) - 1
        b = waiting[k] if k >= 0 else 0
        number = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
        if b and not number:  # one alone is left of a length that would match itself
            smaller = [x for x in waiting[:k] if left[x]]
            b = smaller[-1] if smaller else 0
            number = 1
        put(a, number, new, 0)
        if b:
            put(b, number, new, a)
        keep(capacity - a - b, new, number)
        new += number
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            k = bisect_left(open_, length)
            if k == len(open_):
                # New sequences, as many as these pieces need if they fill them alone.
                fits = capacity // length
                number = math.ceil(left[length] / fits)
                keep(capacity, new, number)
                new += number
                continue
            room = open_[k]
            sequence, number = rooms[room].popleft()
            if not rooms[room]:
                open_.pop(k)
            take = min(number, left[length])
            put(length, take, sequence, capacity - room)
            keep(room - length, sequence, take)
            if number > take:
                if not rooms[room]:
                    insort(open_, room)
                rooms[room].appendleft((sequence + take, number - take))
    return found


def ranked(items: DataFrame) -> DataFrame:
    """Adds rank, from 0, among the pieces of a length; it needs a saved table, as it is read twice."""
    chunks = max(1, math.ceil(items.count() / ROWS_A_CHUNK))
    items = items.withColumn("chunk", F.pmod("place", F.lit(chunks)))
    totals = items.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = totals.select("length", "chunk", (F.sum("n").over(W.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "chunk").orderBy("place", "doc_id", "piece", "ids_crc32"))
    return items.join(before, ["length", "chunk"]).withColumn("rank", F.col("before") + within - 1).drop("chunk", "before")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    items = saved(pieces(docs, vocabulary, capacity, end_id, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    found = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    order = np.lexsort((found[:, 1], found[:, 0]))
    # capacity**2 rows at most, whatever the number of documents.
    placed = spark.sparkContext.broadcast(found[order])
    place = ranked(items)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, sequence, offset = placed.value.T
        span = np.int64(1 << 44)
        keys = length * span + first
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            k = np.searchsorted(keys, batch.column("length").to_numpy() * span + rank, side="right") - 1
            columns = {c: batch.column(c) for c in names} | {"sequence_id": pa.array(sequence[k] + rank - first[k]), "offset": pa.array(offset[k])}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = dict(items.dtypes)
    return place.select(*names, "rank").mapInArrow(put, ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences of pack(with_ids=True): sequence_id, length, ids (little-endian 32-bit) and the pieces' lengths."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select("sequence_id", "length", joined.alias("ids"), F.col("parts.length").alias("lengths"))
