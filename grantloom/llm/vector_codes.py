"""Vector code compression: a vector becomes one byte for each of its parts, the number of the nearest entry of the part's
codebook, in whole numbers throughout.

Components are scaled and rounded down to integers, and each part's codebook starts as that part of the smallest ids. A
round assigns every part to its nearest entry (squared distance, ties to the lower index) and moves each entry to the mean
of its parts, rounded down. Tasks add up counts and sums of their own rows, so that a round shuffles entries and no vectors,
and only the entries, ENTRIES times the length of a vector, come to the driver.

The nearest entry is found by segment means. A part and an entry are cut into blocks, 1, 2, 4 and so on. What lies between
the means of their blocks, and between the norms of what the means leave over, bounds their distance from below. The exact
distance of the entry with the least coarse bound bounds the nearest from above; entries whose bound, less a margin for
rounding, lies above it are out, and the bounds of the others get finer. Survivors get exact integer distances.

Vectors that are null or hold null or non-finite components are dropped, as are those of another length than the first one's
(that of the smallest id). Parts of a length that PARTS doesn't divide differ by one component. Rows that repeat an id are
vectors of their own; among equal ids the smaller vector comes first, and a null id comes last. With fewer than ENTRIES
vectors there are as many entries. Components are at most LARGEST in size, so that no sum of squares overflows; larger ones
raise an error. An empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantloom.llm.common import saved

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Of a scaled component: squares of differences of 8,192 components then fit into 63 bits.
LARGEST = 1 << 24
#: Of the squared sizes of what is compared: far more than rounding can take from a bound.
MARGIN = 1e-10
#: Rows that are compared with all entries of a codebook at a time.
ROWS = 4096


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and vector of the rows that take part; label is null where the table has none."""
    label = vectors["label"] if "label" in vectors.columns else F.lit(None).cast("int")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), label.alias("label"), vectors["embedding"].alias("vector"))
    bad: Column = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vector").isNotNull() & ~bad)


def integers(lists: pa.ListArray, dim: int) -> np.ndarray:
    """A matrix of scaled components, rounded down."""
    scaled = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a vector has a component beyond {LARGEST / SCALE:.0f}")
    return scaled.astype(np.int64)


def cuts(dim: int) -> list[tuple[int, int]]:
    """Where each part begins and ends."""
    return [(k * dim // PARTS, (k + 1) * dim // PARTS) for k in range(PARTS)]


def _blocks(width: int) -> Iterator[np.ndarray]:
    """The edges of 1, 2, 4, ... blocks of a part, as long as a block has two components."""
    n = 1
    while 2 * n <= width:
        yield np.arange(n + 1) * width // n
        n *= 2


def _segments(x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's block sums over the roots of their lengths, and the norm of what the blocks' means leave over."""
    sizes = np.diff(edges)
    sums = np.add.reduceat(x, edges[:-1], axis=1)
    rest = (x * np.repeat(sizes, sizes) - np.repeat(sums, sizes, axis=1)) / np.repeat(sizes, sizes)
    return sums / np.sqrt(sizes), np.sqrt((rest**2).sum(axis=1))


class Codebook:
    """The entries of one part, with their segments from coarse to fine."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.norms = (entries.astype(np.float64) ** 2).sum(axis=1)
        self.levels = [(edges, *_segments(entries, edges)) for edges in _blocks(entries.shape[1])]

    def distances(self, x: np.ndarray, rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
        return ((x[rows] - self.entries[entries]) ** 2).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row, the index of its nearest entry and the squared distance."""
        found = [self._nearest(x[at : at + ROWS]) for at in range(0, len(x), ROWS)]
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = len(self.entries)
        rows, entries = np.repeat(np.arange(len(x)), k), np.tile(np.arange(k), len(x))
        slack = MARGIN * ((x.astype(np.float64) ** 2).sum(axis=1)[:, None] + self.norms)
        least = None
        for edges, sums, rests in self.levels:
            own_sums, own_rests = _segments(x, edges)
            if least is None:
                bound = ((own_rests[:, None] - rests) ** 2 + ((own_sums[:, None, :] - sums) ** 2).sum(axis=2) - slack).ravel()
                best = bound.reshape(len(x), k).argmin(axis=1)
                least = self.distances(x, np.arange(len(x)), best)
            else:
                bound = (own_rests[rows] - rests[entries]) ** 2 + ((own_sums[rows] - sums[entries]) ** 2).sum(axis=1) - slack[rows, entries]
            left = bound <= least[rows]
            rows, entries = rows[left], entries[left]
        exact = self.distances(x, rows, entries)
        # The entry that gave the upper bound is always among the survivors, so each row has some.
        order = np.lexsort((entries, exact, rows))
        first = order[np.flatnonzero(np.diff(rows[order], prepend=-1))]
        return entries[first], exact[first]


def first_entries(vectors: DataFrame) -> np.ndarray | None:
    """The integers of the ENTRIES smallest ids; None of an empty table."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = vectors.orderBy(*order).limit(1).select(F.size("vector").alias("dim")).collect()
    if not first:
        return None
    dim = first[0]["dim"]
    chosen = [r["vector"] for r in vectors.filter(F.size("vector") == dim).orderBy(*order).limit(ENTRIES).select("vector").collect()]
    return integers(pa.array(chosen, pa.list_(pa.float64())), dim).reshape(len(chosen), dim)


def moved(vectors: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The entries after a round: the means of the parts assigned to them, rounded down; unused ones stay."""
    dim, k = entries.shape[1], len(entries)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(entries[:, a:b]) for a, b in cuts(dim)]
        sums, counts = np.zeros((dim, k), np.int64), np.zeros((PARTS, k), np.int64)
        for batch in batches:
            x = integers(batch.column(0), dim)
            for part, ((a, b), book) in enumerate(zip(cuts(dim), books, strict=True)):
                codes, _ = book.nearest(x[:, a:b])
                counts[part] += np.bincount(codes, minlength=k)
                for j in range(a, b):  # a batch's sums are whole numbers far below 2**53
                    sums[j] += np.bincount(codes, x[:, j], minlength=k).astype(np.int64)
        part_of = np.repeat(np.arange(PARTS), [b - a for a, b in cuts(dim)])
        place, entry = np.nonzero(counts[part_of] if dim else np.zeros((0, k)))
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(sums[place, entry]), pa.array(counts[part_of[place], entry])], names=["place", "entry", "total", "n"])

    totals = vectors.select("vector").mapInArrow(add, "place int, entry int, total long, n long")
    after = entries.copy()
    for r in totals.groupBy("place", "entry").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        after[r["entry"], r["place"]] = r["total"] // r["n"]
    return after


def digest(entries: np.ndarray) -> str:
    """SHA-256 of the components as decimals, by part, entry and place within the part."""
    return sha256(",".join(str(x) for a, b in cuts(entries.shape[1]) for row in entries[:, a:b].tolist() for x in row).encode()).hexdigest()


def encoded(vectors: DataFrame, entries: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (the squared distances, summed over parts)."""
    dim = entries.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(entries[:, a:b]) for a, b in cuts(dim)]
        for batch in batches:
            x = integers(batch.column(2), dim)
            codes, error = np.zeros((len(batch), PARTS), np.uint8), np.zeros(len(batch), np.int64)
            for part, ((a, b), book) in enumerate(zip(cuts(dim), books, strict=True)):
                codes[:, part], far = book.nearest(x[:, a:b]) if b > a else (0, 0)
                error += far
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([text[at : at + 2 * PARTS] for at in range(0, len(text), 2 * PARTS)], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(assign, f"vec_id long, label {label}, code string, error long")


def codebooks(vectors: DataFrame) -> np.ndarray | None:
    """The entries after ROUNDS rounds over usable() vectors, a row for each; None of an empty table."""
    entries = first_entries(vectors)
    if entries is not None:
        of_length = vectors.filter(F.size("vector") == entries.shape[1])
        for _ in range(ROUNDS if entries.shape[1] else 0):
            entries = moved(of_length, entries)
    return entries


def compressed(table: DataFrame) -> DataFrame:
    """One row per vector that takes part: vec_id, label, code, error, label_error (the errors of its label's vectors,
    summed), codebooks_sha256."""
    vectors = usable(table)
    entries = codebooks(vectors)
    if entries is None:
        label = vectors.schema["label"].dataType.simpleString()
        return table.sparkSession.createDataFrame([], f"vec_id long, label {label}, code string, error long, label_error long, codebooks_sha256 string")
    rows = saved(encoded(vectors.filter(F.size("vector") == entries.shape[1]), entries), "codes")
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(entries)).alias("codebooks_sha256"))
