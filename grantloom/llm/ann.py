"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a long string of digits: the vector is rotated at random; the first digit is its largest
coordinate, by place and sign (cross-polytope hashing), and BITS binary digits follow, the signs of the coordinates after
that place. A tree is its strings, sorted. A query enters a tree at its own first digit and at those next to it, which are
the places of its next largest coordinates, and descends from each to the strings that share its longest prefix. From
there it ascends, one digit at a time and in all trees at once, until all trees together hold the wanted number of
candidates (repeats over trees counted) or the first digits are reached. If these hold fewer, it goes on ascending by
entering at twice as many first digits, and so on up to all of them, which is the root. Of n vectors FACTOR * n ** POWER are
wanted, at every n. Candidates are scored exactly.

A tree is spread over tasks by the first digit, and a digit that many vectors share is dealt over as many shares as its
count asks for, each a sorted array of its own, so no task holds more than about SHARE vectors at once; a query visits all
shares of its digits. Counts by prefix are added up over trees, entries and shares before any candidate is scored, so that
the ascent is the same for all. A prefix is long enough only if one task holds more than k distinct ids there, so copies
of a few ids never leave a query short; a query without such a task goes to the root, where all vectors are, in blocks,
and its neighbours are exact.

POWER is below 1, so a query's work grows more slowly than the table. FACTOR and POWER are set by vectors without any
structure, whose neighbours are hardly nearer than others (the README has figures); on vectors with structure fewer do. A
tree holds each vector once, in the precision that it comes in.

Vectors that are null, zero or hold null or non-finite components take no part; rows that repeat an id are separate
candidates, and none of them is a candidate for its own id. Vectors are scaled by a power of two before they are measured,
so that no finite one is too large or too small. Vectors of other lengths than the query's are no candidates. Ties go to
the smaller id. An empty table or one without queries gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from grantloom.llm.common import saved

TREES, ENTRIES, BITS, SHARE = 16, 16, 24, 20_000
FACTOR, POWER = 3.0, 0.82
#: More than two ways to compute the same cosine differ by.
ROUNDING = 1e-9


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, vector: the usable ones, each packed as little-endian floats (doubles if they come as such)."""
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)  # a null is not a number
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            some = np.concatenate([[0], np.cumsum(values != 0)])
            good = (bad[ends] == bad[ends - sizes]) & (some[ends] > some[ends - sizes]) & np.asarray(batch.column(0).is_valid())
            raw, width = values.tobytes(), values.itemsize
            rows = np.flatnonzero(good)
            packed = [raw[width * a : width * b] for a, b in zip((ends - sizes)[rows].tolist(), ends[rows].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(sizes[rows].astype(np.int32)), pa.array(packed, pa.binary())], names=["vec_id", "dim", "vector"])

    values = vectors["embedding"] if kind == "<f4" else vectors["embedding"].cast("array<double>")
    return vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), values.alias("embedding")).mapInArrow(make, "vec_id long, dim int, vector binary")


def rotation(dim: int, tree: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([tree, dim, 97])).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Rotations(dict):
    """The rotation of each (dim, tree), made when it is asked for."""

    def __missing__(self, key: tuple[int, int]) -> np.ndarray:
        self[key] = rotation(*key)
        return self[key]


def binary_digits(y: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of rotated vectors, the signs of the coordinates after a place of each, as one number."""
    rows, bits = np.arange(len(y)), np.zeros(len(y), np.int64)
    for k in range(1, BITS + 1):  # a vector of few coordinates has the rest as zeros
        bits = 2 * bits + (y[rows, (places + k) % y.shape[1]] > 0 if k < y.shape[1] else 0)
    return bits


def strings(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rotated vectors, the first digit, 2 * place + sign of the largest coordinate, and the binary ones."""
    top = np.abs(y).argmax(axis=1)
    return 2 * top + (y[np.arange(len(y)), top] > 0), binary_digits(y, top)


def entries(y: np.ndarray) -> np.ndarray:
    """Of a rotated vector, all first digits, in the order in which a query enters at them: the places of its coordinates by
    size and with their signs, then with the other ones."""
    places = np.argsort(-np.abs(y), kind="stable")
    own = 2 * places + (y[places] > 0)
    return np.concatenate([own, own[::-1] ^ 1])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    x = np.frombuffer(raw, "<f4" if len(raw) == 4 * dim * len(column) else "<f8").reshape(-1, dim).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        part = batch.filter(pa.array(dims == dim))
        yield dim, part, _units(_matrix(part.column("vector"), dim))


def hashed(vectors: DataFrame, trees: int, with_vector: bool) -> DataFrame:
    """A row per vector and tree: tree, d1 (first digit), rest (the binary ones), dim, vec_id, salt (and vector)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = Rotations()
        for batch in batches:
            for dim, part, x in _by_dim(batch):
                for tree in range(trees):
                    first, rest = strings(x @ turned[dim, tree])
                    columns = [pa.array(np.full(len(x), tree, np.int32)), pa.array(first), pa.array(rest), part.column("dim"), part.column("vec_id"), part.column("salt")]
                    yield pa.RecordBatch.from_arrays(columns + ([part.column("vector")] if with_vector else []), names=["tree", "d1", "rest", "dim", "vec_id", "salt", "vector"][: 6 + with_vector])

    return vectors.select("vec_id", "dim", "vector", "salt").mapInArrow(make, "tree int, d1 long, rest long, dim int, vec_id long, salt long" + ", vector binary" * with_vector)


def asked(queries: DataFrame, counts: dict[tuple[int, int], np.ndarray], trees: int, wanted: Callable[[int], float]) -> DataFrame:
    """A row per query, tree and entry: tree, d1, rest, dim, vec_id, vector, wanted. counts: vectors by (dim, tree) and first
    digit; wanted: candidates, of the number of vectors of the query's length."""
    goals = {dim: math.ceil(wanted(int(n.sum()))) for (dim, tree), n in counts.items() if tree == 0}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = Rotations()
        for batch in batches:
            for dim, part, x in _by_dim(batch):
                ys = [x @ turned[dim, tree] for tree in range(trees)]
                ids, packed = part.column("vec_id").to_pylist(), part.column("vector").to_pylist()
                for k in range(len(x)):
                    ways = np.array([entries(y[k]) for y in ys])
                    held = np.array([counts[dim, tree][ways[tree]] for tree in range(trees)]).sum(axis=0).cumsum()
                    n = min(ENTRIES, 2 * dim)
                    while n < 2 * dim and held[n - 1] < goals[dim]:
                        n = min(2 * n, 2 * dim)
                    columns = [np.repeat(np.arange(trees, dtype=np.int32), n), ways[:, :n].ravel(), np.concatenate([binary_digits(np.repeat(y[k : k + 1], n, axis=0), ways[tree, :n] // 2) for tree, y in enumerate(ys)])]
                    keep = np.concatenate([counts[dim, tree][ways[tree, :n]] for tree in range(trees)]) > 0
                    size = int(keep.sum())
                    yield pa.RecordBatch.from_arrays([*[pa.array(c[keep]) for c in columns], pa.array([dim] * size, pa.int32()), pa.array([ids[k]] * size, pa.int64()), pa.array([packed[k]] * size, pa.binary()), pa.array([goals[dim]] * size, pa.int64())], names=["tree", "d1", "rest", "dim", "vec_id", "vector", "wanted"])

    return queries.select("vec_id", "dim", "vector").mapInArrow(make, "tree int, d1 long, rest long, dim int, vec_id long, vector binary, wanted long")


def _prefixes(rest: np.ndarray, length: int) -> np.ndarray:
    """The first digits of a string, length of them in all (the one before the binary ones counts)."""
    return rest >> (BITS + 1 - length)


def _grouped(own: DataFrame, asks: DataFrame, shares: DataFrame) -> DataFrame:
    """Deals vectors over tree, dim, first digit and share; queries go to every share of a digit."""
    key = ["tree", "dim", "d1"]
    own = own.join(shares, key).withColumn("share", F.pmod("salt", F.col("shares"))).withColumn("asks", F.lit(False)).drop("shares", "salt")
    asks = asks.join(shares, key).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).withColumn("asks", F.lit(True)).drop("shares")
    return own.unionByName(asks, allowMissingColumns=True)


def depths(keys: DataFrame, asks: DataFrame, shares: DataFrame, k: int) -> DataFrame:
    """vec_id of each query, length of the prefix where it stops (0: the root) and candidates: over all trees, at that length."""
    lengths = range(1, BITS + 2)

    def count(rows: pa.Table) -> pa.Table:
        asking, rest, ids = (rows.column(c).to_numpy() for c in ("asks", "rest", "vec_id"))
        order = np.flatnonzero(~asking)
        order = order[np.argsort(rest[order], kind="stable")]
        tree, own, ask = rest[order], ids[order], rest[asking]
        repeated = len(np.unique(own)) < len(own)
        known: dict[tuple[int, int], int] = {}

        def distinct(low: int, high: int) -> int:
            if (low, high) not in known:
                known[low, high] = len(np.unique(own[low:high]))
            return known[low, high]

        counts, ample = [], np.zeros(len(ask), np.int64)
        for length in lengths:
            array, wanted = _prefixes(tree, length), _prefixes(ask, length)
            low, high = np.searchsorted(array, wanted, "left"), np.searchsorted(array, wanted, "right")
            counts.append(high - low)
            several = np.array([distinct(*x) for x in zip(low.tolist(), high.tolist(), strict=True)], np.int64) if repeated else high - low
            ample[several > k] = length  # the longest so far: shorter prefixes hold no less
        return pa.table([pa.array(ids[asking]), rows.column("wanted").filter(pa.array(asking)), pa.array(ample), *[pa.array(c.astype(np.int64)) for c in counts]], names=["query_id", "wanted", "ample", *[f"n{j}" for j in lengths]])

    dealt = _grouped(keys, asks, shares)
    counted = dealt.groupBy("tree", "dim", "d1", "share").applyInArrow(count, "query_id long, wanted long, ample long, " + ", ".join(f"n{j} long" for j in lengths))
    totals = counted.groupBy("query_id").agg(F.max("wanted").alias("wanted"), F.max("ample").alias("ample"), *[F.sum(f"n{j}").alias(f"n{j}") for j in lengths])
    # Counts fall with the length, so the number of lengths with enough is the longest of them.
    enough = F.greatest(F.lit(1), sum((F.col(f"n{j}") >= F.col("wanted")).cast("int") for j in lengths))
    return totals.select(F.col("query_id").alias("vec_id"), F.least(enough, "ample").cast("int").alias("length"), F.coalesce(*[F.when(F.least(enough, "ample") == j, F.col(f"n{j}")) for j in lengths], F.lit(0).cast("long")).alias("candidates"))


def _reaching(near: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of all cosines not below the k-th largest one of distinct ids, by more than rounding: ties are never cut."""
    size = 2 * k + 20
    while size < len(near):
        top = np.argpartition(-near, size)[:size]
        top = top[np.argsort(-near[top], kind="stable")]
        first = np.sort(np.unique(ids[top], return_index=True)[1])
        if len(first) >= k:
            return np.flatnonzero(near >= near[top[first[k - 1]]] - ROUNDING)
        size *= 4
    return np.arange(len(near))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, trees: int = TREES, factor: float = FACTOR, power: float = POWER) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine). is_query: over vec_id."""
    usable = saved(valid(vectors).withColumns({"query": F.coalesce(is_query, F.lit(False)), "salt": F.xxhash64("vec_id", "vector")}), "vectors")
    keys = saved(hashed(usable, trees, False), "strings")
    # A row per tree, dimension and first digit: trees * 2 * dimension rows for each dimension, whatever the number of vectors.
    by_digit = saved(keys.groupBy("tree", "dim", "d1").agg(F.count("*").alias("n")), "digits")
    counts: dict[tuple[int, int], np.ndarray] = {}
    for r in by_digit.collect():
        counts.setdefault((r["dim"], r["tree"]), np.zeros(2 * r["dim"], np.int64))[r["d1"]] = r["n"]
    shares = by_digit.select("tree", "dim", "d1", F.ceil(F.col("n") / SHARE).cast("long").alias("shares"))
    asks = saved(asked(usable.filter("query"), counts, trees, lambda n: factor * n**power), "asks")
    levels = depths(keys, asks.drop("vector"), shares, k)
    # A query that no entry has anything for isn't counted: it goes to the root as well.
    levels = saved(usable.filter("query").select("vec_id").distinct().join(levels, "vec_id", "left").select("vec_id", F.coalesce("length", F.lit(0)).alias("length")), "levels")

    def score(rows: pa.Table) -> pa.Table:
        dim, asking = rows.column("dim")[0].as_py(), rows.column("asks").to_numpy()
        every = _matrix(rows.column("vector"), dim)
        ids, rest, depth = (rows.column(c).to_numpy() for c in ("vec_id", "rest", "length"))
        order = np.flatnonzero(~asking)
        order = order[np.argsort(rest[order], kind="stable")]
        array, own, x = rest[order], ids[order], every[order]
        units = _units(x)
        found: list[tuple] = []
        for q in np.flatnonzero(asking).tolist():
            low, high = 0, len(array)
            if depth[q] > 1:
                prefix, wanted = _prefixes(array, int(depth[q])), _prefixes(rest[q : q + 1], int(depth[q]))[0]
                low, high = int(np.searchsorted(prefix, wanted, "left")), int(np.searchsorted(prefix, wanted, "right"))
            some = np.flatnonzero(own[low:high] != ids[q]) + low
            if not len(some):
                continue
            some = some[_reaching(units[some] @ _units(every[q : q + 1])[0], own[some], k)]
            exact = (x[some] * every[q]).sum(axis=1) / (np.sqrt((x[some] * x[some]).sum(axis=1)) * math.sqrt(float((every[q] * every[q]).sum())))
            best = np.lexsort((own[some], -exact))
            best = best[np.sort(np.unique(own[some][best], return_index=True)[1])[:k]]  # an id counts once, by its best row
            found += [(int(ids[q]), int(own[some[b]]), float(exact[b])) for b in best]
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    names = ["tree", "dim", "d1", "share", "rest", "vec_id", "vector", "length", "asks"]
    in_trees = _grouped(hashed(usable, trees, True).withColumn("length", F.lit(0)), asks.join(levels.filter("length > 0"), "vec_id"), shares).select(*names)
    n_root = levels.filter(F.col("length") == 0).count()
    rows = in_trees
    if n_root:
        n_blocks = max(1, math.ceil(usable.count() / SHARE))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
        shape = {"tree": F.lit(-1), "d1": F.lit(0).cast("long"), "rest": F.lit(0).cast("long"), "length": F.lit(0)}
        at_root = usable.filter("query").join(levels.filter(F.col("length") == 0).select("vec_id"), "vec_id", "left_semi")
        root_queries = at_root.select("dim", "vec_id", "vector", every.alias("share"), F.lit(True).alias("asks")).withColumns(shape)
        root_rows = usable.select("dim", "vec_id", "vector", F.pmod("salt", F.lit(n_blocks)).alias("share"), F.lit(False).alias("asks")).withColumns(shape)
        rows = rows.unionByName(root_rows.select(*names)).unionByName(root_queries.select(*names))
    scored = rows.groupBy("tree", "dim", "d1", "share").applyInArrow(score, "query_id long, vec_id long, score double")
    once = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
