"""SimHash near-dedup by a self-join of the binary trie of fingerprints.

A fingerprint has a bit for each bit of the XXH64 hashes of a text's shingles, repeats included: 1 if more than half of
the hashes have it. Equal fingerprints are one leaf of the trie, with the smallest id of their documents, so copies are never compared.

The trie is joined with itself by going down pairs of nodes together. A pair of nodes at one depth knows by how many bits
their prefixes differ; its children are the pairs of their children, with one more bit where these differ, and a pair that
differs by more than the budget is left with all that lies below it. The upper levels are a table of pairs: as long as the
nodes of a pair hold more than a task should, the pair is replaced by its children's pairs STEP bits further down, found by
joins of node counts. Below, a task has the sorted fingerprints of one pair of nodes and goes down bit by bit, with
ranges of these arrays as nodes, a block of pairs at a time; ranges of few fingerprints are compared outright.
A task keeps no links: it joins what they link (union by the smaller place) and gives one link for each fingerprint that
isn't the smallest of its group, so even dense groups give no more rows than fingerprints. Groups that several tasks found
are put together by their common members.

Null and empty texts, and those of white space only, have fingerprint zero and are linked like any other. Rows that
repeat an id have fingerprints of their own. A row without id takes part; its component is the smallest id of its group,
if any. Texts of any length are gone through in pieces. Extra columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from grantloom.llm.common import drop_saved, pieces_of, saved, texts_of
from grantloom.llm.near_dup import components

BITS, SEED = 64, 42
#: The prefixes of pairs of nodes grow by so many bits at a time.
STEP = 4
#: A task's pair holds at least LEAST fingerprints, and a share of 1 / CELLS of all where that is more.
LEAST, CELLS = 20_000, 2048
#: Pairs of nodes that a task goes down with at a time, and the number of comparisons at which a pair isn't split further.
BLOCK, OUTRIGHT = 100_000, 16
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 16


# ---------------------------------------------------------------- fingerprints


def shingles(text: bytes, n: int) -> Iterator[list[bytes]]:
    """The n-word shingles of a text with A-Z as a-z, space-joined, in lists; of fewer words, the whole sequence is one."""
    before: list[bytes] = []
    whole = True
    for piece in pieces_of(text):
        words = before + piece.lower().split()
        if len(words) >= n:
            yield list(map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)))
            whole = False
        before = words[-(n - 1) :] if n > 1 else []
    if whole and before:
        yield [b" ".join(before)]


def fingerprint(text: bytes, n: int) -> int:
    ones, total = np.zeros(BITS, np.int64), 0
    for some in shingles(text, n):
        hashes = np.fromiter((xxh64_intdigest(x, SEED) for x in some), np.uint64, len(some))
        total += len(hashes)
        for at in range(0, len(hashes), COUNTED):
            ones += np.unpackbits(hashes[at : at + COUNTED].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number, of each document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, shingle) for x in texts_of(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(make, "doc_id long, fp long")


# ---------------------------------------------------------------- one pair of nodes in a task


class Groups:
    """Places that links have joined; each group is known by its smallest place."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, places: np.ndarray) -> np.ndarray:
        up = self.parent[places]
        while not np.array_equal(up, next_up := self.parent[up]):
            up = next_up
        self.parent[places] = up
        return up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def _children(fps: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Where the fingerprints of sorted ranges that share depth bits begin to have a one next."""
    bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
    shared = fps[low] & ~(bit | (bit - np.uint64(1)))
    return np.clip(np.searchsorted(fps, shared | bit), low, high)


def links_within(fps: np.ndarray, left: slice, right: slice, depth: int, differ: int, budget: int) -> Groups:
    """Goes down a pair of nodes, given as the ranges of sorted fingerprints that share their depth bits, whose prefixes differ by
    so many; joins the places of all fingerprints that differ by the budget at most."""
    groups = Groups(len(fps))
    todo = [(depth, *(np.array([x], np.int64) for x in (left.start, left.stop, right.start, right.stop, differ)))]
    while todo:
        depth, a, a_end, b, b_end, far = todo.pop()
        few = ((a_end - a) * (b_end - b) <= OUTRIGHT) | (depth == BITS)
        _compare(fps, groups, a[few], a_end[few], b[few], b_end[few], budget)
        a, a_end, b, b_end, far = (x[~few] for x in (a, a_end, b, b_end, far))
        if not len(a):
            continue
        a_mid, b_mid = _children(fps, a, a_end, depth), _children(fps, b, b_end, depth)
        own = a == b  # a node with itself: its children's pair comes once
        parts = [(a, a_mid, b, b_mid, far), (a_mid, a_end, b_mid, b_end, far), (a, a_mid, b_mid, b_end, far + 1), tuple(x[~own] for x in (a_mid, a_end, b, b_mid, far + 1))]
        below = [np.concatenate(x) for x in zip(*parts, strict=True)]
        keep = (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= budget)
        below = [x[keep] for x in below]
        todo += [(depth + 1, *(x[at : at + BLOCK] for x in below)) for at in range(0, len(below[0]), BLOCK)]
    return groups


def _compare(fps: np.ndarray, groups: Groups, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, budget: int) -> None:
    """Compares all of each range with all of its partner."""
    width, n = b_end - b, (a_end - a) * (b_end - b)
    of = np.repeat(np.arange(len(a)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    left, right = a[of] + k // width[of], b[of] + k % width[of]
    near = np.bitwise_count(fps[left] ^ fps[right]) <= budget
    near &= left != right
    groups.join(left[near], right[near])


# ---------------------------------------------------------------- pairs of nodes as a table


def _prefix(fp: Column, depth: int) -> Column:
    return F.shiftrightunsigned(fp, BITS - depth) if depth else F.lit(0).cast("long")


def node_pairs(leaves: DataFrame, budget: int, cell: int) -> list[tuple[int, DataFrame]]:
    """(depth, pairs): left, right (prefixes, left <= right) and differ, for the pairs of nodes that tasks go down from.
    Together they hold every pair of fingerprints within the budget once. leaves: distinct fingerprints (fp)."""
    spark, found = leaves.sparkSession, []
    open_pairs = spark.range(1).select(F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("right"), F.lit(0).alias("differ"))
    for depth in range(0, BITS + 1, STEP):
        nodes = leaves.groupBy(_prefix(F.col("fp"), depth).alias("node")).agg(F.count("*").alias("n"))
        child, other = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), _parent("node").alias(f"up_{x}")) for x in ("left", "right"))
        if depth:
            above = open_pairs.select(F.col("left").alias("up_left"), F.col("right").alias("up_right"), "differ")
            pairs = above.join(child, "up_left").join(other, "up_right").filter(F.col("left") <= F.col("right"))
            pairs = pairs.withColumn("differ", F.col("differ") + F.bit_count(F.col("left").bitwiseXOR(F.col("right")).bitwiseAND(2**STEP - 1))).filter(F.col("differ") <= budget)
        else:
            pairs = open_pairs.join(child.drop("up_left"), "left").join(other.drop("up_right"), "right")
        pairs = saved(pairs.select("left", "right", "differ", (F.col("n_left") + F.col("n_right") > 2 * cell).alias("large")), "node-pairs")
        large = F.col("large") if depth < BITS else F.lit(False)
        found.append((depth, pairs.filter(~large)))
        open_pairs = pairs.filter(large)
        if not open_pairs.limit(1).count():
            break
    return found


def _parent(node: str) -> Column:
    return F.shiftrightunsigned(node, STEP)


def _descent(depth: int, budget: int) -> Callable[[pa.Table], pa.Table]:
    """What a task does with the fingerprints of a pair of nodes: (a, b), each fingerprint of a group with its smallest."""

    def descend(table: pa.Table) -> pa.Table:
        fps, is_left = table.column("fp").to_numpy().view(np.uint64), table.column("is_left").to_numpy()
        order = np.argsort(fps)  # the left node's prefix is the smaller one
        fps, n = fps[order], int(is_left.sum())
        a, b = slice(0, n), slice(n, len(fps)) if n < len(fps) else slice(0, n)
        own = table.column("left")[0].as_py() == table.column("right")[0].as_py()
        if not own and n == len(fps):
            return pa.table([pa.array([], pa.int64())] * 2, names=["a", "b"])
        groups = links_within(fps, a, b, depth, table.column("differ")[0].as_py(), budget)
        places = np.arange(len(fps))
        roots = groups.roots(places)
        linked = roots != places
        return pa.table([pa.array(fps[roots[linked]].view(np.int64)), pa.array(fps[linked].view(np.int64))], names=["a", "b"])

    return descend


def links(leaves: DataFrame, budget: int, cell: int) -> DataFrame:
    """Links (a, b) of distinct fingerprints that put together all that differ by the budget at most."""
    every = None
    for depth, pairs in node_pairs(leaves, budget, cell):
        placed = leaves.withColumn("node", _prefix(F.col("fp"), depth))
        left = placed.join(pairs, F.col("node") == F.col("left")).select("left", "right", "differ", "fp", F.lit(True).alias("is_left"))
        right = placed.join(pairs.filter(F.col("left") != F.col("right")), F.col("node") == F.col("right")).select("left", "right", "differ", "fp", F.lit(False).alias("is_left"))

        some = left.unionByName(right).groupBy("left", "right").applyInArrow(_descent(depth, budget), "a long, b long")
        every = some if every is None else every.unionByName(some)
    return every


def link_components(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest id that it is linked with, itself
    included), kept (doc_id = component_id)."""
    of_docs = saved(fingerprints(docs, shingle), "fingerprints")
    leaves = saved(of_docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "leaves")
    fps = leaves.select("fp")
    cell = max(LEAST, fps.count() // CELLS)
    found = saved(links(fps, budget, cell), "fp-links")
    roots = components(found)
    rooted = leaves.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = saved(rooted.join(least, "root").select("fp", "component_id"), "fp-components")
    drop_saved(found)
    result = of_docs.join(by_fp, "fp")
    return result.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """The documents that stay: of each group the one with the smallest id; all columns."""
    verdict = link_components(docs.select("doc_id", "text"), shingle, budget)
    gone = saved(verdict.filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
