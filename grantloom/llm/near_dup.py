"""Near duplicates by circulant MinHash: candidates from bands of signatures, links only after exact Jaccard.

A document's set is its distinct shingles, each a 64-bit mix of its words' BLAKE2b digests: shingles that differ agree by
chance only (in two sets of a million, with probability 5e-8), not by any pattern of their letters or words. Two permutations of 32-bit numbers make all coordinates of
its signature: the first scatters the set, the second, circularly shifted by k, gives the k-th minimum. Documents with
equal sets are one class from the start, so copies are never compared. Classes that agree in a band of the signature are
candidates, and never expanded into all pairs: each bucket's most copied class leads it, and the others are compared
with it first. Those that meet a leader are its family. Where a family is still in several components, each member
outside the largest one is compared with all of the family, in blocks of bounded size that give links and no pairs. Every
pair of candidates that could join two components is thus compared on the full sets; no partner, bucket or group is capped.

With 20 bands of 4 rows, a pair at a Jaccard similarity of 0.8 misses all bands with probability 3e-5 (1e-8 at 0.9).

Null and empty texts have no set and are linked with nothing. Rows that repeat an id get the same verdict by their own
text; a row without id takes part and has the smallest id of its component, if any. Extra columns are kept by
without_near_duplicates(). Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantloom.llm.common import drop_saved, mix, only, release, saved, texts_of, word_hashes

BANDS, ROWS = 20, 4
#: Members outside a family's largest component are compared in blocks of about BLOCK, with about CHUNK members at a time.
BLOCK, CHUNK = 64, 4000


@cache
def _factor(place: int) -> np.uint64:
    """An odd number for each place of a shingle, without any relation between them."""
    return np.uint64(int.from_bytes(blake2b(b"%d" % place, digest_size=8, person=b"shingle").digest(), "little") | 1)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of fewer words, the whole sequence is one."""
    if not len(words):
        return words
    k = min(n, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - k + 1, np.uint64(k), np.uint64)
        for j in range(k):
            total += words[j : len(words) - k + 1 + j] * _factor(j)
    return np.unique(mix(total))


def _permuted(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers (murmur3's finaliser)."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(items: np.ndarray, length: int) -> np.ndarray:
    """Circulant MinHash: the minimum over the set of the second permutation, shifted by k places, of the first."""
    with np.errstate(over="ignore"):
        scattered = _permuted((items >> np.uint64(32)).astype(np.uint32) ^ np.uint32(0x5BD1E995))
        shifts = np.arange(length, dtype=np.uint32)[:, None] * np.uint32(0x9E3779B1)  # an odd stride is a shift of relabelled places
        least = None
        for at in range(0, len(scattered), 4096):
            part = _permuted(scattered[None, at : at + 4096] + shifts).min(axis=1)
            least = part if least is None else np.minimum(least, part)
    return least


def band_values(items: np.ndarray) -> np.ndarray:
    rows = signature(items, BANDS * ROWS).astype(np.uint64).reshape(BANDS, ROWS)
    value = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return value.view(np.int64)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, node (a digest of the set; null without one), bands."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("digests")
        for batch in batches:
            sizes, nodes, bands = [], [], []
            for text in texts_of(batch.column(1)):
                items = shingle_set(word_hashes(text, fold=True), shingle)
                sizes.append(len(items))
                nodes.append(blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                bands.append(band_values(items) if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "node", "bands"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(make, "doc_id long, n_shingles long, node binary, bands array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """node and items (the set) of each document that has one."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("digests")
        for batch in batches:
            nodes, sets = [], []
            for text in texts_of(batch.column(0)):
                items = shingle_set(word_hashes(text, fold=True), shingle)
                if len(items):
                    nodes.append(blake2b(items.tobytes(), digest_size=16).digest())
                    sets.append(items.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "items"])

    return docs.select(docs["text"].cast("string")).mapInArrow(make, "node binary, items array<long>")


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node it is linked with, directly or not), for the nodes of links (a, b).

    Labels fall to the neighbours' minimum and then to their own label's label, so that paths shorten by halves; every
    round is written to the shared folder."""
    edges = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root"))
    labels = saved(labels, "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("jumped"))
        step = saved(step.join(jump, "root").select("node", "was", F.col("jumped").alias("root")), "labels")
        moved = step.filter(F.col("was") != F.col("root")).limit(1).count()
        drop_saved(labels)
        labels = step.select("node", "root")
        if not moved:
            drop_saved(edges)
            return labels


def _similar(common, x, y, percent: int):
    return 100 * common >= percent * (x + y - common)


def _tested(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """leader, node and whether their full sets are at least so similar."""
    left = pairs.join(sets.select(F.col("node").alias("leader"), F.col("items").alias("x")), "leader")
    both = left.join(sets.select("node", F.col("items").alias("y")), "node")
    return both.select("leader", "node", _similar(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), percent).alias("linked"))


def _cross_links(family: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a leader's family that are in different components (leader, node, root).

    Every such pair has a member outside the family's largest component. Those members are dealt into blocks and all
    members into chunks; each block meets each chunk in a task of its own, which compares sets and keeps links only."""
    by_root = family.groupBy("leader", "root").agg(F.count("*").alias("n"))
    sizes = by_root.groupBy("leader").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.count("*").alias("roots")).filter(F.col("roots") > 1)
    sizes = sizes.select("leader", "main", F.ceil((F.col("n") - F.col("n_main")) / BLOCK).alias("blocks"), F.ceil(F.col("n") / CHUNK).alias("chunks"))
    # Nothing but a join on the leader, whose large partitions Spark can split: a leader may have a third of all members.
    placed = saved(family.join(sizes, "leader").select("leader", "node", "root", (F.col("root") != F.col("main")).alias("outer"), "blocks", "chunks", F.xxhash64("node").alias("h")), "open")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = placed.select("leader", "node", "root", F.pmod("h", "chunks").alias("chunk"), every("blocks").alias("block"), F.lit(False).alias("outer"))
    outer = placed.filter("outer").select("leader", "node", "root", every("chunks").alias("chunk"), F.pmod("h", "blocks").alias("block"), F.lit(True).alias("outer"))
    rows = members.unionByName(outer).join(sets, "node")

    def compare(table: pa.Table) -> pa.Table:
        only("sets")
        outer, nodes, roots = table.column("outer").to_numpy(), table.column("node").to_pylist(), table.column("root").to_pylist()
        items = table.column("items").combine_chunks()
        ends, values = items.offsets.to_numpy(), items.values.to_numpy()
        own = np.flatnonzero(outer)
        found: list[tuple[bytes, bytes]] = []
        if len(own):
            sizes = ends[own + 1] - ends[own]
            flat = np.concatenate([values[ends[k] : ends[k + 1]] for k in own])
            of = np.repeat(np.arange(len(own)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, of = flat[order], of[order]
            for k in np.flatnonzero(~outer).tolist():
                mine = values[ends[k] : ends[k + 1]]
                low, high = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
                n = high - low
                at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                common = np.bincount(of[at], minlength=len(own))
                for j in np.flatnonzero(_similar(common, sizes, len(mine), percent)).tolist():
                    if roots[own[j]] != roots[k]:
                        found.append((nodes[own[j]], nodes[k]))
        return pa.table([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["a", "b"])

    return rows.groupBy("leader", "block", "chunk").applyInArrow(compare, "a binary, b binary")


def link_components(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that it is linked with, itself included),
    kept (doc_id = component_id)."""
    spark = docs.sparkSession
    sketched = saved(sketches(docs, shingle), "sketches")
    classes = sketched.filter(F.col("node").isNotNull()).groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    bucketed = classes.select("node", "n", "copies", F.explode("bands").alias("bucket"))
    # The most copied class of a bucket leads it: what other members were changed from, more often than not.
    shared = bucketed.groupBy("bucket").agg(F.max(F.struct("copies", "node")).alias("top"), F.count("*").alias("members")).filter(F.col("members") > 1)
    pairs = saved(bucketed.join(shared.select("bucket", F.col("top.node").alias("leader")), "bucket").filter(F.col("leader") != F.col("node")).select("leader", "node").distinct(), "pairs")
    release(spark)
    # The sets of candidates only; a text for each class.
    wanted = pairs.select("node").unionByName(pairs.select(F.col("leader").alias("node"))).distinct()
    wanted_ids = sketched.join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("wanted")).select("wanted").distinct()
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).join(wanted_ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    sets = saved(shingle_sets(texts, shingle).dropDuplicates(["node"]), "sets")
    release(spark)
    tested = saved(_tested(pairs, sets, percent), "tested")
    links = tested.filter("linked").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    roots = components(links)
    family = pairs.unionByName(pairs.select("leader", F.col("leader").alias("node")).distinct()).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    crossed = saved(_cross_links(family, sets, percent).distinct(), "crossed")
    release(spark)
    roots = components(links.unionByName(crossed))
    grouped = sketched.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return grouped.join(least, "root", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay: of each group the one with the smallest id; all columns. Rows that repeat that id stay
    if they are of the same group, as the id is all that tells documents apart."""
    verdict = link_components(docs.select("doc_id", "text"), shingle, percent)
    gone = saved(verdict.filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
