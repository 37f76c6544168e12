"""Mixing sources to target weights by weighted fair queueing.

Within each source the documents are put in a shuffled order that only a seed, the id and the text decide. A document is
queued in slices of QUANTUM words, as a queue of packets would be, and a slice's virtual finish time is the source's words
up to and with it, divided by the source's target. A source whose target is above its size goes through its order again,
up to max_epochs times. All slices are globally range-sorted by virtual finish time, words are added up in that order, and
the mix is what comes before the budget, the sum of the targets, is used up; the slice in service then is cut. A document's
share of the mix is what its slices got. So each source's words come within a slice or two of its target.

The running totals never gather a source or the queue in one task. Within a source, documents fall into chunks by their
place in the shuffled order, totals of chunks are summed first (one row per source and chunk), and only rows within a
chunk are sorted; the number of chunks follows the number of rows, so a source with a third of all rows has a third of the
chunks. Over the queue, totals of the sorted partitions are summed first; the one partition where the budget ends is added
up row by row, the ones before it are taken and the ones behind it aren't.

Sources are told apart by their whole text; there is a row for each in the plan of targets, which the driver makes, as the
weights are dealt by the order of all names. Null texts and texts without words have size 0 and take nothing; a null
source is a source of its own, last in the order of weights. Rows that repeat an id are queued one after the other, by
size; they differ in nothing that the result shows. An empty table gives an empty mix. mixed_documents() keeps all columns
of its input, whatever their names.
"""

from __future__ import annotations

import math
from itertools import cycle

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from grantloom.llm.common import SPACE_CLASS, saved

ROWS_A_CHUNK = 20_000
#: Words in a slice of a document.
QUANTUM = 128


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS[1:-1]}]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: list[int], share: float, most: float) -> dict[str | None, float]:
    """Words for each source: the share of all words, dealt by the weights (repeated over the sources by code point,
    null last); none gets above most times its size, and the excess goes to the others by weight, until none is above."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be")))
    open_ = {s: w for (s, _), w in zip(order, cycle(weights), strict=False)}
    size, left, found = dict(sizes), share * sum(n for _, n in sizes), {}
    while open_:
        total = sum(open_.values())
        full = [s for s, w in open_.items() if left * w / total >= most * size[s]]
        if not full:
            return found | {s: left * w / total for s, w in open_.items()}
        for s in full:
            found[s] = float(most * size[s])
            del open_[s]
        left = max(0.0, share * sum(size.values()) - sum(found.values()))
    return found


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """Adds _group (the source) and _place (where the shuffle puts a document; only equal ids and texts share one)."""
    source = docs["source"].cast("string")
    group = F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source))
    return docs.withColumns({"_group": group, "_place": F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"])})


def placed(docs: DataFrame, weights: list[int], share: float, max_epochs: int, seed: int) -> DataFrame:
    """A row per document, without its text: doc_id, _place, _size, _source_size, _target, _group, _chunk and _turn (the
    place in the shuffled order), _same (from 1, among rows of one _place), and _end: the source's words up to and with it."""
    spark = docs.sparkSession
    # A finer split of the shuffled order where there are more rows; places are uniform, so chunks are even.
    chunks = max(1, math.ceil(docs.count() / ROWS_A_CHUNK))
    keyed = _keyed(docs.select("doc_id", "source", "text"), seed)
    sized = keyed.select("doc_id", "_group", "_place", word_count(F.col("text")).alias("_size"), F.pmod(F.shiftrightunsigned("_place", 20), F.lit(chunks)).alias("_chunk"))
    sized = saved(sized, "mix-sizes")
    by_chunk = saved(sized.groupBy("_group", "_chunk").agg(F.sum("_size").alias("_n")), "mix-chunks")
    sizes = [(r["_group"], r["n"]) for r in by_chunk.groupBy("_group").agg(F.sum("_n").alias("n")).collect()]
    name = lambda group: group[1:] if group[0] == "=" else None
    goal = targets([(name(g), n) for g, n in sizes], weights, share, float(max_epochs))
    plan = spark.createDataFrame([(g, n, goal[name(g)]) for g, n in sizes], "_group string, _source_size long, _target double")
    before = by_chunk.withColumn("_before", F.sum("_n").over(W.partitionBy("_group").orderBy("_chunk")) - F.col("_n")).drop("_n").join(plan, "_group")
    within = W.partitionBy("_group", "_chunk")
    order = within.orderBy("_place", "doc_id", "_size")
    found = sized.join(before, ["_group", "_chunk"])
    found = found.withColumn("_turn", F.row_number().over(order)).withColumn("_end", F.col("_before") + F.sum("_size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return found.withColumn("_same", F.row_number().over(W.partitionBy("_group", "_chunk", "_place").orderBy("_turn"))).drop("_before")


def served(queue: DataFrame, max_epochs: int, quantum: int) -> DataFrame:
    """From placed(), written: a row for each copy that gets any words: _group, _chunk, _turn, _copy (from 0), _words (what
    it gets) and _finish (when the last of its slices that get any does)."""
    some = queue.filter((F.col("_size") > 0) & (F.col("_target") > 0))
    # A target per source, added up exactly and rounded half up on the driver: a distributed sum's order follows the partitions.
    budget = math.floor(math.fsum(r["t"] for r in some.groupBy("_group").agg(F.first("_target").alias("t")).collect()) + 0.5)
    start = F.col("_end") - F.col("_size") + F.col("_copy") * F.col("_source_size")
    low = F.col("_slice") * quantum
    high = F.least(low + quantum, F.col("_size"))
    slices = (
        some.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("_copy"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_size") - 1) / quantum))).alias("_slice"))
        .select("_group", "_chunk", "_turn", "_copy", "_slice", (high - low).alias("_n"), ((start + high) / F.col("_target")).alias("_finish"))
    )
    order = ["_finish", "_group", "_chunk", "_turn", "_copy", "_slice"]
    sorted_ = saved(slices.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "mix-queue")
    # A row per partition of the sorted queue.
    left, cut = budget, -1
    for r in sorted_.groupBy("_part").agg(F.sum("_n").alias("n")).orderBy("_part").collect():
        cut = r["_part"]
        if r["n"] > left:
            break
        left -= r["n"]
    else:
        cut += 1  # all are within the budget
    running = F.sum("_n").over(W.partitionBy("_part").orderBy(*order)) - F.col("_n")
    last = sorted_.filter(F.col("_part") == cut).withColumn("_words", F.least(F.col("_n"), F.lit(left) - running)).filter(F.col("_words") > 0)
    taken = sorted_.filter(F.col("_part") < cut).withColumn("_words", F.col("_n")).unionByName(last)
    return taken.groupBy("_group", "_chunk", "_turn", "_copy").agg(F.sum("_words").cast("long").alias("_words"), F.max("_finish").alias("_finish"))


def taken_words(docs: DataFrame, weights: list[int], share: float = 1.5, max_epochs: int = 2, seed: int = 11, quantum: int = QUANTUM) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), first_finish (null if it takes none)."""
    queue = saved(placed(docs, weights, share, max_epochs, seed), "mix-placed")
    got = served(queue, max_epochs, quantum).groupBy("_group", "_chunk", "_turn").agg(F.sum("_words").alias("taken"), F.min("_finish").alias("first_finish"))
    found = queue.join(got, ["_group", "_chunk", "_turn"], "left")
    return found.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_finish")


def mixed_documents(docs: DataFrame, weights: list[int], share: float = 1.5, max_epochs: int = 2, seed: int = 11, quantum: int = QUANTUM) -> DataFrame:
    """The documents as the mix takes them, in its order: a row for each copy that gets at least half of its words.

    The queue is decided without texts; the documents themselves are shuffled once to meet what it decided, and once into
    the mix's order."""
    inner = docs.toDF(*[c if c in ("doc_id", "source", "text") else f"x{k}" for k, c in enumerate(docs.columns)])
    queue = saved(placed(inner, weights, share, max_epochs, seed), "mix-placed")
    got = queue.join(served(queue, max_epochs, quantum), ["_group", "_chunk", "_turn"]).filter(2 * F.col("_words") >= F.col("_size"))
    got = got.select("_group", "_place", "_same", "_chunk", "_turn", "_copy", "_finish")
    wide = _keyed(inner, seed).withColumn("_same", F.row_number().over(W.partitionBy("_group", "_place").orderBy("doc_id")))
    # Rows of one place are told apart by the join's key, so that n of them meet n rows and not n times as many.
    both = wide.join(got, ["_group", "_place", "_same"])
    return both.orderBy("_finish", "_group", "_chunk", "_turn", "_copy").select(*inner.columns).toDF(*docs.columns)
