"""Substring dedup with a log-structured index of window fingerprints.

A window is a run of consecutive words. The index is a folder of sorted runs that are never changed, and a manifest that
names them; it can be opened again and extended. Runs are of two kinds, both one row per hash with the smallest document
that has it:

- prints: a window's fingerprint is the smallest hash among the shorter runs of words (grams) that it holds. Equal windows
  have equal fingerprints, and neighbouring windows mostly share theirs, so there is one for about fourteen words.
- windows: 128-bit digests of the windows' own bytes, for fingerprints that more than one document has.

A batch of documents becomes a run of prints, which is merge-joined with those there are. That tells which fingerprints
are shared, and which earlier documents held one that nobody shared until now; the windows of both are read from their
texts. The batch's windows are then merge-joined with the runs of windows: a window goes out of a document if a smaller
id has its digest, that is the same words. Two runs of a level are merged into one of the next level (compaction), so
there are only as many runs as the logarithm of the number of batches.

A batch is judged against the documents before it and itself; a document that came earlier keeps what it kept then.
Windows are judged on the input, not on what is left. Null and empty texts have no words and come back as the digest of
nothing. A row without id is neither removed from nor a reason to remove. Rows that repeat an id are one document for
the others and don't remove each other's words. Nothing is sampled, and no window, document or group is left out. Hot
passages meet in partial aggregates (one row per hash and task); joins on them are split by Spark's skew handling. Extra
columns are kept by without_repeated_passages(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantloom.llm.common import drop_saved, hashes_of, list_folder, only, release, remove, run_hashes, saved, scratch, texts_of, words_of

WINDOW, GRAM = 50, 25
_GRAM_BASE = 0x9E3779B97F4A7C15
_HASHES = {"prints": ["print"], "windows": ["w1", "w2"]}


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The minimum of each k neighbours: of what is left of the one block of k that they touch, and of what they have of the next."""
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    blocks = np.concatenate([x, np.full(-len(x) % k, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, k)
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(left[:n], right[k - 1 : k - 1 + n])


def prints(words: list[bytes], window: int, gram: int) -> np.ndarray:
    """The fingerprint of each window of a text's words."""
    if len(words) < window:
        return np.zeros(0, np.int64)
    return sliding_min(run_hashes(hashes_of(words), gram, _GRAM_BASE), window - gram + 1).view(np.int64)


class Windows:
    """A text's windows: their fingerprints, and the digests of those that are asked for."""

    def __init__(self, text: bytes, window: int, gram: int):
        self.window = window
        self.words = text.split()
        self.prints = prints(self.words, window, gram)

    def digests(self, places: np.ndarray) -> list[bytes]:
        """128-bit digests of the windows that start at these words."""
        if not len(places):
            return []
        joined = b" ".join(self.words)
        sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        ends = np.cumsum(sizes + 1) - 1
        spans = zip((ends - sizes)[places].tolist(), ends[places + self.window - 1].tolist(), strict=True)
        return [blake2b(joined[a:b], digest_size=16).digest() for a, b in spans]


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    return (values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))


def scanned(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """One row per document: doc_id, n_words, whole_sha256 (of the words joined by a space), prints (distinct)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("digests")
        for batch in batches:
            counts, shas, found = [], [], []
            for text in texts_of(batch.column(1)):
                words = text.split()
                counts.append(len(words))
                shas.append(sha256(b" ".join(words)).hexdigest())
                found.append(np.unique(prints(words, window, gram)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(shas), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "n_words", "whole_sha256", "prints"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_words long, whole_sha256 string, prints array<long>")


def windows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """From doc_id, text, shared: the distinct digests (w1, w2) of each row's windows whose fingerprint is shared."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("digests")
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for doc_id, text, shared in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), _lists(batch.column("shared")), strict=True):
                one = Windows(text, window, gram)
                digests = set(one.digests(np.flatnonzero(np.isin(one.prints, shared))))
                found.append((np.full(len(digests), doc_id), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)))
                size += len(digests)
                if size > 100_000:
                    yield out(found)
                    found, size = [], 0
            if found:
                yield out(found)

    def out(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        digests = np.concatenate([d for _, d in found])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _ in found])), pa.array(digests[:, 0]), pa.array(digests[:, 1])], names=["doc_id", "w1", "w2"])

    return texts.select("doc_id", "text", "shared").mapInArrow(make, "doc_id long, w1 long, w2 long")


def cut(texts: DataFrame, window: int, gram: int, with_text: bool = False) -> DataFrame:
    """From doc_id, text, shared, repeated (digests of windows to take out, w1 and w2 in turn): doc_id, whole_sha256,
    n_removed, kept_sha256 (and kept_text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("digests")
        for batch in batches:
            rows = []
            for text, shared, repeated in zip(texts_of(batch.column("text")), _lists(batch.column("shared")), _lists(batch.column("repeated")), strict=True):
                one = Windows(text, window, gram)
                places = np.flatnonzero(np.isin(one.prints, shared))
                raw = repeated.tobytes()
                taken = {raw[k : k + 16] for k in range(0, len(raw), 16)}
                hit = places[np.fromiter((d in taken for d in one.digests(places)), bool, len(places))]
                edge = np.zeros(len(one.words) + 1, np.int64)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(w for w, g in zip(one.words, gone.tolist(), strict=True) if not g)
                rows.append((sha256(b" ".join(one.words)).hexdigest(), int(gone.sum()), sha256(kept).hexdigest(), *([kept.decode("utf-8", "replace")] if with_text else [])))
            names = ["whole_sha256", "n_removed", "kept_sha256", "kept_text"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c) for c in zip(*rows, strict=True)]], names=["doc_id", *names[: 3 + with_text]])

    return texts.select("doc_id", "text", "shared", "repeated").mapInArrow(make, "doc_id long, whole_sha256 string, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


class FingerprintIndex:
    """A folder of runs. FingerprintIndex(spark, folder) opens what is there, or begins a new index."""

    def __init__(self, spark: SparkSession, folder: str, window: int = WINDOW, gram: int = GRAM):
        self.spark, self.folder, self.window, self.gram = spark, folder, window, gram
        self.version = 0
        self.runs: dict[str, list[tuple[int, str]]] = {"prints": [], "windows": []}  # (level, path), newest last
        written = sorted(x for x in list_folder(spark, folder) if x.startswith("manifest-") and "_SUCCESS" in list_folder(spark, f"{folder}/{x}"))
        if written:
            rows = spark.read.parquet(f"{folder}/{written[-1]}").orderBy("place").collect()  # a row per run
            self.version = int(written[-1].rpartition("-")[2])
            shape = {(r["window"], r["gram"]) for r in rows}
            if shape - {(window, gram)}:
                raise ValueError(f"the index has windows and grams of {shape}")
            for r in rows:
                self.runs[r["kind"]].append((r["level"], r["path"]))

    def _run(self, kind: str, rows: DataFrame) -> str:
        path = f"{self.folder}/{scratch(self.spark, kind).rpartition('/')[2]}"
        rows.sortWithinPartitions(*_HASHES[kind]).write.parquet(path)
        return path

    def _rows(self, kind: str) -> Iterator[DataFrame]:
        return (self.spark.read.parquet(path) for _, path in self.runs[kind])

    def _compact(self) -> list[str]:
        """Merges the newest runs while two are of one level; gives the runs that are no longer needed."""
        old = []
        for kind, runs in self.runs.items():
            while len(runs) > 1 and runs[-1][0] == runs[-2][0]:
                pair = [runs.pop(), runs.pop()]
                both = self.spark.read.parquet(pair[0][1]).unionByName(self.spark.read.parquet(pair[1][1]))
                least = [F.min("first_doc").alias("first_doc")]
                again = [((F.count("*") > 1) | F.bool_or("again")).alias("again")] if kind == "prints" else []
                runs.append((pair[0][0] + 1, self._run(kind, both.groupBy(*_HASHES[kind]).agg(*least, *again))))
                old += [path for _, path in pair]
        return old

    def _commit(self) -> None:
        """Runs count once a manifest names them, so that a failed batch leaves the index as it was."""
        old = self._compact()
        self.version += 1
        rows = [(kind, place, level, path, self.window, self.gram) for kind, runs in self.runs.items() for place, (level, path) in enumerate(runs)]
        self.spark.createDataFrame(rows, "kind string, place int, level int, path string, window int, gram int").coalesce(1).write.parquet(f"{self.folder}/manifest-{self.version:08d}")
        for path in old:
            remove(self.spark, path)

    def add(self, batch: DataFrame, earlier: DataFrame | None = None, with_text: bool = False) -> DataFrame:
        """Adds documents (doc_id, text) and returns a row for each: doc_id, n_words, n_removed, kept_sha256, whole_sha256;
        with_text: kept_text too (null if nothing was removed).

        earlier: the documents that the index already has, from which the windows of newly shared fingerprints are read."""
        spark, temporary = self.spark, []
        plain = lambda d: d.select(d["doc_id"].cast("long").alias("doc_id"), d["text"].cast("string").alias("text"))

        def kept(df: DataFrame, name: str) -> DataFrame:
            temporary.append(saved(df, name))
            return temporary[-1]

        if any(self.runs.values()) and earlier is None:
            raise ValueError("the index has documents already; earlier must give them")
        batch = plain(batch)
        base = saved(scanned(batch, self.window, self.gram), "scanned")
        each = base.filter(F.col("doc_id").isNotNull()).select("doc_id", F.explode("prints").alias("print"))
        least, most = F.min("doc_id"), F.max("doc_id")
        new = self._run("prints", each.groupBy("print").agg(least.alias("first_doc"), (least < most).alias("again")))
        run = spark.read.parquet(new)
        shared, found = run.filter("again").select("print"), None
        for old in self._rows("prints"):
            hits = old.join(run.select("print"), "print", "left_semi")
            found = hits if found is None else found.unionByName(hits)
        opened = None
        if found is not None:
            met = kept(found.groupBy("print").agg(F.count("*").alias("runs"), F.bool_or("again").alias("again"), F.min("first_doc").alias("doc_id")), "met")
            shared = shared.unionByName(met.select("print"))
            # What one earlier document had alone: its windows haven't been read yet.
            opened = met.filter((F.col("runs") == 1) & ~F.col("again")).groupBy("doc_id").agg(F.collect_set("print").alias("shared"))
        of = kept(each.join(shared.distinct(), "print", "left_semi").groupBy("doc_id").agg(F.collect_set("print").alias("shared")), "shared-of")
        release(spark)
        texts = kept(batch.join(of, "doc_id"), "texts")
        release(spark)  # the join's shuffle files, before windows are written
        every = kept(windows(texts, self.window, self.gram), "windows")
        first = F.min("doc_id").alias("first_doc")
        added = every.select("w1", "w2", "doc_id")
        if opened is not None:
            added = added.unionByName(windows(plain(earlier).join(opened, "doc_id"), self.window, self.gram).select("w1", "w2", "doc_id"))
        of_windows = self._run("windows", added.groupBy("w1", "w2").agg(first))
        release(spark)
        decided = []
        for old in [spark.read.parquet(of_windows), *self._rows("windows")]:
            # A window that only its own document has is in the new run alone, with that document's id.
            later = every.join(old, ["w1", "w2"]).filter(F.col("doc_id") > F.col("first_doc"))
            decided.append(kept(later.select("doc_id", "w1", "w2"), "repeated"))
            release(spark)
        repeated = decided[0]
        for more in decided[1:]:
            repeated = repeated.unionByName(more)
        repeated = repeated.groupBy("doc_id").agg(F.flatten(F.collect_set(F.array("w1", "w2"))).alias("repeated"))
        changed = saved(cut(texts.join(repeated, "doc_id"), self.window, self.gram, with_text), "cut").dropDuplicates(["doc_id", "whole_sha256"])
        drop_saved(*temporary)
        self.runs["prints"].append((0, new))
        self.runs["windows"].append((0, of_windows))
        self._commit()
        release(spark)
        result = base.select("doc_id", "n_words", "whole_sha256").join(changed, ["doc_id", "whole_sha256"], "left")
        return result.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "whole_sha256", *(["kept_text"] if with_text else []))

    def drop(self) -> None:
        remove(self.spark, self.folder)


def repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = 3, with_text: bool = False) -> DataFrame:
    """One row per document, as FingerprintIndex.add() gives them.

    The documents are indexed in so many batches, by ranges of their ids, as they would be if they came one after the other."""
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    cuts = [int(x) for x in docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.02)] if batches > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    index, results = FingerprintIndex(spark, scratch(spark, "fingerprints"), window, gram), []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        # Rows without id come with the first batch.
        part = docs if high is None else docs.filter((F.col("doc_id") <= high) | F.col("doc_id").isNull())
        part = part if low is None else part.filter(F.col("doc_id") > low)
        results.append(index.add(part, None if low is None else docs.filter(F.col("doc_id") <= low), with_text))
    index.drop()
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found


def without_repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = 3) -> DataFrame:
    """The documents with repeated words taken out of their texts, and n_chars, if there, brought up to date. A text that
    changes has its remaining words joined by one space; other texts stay as they are. Documents of which nothing remains go."""
    result = repeated_passages(docs.select("doc_id", "text"), window, gram, batches, with_text=True)
    changed = saved(result.filter(F.col("n_removed") > 0).select("doc_id", "whole_sha256", "kept_text"), "changed").dropDuplicates(["doc_id", "whole_sha256"])
    inner = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    column = dict(zip(docs.columns, inner.columns, strict=True))
    text, kept = F.col(column["text"]), F.col("kept_text")
    sha = F.sha2(F.array_join(words_of(text), " "), 256)
    both = inner.join(changed, (F.col(column["doc_id"]).cast("long") == F.col("doc_id")) & (sha == F.col("whole_sha256")), "left").filter(kept.isNull() | (kept != ""))
    values = {"text": F.coalesce(kept, text)}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(kept.isNull(), F.col(column["n_chars"])).otherwise(F.length(kept)).cast("long")
    return both.select(*[values.get(c, F.col(column[c])).alias(c) for c in docs.columns])
