"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic and one on ordinary text.

Both are trained alike, by zstandard's own trainer, on equal numbers of bytes of the texts' distinct windows, at every
size of the sample. A window's distance is what the toxic dictionary saves: its compressed length with the ordinary
dictionary less that with the toxic one. How many of a document's windows reach each of THRESHOLDS decides: a logistic
curve weighs them and makes the score, so that 0.5 is the calibrated threshold of whole documents. It is calibrated on windows that the dictionaries weren't trained on: the sample is halved,
and each half is measured with dictionaries of the other one; the dictionaries that score are then trained on both.

What is fitted sees SAMPLE labelled documents at most (the bound for each label), chosen by a hash of their ids, and
SAMPLE_WORDS words of each, in blocks spread over the whole text, so that what passes the driver is bounded; of groups of
copies one is used, so that copied passages don't count as toxic speech.

Whole texts are scored. Nothing but text is an input of a score. Null and empty texts have no window and get the score
of a text without suspect windows. Without both labels in the sample every score is the share of toxic ones in it (0
without labels). Rows that repeat an id are scored each; of a repeated id the sample has one text, and an id with several
labels counts as toxic. All columns are kept; an input's own score and predicted give way to the new ones in scored(), and
are kept by without_toxic(). Scoring shuffles nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantloom.llm.common import only, texts_of

#: Labelled documents used for fitting, toxic ones and ordinary ones, and words of each.
SAMPLE, SAMPLE_WORDS = (2000, 6000), 2000
#: Words in a window when texts are scored, and when dictionaries are trained.
WORDS_A_WINDOW, WORDS_A_SAMPLE = 1, 8
#: Bytes that the toxic dictionary saves in a window.
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8)
#: The trainer's options: bytes of a dictionary, of the segments it is made of, and of what these must share with the samples.
DICTIONARY, SEGMENT, SHARED = 112_640, 16, 6
#: Windows that a worker keeps the distances of; most are words met before.
KEPT_WINDOWS = 500_000
#: Stands before and after each window and ends both dictionaries: every window then has a match, so that zstandard never
#: stores it raw, and its last word isn't within the bytes at the end that zstandard doesn't match.
_PAD = bytes([5, 6, 7, 8, *range(14, 32), 127, 5, 7, 14, 16, 18, 5, 8, 15, 18])
_PLAIN = bytes.maketrans(bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]), b" " * 32)


def plain_words(text: bytes) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.decode("utf-8", "replace").lower().encode().translate(_PLAIN).split()


def joined(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def windows(words: list[bytes], width: int = WORDS_A_WINDOW, step: int | None = None) -> list[bytes]:
    return [joined(words[k : k + width]) for k in range(0, len(words), step or width)]


def spread(words: list[bytes], most: int, block: int = WORDS_A_SAMPLE) -> list[bytes]:
    """So many words at most, in blocks at even distances over the whole text."""
    if len(words) <= most:
        return words
    starts = np.linspace(0, len(words) - block, max(1, most // block)).astype(int).tolist()
    return [w for k in starts for w in words[k : k + block]]


class _Copies:
    """Tells documents that share a lot with one seen before, by two minimum hashes of their shingles."""

    def __init__(self) -> None:
        self.seen: set[tuple[int, int]] = set()

    def fresh(self, words: list[bytes]) -> bool:
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
        keys = [(k, min(zlib.crc32(x, 7919 * k) for x in shingles)) for k in range(2)]
        new = not any(k in self.seen for k in keys)
        self.seen.update(keys)
        return new


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: list[float] = field(default_factory=list)
    prior: float = 0.0

    def compressors(self):
        import zstandard as zs

        # Long matches only, all places of the dictionary searched: a window's distance then comes from words, not chance.
        how = zs.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=9, min_match=5, target_length=64, strategy=zs.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)

        def made(raw: bytes):
            words = zs.ZstdCompressionDict(raw + _PAD, dict_type=zs.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=how)
            return zs.ZstdCompressor(dict_data=words, compression_params=how)

        return made(self.toxic), made(self.ordinary)


def _samples(texts: list[list[bytes]]) -> list[bytes]:
    """Distinct windows in the order of a hash: the trainer gives up after a run of text that it knows, which one long
    document of few phrases would be."""
    return sorted({w for x in texts for w in windows(x, WORDS_A_SAMPLE)}, key=lambda w: (zlib.crc32(w), w))


def trained(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """Both dictionaries' bytes, trained on equal numbers of bytes, and as long as DICTIONARY or half of these."""
    import zstandard as zs

    groups = [_samples(toxic), _samples(ordinary)]
    most = min(sum(map(len, group)) for group in groups)
    found = []
    for group in groups:
        some = [w for w, end in zip(group, np.cumsum([len(w) for w in group]).tolist(), strict=True) if end <= most]
        try:
            found.append(zs.train_dictionary(max(256, min(DICTIONARY, most // 2)), some, k=SEGMENT, d=SHARED, f=20).as_bytes())
        except zs.ZstdError:  # the trainer takes no handful of windows
            found.append(b"".join(some)[:DICTIONARY])
    return found[0], found[1]


class Distances:
    """What the toxic dictionary saves in each window of some words, in bytes."""

    def __init__(self, model: Model):
        self.toxic, self.ordinary = model.compressors()
        self.known: dict[bytes, int] = {}

    def _of(self, window: bytes) -> int:
        padded = _PAD + window + _PAD[:12]
        found = len(self.ordinary.compress(padded)) - len(self.toxic.compress(padded))
        if len(self.known) >= KEPT_WINDOWS:
            self.known.clear()
        self.known[window] = found
        return found

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        return np.array([known[x] if x in known else self._of(x) for x in windows(words)], np.int64)


def features(d: np.ndarray) -> list[float]:
    """Of a document's distances: the largest, their mean, and how many and which share of its windows reach each threshold."""
    if not len(d):
        return [0.0] * (3 + 2 * len(THRESHOLDS))
    top = np.sort(np.maximum(d, 0))[::-1]
    reached = (d[:, None] >= np.array(THRESHOLDS)).sum(axis=0)
    return [float(min(top[0], 12)), float(min(top[:2].sum(), 20)), float(np.clip(d.mean(), -1, 2)), *np.log1p(reached).tolist(), *(10 * reached / len(d)).tolist()]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5) -> np.ndarray:
    """Weights, the last one the constant; the penalty keeps them finite where the labels can be told apart."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-9)[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(texts: list[list[bytes]], labels: list[int]) -> Model:
    """From a bounded sample of labelled texts, as words."""
    copies, toxic, ordinary = _Copies(), [], []
    for words, label in zip(texts, labels, strict=True):
        if words and copies.fresh(words):
            (toxic if label else ordinary).append(words)
    share = sum(labels) / len(labels) if labels else 0.0
    if len(toxic) < 2 or len(ordinary) < 2:
        return Model(prior=share)
    rows: list[list[float]] = []
    marks: list[float] = []
    for half in (0, 1):
        distances = Distances(Model(*trained(toxic[1 - half :: 2], ordinary[1 - half :: 2])))
        for label, group in ((1.0, toxic[half::2]), (0.0, ordinary[half::2])):
            rows += [features(distances(x)) for x in group]
            marks += [label] * len(group)
    return Model(*trained(toxic, ordinary), _logistic(np.array(rows), np.array(marks)).tolist(), share)


def sample(docs: DataFrame, labels: DataFrame, use: Column, bound: tuple[int, int] = SAMPLE, most_words: int = SAMPLE_WORDS) -> tuple[list[list[bytes]], list[int]]:
    """Words and labels of so many toxic and ordinary documents at most, by a hash of their ids. use: over doc_id, which
    labels may be learnt from."""
    picked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).filter(use & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    picked = picked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64(F.lit(5), "doc_id"), F.col("doc_id")]
    ids = [picked.filter(F.col("toxic") == k).orderBy(*order).limit(n) for k, n in ((1, bound[0]), (0, bound[1]))]
    ids = docs.sparkSession.createDataFrame([tuple(r) for part in ids for r in part.collect()], "wanted long, toxic int")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [b" ".join(spread(plain_words(t), most_words)) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(some, pa.binary())], names=["doc_id", "toxic", "words"])

    met = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("wanted")).select("doc_id", "toxic", "text")  # sum(bound) ids at most
    rows = met.mapInArrow(words, "doc_id long, toxic int, words binary").groupBy("doc_id", "toxic").agg(F.min("words").alias("words"))
    found = sorted(((r["doc_id"], bytes(r["words"]), r["toxic"]) for r in rows.toLocalIterator()), key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    return [r[1].split() for r in found], [r[2] for r in found]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, then score (0 to 1) and predicted."""
    docs = docs.drop("score", "predicted")
    names = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("windows")
        distances = Distances(model) if model.weights else None
        weights = np.array(model.weights)
        for batch in batches:
            if distances:
                x = np.array([features(distances(plain_words(t))) + [1.0] for t in texts_of(batch.column("text"))])
                scores = 1 / (1 + np.exp(-np.clip(x.reshape(-1, len(weights)) @ weights, -30, 30)))
            else:
                scores = np.full(len(batch), model.prior)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    return docs.mapInArrow(score, f"{kinds}, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, use: Column, bound: tuple[int, int] = SAMPLE) -> DataFrame:
    """The documents that the classifier doesn't reject; all their columns."""
    model = fit(*sample(docs, labels, use, bound))
    plain = docs.toDF(*[f"c{k}" if c != "text" else c for k, c in enumerate(docs.columns)])
    return scored(plain, model).filter(F.col("predicted") == 0).drop("score", "predicted").toDF(*docs.columns)
