"""An n-gram language model in an Elias-Fano trie, memory-mapped by the tasks that score with it.

Tokens are words with A-Z in lower case and, after each text, one end. The first level has every word of the training
texts, by a 63-bit hash, with its count; a word's number is its rank. Level n has, for each context, the words that
followed it. A context is an entry of level n - 1 (a word's number on level 2, where a text's beginning is one more), and
its successors lie side by side, in the range from its pointer to the next one's. A successor is told by its place among the
successors of the shorter context, the one without its first word (its number on level 2): a few bits, however large the
vocabulary. Pointers ascend, and successors do when each context's begin where the one before it ended, so both are
Elias-Fano sequences. To find an n-gram, its context's pointers are read, then what the sequence stood at before its
range, and the successor is searched from there, within the range. With each entry lies its count, and a smoothed log
probability in 8 bits.

Smoothing: p(w) = (c(w) + 1) / (N + V + 1), and p(w | context) = (c(context w) + MU * p(w | shorter context)) / (c(context)
+ MU), with an own MU for each level. An n-gram that the trie doesn't have gets MU / (c(context) + MU) times the shorter
one's probability.

Counting covers all training texts. Tasks count their own tokens first; n-grams travel as compressed blocks of sorted
numbers, dealt by ranges of contexts. A context that a third of all tokens share has as many rows as it has successors
that differ, for each task that met them. The model is never gathered: every level is written and read in parts, whose
list alone (a row each) passes the driver. A task opens a part when it first looks for something there.

Texts are split into words twice: for the first level, and then to write every text's word numbers to a table, which the
other levels and the scores are made from. A row of that table has consecutive texts of about 4 MB together, or one longer
text.

Null and empty texts have the end alone. Rows that repeat an id count as often as they come. If there is nothing to
learn from, N and V are 0 and every token has probability 1. Extra columns are not looked at. The number of entries of a
level times the largest number of successors must be below 2**64; training stops with an error otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantloom.llm import files
from grantloom.llm.common import only, release, saved, scratch, texts_of, word_hashes
from grantloom.llm.elias_fano import EliasFano, read_arrays, write_arrays
from grantloom.llm.tokens import in_groups

#: How much the shorter context counts on each level from the second one on; there are as many levels.
MU = (50.0, 5.0)
END = np.uint64(0x2545F4914F6CDD1D >> 1)
#: Tokens that a task gathers before it counts them, and about as many in a part of a level.
HELD = 2_000_000
STEPS = 255


def tokens(text: bytes) -> np.ndarray:
    return np.append(word_hashes(text, fold=True) >> np.uint64(1), END)


def counted(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each comes."""
    if counts is None:
        found, n = np.unique(values, return_counts=True)
        return found, n.astype(np.int64)
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


class _Counter:
    """Counts arrays of numbers; holds what it has counted so far, and HELD numbers more."""

    def __init__(self) -> None:
        self.new: list[np.ndarray] = []
        self.size = 0
        self.done = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def add(self, values: np.ndarray) -> None:
        self.new.append(values)
        self.size += len(values)
        if self.size > HELD:
            self.settle()

    def settle(self) -> None:
        if self.new:
            one = counted(np.concatenate(self.new))
            self.done = counted(*(np.concatenate(x) for x in zip(self.done, one, strict=True)))
            self.new, self.size = [], 0


def _texts(batches: Iterator[pa.RecordBatch], column: int, most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    """Consecutive rows with about so many bytes: the batch, the first row and the hashes of each one's tokens."""
    only("digests")
    for batch in batches:
        texts = texts_of(batch.column(column))
        for begin, to in in_groups(texts, most):
            yield batch, begin, [tokens(x) for x in texts[begin:to]]


# ---------------------------------------------------------------- the model


@dataclass
class Parts:
    """Where the parts of a level are."""

    paths: list[str]  # empty: a part without entries
    first: list[int]  # the number of each part's first entry, and of all
    degree: int  # the largest number of successors
    contexts: int

    def of(self, contexts: np.ndarray) -> np.ndarray:
        """The part of each context: ranges of as many contexts each."""
        return contexts * len(self.paths) // self.contexts

    def start(self, k: int) -> int:
        """The first context of a part."""
        return -(-k * self.contexts // len(self.paths))


@dataclass
class Model:
    """What every task needs to open the trie: the parts' places and the totals."""

    n: int
    v: int
    texts: int
    words: list[tuple[str, int, int]]  # path, first number, first hash
    mu: tuple[float, ...]
    levels: list[Parts]  # from the second one on

    @property
    def step(self) -> float:
        return (math.log10(self.n + self.v + 1) + 1) / STEPS

    def quantised(self, logs: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(-logs / self.step), 0, STEPS).astype(np.uint8)


class Words:
    """The first level."""

    def __init__(self, model: Model):
        self.model, self.parts = model, [read_arrays(path) for path, _, _ in model.words]
        self.keys = [EliasFano.from_arrays(x, "keys") for x in self.parts]
        self.first = np.array([x[1] for x in model.words], np.int64)
        self.low = np.array([x[2] for x in model.words], np.int64)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The words' numbers from ascending hashes; -1: unknown."""
        found = np.full(len(keys), -1, np.int64)
        cuts = [*np.searchsorted(keys, self.low.astype(np.uint64)).tolist(), len(keys)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                here = self.keys[k].find(keys[a:b] - np.uint64(self.low[k]))
                found[a:b] = np.where(here >= 0, here + self.first[k], -1)
        return found

    def _of(self, numbers: np.ndarray, name: str, kind) -> np.ndarray:
        found = np.zeros(len(numbers), kind)
        part = np.searchsorted(self.first, numbers, side="right") - 1
        for k in np.unique(part).tolist():
            at = np.flatnonzero(part == k)
            found[at] = self.parts[k][name][numbers[at] - self.first[k]]
        return found

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """How often each word came in training; 0 for -1, the number of texts for V, which stands for a text's beginning."""
        found = np.zeros(len(numbers), np.int64)
        found[numbers == self.model.v] = self.model.texts
        known = np.flatnonzero((numbers >= 0) & (numbers < self.model.v))
        found[known] = self._of(numbers[known], "counts", np.int64)
        return found

    def logs(self, numbers: np.ndarray) -> np.ndarray:
        """The quantised log10 p1."""
        found = np.full(len(numbers), float(self.model.quantised(np.array([-math.log10(self.model.n + self.model.v + 1)]))[0]))
        known = np.flatnonzero(numbers >= 0)
        found[known] = self._of(numbers[known], "logs", np.uint8)
        return -found * self.model.step


def _each(parts: np.ndarray) -> Iterator[tuple[int, slice | np.ndarray]]:
    """The parts that come, and where."""
    if not len(parts):
        return
    order = None if (parts[1:] >= parts[:-1]).all() else np.argsort(parts, kind="stable")
    cuts = np.flatnonzero(np.diff(parts if order is None else parts[order], prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(parts)], strict=True):
        yield (int(parts[a]), slice(a, b)) if order is None else (int(parts[order[a]]), order[a:b])


class Part:
    """A part of a level: for each of a range of contexts a pointer to its successors, the successors, counts and logs."""

    def __init__(self, found: dict[str, np.ndarray]):
        self.counts, self.logs = found["counts"], found["logs"]
        self.pointers, self.successors = (EliasFano.from_arrays(found, x) for x in ("pointers", "successors"))

    @staticmethod
    def arrays(context: np.ndarray, successor: np.ndarray, contexts: int, counts: np.ndarray, logs: np.ndarray) -> dict[str, np.ndarray]:
        """From entries sorted by context and successor. contexts: how many there are, counted from 0; some may have none."""
        pointers = np.searchsorted(context, np.arange(contexts + 1))
        starts = np.flatnonzero(np.diff(context, prepend=-1))
        ends = np.append(starts[1:], len(context))
        # Each context's successors begin one above the last of the context before.
        base = np.concatenate([[0], np.cumsum(successor[ends - 1] + 1)])
        ascending = successor + np.repeat(base[:-1], ends - starts)
        found = {"counts": counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else np.int64), "logs": logs}
        for name, values, top in (("pointers", pointers, len(context) + 1), ("successors", ascending, int(base[-1]))):
            found |= EliasFano.of(values, top).arrays(name)
        return found

    def ranges(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where successors begin and end, and what the sequence counts from there."""
        begin, end = self.pointers.two(context)
        base = np.zeros(len(context), np.int64)
        later = np.flatnonzero(begin > 0)
        base[later] = self.successors.at(begin[later] - 1) + 1
        return begin, end, base

    def find(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries' places here, -1 where there is none, and their places among their context's. Contexts ascend."""
        first = np.flatnonzero(np.diff(context, prepend=-1))
        times = np.diff(np.append(first, len(context)))
        begin, end, base = (np.repeat(x, times) for x in self.ranges(context[first]))
        place = self.successors.find(base + successor)
        there = (place >= begin) & (place < end)
        return np.where(there, place, -1), np.where(there, place - begin, -1)

    def entry(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context and successor of entries."""
        context = self.pointers.below(places + 1) - 1
        return context, self.successors.at(places) - self.ranges(context)[2]


class Level:
    """A level from the second one on; its parts are opened when they are first asked for."""

    def __init__(self, parts: Parts):
        self.parts, self.first, self.open = parts, np.array(parts.first, np.int64), {}

    def part(self, k: int) -> Part:
        if k not in self.open:
            self.open[k] = Part(read_arrays(self.parts.paths[k]))
        return self.open[k]

    def find(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries' numbers, -1 where the trie has none, and their places among their context's successors. Contexts ascend."""
        found, among = np.full(len(context), -1, np.int64), np.full(len(context), -1, np.int64)
        for k, at in _each(self.parts.of(context)):
            if self.parts.paths[k]:
                here, among[at] = self.part(k).find(context[at] - self.parts.start(k), successor[at])
                found[at] = np.where(here >= 0, here + self.first[k], -1)
        return found, among

    def begins(self, context: np.ndarray) -> np.ndarray:
        """The number of the first successor of contexts that have any."""
        found = np.zeros(len(context), np.int64)
        for k, at in _each(self.parts.of(context)):
            found[at] = self.part(k).pointers.at(context[at] - self.parts.start(k)) + self.first[k]
        return found

    def _of(self, numbers: np.ndarray) -> Iterator[tuple[int, slice | np.ndarray, np.ndarray]]:
        for k, at in _each(np.searchsorted(self.first, numbers, side="right") - 1):
            yield k, at, numbers[at] - self.first[k]

    def entries(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        context, successor = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        for k, at, places in self._of(numbers):
            context[at], successor[at] = self.part(k).entry(places)
            context[at] += self.parts.start(k)
        return context, successor

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        found = np.zeros(len(numbers), np.int64)
        for k, at, places in self._of(numbers):
            found[at] = self.part(k).counts[places]
        return found

    def steps(self, numbers: np.ndarray) -> np.ndarray:
        found = np.zeros(len(numbers), np.int64)
        for k, at, places in self._of(numbers):
            found[at] = self.part(k).logs[places]
        return found


class Trie:
    """All levels that a model has so far. Level 1 is words, by number."""

    def __init__(self, model: Model):
        self.model, self.words = model, Words(model)
        self.levels = {n: Level(parts) for n, parts in enumerate(model.levels, 2)}

    def shorter(self, n: int, numbers: np.ndarray) -> np.ndarray:
        """The numbers, on level n - 1, of the same entries without their first word."""
        context, successor = self.levels[n].entries(numbers)
        return successor if n == 2 else self.levels[n - 1].begins(self.shorter(n - 1, context)) + successor

    def counts(self, n: int, numbers: np.ndarray) -> np.ndarray:
        return self.words.counts(numbers) if n == 1 else self.levels[n].counts(numbers)

    def logs(self, n: int, numbers: np.ndarray) -> np.ndarray:
        return self.words.logs(numbers) if n == 1 else -self.levels[n].steps(numbers) * self.model.step

    def walk(self, number: np.ndarray, starts: np.ndarray, depth: int, valued: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For n from 1: (n, context, successor, there, counts, logs) of the n-gram that each token of some texts ends, from
        the tokens' numbers as words (-1: unknown) and where texts start. Context and successor are -1 where there is none.
        valued: there is whether the trie has it, with its count and log probability (0 without it; on level 1 those of any
        word). The last n is depth, a level that the trie need not have and that gives no counts from level 2 on."""
        size, among, none = len(number), number, np.zeros(0)
        values = (none, none)
        if valued:
            each, back = np.unique(number, return_inverse=True)
            values = self.words.counts(each)[back], self.words.logs(each)[back]
        yield 1, np.zeros(size, np.int64), among, number >= 0, *values
        for n in range(2, depth + 1):
            context = np.concatenate([[-1], number[:-1]])
            context[starts] = self.model.v if n == 2 else -1
            successor = among
            if n not in self.levels:
                yield n, context, successor, none, none, none
                return
            number, among = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
            at = np.flatnonzero((context >= 0) & (successor >= 0))
            span = np.uint64(max(1, int(successor.max(initial=0)) + 1))
            both, back = np.unique(context[at].astype(np.uint64) * span + successor[at].astype(np.uint64), return_inverse=True)
            each, places = self.levels[n].find((both // span).astype(np.int64), (both % span).astype(np.int64))
            number[at] = each[back]
            if n < depth:
                among[at] = places[back]
            counts, logs = none, none
            if valued:
                there = np.flatnonzero(each >= 0)
                found, logs = np.zeros(len(each)), np.zeros(size)
                found[there] = self.logs(n, each[there])
                logs[at] = found[back]
            if valued and n < depth:
                found, counts = np.zeros(len(each), np.int64), np.zeros(size, np.int64)
                found[there] = self.levels[n].counts(each[there])
                counts[at] = found[back]
            yield n, context, successor, number >= 0, counts, logs


NUMBERED = "learn boolean, ids array<long>, sizes array<long>, numbers binary"


def _numbered(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Rows (learn, doc_id, text) as rows of NUMBERED: several texts that learn or several that don't, each token's number
    as a word plus one (0: unknown), by byte place and compressed."""
    import zstandard as zs

    press, known = zs.ZstdCompressor(level=1), Words(model)
    kind = np.dtype("<u4" if model.v < 2**32 - 1 else "<u8")
    for batch, begin, rows in _texts(batches, 2):
        keys, back = np.unique(np.concatenate(rows), return_inverse=True)
        numbers = (known.numbers(keys) + 1).astype(kind)[back]
        sizes = np.array([len(x) for x in rows], np.int64)
        learn, ids = batch.column(0).slice(begin, len(rows)).to_numpy(zero_copy_only=False).astype(bool), batch.column(1).slice(begin, len(rows))
        of = np.repeat(learn, sizes)
        for kept in (True, False):
            if (learn == kept).any():
                raw = press.compress(numbers[of == kept].view(np.uint8).reshape(-1, kind.itemsize).T.tobytes())
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids.filter(pa.array(learn == kept)), pa.array(sizes[learn == kept]))]
                yield pa.RecordBatch.from_arrays([pa.array([kept]), *lists, pa.array([raw], pa.binary())], names=["learn", "ids", "sizes", "numbers"])


def _numbers(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """From each row of NUMBERED: ids, sizes and the tokens' numbers as words, -1 for unknown ones."""
    import zstandard as zs

    press = zs.ZstdDecompressor()
    kind = np.dtype("<u4" if model.v < 2**32 - 1 else "<u8")
    for batch in batches:
        for k in range(batch.num_rows):
            planes = np.frombuffer(press.decompress(batch.column(3)[k].as_py()), np.uint8).reshape(kind.itemsize, -1)
            numbers = np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64) - 1
            yield batch.column(1)[k].values, batch.column(2)[k].values.to_numpy(), numbers


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _blocks(keys: np.ndarray, counts: np.ndarray, span: int, parts: Parts) -> Iterator[tuple[int, bytes]]:
    """Ascending keys (context * span + successor) and their counts, by part: differences and counts by byte place, compressed."""
    import zstandard as zs

    press = zs.ZstdCompressor(level=1)
    for k, at in _each(parts.of((keys // np.uint64(span)).astype(np.int64))):
        steps = np.diff(keys[at], prepend=np.uint64(0)).astype("<u8")
        raw = np.concatenate([steps.view(np.uint8).reshape(-1, 8).T.ravel(), counts[at].astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()])
        yield k, press.compress(raw.tobytes())


def _unblocked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard as zs

    planes = np.frombuffer(zs.ZstdDecompressor().decompress(raw), np.uint8).reshape(12, -1)
    steps = np.ascontiguousarray(planes[:8].T).view("<u8").ravel()
    with np.errstate(over="ignore"):
        return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(planes[8:].T).view("<u4").ravel().astype(np.int64)


def train(docs: DataFrame, learn: Column, mu: tuple[float, ...] = MU) -> Model:
    """The model of the documents that learn (over doc_id) picks. mu: one for each level from the second one on."""
    return _trained(docs.filter(learn), F.lit(True), mu)[0]


def trained_scores(docs: DataFrame, learn: Column, mu: tuple[float, ...] = MU) -> DataFrame:
    """What scored() gives for all documents by the model of those that learn picks; both read the same word numbers."""
    model, numbers = _trained(docs, learn, mu)
    return numbers.mapInArrow(lambda batches: _score(batches, model), SCORED)


def base_scores(docs: DataFrame, learn: Column) -> DataFrame:
    """What trained_scores() gives besides score, which alone needs the levels from the second one on: the first is all
    that is counted and written. Every text is split twice, to count its words and to look them up; no numbers are saved."""
    texts = docs.filter(F.coalesce(learn, F.lit(False))).select(docs["text"].cast("string"))
    return scored(docs, _words(texts, (), scratch(docs.sparkSession, "ngram"))).drop("score")


def _trained(docs: DataFrame, learn: Column, mu: tuple[float, ...]) -> tuple[Model, DataFrame]:
    """The model, and the table of all documents' word numbers."""
    rows = docs.select(F.coalesce(learn, F.lit(False)).alias("learn"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    folder = scratch(docs.sparkSession, "ngram")
    model = _words(rows.filter("learn").select("text"), mu, folder)
    numbers = saved(rows.mapInArrow(lambda batches: _numbered(batches, model), NUMBERED), "numbers")
    for n in range(2, len(mu) + 2 if model.n else 2):
        model.levels.append(_level(numbers.filter("learn"), model, n, folder))
    return model, numbers


def _words(texts: DataFrame, mu: tuple[float, ...], folder: str) -> Model:
    """The model with its first level alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for _, _, rows in _texts(batches, 0):
            counter.add(np.concatenate(rows))
        counter.settle()
        keys, n = counter.done
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000])], names=["key", "n"])

    words = saved(texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("key") == int(END), F.col("n"))).alias("texts")).first()
    model = Model(total["n"] or 0, total["v"], total["texts"] or 0, [], mu, [])
    if not model.n:
        return model

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        if len(table):
            keys, n = table.column("key").to_numpy().astype(np.uint64), table.column("n").to_numpy()
            path = files.fresh_name(folder, "words", ".ef")
            logs = np.log10((n + 1) / (model.n + model.v + 1))
            write_arrays(path, EliasFano.of(keys - keys[0], int(keys[-1] - keys[0]) + 1).arrays("keys") | {"counts": n.astype(np.uint32 if n.max() < 2**32 else np.int64), "logs": model.quantised(logs), "low": keys[:1].astype(np.int64)})
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([path]), pa.array([len(keys)], pa.int64()), pa.array([int(keys[0])], pa.int64())], names=["part", "path", "n", "low"])

    parts = saved(words.repartitionByRange(max(1, math.ceil(model.v / HELD * 4)), "key").sortWithinPartitions("key").mapInArrow(write_words, "part long, path string, n long, low long"), "words-manifest")
    first = 0
    for row in parts.orderBy("part").collect():  # a row per part
        model.words.append((row["path"], first, row["low"]))
        first += row["n"]
    return model


def _level(texts: DataFrame, model: Model, n: int, folder: str) -> Parts:
    """Counts the n-grams of texts (as NUMBERED) and writes them; the model has the levels before."""
    n_parts = max(1, math.ceil(model.n / HELD))
    mu = model.mu[n - 2]
    span = model.v if n == 2 else model.levels[-1].degree
    contexts = model.v + 1 if n == 2 else model.levels[-1].first[-1]
    if span * contexts >= 2**64:
        raise ValueError(f"level {n} has too many contexts and successors")
    ranges = Parts([""] * n_parts, [], 1, contexts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, counter = Trie(model), _Counter()

        def out() -> pa.RecordBatch:
            counter.settle()
            blocks = list(_blocks(*counter.done, span, ranges))
            counter.done = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], names=["part", "block"])

        for _, sizes, numbers in _numbers(batches, model):
            for _, context, successor, *_ in trie.walk(numbers, _starts(sizes), n):
                pass
            at = np.flatnonzero((context >= 0) & (successor >= 0))
            counter.add(context[at].astype(np.uint64) * np.uint64(span) + successor[at].astype(np.uint64))
            if len(counter.done[0]) > 2 * HELD:
                yield out()
        yield out()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, part, held = None, None, []

        def done() -> pa.RecordBatch:
            keys, counts = counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            context, successor = (keys // np.uint64(span)).astype(np.int64), (keys % np.uint64(span)).astype(np.int64)
            each, back = np.unique(context, return_inverse=True)
            shorter = successor if n == 2 else trie.levels[n - 1].begins(trie.shorter(n - 1, each))[back] + successor
            logs = np.log10((counts + mu * 10 ** trie.logs(n - 1, shorter)) / (trie.counts(n - 1, each)[back] + mu))
            path = files.fresh_name(folder, f"level{n}-{part:06d}", ".ef")
            write_arrays(path, Part.arrays(context - ranges.start(part), successor, ranges.start(part + 1) - ranges.start(part), counts, model.quantised(logs)))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(keys)], pa.int64()), pa.array([int(np.bincount(back).max())], pa.int64())], names=["part", "path", "n", "degree"])

        for batch in batches:
            for to, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                trie = trie or Trie(model)
                if to != part and held:
                    yield done()
                    held = []
                part = to
                held.append(_unblocked(block))
        if held:
            yield done()

    blocks = texts.mapInArrow(count, "part int, block binary").repartition(n_parts, "part").sortWithinPartitions("part")
    written = {r["part"]: r for r in saved(blocks.mapInArrow(write, "part int, path string, n long, degree long"), f"level{n}-manifest").collect()}  # a row per part
    release(texts.sparkSession)
    first = np.cumsum([0, *[written[k]["n"] if k in written else 0 for k in range(n_parts)]]).tolist()
    return Parts([written[k]["path"] if k in written else "" for k in range(n_parts)], first, max([1, *[r["degree"] for r in written.values()]]), contexts)


SCORED = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.lit(False), docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return rows.mapInArrow(lambda batches: _score(_numbered(batches, model), model), SCORED)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Rows of SCORED from rows of NUMBERED."""
    trie = Trie(model) if model.n else None
    for ids, sizes, numbers in _numbers(batches, model):
        starts = _starts(sizes)
        known, base, logs = _token_logs(trie, numbers, starts) if trie else [np.zeros(len(numbers)) for _ in range(3)]
        sums = [np.add.reduceat(x, starts) for x in (known, base, logs)]
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(sizes), model.n, np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _token_logs(trie: Trie, numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every token: whether it is known, its base and its log10 probability."""
    model = trie.model
    for n, _, _, there, counts, logs in trie.walk(numbers, starts, len(model.levels) + 1, valued=True):
        if n == 1:
            known, base, found = (counts > 0).astype(np.int64), np.log10((counts + 1) / (model.n + model.v + 1)), logs
        else:
            # What the level doesn't have backs off; a context that it doesn't have says nothing.
            mu = model.mu[n - 2]
            found = np.where(there, logs, found + np.log10(mu / (context_counts + mu)))
        if n <= len(model.levels):
            context_counts = np.concatenate([[0], counts[:-1]])
            context_counts[starts] = model.texts if n == 1 else 0
    return known, base, found
