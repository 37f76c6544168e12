"""Cross-tokenizer alignment: where two tokenizers cut a text at the same bytes, and which of their ids meet.

A worker concatenates the ids of a whole run of texts, with the byte offsets where texts end. Prefix sums of token lengths
give the byte at which each token ends; one bincount for each tokenizer marks these ends, and a group ends where both have
one. Texts end in both, so no group crosses a text, and per-text numbers are differences of prefix sums at the texts'
ends. Pairs of ids that share a group are links, taken with their number of occurrences and never for each of these where ids
repeat a lot.

How many documents hold a pair linked is counted over the whole corpus without a row for each document and pair. A task
makes blocks of documents. A block is one row with a sparse matrix of its documents and distinct pairs, compressed, and
the number of its documents with each pair. Those numbers are added up by pair, go back to the blocks by a join, and meet the matrix there. What is
shuffled are a block's distinct pairs, of which there are far fewer than links, and the matrices, once.

Both tokenizers are applied to space-led units of a text: a space that follows a character other than white space begins
a new token for a byte-level BPE whose pattern takes only one leading space, and for a sentencepiece BPE none of whose
pieces has a space behind another character (asserted when the model is opened). Units repeat, so those of a group of texts are
numbered by Arrow, distinct ones are looked up, and each worker keeps the ids of those met lately. A unit of letters and then punctuation is put together from the ids of both, which repeat more often
still, where no token of either vocabulary has a letter and punctuation behind it: no merge can then cross. Texts are gone
through in pieces that end at such a space; memory grows with a text's own ids only.

Texts that are null or empty, or whose tokens' bytes aren't a space and the text for one of the tokenizers, have no
tokens: zeros and an empty hash. Rows that repeat an id are documents of their own. A text without any such space is one
piece. An empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantloom.llm.common import keeps, only, release, saved, texts_of

#: Bytes of text that are aligned at a time, and those of a block.
CHUNK, BLOCK = 1 << 20, 16 << 20
#: Bytes of text whose units are looked up at a time.
GROUP = 8 << 20
#: Units that a worker keeps, of up to so many bytes.
KEPT_UNITS, KEPT_BYTES = 500_000, 64
#: Groups with more links than this are taken by their distinct ids.
MANY = 4096

#: White space: behind it a space need not begin a token.
_WHITE = rb"(?:[\x09-\x0d\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
_ODD, _ODD_END = re.compile(_WHITE + b" "), re.compile(_WHITE + rb"\Z")
_CUT = re.compile(rb"(?<=[!-~]) ")
#: Letters of Latin-1, then ASCII punctuation; and what a token must not hold for these to be independent.
_LETTER, _MARK = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])", rb"[!-/:-@\[-`{-~]"
_LETTERS = string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha())
_SIMPLE = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+[!-/:-@\[-`{-~]+$"
_CROSSES = re.compile(_LETTER + _MARK + rb"|\A[\x80-\xbf]+" + _MARK)


# ---------------------------------------------------------------- ids by units


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def units(piece: bytes) -> list[bytes]:
    """A piece cut where a space begins a token in both tokenizers; each unit has its leading space left out."""
    parts = piece.split(b" ")
    if not (piece.startswith(b" ") or _ODD.search(piece)):
        return parts
    found, run = [], parts[:1]
    for part in parts[1:]:
        if run[-1] and not _ODD_END.search(run[-1][-3:]):
            found.append(b" ".join(run))
            run = []
        run.append(part)
    return [*found, b" ".join(run)]


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about CHUNK bytes, without the spaces that they are cut at; most texts are one."""
    at = 0
    while len(text) - at > 2 * CHUNK and (gap := _CUT.search(text, at + CHUNK)):
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:]


def _in_groups(every: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Consecutive pieces, about GROUP bytes together."""
    group, size = [], 0
    for piece in every:
        group.append(piece)
        size += len(piece)
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


class Pair:
    """Two tokenizers: a byte-level BPE file for the tokenizers library, and a sentencepiece model that puts a space first."""

    _made: dict[tuple[str, str], Pair] = {}

    @classmethod
    def at(cls, first: str, second: str) -> Pair:
        only("pair")
        if (first, second) not in cls._made:
            cls._made[first, second] = cls(first, second)
        return cls._made[first, second]

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        letters, named = byte_letters(), self.a.get_vocab(with_added_tokens=True)
        special = {x.content for x in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * (max(named.values()) + 1)
        for name, k in named.items():
            self.bytes_a[k] = name.encode() if name in special else bytes(letters[x] for x in name)
        #: Tokens that a text's own characters can become.
        plain = [x for name, x in zip(named, map(self.bytes_a.__getitem__, named.values()), strict=True) if name not in special]
        self.bytes_b = []
        for k in range(self.b.get_piece_size()):
            name = self.b.id_to_piece(k)
            if "▁" in name.lstrip("▁"):
                raise ValueError(f"the piece {name!r} has a space behind another character")
            self.bytes_b.append(bytes([int(name[3:5], 16)]) if self.b.is_byte(k) else name.replace("▁", " ").encode())
            if not (self.b.is_control(k) or self.b.is_unknown(k)):
                plain.append(self.bytes_b[-1])
        #: Whether a unit's letters and the punctuation behind them have ids of their own.
        self.apart = not any(map(_CROSSES.search, plain))
        self.space = self.b.piece_to_id("▁")
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        self.long_a, self.long_b = (np.array([len(x) for x in each], np.int64) for each in (self.bytes_a, self.bytes_b))
        #: Each id as text with what follows it in a group: A's ids with a comma, with a bar, then B's with a comma, with a semicolon.
        self.shown = [b"%d%c" % (k, mark) for size, marks in ((self.size_a, b",|"), (self.size_b, b",;")) for mark in marks for k in range(size)]
        #: A's and B's ids of units that are in one part or of their letters, and of punctuation behind letters; and whether their bytes are right.
        self.parts: dict[bytes, tuple[bytes, bytes, bool]] = {}
        self.marks: dict[bytes, tuple[bytes, bytes, bool]] = {b"": (b"", b"", True)}

    def _encode(self, parts: list[bytes], lead: bytes) -> Iterator[tuple[bytes, tuple[bytes, bytes, bool]]]:
        """Each part with its ids. lead: what stands before it, a space or (for punctuation) nothing."""
        texts = [x.decode("utf-8", "replace") for x in parts]
        lists_a = [x.ids for x in self.a.encode_batch_fast([lead.decode() + x for x in texts], add_special_tokens=False)]
        if lead:
            lists_b = [x or [self.space] for x in self.b.encode(texts, num_threads=1)]
        else:  # B puts a space before a text, so a letter stands there and its ids are left out
            first = len(self.b.encode("x"))
            lists_b = [x[first:] for x in self.b.encode(["x" + x for x in texts], num_threads=1)]
        want = [lead + x for x in parts]
        sizes, right, raws = np.cumsum([len(x) for x in want]), True, []
        for lists, named, long in ((lists_a, self.bytes_a, self.long_a), (lists_b, self.bytes_b, self.long_b)):
            ids = np.fromiter(chain.from_iterable(lists), np.uint32)
            upto = np.cumsum([0, *map(len, lists)])
            ends = np.concatenate([[0], np.cumsum(long[ids])])[upto[1:]]
            right = right and np.array_equal(ends, sizes) and b"".join(map(named.__getitem__, ids.tolist())) == b"".join(want)
            raw, upto = ids.tobytes(), (4 * upto).tolist()
            raws.append([raw[begin:end] for begin, end in zip(upto, upto[1:])])
        for k, (part, a, b) in enumerate(zip(parts, *raws, strict=True)):
            yield part, (a, b, right or want[k] == b"".join(self.bytes_a[i] for i in lists_a[k]) == b"".join(self.bytes_b[i] for i in lists_b[k]))

    def _known(self, parts: pa.LargeBinaryArray, kept: dict[bytes, tuple[bytes, bytes, bool]], lead: bytes) -> tuple[pa.LargeListArray, pa.LargeListArray, np.ndarray]:
        """A's and B's ids of distinct parts, and whether their bytes are right."""
        names = parts.to_pylist()
        if len(kept) + len(names) > KEPT_UNITS:
            met = {x: kept[x] for x in [b"", *names] if x in kept}
            kept.clear()
            kept.update(met)
        new = [x for x in names if x not in kept]
        for at in range(0, len(new), 4000):
            kept.update(self._encode(new[at : at + 4000], lead))
        found = [kept[x] for x in names]
        for x in new:
            if len(x) > KEPT_BYTES:
                del kept[x]
        lists = []
        for k in (0, 1):
            raws = [x[k] for x in found]
            upto = np.cumsum(np.fromiter(chain([0], map(len, raws)), np.int64, len(raws) + 1)) // 4
            lists.append(pa.LargeListArray.from_arrays(upto, np.frombuffer(b"".join(raws), np.uint32)))
        return *lists, np.array([x[2] for x in found], bool)

    def ids(self, every: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """For each piece, A's and B's ids of a space and the piece, and whether their bytes are those of each unit."""
        found = [units(x) for x in every]
        upto_units = np.cumsum([0, *map(len, found)])
        each = pa.array(list(chain.from_iterable(found)), pa.large_binary()).dictionary_encode()
        met = each.dictionary.view(pa.large_string())
        simple = pc.match_substring_regex(met, _SIMPLE) if self.apart else pa.array(np.zeros(len(met), bool))
        plain = pc.if_else(simple, met, pa.scalar(None, pa.large_string()))
        parts = pc.coalesce(pc.utf8_rtrim(plain, string.punctuation), met).view(pa.large_binary()).dictionary_encode()
        marks = pc.fill_null(pc.utf8_ltrim(plain, _LETTERS), "").view(pa.large_binary()).dictionary_encode()
        *of_parts, right = self._known(parts.dictionary, self.parts, b" ")
        *of_marks, also = self._known(marks.dictionary, self.marks, b"")
        at_part, at_mark = parts.indices.to_numpy(), marks.indices.to_numpy()
        both = pa.array(np.stack([at_part, at_mark + len(right)], 1).ravel())
        sides = []
        for one, two in zip(of_parts, of_marks, strict=True):
            joined = pa.concat_arrays([one, two]).take(both)
            dealt = pa.LargeListArray.from_arrays(joined.offsets.to_numpy()[::2], joined.values).take(each.indices)
            sides.append((dealt.values.to_numpy(), dealt.offsets.to_numpy()[upto_units].tolist()))
        rights = [True] * len(every)
        if not (right.all() and also.all()):
            wrong = _starts(~(right[at_part] & also[at_mark])[each.indices.to_numpy()])
            rights = (np.diff(wrong[upto_units]) == 0).tolist()
        (a, upto_a), (b, upto_b) = sides
        return [(a[upto_a[k] : upto_a[k + 1]], b[upto_b[k] : upto_b[k + 1]], rights[k]) for k in range(len(every))]

    def of_texts(self, texts: list[bytes]) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each text, of each of its pieces the bytes with the leading space, A's ids and B's; nothing if it has no tokens."""
        cut = [list(pieces(x)) if x else [] for x in texts]
        ids = chain.from_iterable(map(self.ids, _in_groups(chain.from_iterable(cut))))
        found = []
        for text, own in zip(texts, cut, strict=True):
            every = [(len(piece) + 1, *next(ids)) for piece in own]
            if not all(right for *_, right in every) and any(b"".join(named[i] for x in every for i in x[k].tolist()) != b" " + text for k, named in ((1, self.bytes_a), (2, self.bytes_b))):
                every = []
            found.append([x[:3] for x in every])
        return found

    def of_text(self, text: bytes) -> list[tuple[int, np.ndarray, np.ndarray]]:
        return self.of_texts([text])[0]


keeps("pair", Pair._made.clear)


# ---------------------------------------------------------------- alignment of a chunk


@dataclass
class Sums:
    """What a block knows of a document so far."""

    doc_id: int | None
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    sha: object = field(default_factory=sha256)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def aligned(pair: Pair, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many of A's and of B's tokens each group has, and the byte at which it ends. a, b: ids of the same bytes."""
    ends_a, ends_b = np.cumsum(pair.long_a[a]), np.cumsum(pair.long_b[b])
    size = int(ends_a[-1]) + 1 if len(a) else 1
    marks_a, marks_b = np.bincount(ends_a, minlength=size), np.bincount(ends_b, minlength=size)
    cuts = np.flatnonzero((marks_a > 0) & (marks_b > 0))
    upto_a, upto_b = np.cumsum(marks_a)[cuts], np.cumsum(marks_b)[cuts]
    return np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0), cuts


def linked(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """group, pair of ids (a * width + b) and number of occurrences, for all that is linked; pairs may come again."""
    at_a, at_b, n = _starts(n_a), _starts(n_b), n_a * n_b
    many = np.flatnonzero(n > MANY)
    n[many] = 0
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    wide = n_b[of]
    codes = a[at_a[of] + k // wide].astype(np.int64) * width + b[at_b[of] + k % wide]
    groups, found, times = [of], [codes], [np.ones(len(of), np.int64)]
    for g in many.tolist():
        ids_a, times_a = np.unique(a[at_a[g] : at_a[g + 1]], return_counts=True)
        ids_b, times_b = np.unique(b[at_b[g] : at_b[g + 1]], return_counts=True)
        found.append((ids_a.astype(np.int64)[:, None] * width + ids_b).ravel())
        times.append((times_a[:, None] * times_b).ravel())
        groups.append(np.full(len(found[-1]), g))
    return np.concatenate(groups), np.concatenate(found), np.concatenate(times)


def _summed(docs: np.ndarray, codes: np.ndarray, times: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct pairs, by document and pair, with their occurrences. span: more than any pair."""
    keys = docs * span + codes
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first] // span, keys[first] % span, np.add.reduceat(times[order], first) if len(first) else times


class Block:
    """Documents of a task, aligned chunk by chunk."""

    def __init__(self, pair: Pair):
        self.pair, self.docs, self.size = pair, [], 0
        self.texts: list[bytes] = []
        self.bytes_of_texts = 0
        self.waiting: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        self.bytes_waiting = 0
        self.entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, doc_id: int | None, text: bytes) -> None:
        self.docs.append(Sums(doc_id))
        self.texts.append(text)
        self.bytes_of_texts += len(text)
        self.size += len(text)
        if self.bytes_of_texts >= GROUP:
            self._look_up()

    def _look_up(self) -> None:
        """Looks up the waiting texts' units, and aligns them chunk by chunk."""
        first, texts = len(self.docs) - len(self.texts), self.texts
        self.texts, self.bytes_of_texts = [], 0
        for k, found in enumerate(self.pair.of_texts(texts), first):
            for size, a, b in found:
                self.waiting.append((k, size, a, b))
                self.bytes_waiting += size
                if self.bytes_waiting >= CHUNK:
                    self._align()

    def _align(self) -> None:
        if not self.waiting:
            return
        of, sizes, lists_a, lists_b = zip(*self.waiting, strict=True)
        self.waiting, self.bytes_waiting = [], 0
        pair, a, b, of = self.pair, np.concatenate(lists_a), np.concatenate(lists_b), np.array(of)
        n_a, n_b, cuts = aligned(pair, a, b)
        last = np.searchsorted(cuts, np.cumsum(sizes)) + 1  # groups up to the end of each piece
        upto_a, upto_b, upto_links = (_starts(x)[last] for x in (n_a, n_b, n_a * n_b))
        self._show(a, b, n_a, n_b, upto_a + upto_b, of)
        for name, upto in (("n_groups", last), ("n_a", upto_a), ("n_b", upto_b), ("n_links", upto_links)):
            for k, more in zip(of.tolist(), np.diff(upto, prepend=0).tolist(), strict=True):
                setattr(self.docs[k], name, getattr(self.docs[k], name) + more)
        groups, codes, times = linked(a, b, n_a, n_b, pair.size_b)
        docs = np.repeat(of, np.diff(last, prepend=0))[groups]
        self.entries.append(_summed(docs, codes, times, pair.size_a * pair.size_b))

    def _show(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, upto: np.ndarray, of: np.ndarray) -> None:
        """Adds each piece's groups to its document's hash. upto: tokens of both up to the end of each piece."""
        pair = self.pair
        group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[end_a - 1], last_b[end_b - 1] = 1, 1
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + (end_b - n_b)[group_a]] = a + pair.size_a * last_a
        order[np.arange(len(b)) + end_a[group_b]] = 2 * pair.size_a + b + pair.size_b * last_b
        shown = list(map(pair.shown.__getitem__, order.tolist()))
        begin = 0
        for k, end in zip(of.tolist(), upto.tolist(), strict=True):
            doc = self.docs[k]
            if doc.n_groups:
                doc.sha.update(b";")
            doc.sha.update(b"".join(shown[begin:end])[:-1])
            begin = end

    def row(self) -> dict[str, object]:
        """The block as one row."""
        self._look_up()
        self._align()
        span = self.pair.size_a * self.pair.size_b
        docs, codes, times = (np.concatenate(x) for x in zip(*self.entries, strict=True)) if self.entries else [np.zeros(0, np.int64)] * 3
        if len(self.entries) > 1:
            docs, codes, times = _summed(docs, codes, times, span)
        pairs, place = np.unique(codes, return_inverse=True)
        upto = np.searchsorted(docs, np.arange(len(self.docs)), "right")
        matrix = zstandard.compress(b"".join(_planes(x) for x in (np.diff(place, prepend=0), times, np.diff(upto, prepend=0))), 1)
        digests = [x.sha.hexdigest() if x.n_groups else "" for x in self.docs]
        return {
            "doc_id": [x.doc_id for x in self.docs], **{name: [getattr(x, name) for x in self.docs] for name in ("n_a", "n_b", "n_groups", "n_links")}, "groups_sha256": digests,
            "entries": len(place), "matrix": matrix, "pairs": pairs, "docs": np.bincount(place, minlength=len(pairs)),
        }


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, byte by byte: most of these are zero throughout."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view("<i8").ravel()


BLOCKS = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), *((x, pa.list_(pa.int64())) for x in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.list_(pa.string())),
     ("entries", pa.int64()), ("matrix", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))]
)
_BLOCKS = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, entries long, matrix binary, pairs array<long>, docs array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def blocks(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Documents in blocks, a row for each."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block, n = Pair.at(first, second), None, TaskContext.get().partitionId() << 32

        def emitted() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([block.row() | {"block": n}], schema=BLOCKS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                block = block or Block(pair)
                block.add(doc_id, text)
                if block.size >= BLOCK:
                    yield emitted()
                    block, n = None, n + 1
        if block:
            yield emitted()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(make, _BLOCKS)


def pair_counts(of_blocks: DataFrame, width: int) -> DataFrame:
    """pair, count (how many documents hold it linked) and best (whether no pair of its A id has more)."""
    each = of_blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = saved(each.groupBy("pair").agg(F.sum("docs").alias("count")), "pair-counts")
    first = F.expr(f"pair div {width}")
    highest = counts.groupBy(first.alias("a")).agg(F.max("count").alias("highest"))
    return counts.join(highest, first == F.col("a")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _met(block: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a block, with the counts of its pairs (place, count, best) met with its matrix."""
    row = block.to_pylist()[0]
    raw, n, n_docs = zstandard.decompress(row["matrix"]), row["entries"], len(row["doc_id"])
    place, times = np.cumsum(_unplaned(raw, n)), _unplaned(raw[8 * n :], n)
    upto = np.cumsum(_unplaned(raw[16 * n :], n_docs))
    order = counts.column("place").to_numpy()
    count, best = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    count[order], best[order] = counts.column("count").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
    sums = [np.diff(_starts(times * x[place])[upto], prepend=0) for x in (best, count)]
    columns = [row["doc_id"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], *sums, row["groups_sha256"]]
    kinds = [pa.int64()] * 7 + [pa.string()]
    return pa.table([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])


def alignment(docs: DataFrame, first: str, second: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the highest count of its A id),
    count_sum (the counts of its links' pairs), groups_sha256. first, second: the tokenizers' files, see Pair."""
    of_blocks = saved(blocks(docs, first, second), "alignment")
    counts = saved(pair_counts(of_blocks, Pair.at(first, second).size_b), "pair-best")
    release(docs.sparkSession)
    places = of_blocks.select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "pair")).join(counts, "pair").select("of_block", "place", "count", "best")
    whole = of_blocks.drop("pairs", "docs")
    return whole.groupBy("block").cogroup(places.groupBy("of_block")).applyInArrow(_met, RESULT)
