"""Token ids of whole texts by a public tokenizer, with a cache of words inside each task.

Both the normaliser and the pre-tokenizer of the vocabularies used here (NFC, white space, lower case; a pattern that
never crosses white space) work on each run of non-space characters alone, so a text's ids are those of its words one
after the other. Words repeat far more often than texts: a group of texts is split and its distinct words are numbered by
Arrow, only these are looked up, and their ids are dealt out to the places where they stand. Simple words (letters, then
punctuation) are looked up as letters in lower case and as punctuation. Each worker keeps the ids of what it has met, up to a
bound; what isn't kept goes to the tokenizers library, simple parts many at a time: each becomes one run of tokens that ends
with the vocabulary's end-of-word mark.
"""

from __future__ import annotations

import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from grantloom.llm.common import keeps, only

#: Words and parts of words kept by a worker; at about 200 bytes each.
CACHED_WORDS = 800_000
_LETTERS = string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha())
_MARKS = string.punctuation
_SIMPLE = r"^[A-Za-zÀ-ÖØ-öø-ÿ]*[!-/:-@\[-`{-~]*$"


class WordTokenizer:
    """ids(texts) gives an array of ids for each text. vocabulary: the path of a file for the tokenizers library."""

    _made: dict[str, WordTokenizer] = {}

    @classmethod
    def at(cls, vocabulary: str) -> WordTokenizer:
        only("tokens")
        if vocabulary not in cls._made:
            cls._made[vocabulary] = cls(vocabulary)
        return cls._made[vocabulary]

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        pieces = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(pieces.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for piece, i in pieces.items() if piece.endswith("</w>")]] = True
        self.special = {x.content for x in self.tokenizer.get_added_tokens_decoder().values()}
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.cache: dict[bytes, bytes] = {b"": b""}
        #: Whether words can be told apart in the ids of many.
        self.marked = bool(self.ends.any())

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_simple(self, words: list[str]) -> list[bytes]:
        found: list[bytes] = []
        for at in range(0, len(words), 4000):
            some = words[at : at + 4000]
            ids = np.frombuffer(b"".join(self._encode([" ".join(some)])), self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):  # the vocabulary splits words otherwise: one at a time
                found += self._encode(some)
                continue
            raw, upto = ids.tobytes(), [0, *(cuts * ids.itemsize).tolist()]
            found += [raw[begin:end] for begin, end in zip(upto, upto[1:])]
        return found

    def _simple(self, words: pa.LargeStringArray) -> pa.BooleanArray:
        return pc.match_substring_regex(words, _SIMPLE) if self.marked else pa.array(np.zeros(len(words), bool))

    def _learn(self, new: pa.LargeStringArray) -> None:
        simple = self._simple(new)
        for some, encode in ((new.filter(simple), self._encode_simple), (new.filter(pc.invert(simple)), self._encode)):
            words = some.cast(pa.large_binary()).to_pylist()
            for word, ids in zip(words, encode([x.decode("utf-8", "replace") for x in words]), strict=True):
                self.cache[word] = ids

    def _known(self, parts: pa.LargeStringArray) -> pa.LargeListArray:
        """The ids of each of these distinct words or parts."""
        names = parts.cast(pa.large_binary()).to_pylist()
        if len(self.cache) + len(names) > CACHED_WORDS:
            self.cache = {b"": b""} | {x: self.cache[x] for x in names if x in self.cache}
        new = [k for k, x in enumerate(names) if x not in self.cache]
        if new:
            self._learn(parts.take(pa.array(new)))
        found = list(map(self.cache.__getitem__, names))
        upto = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)), out=upto[1:])
        return pa.LargeListArray.from_arrays(upto // np.dtype(self.kind).itemsize, np.frombuffer(b"".join(found), self.kind))

    def _of_words(self, words: pa.LargeStringArray) -> pa.LargeListArray:
        """The ids of each of these distinct words: those of its letters and of its punctuation, or of the whole."""
        plain = pc.if_else(self._simple(words), words, pa.scalar(None, pa.large_string()))
        letters = pc.coalesce(pc.utf8_lower(pc.utf8_rtrim(plain, _MARKS)), words)
        marks = pc.fill_null(pc.utf8_ltrim(plain, _LETTERS), "")
        parts = pa.concat_arrays([letters, marks]).dictionary_encode()
        both = self._known(parts.dictionary).take(pa.array(parts.indices.to_numpy().reshape(2, -1).T.ravel()))
        return pa.LargeListArray.from_arrays(both.offsets.to_numpy()[::2], both.values)

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string())).cast(pa.large_list(pa.large_string()))
        words = split.flatten().dictionary_encode()
        each = self._of_words(words.dictionary).take(words.indices)
        ids, upto = each.values.to_numpy(), each.offsets.to_numpy()[split.offsets.to_numpy()].tolist()
        return [ids[begin:end] for begin, end in zip(upto, upto[1:])]


keeps("tokens", WordTokenizer._made.clear)


def in_groups(texts: list[bytes], most: int = 8_000_000):
    """(from, to) of consecutive texts with about so many bytes, at least one text each."""
    begin, size = 0, 0
    for k, x in enumerate(texts):
        if size and size + len(x) > most:
            yield begin, k
            begin, size = k, 0
        size += len(x)
    if begin < len(texts):
        yield begin, len(texts)
