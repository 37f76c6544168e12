"""Sorted whole numbers as Elias-Fano sequences, searched many at a time, and files of named arrays."""

from __future__ import annotations

import json

import numpy as np

from grantloom.llm import files
from grantloom.llm.bits import pack, unpack


_1, _2, _3, _4, _8, _255 = (np.uint64(k) for k in (1, 2, 3, 4, 8, 255))
_ODD, _PAIRS, _NIBBLES, _BYTES, _TOPS = (np.uint64(int(x * 8, 16)) for x in ("55", "33", "0f", "01", "80"))
#: The place of each one of a byte.
_IN_BYTE = np.array([([k for k in range(8) if byte >> k & 1] + [0] * 8)[:8] for byte in range(256)], np.int64)


class EliasFano:
    """Ascending numbers below some universe: low bits packed, high bits in unary, with counts of the zeros before
    each 64-bit word as a directory. About 3 bits a number and log2(universe / n) low bits."""

    def __init__(self, n: int, low_bits: int, universe: int, lows: np.ndarray, highs: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.universe, self.lows, self.highs, self.zeros = n, low_bits, universe, lows, highs, zeros
        self.ones: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        bits = np.zeros((n + (universe >> low_bits) + 2 + 63) // 64 * 64, bool)
        bits[high + np.arange(n)] = True
        words = np.packbits(bits, bitorder="little").view("<u8")
        zeros = np.concatenate([np.zeros(1, np.int64), np.cumsum(64 - np.bitwise_count(words).astype(np.int64))])
        return cls(n, low_bits, universe, pack(values & np.uint64(2**low_bits - 1), low_bits) if low_bits else np.zeros(1, np.uint64), words, zeros.astype(np.uint32 if zeros[-1] < 2**32 else np.uint64))

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.head": np.array([self.n, self.low_bits, self.universe], np.uint64), f"{name}.lows": self.lows, f"{name}.highs": self.highs, f"{name}.zeros": self.zeros}

    @classmethod
    def from_arrays(cls, found: dict[str, np.ndarray], name: str) -> EliasFano:
        n, low_bits, universe = found[f"{name}.head"].tolist()
        return cls(n, low_bits, universe, *[found[f"{name}.{x}"] for x in ("lows", "highs", "zeros")])

    @staticmethod
    def _place(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Where the rank-th one (from 0) of each 64-bit word is: the ones up to each byte are counted side by side in one
        number, which tells the byte, and a table tells the place within."""
        with np.errstate(over="ignore"):
            ones = words - ((words >> _1) & _ODD)
            ones = (ones & _PAIRS) + ((ones >> _2) & _PAIRS)
            upto = ((ones + (ones >> _4)) & _NIBBLES) * _BYTES
            rank = rank.astype(np.uint64)
            # A byte's top bit stays where the ones up to it are no more than the rank.
            byte = np.bitwise_count((((rank * _BYTES) | _TOPS) - upto) & _TOPS).astype(np.uint64) << _3
            rank = rank - (((upto << _8) >> byte) & _255)
            return byte.astype(np.int64) + _IN_BYTE[((words >> byte) & _255).astype(np.int64), rank.astype(np.int64)]

    def _upto(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have high bits up to these: the place of a zero, less its rank."""
        word = np.searchsorted(self.zeros, high.astype(self.zeros.dtype), side="right") - 1
        return word * 64 + self._place(~self.highs[word], high - self.zeros[word].astype(np.int64)) - high

    def _next(self, bits: np.ndarray, zero: bool) -> np.ndarray:
        """Where the next one (or zero) from each bit on is, if it is in the same 64-bit word; -1 if it isn't."""
        words = self.highs[bits >> 6]
        rest = (~words if zero else words) >> (bits & 63).astype(np.uint64)
        with np.errstate(over="ignore"):
            step = np.bitwise_count((rest & (~rest + _1)) - _1)
        return np.where(rest > 0, bits + step, -1)

    def _one(self, places: np.ndarray) -> np.ndarray:
        """Where the ones with these ranks are."""
        if self.ones is None:
            self.ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros.astype(np.int64)
        word = np.searchsorted(self.ones, places, side="right") - 1
        return word * 64 + self._place(self.highs[word], places - self.ones[word])

    def _number(self, places: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Of a one, its place less its rank is the high bits."""
        low = unpack(self.lows, places, self.low_bits).astype(np.int64) if self.low_bits else 0
        return ((bits - places) << self.low_bits) + low

    def at(self, places: np.ndarray) -> np.ndarray:
        """The numbers at these places."""
        places = np.asarray(places, np.int64)
        return self._number(places, self._one(places))

    def two(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at these places and at those behind them, which must exist."""
        places = np.asarray(places, np.int64)
        bits = self._one(places)
        behind = self._next(bits + 1, False)
        far = np.flatnonzero(behind < 0)
        behind[far] = self._one(places[far] + 1)
        return self._number(places, bits), self._number(places + 1, behind)

    def _search(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of numbers below the universe: how many are smaller, and whether the next one is equal."""
        high = (wanted >> np.uint64(self.low_bits)).astype(np.int64)
        begin = np.where(high > 0, self._upto(np.maximum(high - 1, 0)), 0)
        # Up to the next zero, which is mostly in the same word.
        end = self._next(begin + high, True) - high
        far = np.flatnonzero(end < begin)
        end[far] = self._upto(high[far])
        if not self.low_bits:
            return begin, begin < end
        low, last = wanted & np.uint64(2**self.low_bits - 1), end.copy()
        open_ = np.flatnonzero(begin < end)
        while len(open_):
            middle = (begin[open_] + end[open_]) >> 1
            less = unpack(self.lows, middle, self.low_bits) < low[open_]
            begin[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
            open_ = open_[begin[open_] < end[open_]]
        equal = begin < last  # there are more with these high bits
        there = np.flatnonzero(equal)
        equal[there] = unpack(self.lows, begin[there], self.low_bits) == low[there]
        return begin, equal

    def _asked(self, wanted: np.ndarray, place: np.ndarray, equal: np.ndarray) -> None:
        wanted = np.asarray(wanted).astype(np.uint64)
        inside = np.flatnonzero(wanted < np.uint64(self.universe))
        if self.n and len(inside) == len(wanted):
            place[:], equal[:] = self._search(wanted)
        elif self.n and len(inside):
            place[inside], equal[inside] = self._search(wanted[inside])

    def below(self, wanted: np.ndarray) -> np.ndarray:
        """How many numbers are smaller than each of these, which is where its successor is; any number may be asked for."""
        place, equal = np.full(len(wanted), self.n, np.int64), np.zeros(len(wanted), bool)
        self._asked(wanted, place, equal)
        return place

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each number, -1 if it isn't there."""
        place, equal = np.full(len(wanted), self.n, np.int64), np.zeros(len(wanted), bool)
        self._asked(wanted, place, equal)
        return np.where(equal, place, -1)


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    head, at = {}, 0
    for name, x in arrays.items():
        head[name] = (x.dtype.str, len(x), at)
        at += -(-x.nbytes // 8) * 8
    raw = json.dumps(head).encode()
    raw += b" " * (-len(raw) % 8)
    with files.writer(uri) as out:
        out.write(len(raw).to_bytes(8, "little") + raw)
        for x in arrays.values():
            data = np.ascontiguousarray(x).tobytes()
            out.write(data + b"\0" * (-len(data) % 8))


def read_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays, memory-mapped."""
    raw = files.mapped(uri)
    begin = 8 + int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8:begin].tobytes())
    return {name: raw[begin + at : begin + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, n, at) in head.items()}
