"""Elias-Fano sequences and a trie of n-grams on them, laid out so that a buffer can be mapped as it is.

A sequence of n ascending numbers below u keeps the low bits of each number as
they are, and the high bits in unary: about 2 + log2(u / n) bits a number. Counts of
ones before each 64-bit word give random access and successor search. All
operations take and return arrays.
"""

from __future__ import annotations

import mmap

import numpy as np

_ONE = np.uint64(1)
_COUNTED = np.uint64(64)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of ``bits`` bits, one after the other in 64-bit words; one word is left over at the end."""
    words = np.zeros((len(values) * bits + 63) // 64 + 1, np.uint64)
    if not bits or not len(values):
        return words
    at = np.arange(len(values), dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[first]] = np.bitwise_or.reduceat(values << shift, first)
    over = np.flatnonzero(shift.astype(np.int64) + bits > 64)
    words[word[over] + 1] |= values[over] >> (_COUNTED - shift[over])
    return words


def _select(words: np.ndarray, before: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of the set bits of the given ranks; ``before`` counts the ones up to and with each word."""
    word = np.searchsorted(before, rank, "right")
    left = rank - np.where(word > 0, before[word - 1], 0)
    return _in_word(words[word], left) + word * 64


def _in_word(held: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places of the ``left``-th set bit of each word."""
    place = np.zeros(len(held), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(held & np.uint64((1 << step) - 1)).astype(np.int64)
        beyond = left >= low
        place += np.where(beyond, step, 0)
        held = np.where(beyond, held >> np.uint64(step), held)
        left = np.where(beyond, left - low, left)
    return place


class EliasFano:
    """An ascending sequence over four arrays of a buffer: head (n, low bits), low words, high words, ones before."""

    def __init__(self, arrays: list[np.ndarray]) -> None:
        head, self.low, self.high, self.ones = arrays
        self.size, self.bits = int(head[0]), int(head[1])
        self.zeros = np.arange(1, len(self.high) + 1, dtype=np.int64) * 64 - self.ones

    @staticmethod
    def encode(values: np.ndarray) -> list[np.ndarray]:
        """The arrays of a non-negative, non-descending sequence."""
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = _pack(values & np.uint64((1 << bits) - 1), bits)
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        # One zero more than the greatest high part, so that every part is closed.
        high = np.zeros(((int(place[-1]) if n else 0) + 2 + 63) // 64 + 1, np.uint64)
        if n:
            word = place >> 6
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            high[word[first]] = np.bitwise_or.reduceat(_ONE << (place & 63).astype(np.uint64), first)
        return [np.array([n, bits], np.int64), low, high, np.cumsum(np.bitwise_count(high), dtype=np.int64)]

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        # A shift by 63 and one by 1, as a shift by 64 is none.
        upper = (self.low[word + 1] << (np.uint64(63) - shift)) << _ONE
        return ((self.low[word] >> shift) | upper) & np.uint64((1 << self.bits) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        high = (_select(self.high, self.ones, at) - at).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self._low(at)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have a high part below ``high``."""
        out = np.zeros(len(high), np.int64)
        some = high > 0
        rank = high[some] - 1
        word = np.searchsorted(self.zeros, rank, "right")
        left = rank - np.where(word > 0, self.zeros[word - 1], 0)
        out[some] = _in_word(~self.high[word], left) + word * 64 - rank
        return out

    def find(self, wanted: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each wanted number in [begin, end), or -1: the successor, if it is equal."""
        out = np.full(len(wanted), -1, np.int64)
        if not self.size:
            return out
        top = self.get(np.array([self.size - 1]))[0]
        ask = np.flatnonzero((wanted <= top) & (begin < end))
        if not len(ask):
            return out
        high = (wanted[ask] >> np.uint64(self.bits)).astype(np.int64)
        low = wanted[ask] & np.uint64((1 << self.bits) - 1)
        first, last = np.maximum(self._below(high), begin[ask]), np.minimum(self._below(high + 1), end[ask])
        stop = last.copy()
        open_ = np.flatnonzero(first < last)
        while len(open_):
            middle = (first[open_] + last[open_]) // 2
            less = self._low(middle) < low[open_]
            first[open_[less]] = middle[less] + 1
            last[open_[~less]] = middle[~less]
            open_ = open_[first[open_] < last[open_]]
        inside = np.flatnonzero(first < stop)
        hit = inside[self._low(first[inside]) == low[inside]]
        out[ask[hit]] = first[hit]
        return out


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)]) if len(columns[0]) else np.zeros(0, np.int64)


class NgramTrie:
    """Trigrams in three levels over one buffer, with codes of quantised values beside the second and third.

    The ids below one parent ascend; adding the last number of the parent before
    makes a whole level ascend, so that it is one Elias-Fano sequence. Pointers to
    the children are ascending by themselves. A search for an id below a parent
    adds the parent's base and looks for that number between its pointers.
    """

    NAMES = ("one", "to_two", "two", "to_three", "three")

    def __init__(self, buffer) -> None:
        whole = np.frombuffer(buffer, np.int64)
        head = whole[: 1 + int(whole[0])]
        arrays, at = [], len(head)
        for size in head[1:].tolist():
            arrays.append(whole[at : at + size])
            at += size
        self.codes = {}
        for k, name in enumerate(self.NAMES):
            part = arrays[4 * k : 4 * k + 4]
            setattr(self, name, EliasFano([part[0], part[1].view(np.uint64), part[2].view(np.uint64), part[3]]))
        for k, name in enumerate(("back_one", "own_two", "back_two", "own_three")):
            self.codes[name] = arrays[20 + k].view(np.uint8)

    @staticmethod
    def layout(columns: list[np.ndarray], codes: dict[str, np.ndarray]) -> bytes:
        """A buffer of sorted distinct trigrams (a last id of 0: the bigram alone) and of the codes of each level."""
        one, two, three = columns
        first, second = _starts([one]), _starts([one, two])
        parts = [EliasFano.encode(one[first])]
        for parents, level, ids in ((first, second, two[second]), (second, np.flatnonzero(three > 0), three[three > 0])):
            pointers = np.r_[np.searchsorted(level, parents), len(level)]
            sizes = np.diff(pointers)
            last = np.where(sizes > 0, ids[np.maximum(pointers[1:] - 1, 0)] if len(ids) else 0, 0)
            base = np.cumsum(last) - last
            parts += [EliasFano.encode(pointers), EliasFano.encode(ids + np.repeat(base, sizes))]
        arrays = [a for part in parts for a in part]
        arrays += [codes[name] for name in ("back_one", "own_two", "back_two", "own_three")]
        padded = [np.frombuffer(a.tobytes() + b"\0" * (-a.nbytes % 8), np.int64) for a in arrays]
        head = np.array([len(padded), *[len(a) for a in padded]], np.int64)
        return np.concatenate([head, *padded]).tobytes()

    @staticmethod
    def open(path: str) -> NgramTrie:
        """A trie over a mapped file."""
        return NgramTrie(np.memmap(path, np.uint8, "r"))

    @staticmethod
    def mapped(data: bytes) -> NgramTrie:
        """A trie over a mapping of its own, outside the heap of the process."""
        held = mmap.mmap(-1, max(len(data), 8))
        held.write(data)
        return NgramTrie(held)

    def _child(self, pointers: EliasFano, level: EliasFano, parent: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(parent), -1, np.int64)
        known = np.flatnonzero(parent >= 0)
        if len(known):
            begin = pointers.get(parent[known]).astype(np.int64)
            end = pointers.get(parent[known] + 1).astype(np.int64)
            base = np.zeros(len(known), np.uint64)
            later = begin > 0
            base[later] = level.get(begin[later] - 1)
            out[known] = level.find(base + wanted[known].astype(np.uint64), begin, end)
        return out

    def find_one(self, one: np.ndarray) -> np.ndarray:
        return self.one.find(one.astype(np.uint64), np.zeros(len(one), np.int64), np.full(len(one), self.one.size))

    def find_two(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Places of bigrams in the second level, by the places of their first words."""
        return self._child(self.to_two, self.two, one, two)

    def find_three(self, two: np.ndarray, three: np.ndarray) -> np.ndarray:
        """Places of trigrams in the third level, by the places of their bigrams."""
        return self._child(self.to_three, self.three, two, three)

    def code(self, name: str, place: np.ndarray) -> np.ndarray:
        """Codes at places of a level; 0 where there is none."""
        held = self.codes[name]
        return np.where(place >= 0, held[np.maximum(place, 0)] if len(held) else 0, 0).astype(np.uint8)
