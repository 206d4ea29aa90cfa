"""Weighted acyclic automata over word sequences: incremental building, union, prefix sums, composition.

An automaton maps sequences of ``depth`` labels (shorter ones are padded with the
end label 0) to counts. Its states stand in levels, one per label. States of a
level with equal arcs are one state, found by a register of 128-bit hashes of
their arcs. ``Builder`` takes sorted sequences block by block and freezes a state
as soon as a sequence with another prefix has arrived, so only the open states of
the last prefix wait. All arrays are numpy's, and an automaton travels as bytes.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import zstandard

from netpulse.llm.text import mix64

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def lexicographic(columns: list[np.ndarray]) -> np.ndarray:
    """One integer per row whose order is that of the rows."""
    key, size = np.zeros(len(columns[0]), np.int64), 1
    for column in columns:
        top = int(column.max()) + 1 if len(column) else 1
        if size * top >= 1 << 62:
            held, key = np.unique(key, return_inverse=True)
            size = len(held)
        key = key * top + column
        size *= top
    return key


def summed(columns: list[np.ndarray], weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct rows and the sums of their weights."""
    if not len(weight):
        return columns, weight
    key = lexicographic(columns)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return [c[order[first]] for c in columns], np.add.reduceat(weight[order], first)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts`` and have ``sizes`` numbers, in order."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Names(NamedTuple):
    """The spelling of words: their sorted hashes, sizes in bytes, and the bytes one after the other."""

    hashes: np.ndarray
    sizes: np.ndarray
    body: np.ndarray

    @staticmethod
    def none() -> Names:
        return Names(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))

    @staticmethod
    def of(data: bytes, hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Names:
        """The names of the words at some places of bytes; ``hashes`` ascend."""
        sizes = stops - starts
        return Names(hashes, sizes, np.frombuffer(data, np.uint8)[ranges(starts, sizes)])

    @staticmethod
    def union(parts: list[Names]) -> Names:
        """The names of all parts, each once."""
        hashes, sizes, body = (np.concatenate(x) for x in zip(*parts, strict=True))
        starts = np.cumsum(sizes) - sizes
        hashes, at = np.unique(hashes, return_index=True)
        return Names(hashes, sizes[at], body[ranges(starts[at], sizes[at])])

    def some(self, wanted: np.ndarray) -> Names:
        """The names of those of the sorted ``wanted`` hashes that are here."""
        at = places(self.hashes, wanted)
        at = at[at >= 0]
        starts = np.cumsum(self.sizes) - self.sizes
        return Names(self.hashes[at], self.sizes[at], self.body[ranges(starts[at], self.sizes[at])])

    def spelled(self) -> dict[int, bytes]:
        data, ends = self.body.tobytes(), np.cumsum(self.sizes)
        return {h: data[a:b] for h, a, b in zip(self.hashes.tolist(), (ends - self.sizes).tolist(), ends.tolist(), strict=True)}


class _Level:
    """The states of one level under construction."""

    def __init__(self) -> None:
        # Sorted first hashes of frozen states and their numbers, one pair a block: a few bytes a state.
        self.register: list[tuple[np.ndarray, np.ndarray]] = []
        self.second: list[np.ndarray] = []
        self.states = 0
        self.label: list[np.ndarray] = []
        self.value: list[np.ndarray] = []
        self.size: list[np.ndarray] = []
        self.open: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def push(self, above: np.ndarray, label: np.ndarray, value: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Take sorted arcs, with the prefix of each in ``above``; return frozen prefixes and their states."""
        if self.open is not None:
            above, label, value = (np.concatenate(p) for p in zip(self.open, (above, label, value), strict=True))
            self.open = None
        if not len(label):
            return above, np.zeros(0, np.int64)
        starts = np.flatnonzero(np.r_[True, (above[1:] != above[:-1]).any(axis=1)])
        if not last:
            self.open = above[starts[-1] :], label[starts[-1] :], value[starts[-1] :]
            above, label, value = (x[: starts[-1]] for x in (above, label, value))
            starts = starts[:-1]
            if not len(starts):
                return above, np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(label)])
        arc = mix64(label.astype(np.uint64) * _K1 + mix64(value.astype(np.uint64) + _K2))
        one, two = np.add.reduceat(arc, starts), np.add.reduceat(mix64(arc ^ _K2), starts)
        kinds, first, which = np.unique(one, return_index=True, return_inverse=True)
        if (two[first][which] != two).any():
            both = np.stack([one, two], axis=1)
            _, first, which = np.unique(both, axis=0, return_index=True, return_inverse=True)
            which = which.reshape(-1)
        names = one[first]
        number = np.full(len(names), -1, np.int64)
        for held, states in self.register:
            at = places(held, names)
            number = np.where(at >= 0, states[at], number)
        known = number >= 0
        unheard = ~known
        second = np.concatenate([*self.second, np.zeros(0, np.uint64)]) if known.any() else one[:0]
        # A state whose first hash alone is known stays a state of its own.
        known[known] = second[number[known]] == two[first[known]]
        fresh = np.flatnonzero(~known)
        number[fresh] = self.states + np.arange(len(fresh))
        unheard = np.flatnonzero(unheard)
        held, at = np.unique(names[unheard], return_index=True)
        if len(held):
            self.register.append((held, number[unheard[at]]))
        self.second.append(two[first[fresh]])
        self.states += len(fresh)
        fresh = first[fresh]
        taken = ranges(starts[fresh], sizes[fresh])
        self.label.append(label[taken])
        self.value.append(value[taken])
        self.size.append(sizes[fresh])
        return above[starts], number[which]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        joined = [np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (self.size, self.label, self.value)]
        return np.r_[0, np.cumsum(joined[0])], joined[1], joined[2]


class Builder:
    """Builds an automaton from blocks of sorted, distinct sequences."""

    def __init__(self, depth: int) -> None:
        self.levels = [_Level() for _ in range(depth)]

    def add(self, columns: list[np.ndarray], weight: np.ndarray, last: bool = False) -> None:
        rows, value = np.stack(columns, axis=1).astype(np.int64), weight
        for k in range(len(self.levels) - 1, -1, -1):
            rows, value = self.levels[k].push(rows[:, :k], rows[:, k], value, last)

    def finish(self, words: np.ndarray, tags: np.ndarray, names: Names | None = None) -> CountAutomaton:
        depth = len(self.levels)
        self.add([np.zeros(0, np.int64)] * depth, np.zeros(0, np.int64), last=True)
        return CountAutomaton([level.arrays() for level in self.levels], words, tags, names)


class CountAutomaton:
    """Levels of (first arc of each state, arc labels, arc targets or, in the last level, counts).

    A label of the first level is a place in ``tags`` (sorted bytes); one of the
    others is a place in ``words`` (sorted 64-bit hashes) plus one. ``names`` spells
    the words that begin a sequence.
    """

    def __init__(
        self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], words: np.ndarray, tags: np.ndarray, names: Names | None = None
    ) -> None:
        self.levels, self.words, self.tags, self.names = levels, words, tags, names or Names.none()

    @staticmethod
    def build(
        columns: list[np.ndarray], weight: np.ndarray, words: np.ndarray, tags: np.ndarray, names: Names | None = None, block: int = 1 << 17
    ) -> CountAutomaton:
        builder = Builder(len(columns))
        for at in range(0, len(weight), block):
            builder.add([c[at : at + block] for c in columns], weight[at : at + block])
        return builder.finish(words, tags, names)

    def sequences(self) -> tuple[list[np.ndarray], np.ndarray]:
        """All sequences in order, as one column per level, and their counts."""
        states, columns = np.zeros(1 if len(self.levels[0][1]) else 0, np.int64), []
        for first, label, value in self.levels:
            sizes = first[states + 1] - first[states]
            arcs = ranges(first[states], sizes)
            columns = [np.repeat(c, sizes) for c in columns] + [label[arcs]]
            states = value[arcs]
        return columns, states

    def to_bytes(self) -> bytes:
        head, planes = [], []
        sizes = np.array([len(t) for t in self.tags], np.int64)
        for a in [*(a for level in self.levels for a in level), self.words, self.names.hashes, self.names.sizes, sizes]:
            a = a.astype(np.int64).view(np.uint64)
            width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
            head.append([len(a), width])
            # Byte planes: high bytes are mostly alike and compress well.
            planes.append(a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
        front = json.dumps({"arrays": head, "depth": len(self.levels)}).encode()
        body = len(front).to_bytes(4, "little") + front + b"".join(planes) + self.names.body.tobytes() + b"".join(self.tags)
        return zstandard.ZstdCompressor(level=3).compress(body)

    @staticmethod
    def from_bytes(data: bytes) -> CountAutomaton:
        body = zstandard.ZstdDecompressor().decompress(data)
        at = 4 + int.from_bytes(body[:4], "little")
        front = json.loads(body[4:at])
        arrays = []
        for size, width in front["arrays"]:
            wide = np.zeros((size, 8), np.uint8)
            wide[:, :width] = np.frombuffer(body, np.uint8, size * width, at).reshape(width, size).T
            arrays.append(wide.view(np.int64)[:, 0])
            at += size * width
        words, hashes, sizes, tag_sizes = arrays[-4:]
        spelled = np.frombuffer(body, np.uint8, int(sizes.sum()), at).copy()
        ends = at + len(spelled) + np.cumsum(tag_sizes)
        tags = np.empty(len(tag_sizes), object)
        tags[:] = [body[a:b] for a, b in zip((ends - tag_sizes).tolist(), ends.tolist(), strict=True)]
        levels = [tuple(arrays[3 * k : 3 * k + 3]) for k in range(front["depth"])]
        return CountAutomaton(levels, words, tags, Names(hashes, sizes, spelled))

    def part(self, low: int, high: int, columns: list[np.ndarray], weight: np.ndarray) -> CountAutomaton:
        """An automaton of the sequences [low, high) of this one's, with the words they use."""
        rows, counts = [c[low:high] for c in columns], weight[low:high]
        mark = np.zeros(len(self.words) + 1, bool)
        for r in rows[1:]:
            mark[r] = True
        mark[0] = False
        place = np.cumsum(mark)
        place[0] = 0
        tags = np.unique(rows[0])
        cut = [np.searchsorted(tags, rows[0]), *[place[r] for r in rows[1:]]]
        begins = np.unique(self.words[rows[1][rows[1] > 0] - 1])
        return CountAutomaton.build(cut, counts, self.words[np.flatnonzero(mark) - 1], self.tags[tags], self.names.some(begins))

    def compose(self, other: CountAutomaton) -> tuple[list[np.ndarray], np.ndarray]:
        """The sequences of this automaton that ``other`` accepts too, with the counts there.

        Labels are matched level by level over pairs of states, as words of either automaton.
        """
        words = places(other.words, self.words) + 1
        tags = places(other.tags, self.tags)
        label_of = [tags, *[np.r_[0, words]] * (len(self.levels) - 1)]
        missing = [tags < 0, *[np.r_[False, words == 0]] * (len(self.levels) - 1)]
        here = there = np.zeros(1 if len(self.levels[0][1]) and len(other.levels[0][1]) else 0, np.int64)
        columns: list[np.ndarray] = []
        for k, ((first, label, value), (first_o, label_o, value_o)) in enumerate(zip(self.levels, other.levels, strict=True)):
            sizes = first[here + 1] - first[here]
            arcs = ranges(first[here], sizes)
            state = np.repeat(there, sizes)
            columns = [np.repeat(c, sizes) for c in columns] + [label[arcs]]
            # States are stored one after the other and labels ascend in each: one sorted key.
            span = max(int(label_o.max()) + 2 if len(label_o) else 2, int(label_of[k].max()) + 2 if len(label_of[k]) else 2)
            keys = np.repeat(np.arange(len(first_o) - 1), np.diff(first_o)) * span + label_o
            wanted = state * span + label_of[k][label[arcs]]
            found = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            hit = (keys[found] == wanted) & ~missing[k][label[arcs]] if len(keys) else np.zeros(len(wanted), bool)
            columns = [c[hit] for c in columns]
            here, there = value[arcs][hit], value_o[found[hit]] if len(keys) else here[:0]
        return columns, there


def places(held: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in the sorted, distinct ``held``, -1 for those that are not there."""
    if not len(held):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
    return np.where(held[at] == wanted, at, -1)


class Sequences(NamedTuple):
    """Sorted distinct sequences, their counts, and the words and tags they number."""

    columns: list[np.ndarray]
    weight: np.ndarray
    words: np.ndarray
    tags: np.ndarray

    @staticmethod
    def of(automaton: CountAutomaton) -> Sequences:
        columns, weight = automaton.sequences()
        return Sequences([c.astype(np.int32) for c in columns], weight, automaton.words, automaton.tags)

    def prefixes(self, size: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The distinct prefixes of ``size`` labels after the first, and the sums of their ranges of counts."""
        whole = self.columns[size] > 0
        columns, weight = [c[whole] for c in self.columns[: size + 1]], self.weight[whole]
        if not len(weight):
            return columns, weight
        first = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])
        return [c[first] for c in columns], np.add.reduceat(weight, first)


def union(parts: list[Sequences]) -> Sequences:
    """The sequences of all parts, counts of equal ones summed."""
    if len(parts) == 1:
        return parts[0]
    words = np.unique(np.concatenate([p.words for p in parts]))
    tags = np.unique(np.concatenate([p.tags for p in parts]))
    columns = []
    for p in parts:
        word = np.r_[0, np.searchsorted(words, p.words) + 1].astype(np.int32)
        columns.append([np.searchsorted(tags, p.tags).astype(np.int32)[p.columns[0]], *[word[c] for c in p.columns[1:]]])
    rows, weight = summed([np.concatenate(c) for c in zip(*columns, strict=True)], np.concatenate([p.weight for p in parts]))
    return Sequences(rows, weight, words, tags)
