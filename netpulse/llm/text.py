"""Words, shingles and token ids inside tasks: the helpers several operators share.

Words are found and hashed with numpy over the bytes of many texts at once. The
hash of a word is a polynomial of its bytes modulo 2^64, read off a running sum;
two of a million different words agree with a probability of about 3e-8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import SparkSession

# Fixed value of the contracts: a word is a run of anything but these six characters.
WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
SPACES = b"\x09\x0a\x0b\x0c\x0d\x20"

_BASE = 0x9E3779B97F4A7C15 | 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE, _LETTER, _MARK, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[list(SPACES)] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = _MARK
# Texts that hold a special token string, or marks that combine with letters before these are lower-cased.
_WHOLE = re.compile("<\\||[̀-ͯ]")
# Bounds of what a worker process keeps between tasks: stretches of text (their powers take 16 MB), known words.
SLICE = 1 << 19
CACHE_WORDS = 400_000
_TABLE = 1 << 20
# Bytes of one batch between the JVM and a worker, of which both sides hold two at a time.
BATCH = 8 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside send rows to their workers in batches of about ``BATCH`` bytes; the session's own size returns afterwards."""
    before = spark.conf.get(_BATCH_BYTES)
    spark.conf.set(_BATCH_BYTES, BATCH)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, before)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        out.append(np.multiply.accumulate(factors))
    return out[0], out[1]


def segments(data: bytes) -> list[bytes]:
    """A long text cut at white space into stretches of about SLICE bytes; a longer word stays whole."""
    out, at = [], 0
    while len(data) - at > SLICE:
        cut = max(data.rfind(bytes([c]), at, at + SLICE) for c in SPACES)
        if cut < at:
            cut = min((p for c in SPACES if (p := data.find(bytes([c]), at + SLICE)) >= 0), default=len(data))
        out.append(data[at:cut])
        at = cut + 1
    out.append(data[at:])
    return out


def hashed_words(data: bytes, marks_apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of bytes that end in white space, A-Z lower-cased.

    ``marks_apart`` also cuts between ASCII letters and ASCII punctuation other than the apostrophe.
    """
    raw = np.frombuffer(data, np.uint8)
    kind = _CLASS[raw]
    space = kind == _SPACE
    begins = ~space
    begins[1:] &= space[:-1]
    if marks_apart:
        change = ((kind[1:] == _MARK) & (kind[:-1] == _LETTER)) | ((kind[1:] == _LETTER) & (kind[:-1] == _MARK))
        begins[1:] |= change
        ends_at = space | begins
    else:
        ends_at = space
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    stops = np.flatnonzero(ends_at[1:] & ~space[:-1]) + 1
    size = 1 << max(16, int(len(raw)).bit_length())
    powers, inverses = _powers(size) if size > 2 * SLICE else _powers(2 * SLICE)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
    return mix64((sums[stops] - sums[starts]) * inverses[starts]), starts, stops


def hashed_runs(data: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the runs of bytes that ``inside`` (by byte) allows, A-Z lower-cased.

    ``data`` ends in a byte that is not allowed.
    """
    raw = np.frombuffer(data, np.uint8)
    word = inside[raw]
    edges = np.flatnonzero(np.diff(np.r_[False, word].astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    size = 1 << max(16, int(len(raw)).bit_length())
    powers, inverses = _powers(size) if size > 2 * SLICE else _powers(2 * SLICE)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
    return mix64((sums[stops] - sums[starts]) * inverses[starts]), starts, stops


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a whole text in order (null: none)."""
    if not text:
        return np.zeros(0, np.uint64)
    parts = [hashed_words(s + b" ", False)[0] for s in segments(text.encode("utf-8", "surrogatepass"))]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    Fewer words than ``width``: the whole sequence is the one shingle. No words: empty.
    """
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    size = min(width, len(hashes))
    places = len(hashes) - size + 1
    out = np.full(places, size, np.uint64)
    for i in range(size):
        out = mix64(out ^ hashes[i : i + places]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)
    return np.unique(out)


class TokenIds:
    """Token ids of whole texts, by the tokenizers library; each distinct word is encoded once.

    White space never reaches the vocabulary of a word-end tokenizer, and it never
    joins a letter with punctuation, so the ids of a text are those of its words in
    order. Known words are found in an open-addressing table by their hash.
    ``CACHE_WORDS`` bounds the memory: beyond it the table starts anew. A text that
    holds a special token string or combining marks is encoded as one.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.places = np.zeros(_TABLE, np.uint64), np.zeros(_TABLE, np.int32)
        self.words, self.used = 0, 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of known words, -1 for others."""
        slots = (hashes & np.uint64(_TABLE - 1)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        while len(left):
            held = self.keys[slots[left]]
            hit = held == hashes[left]
            out[left[hit]] = self.places[slots[left[hit]]]
            left = left[~hit & (held != 0)]
            slots[left] = (slots[left] + 1) & (_TABLE - 1)
        return out

    def _insert(self, hashes: np.ndarray, places: np.ndarray) -> None:
        slots = (hashes & np.uint64(_TABLE - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.keys[slots[left]] == 0]
            self.keys[slots[free]] = hashes[free]
            placed = free[self.keys[slots[free]] == hashes[free]]
            self.places[slots[placed]] = places[placed]
            left = left[self.keys[slots[left]] != hashes[left]]
            slots[left] = (slots[left] + 1) & (_TABLE - 1)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids = self._encode(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        first, total = self.words, int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(words) > len(self.sizes):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.sizes[first : first + len(words)] = sizes
        self.starts[first : first + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.words += len(words)
        self._insert(hashes, np.arange(first, self.words))

    def _ids(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of each word in the bytes, ids of each word) of bytes that end in white space."""
        hashes, starts, stops = hashed_words(data, True)
        places = self._find(hashes)
        if (places < 0).any():
            if self.words > CACHE_WORDS:
                self._clear()
                places[:] = -1
            new, first = np.unique(hashes[places < 0], return_index=True)
            at = np.flatnonzero(places < 0)[first]
            words = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]
            self._learn(new, words)
            places = self._find(hashes)
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[places] - (ends - sizes), sizes) + np.arange(total)], starts, sizes

    def ids_of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each whole text as unsigned 32-bit integers (null: none)."""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, bytes]] = []
        held = 0

        def flush() -> None:
            nonlocal waiting, held
            if waiting:
                ids, starts, sizes = self._ids(b"".join(part + b" " for _, part in waiting))
                bounds = np.cumsum([len(part) + 1 for _, part in waiting])
                upto = np.r_[0, np.cumsum(sizes)][np.searchsorted(starts, bounds, "left")]
                for (i, _), a, b in zip(waiting, np.r_[0, upto[:-1]], upto, strict=True):
                    found[i].append(ids[a:b])
            waiting, held = [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if not text.isascii() and _WHOLE.search(text) or "<|" in text:
                found[i].append(np.array(self._encode([text])[0], np.uint32))
                continue
            for part in segments(text.encode("utf-8", "surrogatepass")):
                waiting.append((i, part))
                held += len(part)
                if held >= SLICE:
                    flush()
        flush()
        return [np.concatenate(parts) if len(parts) != 1 else parts[0] for parts in (p or [np.zeros(0, np.uint32)] for p in found)]


@lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    """One encoder per worker process."""
    return TokenIds(path)
