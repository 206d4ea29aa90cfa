"""Best-fit decreasing packing of tokenised documents into fixed-length sequences.

Documents of one length are interchangeable, so the packing needs only how many
pieces there are of each length: at most ``capacity`` numbers, whatever the data.
Best-fit decreasing runs over these counts on the driver, with a segment tree
over remaining capacities; it moves whole ranges of equal bins at once and gives
the same bins as the one-by-one algorithm. Spark counts the lengths, numbers the
pieces of a length without gathering them, and every task looks its pieces up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netpulse.llm.text import small_batches, token_ids
from netpulse.sinks.tables import written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


class CapacityTree:
    """Open bins by remaining capacity; finds the tightest that fits in logarithmic time."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _set(self, at: int, state: bool) -> None:
        node = at + self.size
        self.open[node] = state
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def push(self, remaining: int, first: int, bins: int) -> None:
        if bins:
            self.ranges[remaining].append((first, bins))
            if not self.open[remaining + self.size]:
                self._set(remaining, True)

    def pop(self, remaining: int) -> tuple[int, int]:
        taken = self.ranges[remaining].pop()
        if not self.ranges[remaining]:
            self._set(remaining, False)
        return taken

    def tightest(self, needed: int) -> int | None:
        """The smallest remaining capacity of an open bin that is at least ``needed``."""
        node = needed + self.size
        if self.open[node]:
            return needed
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


def pack_counts(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over ``counts`` (length: pieces).

    Returns runs (length, first piece, first bin, pieces per bin, offset in the
    bin), ordered by length and piece, and the number of bins. A bin takes at
    most about sqrt(2 * capacity) different lengths and every length opens and
    splits a fixed number of ranges, so the number of runs is bounded by the
    capacity and does not grow with the data.
    """
    tree, runs, bins = CapacityTree(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, at = counts[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, new = capacity, -(-left // (capacity // length))
                first, n = bins, new
                bins += new
            else:
                first, n = tree.pop(remaining)
            fit = remaining // length
            full = min(n, left // fit)
            per_bin, used = (fit, full) if full else (left, 1)
            runs.append((length, at, first, per_bin, capacity - remaining))
            tree.push(remaining - per_bin * length, first, used)
            tree.push(remaining, first + used, n - used)
            at += per_bin * used
            left -= per_bin * used
    table = np.array(runs, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))], bins


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Every document as pieces of at most ``capacity`` ids, numbered by task and length."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, encoder = TaskContext.get().partitionId(), token_ids(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch["doc_id"], encoder.ids_of(batch["text"].tolist()), strict=True):
                ids = np.concatenate([ids, end])
                doc = None if pd.isna(doc_id) else int(doc_id)
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part_ids = ids[start : start + capacity]
                    size = len(part_ids)
                    out.append((doc, piece, start, size, zlib.crc32(part_ids.astype("<u4").tobytes()), part, seen[size]))
                    seen[size] += 1
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select("doc_id", "text").mapInPandas(task, PIECES)


def best_fit_pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    Null text: the end id alone. Null doc_id and repeated rows: pieces of their
    own. An empty table gives no row. Which of several equally long pieces goes
    to which sequence is arbitrary, the sequences' lengths are not.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        cut = written(pieces(docs, tokenizer, end_id, capacity), "pieces")
    sizes = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # At most ``capacity`` rows, however many documents there are.
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = pack_counts(counts, capacity)
    shared = spark.sparkContext.broadcast(runs)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            lengths, ranks = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            _, first_piece, first_bin, per_bin, base = table[np.searchsorted(keys, (lengths << 48) + ranks, "right") - 1].T
            batch["sequence_id"] = first_bin + (ranks - first_piece) // per_bin
            batch["offset"] = base + (ranks - first_piece) % per_bin * lengths
            yield batch.drop(columns="rank")

    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = cut.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank")
    )
    return ranked.mapInPandas(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
