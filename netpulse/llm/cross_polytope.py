"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform)
turns a unit vector; its hash is the nearest signed axis. ``TABLES`` rotations
give as many tables of 2 d buckets. A query looks into the ``PROBES`` buckets of
each table whose axes are nearest to it, and every vector found there is ranked by
its exact inner product in double precision. For inner products of vectors of
unlike length the vectors are lifted to a sphere by one more coordinate first, so
that the largest product is the nearest direction; queries get a zero there.

How many buckets a share of true neighbours needs depends on the dimension and on
the spread of norms. So the recall is measured in the job: about ``DRAWN`` queries are
compared with every vector, and the probes are widened until the true neighbours of
these queries lie in probed buckets to ``RECALL``, two standard errors of the draw
left. Where that takes as many buckets as one table has, or more, one table is read
whole instead, which costs no more and finds all.

Groups of buckets are cut into cells of about ``CELL`` vectors by ``CELL`` queries,
by their counts (at most tables x axes rows), so a bucket that holds a third of all
vectors is many tasks of a known size. A cell returns the best ``k`` of each query,
never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netpulse.sinks.tables import written

TABLES = 6
PROBES = 36
RECALL = 0.9
DRAWN = 200
# Buckets that one task ranks together, and the vectors and queries of a task at most (about).
GROUP = 16
CELL = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix, by butterflies."""
    rows, size = x.shape
    step = 1
    while step < size:
        pairs = x.reshape(rows, size // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, size)
        step *= 2
    return x / np.sqrt(size)


class Rotations:
    """The pseudo-rotations of every table, the same in every task."""

    def __init__(self, dimensions: int, tables: int, seed: int) -> None:
        self.size = 1 << max(1, (dimensions - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.size))

    def rotate(self, x: np.ndarray, table: int) -> np.ndarray:
        y = np.zeros((len(x), self.size))
        y[:, : x.shape[1]] = x
        for signs in self.signs[table]:
            y = hadamard(y * signs)
        return y

    def nearest_axis(self, x: np.ndarray, table: int) -> np.ndarray:
        y = self.rotate(x, table)
        axis = np.abs(y).argmax(axis=1)
        return axis + self.size * (y[np.arange(len(y)), axis] < 0)

    def places(self, x: np.ndarray, table: int, axis: np.ndarray) -> np.ndarray:
        """Number of probes that reach the signed axis given for each row."""
        y = self.rotate(x, table)
        both = np.concatenate([y, -y], axis=1)
        return (both >= both[np.arange(len(both)), axis][:, None]).sum(axis=1)

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """The ``n`` nearest signed axes of each row."""
        y = self.rotate(x, table)
        both = np.concatenate([y, -y], axis=1)
        n = min(n, both.shape[1])
        return np.argpartition(-both, n - 1, axis=1)[:, :n]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) and norm of the vectors that take part.

    Left out: null id, null or empty vectors, null or non-finite components, zero vectors.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").select("vec_id", v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.where(fine).withColumn("norm", norm).where("norm > 0")


def index_rows(rows: DataFrame, rotations: Rotations, longest: float, lift: bool) -> DataFrame:
    """vec_id, v, table_no, bucket_group and bucket (within the group) of every vector, once a table."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["v"].to_numpy()) / longest
            if lift:
                rest = 1 - (x**2).sum(axis=1, keepdims=True)
                x = np.concatenate([x, np.sqrt(np.maximum(0.0, rest))], axis=1)
            for table in range(len(rotations.signs)):
                axis = rotations.nearest_axis(x, table)
                yield batch[["vec_id", "v"]].assign(table_no=table, bucket_group=axis // GROUP, bucket=axis % GROUP)

    return rows.select("vec_id", "v").mapInPandas(task, "vec_id long, v array<double>, table_no int, bucket_group int, bucket int")


def query_rows(rows: DataFrame, rotations: Rotations, probes: int, tables: int) -> DataFrame:
    """vec_id, v, table_no, bucket_group and probed (a bit for each bucket of the group) of every query, for the first ``tables``."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["v"].to_numpy())
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            groups = -(-2 * rotations.size // GROUP)
            for table in range(tables):
                found = rotations.probes(x, table, probes)
                masks = np.zeros((len(x), groups), np.int64)
                np.bitwise_or.at(masks, (np.arange(len(x))[:, None], found // GROUP), np.int64(1) << (found % GROUP))
                row, group = np.nonzero(masks)
                yield batch[["vec_id", "v"]].iloc[row].assign(table_no=table, bucket_group=group, probed=masks[row, group])

    return rows.select("vec_id", "v").mapInPandas(task, "vec_id long, v array<double>, table_no int, bucket_group int, probed long")


def best_in_cells(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the best ``k`` of each query in each cell; ties to the smaller vec_id."""

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, x, bucket = left["vec_id"].to_numpy(np.int64), np.stack(left["v"].to_numpy()), left["bucket"].to_numpy(np.int64)
            own, probed = right["vec_id"].to_numpy(np.int64), right["probed"].to_numpy(np.int64)
            scale = float(np.abs(x).max())
            for at in range(0, len(right), 256):
                q, asking = np.stack(right["v"].iloc[at : at + 256].to_numpy()), own[at : at + 256]
                rough = q @ x.T
                rough[(asking[:, None] == ids[None]) | ((probed[at : at + 256, None] >> bucket[None]) & 1 == 0)] = -np.inf
                n = min(k, len(ids))
                floor = np.partition(rough, len(ids) - n, axis=1)[:, len(ids) - n]
                # A matrix product rounds by the shape of its blocks: what may tie with the last stays, and is scored again.
                slack = 1e-12 * (1 + np.abs(q).max() * scale * x.shape[1])
                row, column = np.nonzero((rough >= floor[:, None] - slack) & np.isfinite(rough))
                score = np.einsum("nd,nd->n", q[row], x[column])
                order = np.lexsort((ids[column], -score, row))
                row, column, score = row[order], column[order], score[order]
                first = np.searchsorted(row, row, "left")
                best = np.arange(len(row)) - first < k
                out.append(pd.DataFrame({"query_id": asking[row[best]], "vec_id": ids[column[best]], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    cell = ["table_no", "bucket_group", "part", "query_part"]
    return index.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInPandas(rank, "query_id long, vec_id long, score double")


def _dealt(rows: DataFrame, sizes: DataFrame, last: str, own: str, other: str) -> DataFrame:
    """Rows of a bucket group with their own part, once for each part of the other side."""
    joined = rows.join(F.broadcast(sizes), ["table_no", "bucket_group"])
    own_part = F.pmod(F.xxhash64("vec_id"), F.col(f"{own}s"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1))
    # Both sides come from one table; new names for its columns keep them apart in the cogroup.
    columns = [F.col(c).alias(c) for c in ("vec_id", "v", "table_no", "bucket_group", last)]
    return joined.select(*columns, own_part.alias(own), others.alias(other))


def probes_needed(drawn: DataFrame, truth: DataFrame, index: DataFrame, rotations: Rotations, whole: bool) -> int:
    """Smallest number of probes that reaches ``RECALL`` of the true neighbours of the drawn queries.

    A neighbour is found as soon as its bucket is probed in one table, so one look at
    the true neighbours gives the recall of every number of probes. The driver gets
    the drawn queries and the buckets of their neighbours. ``whole``: these are all
    queries, so the draw has no error.
    """
    axis = (F.col("bucket_group") * GROUP + F.col("bucket")).alias("axis")
    near = truth.select("query_id", "vec_id").join(index.select("vec_id", "table_no", axis), "vec_id").toPandas()
    if not len(near):
        return 0
    queries = drawn.select("vec_id", "v").toPandas()
    place = dict(zip(queries["vec_id"], range(len(queries)), strict=True))
    x = np.stack(queries["v"].to_numpy())
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parts = []
    for table, rows in near.groupby("table_no"):
        asking = x[rows["query_id"].map(place).to_numpy()]
        parts.append(rows[["query_id", "vec_id"]].assign(look=rotations.places(asking, int(table), rows["axis"].to_numpy())))
    looks = pd.concat(parts).groupby(["query_id", "vec_id"])["look"].min()
    for look in np.unique(looks):
        found = (looks <= look).groupby(level="query_id").mean()
        error = 0.0 if whole or len(found) < 2 else found.std() / np.sqrt(len(found))
        if found.mean() - 2 * error >= RECALL:
            return int(look)
    return 2 * rotations.size


def nearest(
    vectors: DataFrame, query: Column, k: int = 20, tables: int = TABLES, probes: int = PROBES, seed: int = 5, cell: int = CELL
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of every row that ``query`` selects.

    ``probes`` is the least number of buckets looked into; the measured recall may ask for more.

    Candidates are all rows but the query's own. Vectors that cannot take part
    (``usable``) are neither queries nor candidates. Rows that share a vec_id count
    once, with the smallest vector. All vectors must have one length; others raise.
    A query whose probed buckets hold fewer than ``k`` candidates looks into all, so
    that fewer come back only where there are fewer. An empty table gives no row.
    """
    rows = usable(vectors)
    rows = written(rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.min("norm").alias("norm")), "vectors")
    shape = rows.agg(F.max("norm").alias("longest"), F.min("norm").alias("shortest"), F.max(F.size("v")).alias("d"), F.min(F.size("v")).alias("least"), F.count(F.lit(1)).alias("n"), F.count_if(query).alias("asking")).first()
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if shape["d"] is None:
        return empty
    if shape["d"] != shape["least"]:
        raise ValueError("vectors of different lengths")
    lift = shape["shortest"] < shape["longest"] * (1 - 1e-5)
    rotations = Rotations(shape["d"] + lift, tables, seed)
    index = written(index_rows(rows, rotations, shape["longest"], lift), "index")
    counts = index.groupBy("table_no", "bucket_group").agg(F.count(F.lit(1)).alias("n"))

    def search(asking: DataFrame, look: int, used: int = tables) -> DataFrame:
        asked = written(query_rows(asking, rotations, look, used), "probes")
        asks = asked.groupBy("table_no", "bucket_group").agg(F.count(F.lit(1)).alias("m"))
        # One row per table and group of axes at most.
        sizes = counts.join(asks, ["table_no", "bucket_group"]).select(
            "table_no", "bucket_group", F.ceil(F.col("n") / cell).alias("parts"), F.ceil(F.col("m") / cell).alias("query_parts")
        )
        left = _dealt(index, sizes, "bucket", "part", "query_part")
        right = _dealt(asked, sizes, "probed", "query_part", "part")
        found = best_in_cells(left, right, k)
        # The same neighbour found in several tables has the same rank; the limit works before the shuffle.
        place = F.dense_rank().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = found.withColumn("rank", place).where(F.col("rank") <= k)
        return written(best.select("query_id", "rank", "vec_id", "score").distinct(), "nearest")

    asking, every = rows.where(query), 2 * rotations.size
    if probes < every:
        share = max(1, shape["asking"] // DRAWN)
        drawn = written(asking.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(share)) == 0), "drawn")
        # Every vector is once in each table.
        look = probes_needed(drawn, search(drawn, every, 1), index, rotations, share == 1)
        if look > probes and look * tables >= every:
            return search(asking, every, 1)
        probes = max(probes, look)
    best = search(asking, probes)
    full = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, shape["n"] - 1))
    short = written(asking.join(full, asking["vec_id"] == full["query_id"], "left_anti"), "short")
    if short.limit(1).count():
        # Too little in the probed buckets: these queries look into every bucket.
        rest = search(short, every)
        best = best.join(short, best["query_id"] == short["vec_id"], "left_anti").union(rest)
    return best
