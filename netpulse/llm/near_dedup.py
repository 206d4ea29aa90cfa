"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A signature has 112 min-hashes of 6 bits, eight to a 64-bit chunk, fourteen
chunks. Its distance is the number of min-hashes that differ. By the pigeonhole
principle two signatures at a distance of at most 27 agree, in at least one of
the fourteen chunks, on all but at most one of eight min-hashes. So each chunk is
indexed with each of its allowed errors left out (112 keys a signature), and
every pair within the distance shares a key. Pairs further apart mostly do too:
at a Jaccard similarity of exactly 0.8 a pair without a common key has a
probability of 6e-5, at 0.85 of 3e-7.

Documents with equal shingle sets are one class from the start. Classes that
share a key are linked without listing all pairs:

1. every member is compared with the leader of its bucket, for each of the
   ``ORDERS`` ways to choose leaders, and what the leaders join is one component;
2. the remaining pairs of a bucket, those between different components, are
   compared inside the tasks by a wider signature of ``WIDE`` min-hashes of one
   bit, made for these members alone; each pair in the first bucket it shares. A
   large bucket is dealt to cells of about ``CELL`` members, ``BUCKET`` components
   or ``BYTES`` of sets each, every cell with every other, so that all its pairs are
   compared whatever its size. Out come the members that are near another one;
3. these meet again in their cells with their full sets. There near pairs are
   confirmed one by one, closest first, those already joined being passed over, and
   a cell gives at most one link less than it has members: a spanning forest, so
   the output grows with the members and not with their pairs.

Every link is confirmed on the full sets. Distances above ``FAR`` (a pair of
similarity 0.8 gets there once in a hundred thousand) are not compared further,
nor are wider signatures that differ in more than ``WIDE_FAR`` bits, or in more
than ``FIRST_FAR`` of the first ``FIRST`` bits: both are 4.5 standard deviations
beyond the mean of a pair of similarity 0.8 (less than once in a hundred thousand).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netpulse.llm.text import mix64, shingle_set, small_batches
from netpulse.sinks.tables import written

CHUNKS, LANES, BITS = 14, 8, 6
LANE = BITS + 1  # a spare bit, so that lanes can be compared by one addition
LANE_MAX = (1 << BITS) - 1
ORDERS = 4
FAR = 42
WIDE, WIDE_FAR = 2048, 266
FIRST, FIRST_FAR = 512, 82
BUCKET = 1000
CELL = 4096
BYTES = 64 << 20
# Ids or keys up to this number (32 MB) may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
# Tasks, and so files, that make a table of ids or keys of up to that number.
FEW = 8

_LOW = sum(LANE_MAX << (LANE * j) for j in range(LANES))
_HIGH = sum(1 << (LANE * j + BITS) for j in range(LANES))
SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, " + ", ".join(f"s{i} long" for i in range(CHUNKS))
SIGNATURE = [f"s{i}" for i in range(CHUNKS)]
_SLICE = 1 << 11


def _min_hashes(shingles: np.ndarray, first: int, number: int) -> np.ndarray:
    """64-bit min-hashes of a non-empty set of 64-bit hashes, by the hash functions from ``first`` on."""
    seeds = mix64(np.arange(first, first + number, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    add, odd = (seeds >> np.uint64(32)).astype(np.uint32), seeds.astype(np.uint32) | np.uint32(1)
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    lows = np.full(len(seeds), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(folded), _SLICE):
        # Products of mixed 32-bit values with an odd number: their order is the permutation.
        products = (folded[None, at : at + _SLICE] ^ add[:, None]) * odd[:, None]
        lows = np.minimum(lows, products.min(axis=1))
    return mix64(lows.astype(np.uint64) + seeds)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The chunks of 6-bit min-hashes of a non-empty set of 64-bit hashes."""
    hashes = _min_hashes(shingles, 1, CHUNKS * LANES)
    lanes = (hashes & np.uint64(LANE_MAX)).reshape(CHUNKS, LANES)
    return (lanes << (np.arange(LANES, dtype=np.uint64) * np.uint64(LANE))).sum(axis=1, dtype=np.uint64).view(np.int64)


def wide_signature(shingles: np.ndarray) -> bytes:
    """WIDE min-hashes of one bit, by other hash functions than those of the signature."""
    hashes = _min_hashes(shingles, 1 + CHUNKS * LANES, WIDE)
    return np.packbits((hashes & np.uint64(1)).astype(np.uint8)).tobytes()


def sign_wide(docs: DataFrame, width: int) -> DataFrame:
    """id and wide signature of every document that has shingles; rows that share a doc_id give one each."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingle_set(text, width)
                if len(s):
                    out.append((doc_id, wide_signature(s)))
            yield pd.DataFrame(out, columns=["id", "wide"])

    return docs.select("doc_id", "text").mapInPandas(task, "id long, wide binary").distinct()


def sign(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, set size, a 128-bit fingerprint of the set and the signature of every document."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingle_set(text, width)
                prints = (0, 0)
                if len(s):
                    prints = tuple(int(f.sum(dtype=np.uint64).astype(np.int64)) for f in (mix64(s), mix64(~s)))
                chunks = signature(s).tolist() if len(s) else [0] * CHUNKS
                out.append((None if pd.isna(doc_id) else int(doc_id), len(s), *prints, *chunks))
            frame = pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_a", "set_b", *SIGNATURE])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select("doc_id", "text").mapInPandas(task, SIGNED)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and the full set as an array of 64-bit hashes."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(text, width).view(np.int64) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "shingles": sets})

    return docs.select("doc_id", "text").mapInPandas(task, "doc_id long, shingles array<long>")


def distance(left: str, right: str) -> Column:
    """Differing min-hashes of two signatures, by lane-wise arithmetic on the chunks."""
    total = F.lit(0)
    for i in range(CHUNKS):
        differs = F.col(f"{left}s{i}").bitwiseXOR(F.col(f"{right}s{i}"))
        total = total + F.bit_count((differs + F.lit(_LOW)).bitwiseAND(F.lit(_HIGH)))
    return total


def _keys() -> Column:
    """Key of each chunk with each lane left out; the lowest four bits of a key are the chunk's number, the next three the lane's."""
    keys = []
    for i in range(CHUNKS):
        for j in range(LANES):
            kept = F.col(f"s{i}").bitwiseAND(F.lit(_LOW & ~(LANE_MAX << (LANE * j))))
            keys.append(F.xxhash64(F.lit(i * LANES + j), kept).bitwiseAND(F.lit(-128)).bitwiseOR(F.lit(j << 4 | i)))
    return F.array(*keys)


def _chunk(key: Column) -> Column:
    return key.bitwiseAND(F.lit(15))


def _checked(small: DataFrame) -> DataFrame:
    """A written table of one BIGINT column, to be broadcast only where its counted rows are few."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _few_files(small: DataFrame, rows: int) -> DataFrame:
    """A table of at most ``rows`` ids or keys, made from tables as small, by a few tasks where that is little.

    Else every round of a loop leaves a file for each partition.
    """
    return small.coalesce(FEW) if rows <= BROADCAST_ROWS else small


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node that has an edge.

    Labels fall to the smallest label among the neighbours and then jump to the
    label of the label, until none changes. Rounds are few, since most groups
    are stars; each is written to the shared folder. Joins on a label that many
    nodes share are split by the adaptive skew join, and minima combine before
    the shuffle. ``edges`` is a written table.
    """
    # Rows of either direction; there are no more nodes.
    most = 2 * edges.count()
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(_few_files(both, most), "edges")
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node")
    labels = written(_few_files(labels, most), "labels")
    while True:
        heard = (
            both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        )
        lower = labels.join(heard, labels["node"] == heard["a"]).select(
            "node", F.col("label").alias("before"), F.least("label", "heard").alias("label")
        )
        lower = written(_few_files(lower, most), "labels")
        jump = lower.select(F.col("node").alias("via"), F.col("label").alias("far"))
        jumped = lower.join(jump, lower["label"] == jump["via"]).select(
            "node", "before", F.least("label", "far").alias("label")
        )
        jumped = written(_few_files(jumped, most), "labels")
        changed = jumped.where(F.col("label") != F.col("before")).limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; ``pairs`` is a written table."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = written(_few_files(ids, 2 * pairs.count()), "paired")
    wanted = docs.select("doc_id", "text").join(_checked(ids), "doc_id", "left_semi")
    # Rows that share a doc_id: the first set in order stands for them.
    sets = written(shingle_sets(wanted, width), "sets").groupBy("doc_id").agg(F.min("shingles").alias("shingles"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_of_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_of_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("set_of_a", "set_of_b"))
    union = F.size("set_of_a") + F.size("set_of_b") - common
    return both.where(common * 100 >= union * percent).select("a", "b")


def _labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Bucket members with the component each is in; only buckets of several components stay."""
    if labels is None:
        members = buckets.withColumn("component", F.col("id"))
    else:
        members = buckets.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn(
            "component", F.coalesce("component", "id")
        )
    mixed = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    return members.join(mixed.select("key"), "key", "left_semi")


def _with_signature(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs no further apart than FAR."""
    left = classes.select(F.col("id").alias("a"), *[F.col(s).alias(f"l_{s}") for s in SIGNATURE])
    right = classes.select(F.col("id").alias("b"), *[F.col(s).alias(f"r_{s}") for s in SIGNATURE])
    both = pairs.join(left, "a").join(right, "b")
    return both.where(distance("l_", "r_") <= FAR).select("a", "b")


def star_pairs(members: DataFrame, order: int) -> DataFrame:
    """One pair a member: with the smallest leader of its buckets, or the one it shares most buckets with.

    Order 0 leads buckets by the smallest id, so that a tight group has one leader;
    the other orders draw leaders per chunk, for groups whose members are only
    similar to some of the others, and a member is compared with the likeliest.
    """
    rank = F.lit(0) if order == 0 else F.xxhash64(F.lit(order), _chunk(F.col("key")), "id")
    ranked = members.withColumn("at", F.struct(rank.alias("rank"), F.col("id"), F.col("component")))
    leaders = ranked.groupBy("key").agg(F.min("at").alias("leader"))
    pairs = ranked.join(leaders, "key").where(F.col("component") != F.col("leader.component"))
    if order == 0:
        pairs = pairs.groupBy("id").agg(F.min("leader.id").alias("b"))
        return pairs.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))
    shared = pairs.groupBy("id", F.col("leader.id").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy("id").agg(F.max(F.struct("n", "other")).alias("best"))
    ends = best.select(F.least("id", "best.other").alias("a"), F.greatest("id", "best.other").alias("b"))
    return ends.distinct()


def near_in_cell(cell: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of rows, and their wide distance, that are near and in different components of a cell.

    ``cell`` holds whole cells, in order of component. A pair that shares several
    buckets is found in the first of them only.
    """
    words = np.frombuffer(b"".join(cell["wide"]), np.uint64).reshape(len(cell), WIDE // 64).T.copy()
    chunks = cell[SIGNATURE].to_numpy(np.uint64)
    part = cell["part"].to_numpy(np.int64)
    same_part = (cell["low"] == cell["high"]).to_numpy()
    place = np.arange(len(cell))
    marks = cell[["key", "low", "high"]].to_numpy(np.int64)
    chunk_of, lane_of = marks[:, 0] & 15, marks[:, 0] >> 4 & 7
    new_cell = np.r_[True, (marks[1:] != marks[:-1]).any(axis=1)]
    new_block = new_cell | np.r_[True, np.diff(cell["component"].to_numpy(np.int64)) != 0]

    def ends(starts: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(starts)
        return np.r_[first[1:], len(cell)][np.cumsum(starts) - 1]

    # The partners of a row are those of its cell after its component.
    after, until = ends(new_block), ends(new_cell)
    many = until - after
    out, at = [(place[:0], place[:0], place[:0])], 0
    while at < len(cell):
        upto = max(at + 1, int(np.searchsorted(np.cumsum(many[at:]), 500_000, "right")) + at)
        n = many[at:upto]
        left = np.repeat(place[at:upto], n)
        right = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(after[at:upto], n)
        fits = same_part[left] | (part[left] != part[right])
        left, right = left[fits], right[fits]
        far = np.zeros(len(left), np.int64)
        for until_word, most in ((FIRST // 64, FIRST_FAR), (WIDE // 64, WIDE_FAR)):
            far = np.zeros(len(left), np.int64)
            for word in words[:until_word]:
                far += np.bitwise_count(word[left] ^ word[right])
            left, right, far = left[far <= most], right[far <= most], far[far <= most]
        first = np.ones(len(left), bool)
        for i in range(CHUNKS):
            lanes = np.bitwise_count(((chunks[left, i] ^ chunks[right, i]) + np.uint64(_LOW)) & np.uint64(_HIGH))
            chunk, lane = chunk_of[left], lane_of[left]
            # An earlier chunk with at most one lane apart has a bucket for this pair; equal chunks share all eight, and lane 1 counts.
            first &= np.where(i < chunk, lanes > 1, np.where(i == chunk, (lanes > 0) | (lane == 1), True))
        out.append((left[first], right[first], far[first]))
        at = upto
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def forest_in_cell(cell: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) that span what the confirmed near pairs of a cell join; ``cell`` also holds the full sets."""
    left, right, far = near_in_cell(cell)
    order = np.lexsort((right, left, far))
    # One tree over the whole stretch of cells: an id in several cells is joined once.
    ids, components_, sets = cell["id"].tolist(), cell["component"].tolist(), cell["shingles"].to_numpy()
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.get(x, x) != x:
            above[x] = x = above.get(above[x], above[x])
        return x

    out = []
    for i, j in zip(left[order].tolist(), right[order].tolist(), strict=True):
        one, two = top(components_[i]), top(components_[j])
        if one == two:
            continue
        a, b = sets[i], sets[j]
        if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            continue
        common = len(np.intersect1d(a, b, assume_unique=True))
        if common * 100 >= (len(a) + len(b) - common) * percent:
            above[max(one, two)] = min(one, two)
            out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _whole_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A sorted stream cut into frames of whole cells."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        marks = batch[CELL_KEY].to_numpy(np.int64)
        before = held[-1][CELL_KEY].iloc[-1].to_numpy(np.int64) if held else None
        if before is not None and (marks[0] != before).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        # The last cell may go on in the next batch.
        whole = np.flatnonzero((marks != marks[-1]).any(axis=1))
        if len(whole):
            yield pd.concat([*held, batch.iloc[: whole[-1] + 1]], ignore_index=True)
            held = [batch.iloc[whole[-1] + 1 :]]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


CELL_KEY = ["key", "low", "high"]


def cross_links(members: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, bucket: int, cell: int) -> DataFrame:
    """Confirmed links that span the near pairs of each bucket between different components.

    Rows are sorted by cell; a task holds one cell (or many small ones) at a time.
    """
    sized = members.join(classes.select("id", "n_shingles"), "id")
    blocks = sized.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("set_size"))
    most = F.greatest(F.sum("n") / cell, F.count(F.lit(1)) / bucket, F.sum("set_size") * 8 / BYTES)
    sizes = blocks.groupBy("key").agg(F.ceil(most).alias("parts"))
    dealt = members.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = dealt.withColumn("other", other).select(
        "key", "id", "component", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")
    )
    ids = written(members.select(F.col("id").alias("doc_id")).distinct(), "residual")
    wide = written(sign_wide(docs.join(_checked(ids), "doc_id", "left_semi"), width), "wide")
    signs = written(wide.join(classes.select("id", *SIGNATURE), "id"), "signs")
    cells = dealt.join(signs, "id")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in _whole_cells(batches):
            left, right, _ = near_in_cell(whole)
            yield whole.iloc[np.union1d(left, right)][["key", "id", "component", "part", "low", "high"]]

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in _whole_cells(batches):
            yield forest_in_cell(whole, percent)

    by_cell = cells.repartition(*CELL_KEY).sortWithinPartitions(*CELL_KEY, "component", "id")
    kept = "key long, id long, component long, part long, low long, high long"
    chosen = written(by_cell.mapInPandas(near, kept), "near-members")
    wanted = written(chosen.select(F.col("id").alias("doc_id")).distinct(), "near-ids")
    sets = written(shingle_sets(docs.join(_checked(wanted), "doc_id", "left_semi"), width), "near-sets")
    # Rows that share a doc_id: the first set in order stands for them.
    sets = sets.groupBy(F.col("doc_id").alias("id")).agg(F.min("shingles").alias("shingles"))
    full = chosen.join(signs, "id").join(sets, "id")
    return full.repartition(*CELL_KEY).sortWithinPartitions(*CELL_KEY, "component", "id").mapInPandas(link, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, bucket: int = BUCKET, cell: int = CELL, orders: int = ORDERS
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Null, empty or wordless text: no shingles, linked with nothing. Rows that
    share a doc_id with different texts are one node, linked by one of their
    sets. A null doc_id takes no part: component_id null, kept true.
    An empty table gives no row; columns but doc_id and text are left out.
    """
    docs = docs.select("doc_id", "text")
    with small_batches(docs.sparkSession):
        signed = written(sign(docs, width), "signed")
        usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        same_set = ["n_shingles", "set_a", "set_b"]
        # Equal sets have equal signatures: one class, whatever its number of documents.
        classes = written(
            usable.groupBy(*same_set).agg(F.min("doc_id").alias("id"), *[F.min(s).alias(s) for s in SIGNATURE]), "classes"
        )
        # 112 keys a class: the classes are dealt to all tasks first.
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keyed = classes.repartition(tasks, "id").select("id", F.explode(_keys()).alias("key"))
        shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared")
        members = written(keyed.join(_checked(shared), "key", "left_semi"), "buckets")
        links, labels, most = None, None, members.count()
        for step in range(orders + 1):
            members = written(_few_files(_labelled(members.select("key", "id"), labels), most), "members")
            most = members.count()
            if not most:
                break
            if step < orders:
                near = written(_with_signature(star_pairs(members, step), classes), "near")
                if not near.limit(1).count():
                    continue
                fresh = written(confirm(near, docs, width, percent), "links")
            else:
                fresh = written(cross_links(members, classes, docs, width, percent, bucket, cell), "links")
            if not fresh.limit(1).count():
                continue
            links = fresh if links is None else links.union(fresh)
            labels = components(links)
    lowest = classes.select(*same_set, F.col("id").alias("class_id"))
    out = signed.join(lowest, same_set, "left")
    if labels is not None:
        out = out.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
        out = out.withColumn("component_id", F.coalesce("component", "class_id", "doc_id"))
    else:
        out = out.withColumn("component_id", F.coalesce("class_id", "doc_id"))
    own = F.col("doc_id").isNull()
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(~own, F.col("component_id")).alias("component_id"),
        (own | (F.col("doc_id") == F.col("component_id"))).alias("kept"),
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one left of each group of near-duplicates; columns as they are, whatever their names.

    Null, empty or wordless texts are near nothing and stay, very long texts are
    compared whole, and an empty table gives no row. Of rows equal in doc_id and
    text one stays; different texts of a kept doc_id all do. Rows without doc_id stay.
    """
    names = docs.columns
    rows = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    doc_id, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    groups = near_duplicates(docs, width, percent)
    kept = groups.where("kept").select(F.col("doc_id").alias(doc_id)).distinct()
    named = rows.where(F.col(doc_id).isNotNull()).join(kept, doc_id, "left_semi").withColumn("mark", F.sha2(text, 256))
    first = F.row_number().over(W.partitionBy(doc_id, "mark").orderBy(doc_id))
    once = named.withColumn("nth", first).where("nth = 1").select(rows.columns)
    return once.unionByName(rows.where(F.col(doc_id).isNull())).toDF(*names)
