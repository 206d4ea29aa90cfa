"""Mixing sources to target weights.

The words of a source, in doc_id order, are cut into fixed-length blocks. The
mix is a row of output slots, each of which takes one block: a source takes its
blocks once per whole epoch, and in its last, partial epoch as many as the
target still needs, the last of them in part. Which block a slot takes is given
by a pseudorandom permutation of the source's block indexes, another one for
each epoch, so nothing is sorted or shuffled to randomise. Slots are dealt to
output shards of ``SLOTS``: the counts of the sources in a shard are a
multinomial draw, conditioned on the slots that each source has in all, so that
the totals meet the targets. The draw walks a binary tree over the shards whose
nodes have seeds of their own; a task draws only the shards it makes. Blocks and
slots then join by (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netpulse.llm.text import SPACE, WORD, mix64
from netpulse.sinks.tables import written

WEIGHTS = (5, 2, 1)
BLOCK = 256
SLOTS = 1024
MOST = 3
BUCKETS = 1024
# Each slot row carries its source's number; the per-source table is one row per source.
MAX_SOURCES = 100_000
SLOT_ROWS = "shard long, slot int, source_no int, epoch int, block long, words long"


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutations of 0..size-1, by a Feistel network that walks out of the rest of its square."""
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64), np.uint64(1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        left, right = out[walking] >> half[walking], out[walking] & mask[walking]
        for turn in range(4):
            keyed = mix64(right + key[walking] * np.uint64(4) + np.uint64(turn) + np.uint64(0x9E3779B97F4A7C15))
            left, right = right, left ^ (keyed & mask[walking])
        out[walking] = (left << half[walking]) | right
        walking &= out >= size.astype(np.uint64)
    return out.astype(np.int64)


def shard_counts(slots: np.ndarray, shard: int, seed: int, per_shard: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before the shard, in the shard).

    A node of the tree holds the slots of its shards; the left half takes a
    multivariate hypergeometric share of them, which is a multinomial draw on the
    condition of the total. Beyond a thousand million slots the share is the
    rounded expectation, from which a draw differs by less than one in ten thousand.
    """
    total = int(slots.sum())
    shards = max(1, -(-total // per_shard))
    low, high, here, before, node = 0, shards, slots.astype(np.int64), np.zeros(len(slots), np.int64), 1
    while high - low > 1:
        middle = (low + high) // 2
        share, amount = (middle - low) * per_shard, int(here.sum())
        if amount < 1_000_000_000:
            draw = np.random.default_rng([seed, node]).multivariate_hypergeometric(here, share, method="marginals")
        else:
            exact = here * (share / amount)
            draw = np.minimum(np.floor(exact).astype(np.int64), here)
            for at in np.argsort(draw - exact, kind="stable")[: share - int(draw.sum())]:
                draw[at] += 1
        if shard < middle:
            high, here, node = middle, draw, 2 * node
        else:
            low, before, here, node = middle, before + draw, here - draw, 2 * node + 1
    return before, here


def targets(sizes: pd.DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> pd.DataFrame:
    """``target`` of each source (rows: source, source_size), by the source's place in code point order.

    Shares of the whole by weight; a share above ``most`` times its source's size
    stops there and the excess is shared again among the others.
    """
    order = sorted(range(len(sizes)), key=lambda i: (sizes["source"][i] is None, sizes["source"][i] or ""))
    out = sizes.iloc[order].reset_index(drop=True)
    weight = np.array([weights[i % len(weights)] for i in range(len(out))], float)
    size = out["source_size"].to_numpy(float)
    target, open_, rest = np.zeros(len(out)), np.ones(len(out), bool), float(size.sum())
    while open_.any():
        share = rest * weight / weight[open_].sum()
        over = open_ & (share > most * size)
        if not over.any():
            target[open_] = share[open_]
            break
        target[over] = most * size[over]
        rest -= target[over].sum()
        open_ &= ~over
    return out.assign(source_no=np.arange(len(out)), target=target)


def sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The documents' columns with ``size``: the words of the whole text (null: 0)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*columns, size.alias("size"))


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the word range [begin, end) of each document in its source.

    Order in a source: hash bucket, doc_id, text hash. Buckets split a hot source,
    and only ``BUCKETS`` sums a source are needed to join them.
    """
    rows = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select(
        F.col("source").alias("of"), F.col("bucket").alias("at"),
        (F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("before"),
    )
    inside = W.partitionBy("source", "bucket").orderBy("doc_id", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("inside", F.sum("size").over(inside))
    joined = placed.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
    end = F.col("before") + F.col("inside")
    return joined.withColumns({"begin": end - F.col("size"), "end": end}).drop("bucket", "of", "at", "before", "inside")


def source_table(docs: DataFrame, weights: tuple, most: int) -> pd.DataFrame:
    """One row per source with its target and its epochs; raises above ``MAX_SOURCES`` sources."""
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = sizes.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    table = targets(pd.DataFrame([(r["source"], r["source_size"]) for r in rows], columns=["source", "source_size"]).astype({"source": object}), weights, most)
    words = table["target"].round().astype("int64")
    size = table["source_size"].clip(lower=1).astype("int64")
    return table.assign(epochs=words // size, rest=words % size)


def draw_slots(spark, table: pd.DataFrame, seed: int, block: int, per_shard: int = SLOTS) -> DataFrame:
    """Every output slot: its shard, place, source, epoch, block and the words it takes of the block.

    In an epoch a source's full blocks come in permuted order and the short last
    block after them.
    """
    size = table["source_size"].to_numpy(np.int64)
    full, tail = size // block, size % block
    epochs, rest = table["epochs"].to_numpy(np.int64), table["rest"].to_numpy(np.int64)
    per_epoch = full + (tail > 0)
    slots = epochs * per_epoch + -(-rest // block)
    shards = -(-int(slots.sum()) // per_shard)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                before, here = shard_counts(slots, int(shard), seed, per_shard)
                source = np.repeat(np.arange(len(here)), here)
                first = np.repeat(np.cumsum(here) - here, here)
                draw = before[source] + np.arange(len(source)) - first
                epoch, place = draw // per_epoch[source], draw % per_epoch[source]
                number = place.copy()
                inner = place < full[source]
                key = (np.uint64(seed) << np.uint64(40)) + source[inner].astype(np.uint64) * np.uint64(64) + epoch[inner].astype(np.uint64)
                number[inner] = permute(place[inner], full[source[inner]], mix64(key))
                words = np.where(inner, block, tail[source])
                last = epoch == epochs[source]
                words = np.where(last, np.minimum(words, rest[source] - place * block), words)
                order = np.random.default_rng([seed, 7, int(shard)]).permutation(len(source))
                frame = pd.DataFrame({"shard": shard, "source_no": source, "epoch": epoch, "block": number, "words": words})
                frame = frame.iloc[order]
                frame.insert(1, "slot", np.arange(len(frame)))
                yield frame

    return spark.range(0, shards, 1, max(1, min(shards, spark.sparkContext.defaultParallelism * 4))).mapInPandas(task, SLOT_ROWS)


def _source_rows(spark: SparkSession, table: pd.DataFrame) -> DataFrame:
    """of, source_no, source_size and target of each source.

    Arrow data become a table in the JVM; a list of rows would go through workers of another kind, which stay beside those of the queries.
    """
    columns = [
        pa.array(table["source"].tolist(), pa.string()), pa.array(table["source_no"].tolist(), pa.int32()),
        pa.array(table["source_size"].tolist(), pa.int64()), pa.array(table["target"].tolist(), pa.float64()),
    ]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=["of", "source_no", "source_size", "target"]))


def block_parts(docs: DataFrame, table: pd.DataFrame, block: int) -> DataFrame:
    """Documents cut at the blocks of their source: source_no, block, and the words [from, to) of the document.

    ``docs`` are placed; a document without words has no part.
    """
    spark = docs.sparkSession
    numbers = _source_rows(spark, table).select("of", "source_no")
    rows = docs.where("size > 0").join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    whole = F.sequence(F.expr(f"begin div {block}"), F.expr(f"(end - 1) div {block}"))
    rows = rows.withColumn("block", F.explode(whole))
    return rows.withColumns({
        "at": F.greatest(F.col("block") * block - F.col("begin"), F.lit(0)),
        "to": F.least((F.col("block") + 1) * block, F.col("end")) - F.col("begin"),
        "in_block": F.greatest(F.col("begin") - F.col("block") * block, F.lit(0)),
    })


def _cut(text: str, spans: str) -> Column:
    """The words [at, upto) of each span with the space after each, the first word with the space before it."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?:^{SPACE}+)?{WORD}{SPACE}*"), F.lit(0))

    def joined(held: Column) -> Column:
        return F.array_join(F.flatten(F.transform(spans, lambda s: F.slice(held, s["at"] + 1, s["upto"] - s["at"]))), "")

    # An array of one: the text is cut into pieces once, not once a span.
    return F.transform(F.array(pieces), joined)[0]


class Mix:
    """The placed documents, the sources' targets and the drawn slots of one mix."""

    def __init__(self, docs: DataFrame, weights: tuple, most: int, seed: int, block: int) -> None:
        spark = docs.sparkSession
        tie = F.xxhash64("text").alias("tie")
        self.docs = written(sized(docs, ["doc_id", F.col("source").cast("string").alias("source"), tie]), "sizes")
        self.table = source_table(self.docs, weights, most)
        self.block = block
        self.placed = written(placed(self.docs), "placed")
        self.slots = draw_slots(spark, self.table, seed, block)
        self.parts = block_parts(self.placed, self.table, block)

    def takes(self) -> DataFrame:
        """Each slot's words of each document: source_no, begin, epoch, block, at, upto (words of the document)."""
        both = self.parts.join(self.slots, ["source_no", "block"])
        upto = F.least(F.col("to"), F.col("at") + F.col("words") - F.col("in_block"))
        return both.withColumn("upto", upto).where("upto > at")


def source_mix(
    docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = 20, block: int = BLOCK
) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document.

    Null or wordless text: size 0, taken 0. A null source is a source, the last
    in order. Null doc_id and repeated rows are documents of their own; equal
    rows share what the blocks they lie in take. An empty table gives no row.
    """
    mix = Mix(docs, weights, most, seed, block)
    counted = mix.takes().groupBy("source_no", "begin").agg(F.sum(F.col("upto") - F.col("at")).alias("taken"))
    info = _source_rows(docs.sparkSession, mix.table)
    rows = mix.placed.join(F.broadcast(info), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    has = rows.where("size > 0").join(counted, ["source_no", "begin"], "left")
    none = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", "taken", "source"]
    return has.select(*columns).unionByName(none.select(*columns)).withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(
    docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = 20, block: int = BLOCK
) -> DataFrame:
    """The mix as documents, with the columns of ``docs``.

    A document comes once per epoch that takes words of it: whole in the whole
    epochs, and in its source's last epoch the parts that were drawn, in order, a
    part being cut at words with the space after them. ``n_chars``, if there is
    such a column, is that of the new text. Documents without words hold nothing
    to take and are left out.
    """
    mix = Mix(docs, weights, most, seed, block)
    spans = F.sort_array(F.collect_list(F.struct("at", "upto")))
    copies = mix.takes().groupBy("source_no", "begin", "epoch").agg(
        F.first("doc_id").alias("_id"), F.first("tie").alias("_tie"), F.first("size").alias("_size"), spans.alias("_spans")
    )
    whole = F.expr("aggregate(_spans, 0L, (n, s) -> n + s.upto - s.at)") == F.col("_size")
    copies = copies.withColumn("_spans", F.when(~whole, F.col("_spans")))
    # Rows equal in doc_id and text are told apart by number; one exchange serves the window and the join.
    keyed = F.coalesce("doc_id", F.lit(-(1 << 63)))
    same = W.partitionBy("_key", "_hash").orderBy(F.lit(1))
    texts = docs.where("text IS NOT NULL").withColumns({"_key": keyed, "_hash": F.xxhash64("text")})
    texts = texts.withColumn("_nth", F.row_number().over(same))
    nth = F.row_number().over(W.partitionBy("_id", "_tie", "epoch").orderBy("source_no", "begin"))
    copies = copies.withColumn("_copy", nth).select(
        F.coalesce("_id", F.lit(-(1 << 63))).alias("_key"), F.col("_tie").alias("_hash"), "_copy", "_spans"
    )
    both = texts.join(copies, ["_key", "_hash"]).where("_nth = _copy")
    # Texts stay in the JVM: workers, which other stages leave full, take no part.
    out = both.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(_cut("text", "_spans")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)
