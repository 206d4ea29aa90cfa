"""Prefix trie of conversations by a van Emde Boas recursion over depth, with DataFrame functions only.

The sequences are cut at half their depth: the part above the cut is the upper
trie, the parts below it are the lower forests, and each half is cut the same
way until every segment is one turn high. All segments of one height are
handled at once, so there are log2(depth) rounds instead of one per turn:

1. naming, from the lowest cuts up: the prefix that ends at a cut has a 128-bit
   name, and a position below the cut is named by the cut's name and its own
   name inside the lower forest;
2. grafting, in the same order: the totals of the roots of a lower forest are
   summed per leaf of the upper trie and added to that leaf and to its ancestors
   inside the upper trie. A segment of height h so costs its cut nodes times h.

Each round is written to the shared folder. A turn that a third of all
conversations begin with combines before the shuffle, and a conversation with a
third of all turns is placed by a range partition and joined by skew joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netpulse.llm.text import WORD
from netpulse.operators.ordinal import with_position
from netpulse.sinks.tables import written

BLOCK, STEPS = 20, 4
# Ids of conversations that end at one node are joined to text in pieces of this many.
PIECE = 4096
NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)


def _name(first: Column | str, *rest: Column | str) -> list[Column]:
    """Two 64-bit hashes of the values, as columns a and b."""
    return [F.xxhash64(F.lit(seed), first, *rest).alias(name) for seed, name in ((1, "a"), (2, "b"))]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), n_rows, the name (a, b) and the words of every turn; rows without conv_id are left out."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    placed = with_position(turns, ["conv_id"], ["turn", "role", "text"])
    words = F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")
    return placed.select("conv_id", "pos", "n_rows", *_name("role", "text"), words)


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations with the beginning of another one: (conv_id, n_turns) and their turns.

    The first h turns of conversation c - c % 20 replace the first h of c, where
    h is crc32 of c in decimal, modulo 4. At most 39 conversations share a beginning.
    """
    own = turns.groupBy("conv_id").agg(F.max("n_rows").alias("n_own"))
    plan = own.withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % BLOCK,
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % STEPS,
    })
    sizes = own.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    plan = plan.join(sizes, "base", "left").withColumn("n_head", F.least("h", F.coalesce("n_base", F.lit(0))))
    plan = plan.withColumn("n_turns", F.col("n_head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))
    plan = written(plan.select("conv_id", "base", "h", "n_head", "n_turns"), "trie-plan")
    begins = turns.where(F.col("pos") < STEPS - 1).select(F.col("conv_id").alias("base"), "pos", "a", "b", "words")
    heads = plan.join(begins, "base").where("pos < h").select("conv_id", "pos", "a", "b", "words")
    tails = turns.join(plan, "conv_id").where("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("n_head")).alias("pos"), "a", "b", "words"
    )
    return plan.select("conv_id", "n_turns"), heads.unionByName(tails)


def prefix_names(turns: DataFrame) -> tuple[DataFrame, int]:
    """The turns (conv_id, pos, a, b, words) with a and b naming the whole prefix up to them, and the greatest depth."""
    named = written(turns, "trie-turns")
    depth = named.agg(F.max("pos")).first()[0]
    depth = 0 if depth is None else depth + 1
    half = 1
    while half < depth:
        # Positions in the lower half of a segment of height 2 * half take the name of the cut above them.
        at = F.expr(f"pos - pos % {half} - 1")
        lower = named.where(F.col("pos") % (2 * half) >= half).withColumn("cut", at)
        cuts = named.where(F.col("pos") % (2 * half) == half - 1).select(
            "conv_id", F.col("pos").alias("cut"), F.col("a").alias("cut_a"), F.col("b").alias("cut_b")
        )
        joined = lower.join(cuts, ["conv_id", "cut"]).select(
            "conv_id", "pos", *_name("cut_a", "cut_b", "a", "b"), "words"
        )
        named = written(named.where(F.col("pos") % (2 * half) < half).unionByName(joined), "trie-names")
        half *= 2
    return named, depth


def trie_nodes(named: DataFrame) -> DataFrame:
    """One row per node below the root: its name, pos, first member, members, words, and its parent's name (null: the root)."""
    nodes = named.groupBy("pos", "a", "b").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words")
    )
    above = named.select("conv_id", (F.col("pos") + 1).alias("pos"), F.col("a").alias("up_a"), F.col("b").alias("up_b"))
    return nodes.join(above, ["conv_id", "pos"], "left")


def graft(nodes: DataFrame, named: DataFrame, depth: int) -> DataFrame:
    """a, b and the totals (leaves, saved) of every node's subtree, from its own ``leaves`` and ``saved``."""
    paths = named.select("conv_id", "pos", "a", "b")
    totals = nodes.select("pos", "conv_id", "a", "b", "up_a", "up_b", "leaves", "saved")
    half = 1
    while half < depth:
        roots = totals.where(F.col("pos") % (2 * half) == half)
        # One row per leaf of an upper trie; its first member is on the path of all its ancestors.
        hung = roots.groupBy("up_a", "up_b").agg(
            F.min("conv_id").alias("conv_id"), F.min("pos").alias("cut"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
        ancestors = hung.select("conv_id", "leaves", "saved", F.explode(F.sequence(F.col("cut") - half, F.col("cut") - 1)).alias("pos"))
        gains = ancestors.join(paths, ["conv_id", "pos"]).groupBy("a", "b").agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        totals = written(
            totals.join(gains, ["a", "b"], "left").withColumns({
                "leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)),
                "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0)),
            }).drop("more_leaves", "more_saved"),
            "trie-totals",
        )
        half *= 2
    return totals


def end_hashes(ends: DataFrame) -> DataFrame:
    """a, b and the SHA-256 of the ids (conv_id) that end at each node, ascending and comma-joined.

    Ids are joined in pieces by position, and a node's pieces stream through one
    hash: a node with many ends is never held as a whole.
    """
    placed = with_position(ends, ["a", "b"], ["conv_id"])
    pieces = placed.groupBy("a", "b", F.expr(f"pos div {PIECE}").alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, digest = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(batch["a"], batch["b"], batch["ids"], strict=True):
                if node == (a, b):
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = (a, b), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["a", "b", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, digest.hexdigest())], columns=["a", "b", "ends_sha256"])

    ordered = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "piece")
    return ordered.select("a", "b", "ids").mapInPandas(task, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    Conversations are rebuilt first (``rebuilt_turns``). Turns are ordered by
    turn, null first, then role and text; null role or text is empty. Rows
    without conv_id take no part; repeated rows are turns of their own; very long
    texts are hashed whole. An empty table gives no row. Other columns are left out.
    """
    plan, rebuilt = rebuilt_turns(written(ordered_turns(conversations), "trie-ordered"))
    named, depth = prefix_names(rebuilt)
    nodes = written(trie_nodes(named), "trie-nodes")
    children = nodes.groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    known = nodes.join(children.where("a IS NOT NULL"), ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = known.withColumns({
        "leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"),
        "saved": (F.col("n_convs") - 1) * F.col("words"),
    })
    known = written(known, "trie-children")
    totals = graft(known, named, depth).select("a", "b", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    totals = written(totals, "trie-grafted")
    last = plan.where("n_turns > 0").select("conv_id", (F.col("n_turns") - 1).alias("pos"))
    ends = end_hashes(named.join(last, ["conv_id", "pos"]).select("a", "b", "conv_id"))
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    below = known.join(totals, ["a", "b"]).join(ends, ["a", "b"], "left").join(parents, ["up_a", "up_b"], "left")
    root = _root(plan, known, totals)
    below = below.withColumns({
        "depth": F.col("pos") + 1,
        "parent_conv_id": F.coalesce("parent_conv_id", F.lit(root[0][0] if root else None).cast("long")),
        "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)),
    })
    top = conversations.sparkSession.createDataFrame(root, NODE)
    return below.select(*top.columns).unionByName(top)


def _root(plan: DataFrame, known: DataFrame, totals: DataFrame) -> list[tuple]:
    """The root as one row; no row without a conversation."""
    members, first = plan.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    if not members:
        return []
    top = known.where("pos = 0").select("a", "b").join(totals, ["a", "b"])
    children, leaves, saved = top.agg(F.count(F.lit(1)), F.sum("n_leaves"), F.sum("saved_tokens")).first()
    zero = F.lit(0).cast("long")
    ends = end_hashes(plan.where("n_turns = 0").select(zero.alias("a"), zero.alias("b"), "conv_id")).first()
    digest = ends["ends_sha256"] if ends else hashlib.sha256(b"").hexdigest()
    return [(first, 0, None, members, children, leaves if children else 1, saved or 0, digest)]
