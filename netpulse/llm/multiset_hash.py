"""Homomorphic multiset fingerprints of documents, with DataFrame functions only.

A document is the multiset of its paragraphs (lines). Each paragraph is hashed to
a wide vector, and the fingerprint is the sum of the vectors, modulo powers of
two: the order of paragraphs does not matter, and inserting or deleting one adds
or subtracts its vector (``combine``). A vector has two groups of lanes:

* ``EXACT`` lanes of 32 bits hashed from the whole paragraph, which tell multisets
  apart;
* ``LIKE`` lanes that add up the signs hashed from each sentence of the paragraph.
  Sums of random signs keep the angle between multisets, so the cosine of two
  fingerprints estimates how many sentences they share. While they are added,
  two lanes travel in one BIGINT as counts of positive signs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netpulse.operators.ordinal import with_position
from netpulse.sinks.tables import written

EXACT = 8
LIKE = 128
_MOD = 1 << 32
_NO_ID = -(1 << 63)
_SENTENCE_END = r"(?<=[.!?])\s+"


def _parts(text: Column) -> Column:
    """Sentences in order; the first of a paragraph carries the paragraph."""
    paragraphs = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    def sentences(paragraph: Column) -> Column:
        return F.transform(
            F.split(paragraph, _SENTENCE_END, -1),
            lambda s, i: F.struct(F.when(i == 0, paragraph).alias("paragraph"), s.alias("sentence")),
        )

    return F.flatten(F.transform(paragraphs, sentences))


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, exact (lanes of 0 .. 2^32 - 1) and like (signed lanes) of each text.

    ``keys`` identify a text. Null and empty text: one empty paragraph without a
    sentence. Every sentence is one row between the explode and the sum, and the
    sums combine before any shuffle.
    """
    rows = texts.select(*keys, F.explode(_parts(F.col(text))).alias("p")).select(*keys, "p.*")
    lanes = {}
    for i in range(EXACT // 2):
        h = F.xxhash64(F.lit(i + 1), "paragraph")
        inside = F.col("paragraph").isNotNull()
        lanes[f"e{2 * i}"] = F.sum(F.when(inside, h.bitwiseAND(F.lit(_MOD - 1))))
        lanes[f"e{2 * i + 1}"] = F.sum(F.when(inside, F.shiftrightunsigned(h, 32)))
    hashes = {f"h{w}": F.xxhash64(F.lit(100 + w), "sentence") for w in range(LIKE // 64)}
    spoken = F.col("sentence") != ""
    rows = rows.withColumns(hashes)
    for i in range(LIKE // 2):
        h, bit = F.col(f"h{i // 32}"), i % 32
        pair = F.shiftrightunsigned(h, bit).bitwiseAND(F.lit((1 << 32) | 1))
        lanes[f"p{i}"] = F.sum(F.when(spoken, pair))
    sums = rows.groupBy(*keys).agg(F.count_if(spoken).alias("n"), *[c.alias(name) for name, c in lanes.items()])
    like = []
    for i in range(LIKE // 2):
        both = F.coalesce(F.col(f"p{i}"), F.lit(0))
        for positive in (both.bitwiseAND(F.lit(_MOD - 1)), F.shiftrightunsigned(both, 32)):
            like.append((positive * 2 - F.col("n")).cast("int"))
    exact = [F.pmod(F.col(f"e{i}"), F.lit(_MOD)) for i in range(EXACT)]
    return sums.select(*keys, F.array(*exact).alias("exact"), F.array(*like).alias("like"))


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """Lane-wise sum (1: insert) or difference (-1: delete) of exact lanes, modulo 2^32."""
    return F.zip_with(left, right, lambda a, b: F.pmod(a + b * sign, F.lit(_MOD)))


def as_text(exact: Column, like: Column) -> Column:
    """All lanes modulo 2^32 as hexadecimal text, eight digits a lane."""
    lanes = F.concat(exact, F.transform(like, lambda v: F.pmod(v.cast("long"), F.lit(_MOD))))
    return F.array_join(F.transform(lanes, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def likeness(left: Column, right: Column) -> Column:
    """Cosine of two groups of sign lanes, at least 0; equal lanes: 1."""

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y)
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(left, left) * dot(right, right))
    cosine = F.when(norm > 0, dot(left, right) / norm).otherwise(F.lit(0.0))
    return F.when(left == right, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def edited_texts(docs: DataFrame) -> DataFrame:
    """key, next_key, n_chars, text and edited of every document.

    The last third of the code points gives way to the beginning of the next
    document in descending doc_id; after the last comes the first. Rows that
    share a doc_id are one document, that of the smallest text hash. Null doc_id
    is one document, the last in descending order.
    """
    rows = docs.select(
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    sizes = rows.select("key", F.struct("tie", F.char_length("text").alias("n")).alias("size"))
    one = sizes.groupBy("key").agg(F.min("size").alias("size")).select("key", "size.*", F.lit(1).alias("all"))
    # Ascending positions: the next document in descending order is one lower, and before the first is the last.
    order = with_position(one, ["all"], ["key"])
    order = order.select("key", "tie", "n", "pos", F.pmod(F.col("pos") - 1, F.col("n_rows")).alias("next_pos"))
    after = order.select(F.col("key").alias("next_key"), F.col("pos").alias("next_pos"))
    before = order.select(F.col("key").alias("of"), F.col("n").alias("n_of"), F.col("next_pos").alias("pos"))
    plan = written(
        order.join(after, "next_pos").join(before, "pos").select(
            "key", F.col("tie").alias("wanted"), "next_key", F.expr("int(n div 3)").alias("cut"), "of", F.expr("int(n_of div 3)").alias("cut_of")
        ),
        "edits",
    )
    # Every document is some other one's next: the texts are shuffled once, and their beginnings once more.
    # Not an equality of columns, or it would become a join key and the next window need another shuffle.
    found = rows.join(plan, "key").where("(tie ^ wanted) = 0")
    same = W.partitionBy("key").orderBy("key")
    found = found.withColumn("_row", F.row_number().over(same)).where("_row = 1")
    heads = found.select(F.col("of").alias("key"), F.substring("text", F.lit(1), F.col("cut_of")).alias("head"))
    both = found.select("key", "next_key", "text", "cut").join(heads, "key")
    length = F.char_length("text")
    kept = F.substring("text", F.lit(1), length - F.col("cut"))
    return both.select(
        "key", "next_key", length.cast("long").alias("n_chars"), "text", F.concat(kept, "head").alias("edited")
    )


def multiset_hash(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next of every document.

    Null text counts as empty. A single document is its own next one. An empty
    table gives no row; columns but doc_id and text are left out.
    """
    texts = edited_texts(docs).withColumn("sha", F.sha2("edited", 256))
    version = F.explode(F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("body")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("body"))))
    bodies = texts.select("key", "next_key", "n_chars", "sha", version.alias("v")).select("key", "next_key", "n_chars", "sha", "v.*")
    prints = fingerprints(bodies, ["key", "next_key", "n_chars", "sha", "version"], "body")
    # Both versions of a document are in one task already; this pairs them without a shuffle.
    plain = F.max(F.when(F.col("version") == 0, F.struct("exact", "like"))).alias("plain")
    edited = F.max(F.when(F.col("version") == 1, F.struct("exact", "like"))).alias("edited")
    paired = written(prints.groupBy("key", "next_key", "n_chars", "sha").agg(plain, edited), "fingerprints")
    following = paired.select(F.col("key").alias("next_key"), F.col("plain.like").alias("like_n"))
    both = paired.join(following, "next_key")
    return both.select(
        F.nullif("key", F.lit(_NO_ID)).alias("doc_id"),
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        as_text(F.col("plain.exact"), F.col("plain.like")).alias("fingerprint"),
        as_text(F.col("edited.exact"), F.col("edited.like")).alias("edited_fingerprint"),
        likeness(F.col("plain.like"), F.col("edited.like")).alias("near_edited"),
        likeness(F.col("plain.like"), F.col("like_n")).alias("near_next"),
    )
