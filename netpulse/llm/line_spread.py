"""Line dedup by distinct-site spread, with DataFrame functions only.

Each line hash gets a HyperLogLog sketch of the sites it occurs on, built from the
lines themselves with a combine before the shuffle. Sketches of parts of a corpus
merge by aggregation (``merge_sketches``), so a new batch needs no second look at
the old one. An estimate that is clearly above or below the threshold decides; only
lines whose estimate is within ``BAND`` of it get an exact distinct count, from the
sites of these lines alone. A line on at least ``min_sites`` sites is boilerplate:
it stays where it occurs first and goes everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netpulse.sinks.tables import written

MIN_SITES = 5
BAND = 0.5
LG_K = 12
# Parts of a line in joins: a line that a third of all rows hold is so many keys.
PARTS = 16


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_places(docs: DataFrame) -> DataFrame:
    """line (128-bit hash), site, doc_id, text hash and place of every line that is not blank.

    Blank lines are layout and never boilerplate. A null source is a site of its own.
    """
    rows = docs.where("text IS NOT NULL").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("site"), F.xxhash64("text").alias("tie"),
        F.posexplode(_lines(F.col("text"))).alias("place", "content"),
    )
    line = F.struct(F.xxhash64("content").alias("one"), F.xxhash64(F.lit(1), "content").alias("two"))
    return rows.where(F.trim("content") != "").select("doc_id", "tie", "site", "place", line.alias("line"))


def line_sketches(places: DataFrame) -> DataFrame:
    """The sketch of sites, the number of occurrences and the first place of every line hash.

    Occurrences combine in their tasks: a line that a third of all rows hold arrives
    once per task.
    """
    return places.groupBy("line").agg(
        F.hll_sketch_agg("site", F.lit(LG_K)).alias("sites"), F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "tie", "place")).alias("first")
    )


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of several batches, merged."""
    return sketches.groupBy("line").agg(F.hll_union_agg("sites").alias("sites"), F.sum("n").alias("n"), F.min("first").alias("first"))


def _among(places: DataFrame, lines: DataFrame, how: str) -> DataFrame:
    """``places`` joined with a table of lines, each of them in ``PARTS`` parts."""
    dealt = places.withColumn("part", F.pmod(F.xxhash64("doc_id", "place"), F.lit(PARTS)).cast("int"))
    return dealt.join(lines.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["line", "part"], how).drop("part")


def boilerplate(places: DataFrame, min_sites: int) -> DataFrame:
    """The line hashes on at least ``min_sites`` distinct sites, with their first place."""
    low, high = min_sites * (1 - BAND), min_sites * (1 + BAND)
    # A line that occurs less often than min_sites cannot be on that many sites.
    often = line_sketches(places).where(F.col("n") >= min_sites)
    judged = often.select("line", "first", F.hll_sketch_estimate("sites").alias("sites")).where(F.col("sites") >= low)
    judged = written(judged, "line-estimates")
    near = judged.where(F.col("sites") <= high)
    pairs = _among(places, near.select("line"), "left_semi").select("line", "site").distinct()
    exact = pairs.groupBy("line").agg(F.count(F.lit(1)).alias("exact")).where(F.col("exact") >= min_sites)
    certain = judged.where(F.col("sites") > high).select("line", "first")
    return certain.union(near.join(exact, "line").select("line", "first"))


def removed_places(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, text hash and places of the lines to remove, one row per document that loses any."""
    places = line_places(docs)
    spread = written(boilerplate(places, min_sites), "boilerplate")
    hits = _among(places, spread, "inner").where(~F.struct("doc_id", "tie", "place").eqNullSafe(F.col("first")))
    # Rows equal in doc_id and text are one document here; their lines are the same.
    return hits.groupBy("doc_id", "tie").agg(F.collect_set("place").alias("removed"))


def _cleaned(docs: DataFrame, min_sites: int) -> DataFrame:
    """``row``, all columns of a document as they are, beside the new ``text``, ``n_lines`` and ``n_removed``."""
    gone = removed_places(docs, min_sites).select(F.col("doc_id").alias("gone_id"), F.col("tie").alias("gone_tie"), "removed")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie")
    )
    both = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("tie") == F.col("gone_tie")), "left")
    text = F.col("row").getField("text")
    kept = F.filter(_lines(text), lambda line, at: ~F.array_contains("removed", at))
    return both.select(
        "row",
        F.when(F.col("removed").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.size(_lines(text)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
    )


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with ``text`` without boilerplate lines, and ``n_lines`` and ``n_removed`` beside it.

    Sites are values of ``source``. First place: smallest doc_id (null first), then
    text hash, then line. Null text stays null with no lines; an empty text is one
    blank line; a text of any length is read whole. A document that consists of
    boilerplate seen before ends with an empty text and stays. Rows equal in doc_id
    and text get the same result. An empty table gives no row. Other columns stay as
    they are, whatever their names; columns ``n_lines`` and ``n_removed`` of the
    input give way to those of the result.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    columns = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in own]
    return _cleaned(docs, min_sites).select(*columns, "n_lines", "n_removed")


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``line_dedup`` with the columns of ``docs``; ``n_chars``, where present, is that of the new text.

    All other columns keep their values. Null and empty texts, repeated rows, very
    long texts and empty tables as in ``line_dedup``.
    """
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long").alias("n_chars")}
    return _cleaned(docs, min_sites).select(*[new.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns])
