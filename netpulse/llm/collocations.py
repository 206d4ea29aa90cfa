"""Phrase collocations, counted by weighted acyclic automata.

Every task builds automata of the word windows of its documents: the ``longest``
words that begin at each place of a piece, padded at the piece's end. The windows
that begin with a phrase are as many as its occurrences, so its count is the sum
over a prefix range. Automata are cut at bounds of (lang, first word, second
word); those of one range meet in one task, are united there, and give all
phrases with enough occurrences. Repeats combine before the shuffle: a pair that a
third of all rows hold is one entry per automaton, and a frequent first word is
cut among ranges by its second words. Words are 64-bit hashes on the way (two of
five million agree with a probability of 7e-7); each range spells the words its
sequences begin with, and every word begins some. The counts of a phrase's parts are looked up
by composing an automaton of the parts with the counts of their range. Scores are
whole numbers in decimals of 38 digits.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netpulse.llm.count_automata import CountAutomaton, Names, Sequences, summed, union
from netpulse.llm.text import SLICE, hashed_runs, small_batches
from netpulse.sinks.tables import written

UNKNOWN = "und"
# Products of counts stay whole numbers of up to 38 digits.
SCORE = (
    "(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))))"
    " div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"
)
LONGEST, LEAST, BEST = 3, 10, 2000
# Fixed values of the contract: pieces end at these bytes, words at these and at blank and tab.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"
# Words of one automaton in a task, windows of one range, and bounds drawn from an automaton.
CHUNK, RANGE, DRAWN = 1 << 19, 1 << 19, 128
_INSIDE = np.ones(256, bool)
_INSIDE[list(BREAKS + BLANKS)] = False
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
# Rows of megabytes: a page or a row group ends at its size, not after the hundred rows the writer waits for.
EACH_ROW = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}
FOUND = "kind string, bucket int, lang string, words array<long>, name string, a long, automaton binary"


class Words:
    """The words of many texts as numbers of a dictionary, with the piece and the tag of each."""

    def __init__(self) -> None:
        self.names: list[Names] = []
        self.tags: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.pieces = 0

    def add(self, tags: list[str], texts: list[str]) -> None:
        data = "\n".join(texts).encode("utf-8", "surrogatepass") + b"\n"
        ends = np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])
        tag = np.array([self.tags.setdefault(t, len(self.tags)) for t in tags], np.int64)
        at = 0
        while at < len(data):
            upto = _cut(data, at)
            part = data[at:upto]
            hashes, starts, stops = hashed_runs(part, _INSIDE)
            hashes = hashes.view(np.int64)
            new, first = np.unique(hashes, return_index=True)
            self.names.append(Names.of(part.lower(), new, starts[first], stops[first]))
            breaks = np.cumsum(_BREAK[np.frombuffer(part, np.uint8)])
            self.parts.append((hashes, self.pieces + breaks[starts], tag[np.searchsorted(ends, at + starts, "right")]))
            self.pieces += int(breaks[-1])
            self.size += len(hashes)
            at = upto

    def automaton(self, longest: int) -> CountAutomaton:
        """All windows, each padded where its piece ends."""
        hashes, piece, tag = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        names = Names.union(self.names)
        # What is joined needs its parts no longer.
        self.parts, self.names = [], []
        found = names.hashes
        which = np.searchsorted(found, hashes).astype(np.int32)
        del hashes
        tags = np.empty(len(self.tags), object)
        tags[:] = [t.encode("utf-8", "surrogatepass") for t in self.tags]
        by_tag = np.argsort(tags, kind="stable")
        tag_rank = np.empty(len(tags), np.int64)
        tag_rank[by_tag] = np.arange(len(tags))
        word = which + np.int32(1)
        columns = [tag_rank[tag].astype(np.int32), word]
        for k in range(1, longest):
            next_word = np.zeros(len(word), np.int32)
            same = piece[k:] == piece[:-k]
            next_word[: len(same)][same] = word[k:][same]
            columns.append(next_word)
        rows, weight = summed(columns, np.ones(len(word), np.int64))
        del columns, piece, tag, word, which
        return CountAutomaton.build(rows, weight, found, tags[by_tag], names)


def _cut(data: bytes, at: int) -> int:
    """The end of a stretch of about a slice that ends in a byte between words; a longer word stays whole."""
    if len(data) - at <= SLICE:
        return len(data)
    between = BREAKS + BLANKS
    cut = max(data.rfind(bytes([c]), at, at + SLICE) for c in between)
    if cut < 0:
        cut = min(p for c in between if (p := data.find(bytes([c]), at + SLICE)) >= 0)
    return cut + 1


def shard_automata(docs: DataFrame, longest: int) -> DataFrame:
    """Automata of about ``CHUNK`` words each, with their number of windows and some of their keys (lang, word, word)."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Words()

        def flush() -> pd.DataFrame:
            built = held.automaton(longest)
            columns, weight = built.sequences()
            at = np.unique(np.linspace(0, len(weight) - 1, min(DRAWN, len(weight))).astype(np.int64))
            keys = list(zip(*_keys(built, columns, at), strict=True))
            return pd.DataFrame({"automaton": [built.to_bytes()], "windows": [len(weight)], "drawn": [keys]})

        for batch in batches:
            texts, tags = batch["text"].tolist(), batch["lang"].tolist()
            at = size = 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= SLICE or i == len(texts) - 1:
                    held.add(tags[at : i + 1], texts[at : i + 1])
                    at, size = i + 1, 0
                    if held.size >= CHUNK:
                        yield flush()
                        held = Words()
        if held.size:
            yield flush()

    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text")
    ).where("text IS NOT NULL")
    key = "lang: binary, one: bigint, two: bigint"
    return texts.mapInPandas(task, f"automaton binary, windows long, drawn array<struct<{key}>>")


# The key of a sequence that ends after its first word; hashes below it do not occur in practice, and sort among them if they do.
_NONE = -(1 << 63)


def _keys(built: CountAutomaton | Sequences, columns: list[np.ndarray], at: np.ndarray) -> tuple[list, list, list]:
    """lang, first and second word (none: ``_NONE``) of the sequences at some places."""
    words = np.r_[_NONE, built.words]
    second = words[columns[2][at]] if len(columns) > 2 else np.full(len(at), _NONE)
    return built.tags[columns[0][at]].tolist(), words[columns[1][at]].tolist(), second.tolist()


def range_bounds(shards: DataFrame, number: int) -> list[tuple[bytes, int, int]]:
    """At most ``number`` lower bounds of ranges with about as many windows each, the first of all being left out."""
    keys = shards.select(F.explode("drawn").alias("key")).select("key.*")
    dealt = keys.repartitionByRange(number, "lang", "one", "two")
    lows = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("lang", "one", "two")).alias("low"))
    found = sorted({(bytes(r["low"]["lang"]), r["low"]["one"], r["low"]["two"]) for r in lows.collect()})
    return found[1:]


def _places_of(built: CountAutomaton, columns: list[np.ndarray], bounds: list[tuple]) -> list[int]:
    """For each bound the number of sequences below it, by bisection over the keys."""
    size, out = len(columns[0]), []
    for bound in bounds:
        low, high = out[-1] if out else 0, size
        while low < high:
            middle = (low + high) // 2
            if tuple(x[0] for x in _keys(built, columns, np.array([middle]))) < bound:
                low = middle + 1
            else:
                high = middle
        out.append(low)
    return out


def united(shards: DataFrame, bounds: list[tuple], longest: int, least: int) -> DataFrame:
    """Rows of ``FOUND`` for every range: frequent phrases, words of each lang, and the automaton of frequent prefixes."""
    shared = shards.sparkSession.sparkContext.broadcast(bounds)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["automaton"]:
                built = CountAutomaton.from_bytes(data)
                columns, weight = built.sequences()
                ends = [0, *_places_of(built, columns, shared.value), len(weight)]
                out = [(i, built.part(a, b, columns, weight).to_bytes()) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
                yield pd.DataFrame(out, columns=["bucket", "automaton"])

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, whole, waiting, names, size = None, None, [], [], 0

        def close() -> pd.DataFrame:
            return frequent(bucket, union(waiting + ([whole] if whole else [])), names, longest, least, shared.value)

        for batch in batches:
            for number, data in zip(batch["bucket"], batch["automaton"], strict=True):
                if number != bucket:
                    if bucket is not None:
                        yield close()
                    bucket, whole, waiting, names, size = number, None, [], [], 0
                part = CountAutomaton.from_bytes(data)
                names.append(part.names)
                waiting.append(Sequences.of(part))
                size += len(waiting[-1].weight)
                if len(waiting) > 1 and size > max(RANGE // 4, len(whole.weight) if whole else 0):
                    whole, waiting, size = union(waiting + ([whole] if whole else [])), [], 0
        if bucket is not None:
            yield close()

    parts = shards.select("automaton").mapInPandas(cut, "bucket int, automaton binary")
    return parts.repartition(len(bounds) + 1, "bucket").sortWithinPartitions("bucket").mapInPandas(unite, FOUND)


def frequent(bucket: int, counts: Sequences, names: list[Names], longest: int, least: int, bounds: list[tuple]) -> pd.DataFrame:
    """What a range knows: phrases of two words and more with their counts, their parts by range, words of each lang, names, and counts of frequent prefixes."""
    rows: list[tuple] = []
    kept, kept_weight = [], []
    words = np.r_[0, counts.words]
    langs = [t.decode("utf-8", "surrogatepass") for t in counts.tags]
    asked: set[tuple] = set()
    for size in range(1, longest + 1):
        columns, weight = counts.prefixes(size)
        if not len(weight):
            continue
        often = weight >= least
        if size == 1:
            per_lang = np.bincount(columns[0], weights=weight, minlength=len(langs)).astype(np.int64)
            rows += [("words", bucket, lang, None, None, n, None) for lang, n in zip(langs, per_lang.tolist(), strict=True)]
            # The first and the last word may go on in the ranges beside this one.
            often[[0, -1]] = True
            wanted = np.unique(words[columns[1][often]])
            for held in names:
                found = held.some(wanted)
                rows += [("name", bucket, None, [h], w.decode("utf-8", "surrogatepass"), 0, None) for h, w in found.spelled().items()]
                wanted = np.setdiff1d(wanted, found.hashes, assume_unique=True)
                if not len(wanted):
                    break
        chosen = [c[often] for c in columns]
        kept.append(chosen + [np.zeros(len(chosen[0]), np.int64)] * (longest - size))
        kept_weight.append(weight[often])
        if size > 1:
            for tag, n, *phrase in zip(chosen[0].tolist(), weight[often].tolist(), *[words[c].tolist() for c in chosen[1:]], strict=True):
                rows.append(("phrase", bucket, langs[tag], phrase, None, n, None))
                for k in range(1, size):
                    asked.add((tag, *phrase[:k]))
                    asked.add((tag, *phrase[k:]))
    # A part is asked for once by a range.
    for tag, *part in asked:
        low = (counts.tags[tag], part[0], part[1] if len(part) > 1 else _NONE)
        first = last = bisect_right(bounds, low)
        if len(part) == 1:
            # A word may begin in one range and go on in those whose bounds start with it.
            last = bisect_left(bounds, (counts.tags[tag], part[0] + 1, _NONE))
        rows += [("part", place, langs[tag], part, None, 0, None) for place in range(first, last + 1)]
    columns, weight = summed([np.concatenate(c) for c in zip(*kept, strict=True)], np.concatenate(kept_weight))
    table = CountAutomaton.build(columns, weight, counts.words, counts.tags).part(0, len(weight), columns, weight)
    rows.append(("counts", bucket, None, None, None, 0, table.to_bytes()))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])


def part_counts(found: DataFrame, longest: int, ranges_: int) -> DataFrame:
    """lang, part and count of every part of a frequent phrase, by composing the parts with the counts of their range."""
    asked = found.where("kind = 'part'").select("bucket", "lang", "words").distinct()
    rows = asked.withColumn("automaton", F.lit(None).cast("binary")).unionByName(
        found.where("kind = 'counts'").select("bucket", "lang", "words", "automaton")
    )

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = None
        for batch in batches:
            waiting: list[tuple] = []
            for lang, words, data in zip(batch["lang"], batch["words"], batch["automaton"], strict=True):
                if data is not None:
                    # The counts come first in their range.
                    if waiting:
                        yield _composed(waiting, table, longest)
                    table, waiting = CountAutomaton.from_bytes(data), []
                else:
                    waiting.append((lang, *words.tolist()))
            if waiting:
                yield _composed(waiting, table, longest)

    order = [F.col("bucket"), F.col("automaton").isNull(), F.col("lang"), F.col("words")]
    dealt = rows.repartition(ranges_, "bucket").sortWithinPartitions(*order)
    looked = dealt.select("lang", "words", "automaton").mapInPandas(task, "lang string, part array<long>, n long")
    return looked.groupBy("lang", "part").agg(F.sum("n").alias("n"))


def _composed(asked: list[tuple], table: CountAutomaton, longest: int) -> pd.DataFrame:
    langs = sorted({a[0] for a in asked}, key=lambda t: t.encode("utf-8", "surrogatepass"))
    tags = np.empty(len(langs), object)
    tags[:] = [t.encode("utf-8", "surrogatepass") for t in langs]
    number = {lang: i for i, lang in enumerate(langs)}
    words = np.unique(np.array([w for a in asked for w in a[1:]], np.int64))
    flat = np.zeros((len(asked), longest + 1), np.int64)
    for size in {len(a) for a in asked}:
        at = [i for i, a in enumerate(asked) if len(a) == size]
        flat[at, 1:size] = np.searchsorted(words, np.array([asked[i][1:] for i in at], np.int64)) + 1
    flat[:, 0] = [number[a[0]] for a in asked]
    columns, weight = summed(list(flat.T), np.zeros(len(flat), np.int64))
    columns, counts = CountAutomaton.build(columns, weight, words, tags).compose(table)
    out = [
        (langs[t], [w for w in row if w is not None], n)
        for t, n, *row in zip(columns[0].tolist(), counts.tolist(), *[[None if i == 0 else int(words[i - 1]) for i in c.tolist()] for c in columns[1:]], strict=True)
    ]
    return pd.DataFrame(out, columns=["lang", "part", "n"])


def _spelled(phrases: DataFrame, names: DataFrame) -> DataFrame:
    """Phrases with their words as text; a name may come from several ranges."""
    once = names.select(F.col("words")[0].alias("word"), "name").distinct()
    places = phrases.select("lang", "words", F.posexplode("words").alias("at", "word")).join(once, "word")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), " ")
    return phrases.join(places.groupBy("lang", "words").agg(text.alias("phrase")), ["lang", "words"])


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases.

    Null text is empty, null lang ``und``. Texts are read whole, rows that repeat
    count again, and only lang and text are read. Equal scores and counts go by
    phrase. An empty table, or one without a frequent phrase, gives no row.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        shards = written(shard_automata(docs, longest), "phrase-shards", **EACH_ROW)
        windows = shards.agg(F.sum("windows")).first()[0] or 0
        number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), windows // RANGE + 1)
        bounds = range_bounds(shards, number)
        found = written(united(shards, bounds, longest, least), "phrase-counts")
        counts = written(part_counts(found, longest, len(bounds) + 1), "phrase-parts")
    phrases = found.where("kind = 'phrase'").select("lang", "words", F.size("words").alias("size"), "a")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).withColumns({
        "first": F.slice("words", F.lit(1), F.col("k")), "rest": F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")),
    })
    left = counts.select("lang", F.col("part").alias("first"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("part").alias("rest"), F.col("n").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", F.expr(SCORE))
    lowest = cuts.groupBy("lang", "words", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> slice(words, i, m))))")
    longer = phrases.where("size > 2").select("lang", F.explode(inner).alias("words"), "a")
    longer = longer.groupBy("lang", "words").agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "words"], "left").where("longer IS NULL OR 100 * longer < 50 * a")
    spelled = _spelled(kept, found.where("kind = 'name'")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = spelled.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    n = found.where("kind = 'words'").groupBy("lang").agg(F.sum("a").alias("n"))
    return ranked.where(F.col("rank") <= best).join(n, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
