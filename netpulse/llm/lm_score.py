"""Scores of a trigram language model kept as Elias-Fano tries.

The model interpolates absolutely discounted trigrams and bigrams with add-one
unigrams; every part is quantised to an eighth of a bit in one byte. It grows with
the corpus and is never in one place:

1. documents become chunks of word numbers, and the words of a chunk ask shards of
   the vocabulary for their ids (frequent words have small ids) and counts;
2. each distinct window of three words of a chunk, with its training count, goes to
   a shard by its first word, or by its first two if the first is so frequent that
   it would fill a shard. The shard sums the counts of all chunks, builds the trie of
   its windows and answers every chunk from it;
3. the answers meet their chunk again and give one score per document.

Windows are combined before they move, so a shard gets an entry per chunk from a
pair that a third of all rows hold. Shards and chunks hold a bounded number of
words; a document above that is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netpulse.llm.count_automata import lexicographic, summed
from netpulse.llm.elias_fano import NgramTrie
from netpulse.llm.text import SLICE, hashed_words, mix64, word_hashes
from netpulse.sinks.tables import written

PAD, BEFORE, BEGIN, UNKNOWN, WORDS = range(5)
# The hash that stands for the end of a document among those of words.
END = np.uint64(0x5851F42D4C957F2D)
DISCOUNT = 0.75
# Words of a chunk, windows of a shard, and words of a shard of the vocabulary, about.
CHUNK, SHARD, VOCABULARY = 1 << 20, 1 << 22, 1 << 22
STEPS = 8


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative numbers in byte planes, compressed."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a, np.uint64)
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        parts += [len(a).to_bytes(8, "little"), bytes([width]), a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 0
    while at < len(body):
        size, width = int.from_bytes(body[at : at + 8], "little"), body[at + 8]
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :width] = np.frombuffer(body, np.uint8, size * width, at + 9).reshape(width, size).T
        out.append(wide.view(np.uint64)[:, 0])
        at += 9 + size * width
    return out


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 7, is 2 (null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after the other, each text closed by ``END``, and their sizes with the end."""
    out: list[np.ndarray] = []
    sizes: list[int] = []
    waiting: list[bytes] = []

    def flush() -> None:
        if waiting:
            data = b"".join(waiting)
            found, starts, _ = hashed_words(data, False)
            ends = np.searchsorted(starts, np.cumsum([len(w) for w in waiting]))
            out.append(np.insert(found, ends, END))
            sizes.extend((np.diff(np.r_[0, ends]) + 1).tolist())
            waiting.clear()

    held = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > SLICE:
            flush()
            out.append(np.r_[word_hashes(text), END])
            sizes.append(len(out[-1]))
            held = 0
            continue
        waiting.append(data + b" ")
        held += len(data)
        if held > SLICE:
            flush()
            held = 0
    flush()
    return np.concatenate([*out, np.zeros(0, np.uint64)]), np.array(sizes, np.int64)


CHUNKS = "chunk long, docs array<long>, held array<boolean>, tokens binary, vocabulary binary, n_tokens long, n_words long"


def chunked(docs: DataFrame) -> DataFrame:
    """Chunks of documents: ids, whether held out, word numbers by frequency in the chunk, and the words' hashes and training counts."""

    def row(number: int, ids: list, held: list, hashes: np.ndarray, sizes: np.ndarray) -> tuple:
        words, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        tokens = rank[which]
        learnt = np.repeat(~np.array(held, bool), sizes)
        trained = np.bincount(tokens[learnt], minlength=len(words))
        chunk = (TaskContext.get().partitionId() << 32) + number
        return chunk, ids, held, pack(tokens, sizes), pack(words[order], trained), len(tokens), len(words)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, waiting, size = 0, [], 0

        def close() -> pd.DataFrame:
            ids, held, hashes, sizes = (list(x) for x in zip(*waiting, strict=True))
            made = row(number, sum(ids, []), sum(held, []), np.concatenate(hashes), np.concatenate(sizes))
            return pd.DataFrame([made], columns=[c.split()[0] for c in CHUNKS.split(", ")])

        for batch in batches:
            ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            held, texts = batch["held"].tolist(), batch["text"].tolist()
            at = length = 0
            for i, text in enumerate(texts):
                length += len(text or "")
                if length >= SLICE or i == len(texts) - 1:
                    hashes, sizes = _hashes(texts[at : i + 1])
                    waiting.append((ids[at : i + 1], held[at : i + 1], hashes, sizes))
                    size += len(hashes)
                    at, length = i + 1, 0
                    if size >= CHUNK:
                        yield close()
                        number, waiting, size = number + 1, [], 0
        if waiting:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(task, CHUNKS)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the places it has, in order."""
    order = np.argsort(shard, kind="stable")
    found, first = np.unique(shard[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, first[1:]), strict=True)


MESSAGE = "shard int, chunk long, body binary"


def ask_words(chunks: DataFrame, shards: int) -> DataFrame:
    """What each chunk asks each shard of the vocabulary: numbers, hashes and training counts of its words."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, data in zip(batch["chunk"], batch["vocabulary"], strict=True):
                words, trained = unpack(data)
                shard = (mix64(words) % np.uint64(shards)).astype(np.int64)
                out = [(s, chunk, pack(at, words[at], trained[at])) for s, at in _by_shard(shard)]
                yield pd.DataFrame(out, columns=["shard", "chunk", "body"])

    return chunks.select("chunk", "vocabulary").mapInPandas(task, MESSAGE)


def _grouped(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[int, list]]:
    """Rows of a sorted stream with the same key, one group at a time."""
    now, rows = None, []
    for batch in batches:
        for row in batch.itertuples(index=False):
            if getattr(row, key) != now:
                if rows:
                    yield now, rows
                now, rows = getattr(row, key), []
            rows.append(row)
    if rows:
        yield now, rows


def _dealt(rows: DataFrame, shards: int, key: str, *order: str) -> DataFrame:
    return rows.repartition(shards, key).sortWithinPartitions(key, *order)


VOCABULARY_ANSWER = "chunk long, body binary, n_tokens long, n_words long"


def answer_words(asked: DataFrame, shards: int) -> DataFrame:
    """Ids and training counts of the words of each chunk; rows without a chunk carry the shard's totals."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard, rows in _grouped(batches, "shard"):
            parts = [unpack(r.body) for r in rows]
            (words,), counts = summed([np.concatenate([p[1] for p in parts]).view(np.int64)], np.concatenate([p[2] for p in parts]).astype(np.int64))
            order = np.argsort(-counts, kind="stable")
            ids = np.empty(len(words), np.int64)
            # Ids interleave the shards, so that frequent words have small ones.
            ids[order] = WORDS + np.arange(len(words)) * shards + shard
            ids[counts == 0] = UNKNOWN
            out = [(None, None, int(counts.sum()), int((counts > 0).sum()))]
            for r, (at, asked_for, _) in zip(rows, parts, strict=True):
                place = np.searchsorted(words, asked_for.view(np.int64))
                out.append((r.chunk, pack(at, ids[place], counts[place]), 0, 0))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in VOCABULARY_ANSWER.split(", ")])
            frame["chunk"] = frame["chunk"].astype("Int64")
            yield frame

    return _dealt(asked, shards, "shard", "chunk").mapInPandas(task, VOCABULARY_ANSWER)


def _windows(tokens: np.ndarray, sizes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Three columns of windows of the documents, the document of each, and the windows that predict the tokens in order.

    A document of n tokens has n + 1 windows, beginning before its first token; the
    last one has no third word and stands for the last bigram.
    """
    longer = sizes + 2
    ends = np.cumsum(longer)
    line = np.full(int(longer.sum()), UNKNOWN, np.int64)
    first = ends - longer
    line[first], line[first + 1] = BEFORE, BEGIN
    inside = np.ones(len(line), bool)
    inside[first] = inside[first + 1] = False
    line[inside] = tokens
    third = np.r_[line[2:], PAD, PAD][: len(line)]
    third[ends - 2] = PAD
    keep = np.ones(len(line), bool)
    keep[ends - 1] = False
    doc = np.repeat(np.arange(len(sizes)), longer)
    columns = [line[keep], np.r_[line[1:], PAD][keep], third[keep]]
    return columns, doc[keep], np.flatnonzero(columns[2] != PAD)


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct windows, and the place of each window among them."""
    key = lexicographic(columns)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    return [c[first] for c in columns], which


class _Coded:
    """A chunk with the ids and counts of its words."""

    def __init__(self, chunk, answers: list[bytes], total: int, shards: int) -> None:
        tokens, self.sizes = (a.astype(np.int64) for a in unpack(chunk.tokens))
        n = int(chunk.n_words)
        ids, counts = np.full(n, UNKNOWN, np.int64), np.zeros(n, np.int64)
        for body in answers:
            at, found, trained = unpack(body)
            ids[at.astype(np.int64)], counts[at.astype(np.int64)] = found, trained
        self.counts = counts[tokens]
        columns, self.doc, self.predicts = _windows(ids[tokens], self.sizes)
        self.columns, self.which = _distinct(columns)
        # Words that would fill a shard are dealt by two words; of the words of one count no more than 2 x shards are.
        self.hot = {BEGIN: 0} | {int(i): int(c) for i, c in zip(ids, counts, strict=True) if c * shards * 2 > total}
        one, two, _ = self.columns
        key = mix64(one.astype(np.uint64))
        key = np.where(np.isin(one, list(self.hot)), mix64(key + two.astype(np.uint64)), key)
        self.shard = (key % np.uint64(shards)).astype(np.int64)


def _chunk_stream(chunks: DataFrame, answers: list[DataFrame], partitions: int) -> DataFrame:
    """Chunks, and after each its answers (kind 1, 2, ...), in one sorted stream."""
    none = F.lit(None)
    rows = chunks.select(
        "chunk", F.lit(0).alias("kind"), "docs", "held", "tokens", "n_words", F.lit(0).alias("shard"), none.cast("binary").alias("body")
    )
    for kind, answer in enumerate(answers, 1):
        shard = F.col("shard") if "shard" in answer.columns else F.lit(0)
        rows = rows.unionByName(answer.select("chunk", F.lit(kind).alias("kind"), shard.alias("shard"), "body"), allowMissingColumns=True)
    return _dealt(rows, partitions, "chunk", "kind", "shard")


def ask_windows(chunks: DataFrame, words: DataFrame, total: int, ends: int, shards: int, partitions: int) -> DataFrame:
    """What each chunk sends each shard: its distinct windows, their training counts, and the counts of dealt words."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk, rows in _grouped(batches, "chunk"):
            coded = _Coded(rows[0], [r.body for r in rows[1:]], total, shards)
            learnt = ~np.array(rows[0].held, bool)[coded.doc]
            counts = np.bincount(coded.which[learnt], minlength=len(coded.columns[0]))
            hot = coded.hot | {BEGIN: ends}
            many = [np.array(list(x), np.int64) for x in (hot.keys(), hot.values())]
            out = [(s, chunk, pack(*[c[at] for c in coded.columns], counts[at], *many)) for s, at in _by_shard(coded.shard)]
            yield pd.DataFrame(out, columns=["shard", "chunk", "body"])

    return _chunk_stream(chunks, [words], partitions).mapInPandas(task, MESSAGE)


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes of values in (0, 1]: one more than eighths of a bit below 1; at most 255."""
    return np.minimum(np.rint(-np.log2(p) * STEPS) + 1, 255).astype(np.uint8)


def value_of(code: np.ndarray) -> np.ndarray:
    """The values of codes; 0 for code 0."""
    return np.where(code > 0, np.exp2(-(code.astype(np.float64) - 1) / STEPS), 0.0)


def build_trie(columns: list[np.ndarray], counts: np.ndarray, hot: dict[int, int], discount: float) -> tuple[bytes, dict[int, int]]:
    """The trie of sorted windows with their counts, and for each dealt word how many different words follow it here."""
    one, two, three = columns
    first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
    second = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    pairs = np.add.reduceat(counts, second)
    of_first = np.searchsorted(first, second, "right") - 1
    followers = np.bincount(of_first, minlength=len(first))
    total = np.bincount(of_first, weights=pairs, minlength=len(first))
    total = np.array([hot.get(w, t) for w, t in zip(one[first].tolist(), total.tolist(), strict=True)])
    whole = three > 0
    of_second = np.searchsorted(second, np.arange(len(one)), "right") - 1
    context = np.bincount(of_second[whole], weights=counts[whole], minlength=len(second))
    seconds = np.bincount(of_second[whole], minlength=len(second))
    back_two = np.zeros(len(second), np.uint8)
    some = context > 0
    back_two[some] = quantised(discount * seconds[some] / context[some])
    codes = {
        "back_one": quantised(discount * followers / total),
        "own_two": quantised((pairs - discount) / total[of_first]),
        "back_two": back_two,
        "own_three": quantised((counts[whole] - discount) / context[of_second[whole]]),
    }
    spread = {int(w): int(n) for w, n in zip(one[first], followers, strict=True) if int(w) in hot}
    return NgramTrie.layout(columns, codes), spread


WINDOW_ANSWER = "shard int, chunk long, body binary, spread array<struct<word: long, followers: long>>, trie binary"


def answer_windows(asked: DataFrame, shards: int, discount: float, keep_trie: bool) -> DataFrame:
    """Codes for the windows of each chunk; a row without a chunk carries the followers of dealt words and, if kept, the trie."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard, rows in _grouped(batches, "shard"):
            hot: dict[int, int] = {}
            columns, counts = [np.zeros(0, np.int64)] * 3, np.zeros(0, np.int64)
            waiting: list[list[np.ndarray]] = []
            for n, r in enumerate(rows, 1):
                *part, many, most = (a.astype(np.int64) for a in unpack(r.body))
                hot.update(zip(many.tolist(), most.tolist(), strict=True))
                learnt = part[3] > 0
                waiting.append([p[learnt] for p in part])
                if n == len(rows) or sum(len(w[3]) for w in waiting) > max(SHARD // 8, len(counts)):
                    joined = [np.concatenate(x) for x in zip([*columns, counts], *waiting, strict=True)]
                    columns, counts = summed(joined[:3], joined[3])
                    waiting = []
            data, spread = build_trie(columns, counts, hot, discount) if len(counts) else (b"", {})
            del columns, counts
            trie = NgramTrie.mapped(data) if data else None
            out = [(shard, None, None, [(w, n) for w, n in spread.items()], data if keep_trie and data else None)]
            for r in rows:
                one, two, three, *_ = (a.astype(np.int64) for a in unpack(r.body))
                out.append((shard, r.chunk, _answer(trie, one, two, three), None, None))
            frame = pd.DataFrame(out, columns=["shard", "chunk", "body", "spread", "trie"])
            frame["chunk"] = frame["chunk"].astype("Int64")
            yield frame

    return _dealt(asked, shards, "shard", "chunk").mapInPandas(task, WINDOW_ANSWER)


def _heads(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the first word, and the first two words, of sorted windows change."""
    first = np.r_[True, one[1:] != one[:-1]] if len(one) else np.zeros(0, bool)
    return first, first | np.r_[True, two[1:] != two[:-1]] if len(one) else first


def _answer(trie: NgramTrie | None, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> bytes:
    first, second = _heads(one, two)
    if trie is None:
        return pack(np.zeros(first.sum(), np.uint8), np.zeros(second.sum(), np.uint8), np.zeros(second.sum(), np.uint8), np.zeros(len(one), np.uint8))
    at_one = trie.find_one(one[first])
    at_two = trie.find_two(at_one[np.cumsum(first) - 1][second], two[second])
    at_three = trie.find_three(at_two[np.cumsum(second) - 1], three)
    return pack(trie.code("back_one", at_one), trie.code("own_two", at_two), trie.code("back_two", at_two), trie.code("own_three", at_three))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def combined(chunks: DataFrame, words: DataFrame, answers: DataFrame, total: int, kinds: int, followers: dict, ends: int, shards: int, discount: float, partitions: int) -> DataFrame:
    """One row of ``SCORES`` per document, from the chunks and their answers."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _grouped(batches, "chunk"):
            coded = _Coded(rows[0], [r.body for r in rows if r.kind == 1], total, shards)
            one, two, _ = coded.columns
            back_one, own_two, back_two, own_three = (np.zeros(len(one)) for _ in range(4))
            bodies = {r.shard: r.body for r in rows if r.kind == 2}
            for s, at in _by_shard(coded.shard):
                first, second = _heads(one[at], two[at])
                b1, o2, b2, o3 = (value_of(c) for c in unpack(bodies[s]))
                of_first, of_second = np.cumsum(first) - 1, np.cumsum(second) - 1
                back_one[at], own_two[at], back_two[at], own_three[at] = b1[of_first], o2[of_second], b2[of_second], o3
            for word, count in (coded.hot | {BEGIN: ends}).items():
                here = one == word
                back_one[here] = min(1.0, discount * followers.get(word, 0) / count) if count else 0.0
            now, then = coded.which[coded.predicts], coded.which[coded.predicts + 1]
            unigram = (coded.counts + 1) / (total + kinds + 1)
            p = np.where(back_one[then] > 0, own_two[then] + back_one[then] * unigram, unigram)
            p = np.where(back_two[now] > 0, own_three[now] + back_two[now] * p, p)
            first = np.cumsum(coded.sizes) - coded.sizes
            frame = pd.DataFrame({
                "doc_id": pd.array(list(rows[0].docs), "Int64") if len(rows[0].docs) else [], "held_out": list(rows[0].held), "n_tokens": coded.sizes,
                "n_known": np.add.reduceat((coded.counts > 0).astype(np.int64), first), "train_tokens": total,
                "base_score": np.add.reduceat(np.log10(unigram), first), "score": np.add.reduceat(np.log10(np.minimum(p, 1.0)), first),
            })
            yield frame

    return _chunk_stream(chunks, [words, answers], partitions).mapInPandas(task, SCORES)


def lm_scores(docs: DataFrame, discount: float = DISCOUNT, model_path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Null or empty text: one token, its end. A null doc_id trains and has a row of
    its own, and so has every repeated row. Very long texts are whole. Columns but
    doc_id and text are left out. An empty table gives no row. With ``model_path``
    the tries of all shards are written there, one row a shard.
    """
    spark = docs.sparkSession
    chunks = written(chunked(docs), "lm-chunks")
    n_tokens, n_words, n_chunks = chunks.agg(F.sum("n_tokens"), F.sum("n_words"), F.count(F.lit(1))).first()
    if not n_chunks:
        return spark.createDataFrame([], SCORES)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of_words = max(least, n_words // VOCABULARY + 1)
    shards = max(least, n_tokens // SHARD + 1)
    partitions = max(least, n_chunks)
    words = written(answer_words(ask_words(chunks, of_words), of_words), "lm-words")
    total, kinds = words.where("chunk IS NULL").agg(F.sum("n_tokens"), F.sum("n_words")).first()
    words = words.where("chunk IS NOT NULL")
    # Every training document has one end, and one beginning.
    ends = chunks.select(F.explode("held").alias("h")).where("NOT h").count()
    asked = ask_windows(chunks, words, total, ends, shards, partitions)
    answers = written(answer_windows(asked, shards, discount, model_path is not None), "lm-answers")
    if model_path is not None:
        answers.where("chunk IS NULL AND trie IS NOT NULL").select("shard", "trie").write.parquet(model_path)
    # At most 2 x shards words are dealt, whatever the corpus.
    spread = answers.where("chunk IS NULL").select(F.explode("spread").alias("s")).groupBy("s.word").agg(F.sum("s.followers").alias("n"))
    followers = {r["word"]: r["n"] for r in spread.collect()}
    found = answers.where("chunk IS NOT NULL").select("shard", "chunk", "body")
    return combined(chunks, words, found, total, kinds, followers, ends, shards, discount, partitions)
