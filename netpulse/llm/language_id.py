"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is its letters, lower-cased, anything else being a space. Every subword of
one to three characters is hashed to a row of an embedding table; the average of
the rows goes through a linear layer to a softmax. Both are trained by stochastic
gradient descent in numpy on the driver, on a bounded sample. A temperature,
fitted on a part of the sample kept out of training, calibrates the scores; the
same part gives the score below which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netpulse.llm.text import small_batches
from netpulse.sinks.tables import written

UNKNOWN = "und"
TABLE = 1 << 15
DIMENSIONS = 16
# Bounds of the training sample: documents a language, and subwords drawn evenly over each whole text.
SAMPLE = 1500
SUBWORDS = 512
MAX_LANGUAGES = 500
_CHARS = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def subwords(text: str) -> Iterator[np.ndarray]:
    """Table rows of all subwords of a whole text, a stretch at a time; none if it has no letter."""
    for at in range(0, len(text), _CHARS):
        # Two characters of the stretch before, so that no subword is lost between stretches.
        points = _code_points(text[max(0, at - 2) : at + _CHARS])
        letter = _letters()[points]
        points = np.where(letter, points, 32).astype(np.uint32)
        fresh = 2 if at else 0
        one = points * np.uint32(2654435761)
        two = (one[:-1] ^ (points[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        three = (two[:-1] ^ (points[2:] * np.uint32(668265263))) * np.uint32(374761393)
        for size, hashed in ((1, one), (2, two), (3, three)):
            skip = max(0, fresh - size + 1)
            middle = letter[: len(hashed)].copy()
            for i in range(1, size):
                middle |= letter[i : i + len(hashed)]
            yield ((hashed + np.uint32(size * 97)) >> np.uint32(17))[skip:][middle[skip:]].astype(np.int64)


@dataclass
class LanguageModel:
    """Languages, the product of embeddings and linear layer, its bias, the temperature and the rejection score."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated score; ``und`` and 0 for a text without a letter or an empty model."""
        if not text or not self.languages:
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.languages)), 0
        for rows in subwords(text):
            # Equal subwords are counted first: one table row each, whatever the length of the text.
            counts = np.bincount(rows, minlength=TABLE) if len(rows) > TABLE else None
            total += counts @ self.table if counts is not None else self.table[rows].sum(axis=0)
            n += len(rows)
        if not n:
            return UNKNOWN, 0.0
        scores = _softmax((total / n + self.bias)[None] / self.temperature)[0]
        best = int(scores.argmax())
        return self.languages[best], float(scores[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(samples: list[tuple[str, list[int]]], epochs: int = 12, rate: float = 2.0, seed: int = 4) -> LanguageModel:
    """Fit on (language, subword rows) pairs; languages weigh alike, however often they occur."""
    samples = [(lang, rows) for lang, rows in samples if len(rows)]
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return LanguageModel([], np.zeros((TABLE, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    label = np.array([languages.index(lang) for lang, _ in samples])
    weight = len(label) / (len(languages) * np.bincount(label)[label])
    order = rng.permutation(len(samples))
    held = order[: len(order) // 5]
    fitted = order[len(order) // 5 :]
    embedding = rng.normal(0, 0.1, (TABLE, DIMENSIONS))
    linear, bias = rng.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(fitted), 32):
            batch = rng.permutation(fitted)[:32] if at == 0 else fitted[at : at + 32]
            sizes = np.array([len(samples[i][1]) for i in batch])
            rows = np.concatenate([samples[i][1] for i in batch]).astype(np.int64)
            owner = np.repeat(np.arange(len(batch)), sizes)
            mean = np.add.reduceat(embedding[rows], np.cumsum(sizes) - sizes) / sizes[:, None]
            error = _softmax(mean @ linear + bias)
            error[np.arange(len(batch)), label[batch]] -= 1
            error *= weight[batch, None] / len(batch)
            back = error @ linear.T
            linear -= step * mean.T @ error
            bias -= step * error.sum(axis=0)
            # A document's gradient goes to each of its subwords; scaled up, as each gets but one part in its length.
            np.add.at(embedding, rows, -step * 16 * (back / np.sqrt(sizes)[:, None])[owner])
        fitted = rng.permutation(fitted)
    table = embedding @ linear
    kept = held if len(held) else fitted
    logits = np.array([table[samples[i][1]].mean(axis=0) + bias for i in kept])
    truth = label[kept]
    grid = np.geomspace(0.05, 20, 60)
    losses = [-np.log(_softmax(logits / t)[np.arange(len(kept)), truth] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    scores = _softmax(logits / temperature)
    right = scores.max(axis=1)[scores.argmax(axis=1) == truth]
    # One in a thousand rightly labelled texts may fall below; never more than an even chance is asked for.
    reject = min(0.5, float(np.quantile(right, 0.001))) if len(right) else 0.0
    return LanguageModel(languages, table, bias, temperature, reject)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is 1 (null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, list[int]]]:
    """At most ``sample`` documents a language, by hash of their id, with ``SUBWORDS`` subwords of each."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    narrow = usable.select("doc_id", "lang")
    languages = [r["lang"] for r in narrow.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return []
    chosen = None
    for lang in sorted(languages):
        part = narrow.where(F.col("lang") == lang).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            drawn = []
            for text in batch["text"]:
                rows = np.concatenate([*subwords(text), np.zeros(0, np.int64)])
                drawn.append(rows[np.linspace(0, len(rows) - 1, min(SUBWORDS, len(rows))).astype(int)] if len(rows) else rows)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "rows": drawn})

    # At most sample x languages ids: a bounded side.
    picked = F.broadcast(chosen.select("doc_id").distinct())
    texts = usable.select("doc_id", "lang", "text").join(picked, "doc_id", "left_semi")
    rows = texts.mapInPandas(task, "doc_id long, lang string, rows array<int>")
    rows = rows.orderBy("doc_id", "lang").limit(sample * len(languages))
    return [(r["lang"], r["rows"]) for r in rows.collect()]


def language_model(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """A model learned from text and non-null lang of the documents that are not held out."""
    return train(training_sample(docs, sample))


def with_language(docs: DataFrame, model: LanguageModel, text: str) -> DataFrame:
    """The documents with lang_pred, score and rejected from the whole text in column ``text``.

    Null text, or one without a letter: ``und``, score 0, rejected. Without any
    training text every prediction is that. Predictions depend on nothing but the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.predict(t) for t in texts]
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    # Only the text goes to Python, and what comes back is small.
    out = docs.withColumn("found_", predict(text)).select(*docs.columns, "found_.*")
    rejected = (F.col("lang_pred") == UNKNOWN) | (F.col("score") < model.reject_below)
    return out.withColumn("rejected", rejected)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document.

    Repeated rows and null doc_id are rows of their own. Very long texts count with
    all their subwords. Other columns are left out. An empty table gives no row.
    """
    model = language_model(docs)
    return with_language(docs.select("doc_id", "text"), model, "text").withColumn("held_out", held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected"
    )


def in_known_language(docs: DataFrame) -> DataFrame:
    """The documents whose language is told with enough certainty; columns as they are, whatever their names.

    Null, empty and letterless texts go; very long ones are read whole. Rows that
    repeat are judged alike. An empty table, or one without a training text, gives no row.
    """
    names = docs.columns
    rows = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    with small_batches(docs.sparkSession):
        out = with_language(rows, language_model(docs), f"c{names.index('text')}")
        # Written here: a frame that the caller runs would send its rows in batches of the session's size.
        known = written(out.where(~F.col("rejected")).select(rows.columns), "known-language")
    return known.toDF(*names)
