"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netpulse.llm.best_fit import best_fit_pack
from netpulse.llm.language_id import in_known_language
from netpulse.llm.line_spread import without_boilerplate
from netpulse.llm.near_dedup import keep_one
from netpulse.llm.queries import TOKENIZER
from netpulse.llm.source_mix import mixed_documents
from netpulse.session import fresh_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null, letterless and uncertain ones go."""
    return in_known_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that spread over sites; each such line stays where it is first."""
    return without_boilerplate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, a similarity of 0.8 or more."""
    return keep_one(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; a document comes once per epoch that takes words of it."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096: the place of every piece."""
    return best_fit_pack(docs, TOKENIZER, end_id=1, capacity=4096)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs


# Training, pseudorandom draws and tokenisation are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
