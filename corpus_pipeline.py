"""The corpus pipeline: from documents to the token ids of a mixed, clean corpus.

Each stage takes an empty table to one; further columns, whatever their names, pass all stages but the last. Texts of any
length go through whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, jaccard_join, language_id, mixing, sentencepieces
from corpusloom.llm.common import workspace, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification rejects: null texts and those without letters among them."""
    return language_id.accepted(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts, null as empty; a row without an id loses to all others."""
    return exact_dedup.keep_first(docs)


def distinct_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five words, a similarity of 0.8 or more; texts without words stay."""
    return jaccard_join.keep_one(docs, words=5, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's words near its target, null being a source; texts without words go, repeated rounds are rows."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether they decode to it; a null text has none."""
    found = sentencepieces.checked(docs.select("doc_id", "lang", "source", "text"), sentencepieces.model_path())
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language ID", known_language),
    ("exact dedup", distinct_texts),
    ("n-gram Jaccard join", distinct_content),
    ("mixing sources to target weights", mixed_sources),
    ("SentencePiece encoding and decoding", token_ids),
]
#: Language models, near copies and token ids are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"{where}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
