"""A training corpus in five stages: raw documents to token shards.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns
the documents that go on, with their columns; the last returns what it read back from its files.

In every stage a null or empty text is a document without words, a null id is a document of its own,
rows that repeat an id stay apart unless a stage says otherwise, columns of any name keep their
values, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import decontaminate, mixing, near_dedup, quality, token_store
from keyloom.llm.encoder import SMALL_TABLE
from keyloom.llm.queries import table, vocabulary
from keyloom.staging import Stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, with them those without words."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: those that share four fifths of their runs of
    five words. Rows with the id of a document that goes go with it."""
    return near_dedup.dedup(docs, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by the target weights of their sources; a drawn copy is a row."""
    return mixing.shuffled(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids are written in shuffled order, and every copy's place, length and checksum are read
    back. (The mix is reread from Parquet, which has no order, so it is shuffled here.)"""
    order = token_store.shuffle_order()
    shards = token_store.write_shards(docs, Stage(spark), vocabulary(), order=order, table_bytes=SMALL_TABLE)
    return token_store.read_documents(shards)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("token_shards", token_shards),
]

# Near-duplicate signatures and tokenizers have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage.put(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
