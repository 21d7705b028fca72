"""From raw documents to token ids: toxic documents go, near copies are merged, sources are mixed, texts are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import bpe, mixing, partenum, toxicity
from lamella.llm.common import settle, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine, trained on the labels outside the hold-out, doesn't reject."""
    scored = toxicity.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return scored.where("predicted = 0").select(*COLUMNS)


def near_copies_merged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id. Documents without words or without an id stay, and rows that repeat a doc_id stay or go together."""
    docs = docs.select(*COLUMNS)
    found = partenum.near_duplicates(docs.select("doc_id", "text")).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("gone"), "left_anti").select(*COLUMNS)


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts around their source's rate, in one global random order."""
    return mixing.replicate(docs.select(*COLUMNS)).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text decoded from them, as digests, for every row."""
    return bpe.digests(docs.select("doc_id", "text"))


#: Each stage works on all rows its predecessor kept.
STAGES = [
    ("toxicity", toxic_removed),
    ("near_copies", near_copies_merged),
    ("mixing", sources_mixed),
    ("encoding", encoded),
]
#: No SQL: the string kernel and byte-pair encoding can't be written in it; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
