"""A training corpus from raw documents, in stages that are written one after the other."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.bpe import bpe
from canvass.llm.decontaminate import without_benchmarks
from canvass.llm.near_dedup import near_dedup
from canvass.llm.shared import stored
from canvass.llm.substring_dedup import substring_dedup
from canvass.llm.toxicity import without_toxic


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; it learns from the labels as in its query."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays."""
    return near_dedup(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier are cut; every document stays, with the words that are left."""
    kept = substring_dedup(docs, keep=["lang", "source"])
    return kept.select("doc_id", F.col("kept").alias("text"), "kept_columns.lang", "kept_columns.source",
                       F.length("kept").cast("long").alias("n_chars"))


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_benchmarks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the text decoded from the ids."""
    coded = bpe(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("decoded").alias("text"))


STAGES = [
    ("toxicity", harmless), ("MinHash near-dedup", distinct), ("substring dedup", without_passages),
    ("benchmark decontamination", unleaked), ("BPE encoding and decoding", tokens),
]
#: SQL cannot express the classifier, the signatures or the tokens; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
