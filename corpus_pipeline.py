"""A training corpus from the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return
the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import exact_dedup, mixing, packing, quality, simhash
from docquarry.llm.common import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.drop_rejected(docs, labels)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest identifier stays."""
    return exact_dedup.drop_exact_copies(docs, keep="largest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest identifier stays."""
    return simhash.drop_near_copies(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves the sources by weight."""
    return mixing.in_mixed_order(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the packed sequences, which follow the mixed order."""
    turns = mixing.with_turns(docs.select("doc_id", "source", "text"), "turn")
    return packing.pack(turns, packing.default_vocabulary(), turn_col="turn").withColumnRenamed("doc", "doc_id")


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("mix", mix_stage), ("pack", pack_stage)]

#: SQL states neither the classifier nor the packing; tests hold the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
