"""A stored inverted index: postings in sorted blocks, in buckets of tokens, with the greatest weight of each block.

A search reads the buckets of its tokens alone, and of these the blocks that may still hold one of the k best: what a token's first blocks
bring gives a score that the k-th best reaches at least, and a block is left where its greatest weight, with the greatest of all other
tokens, stays below it. Rows are those of retrieval.sparse_top_k over the same postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import retrieval
from docquarry.scratch import materialize

#: Buckets of tokens, postings in a block, tokens that are pushed into the scan, and what rounding may take from a score.
BUCKETS, BLOCK, PUSHED, SLACK = 64, 512, 1_000, 1e-6


@dataclass(frozen=True)
class Found:
    """rows: query_id, item, score, rank; read: blocks and postings that were met and that were left."""

    rows: DataFrame
    met: DataFrame


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _blocks(item: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            tokens = b["token"].dictionary_encode()
            codes = tokens.indices.to_numpy()
            cuts = np.flatnonzero(np.diff(codes)) + 1
            edges = [0]
            for to in [*cuts.tolist(), len(b)]:
                edges += range(edges[-1] + BLOCK, to, BLOCK)
                edges.append(to)
            at = pa.array(edges[:-1])
            offsets = pa.array(edges, pa.int32())
            yield pa.RecordBatch.from_arrays([b["bucket"].take(at), b["token"].take(at), b["weight"].take(at), pa.ListArray.from_arrays(offsets, b[item]), pa.ListArray.from_arrays(offsets, b["weight"])], ["bucket", "token", "top", "items", "weights"])

    return run


def save(postings: DataFrame, path: str, item: str = "chunk_id") -> None:
    """Write token, item, weight as blocks. Range partitioning cuts a token's postings wherever they are many, so a common token is no single task's."""
    kind = dict(postings.dtypes)[item]
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = postings.select(_bucket(F.col("token")).alias("bucket"), "token", F.col("weight").cast("double").alias("weight"), item)
    rows = materialize(rows, "posting-rows")  # the ranges are found in a pass of their own, which would make all postings again
    order = ["bucket", "token", F.desc("weight"), item]
    made = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_blocks(item), f"bucket int, token string, top double, items array<{kind}>, weights array<double>")
    made.withColumn("size", F.size("items")).write.mode("overwrite").partitionBy("bucket").parquet(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load(spark: SparkSession, path: str, item: str = "chunk_id") -> DataFrame:
    """All postings, one row each."""
    rows = blocks(spark, path).select("token", F.explode(F.arrays_zip("items", "weights")).alias("p"))
    return rows.select("token", F.col("p.items").alias(item), F.col("p.weights").alias("weight"))


def wanted(spark: SparkSession, path: str, questions: DataFrame) -> DataFrame:
    """The blocks of the questions' tokens; buckets, and tokens while they are few, are pushed into the scan."""
    tokens = questions.select("token").distinct()
    buckets = [r["b"] for r in tokens.select(_bucket(F.col("token")).alias("b")).distinct().collect()]  # BUCKETS numbers at most
    some = blocks(spark, path).where(F.col("bucket").isin(*buckets)) if buckets else blocks(spark, path).where(F.lit(False))
    few = [r["token"] for r in tokens.limit(PUSHED + 1).collect()]
    return some.where(F.col("token").isin(*few)) if len(few) <= PUSHED else some


def search(spark: SparkSession, path: str, questions: DataFrame, k: int = retrieval.SEARCH_K, item: str = "chunk_id", digits: int = 9) -> Found:
    """questions: query_id, token, weight (question_terms)."""
    questions = materialize(questions.select("query_id", "token", "weight"), "asked-terms")
    asked = retrieval.small(questions.withColumnRenamed("weight", "q_weight"))
    met = wanted(spark, path, questions).where("top > 0").join(asked, "token")
    peaks = met.groupBy("query_id", "token").agg(F.max("top").alias("peak"), F.max("q_weight").alias("w"))
    total = peaks.groupBy("query_id").agg(F.sum(F.col("peak") * F.col("w")).alias("total"))
    opened = met.join(peaks.select("query_id", "token", "peak"), ["query_id", "token"])

    def scored(rows: DataFrame) -> DataFrame:
        each = rows.select("query_id", "q_weight", F.explode(F.arrays_zip("items", "weights")).alias("p")).where("p.weights > 0")
        return each.groupBy("query_id", F.col("p.items").alias(item)).agg(F.round(F.sum(F.col("p.weights") * F.col("q_weight")), digits).alias("score"))

    first = retrieval.top_k(scored(opened.where(F.col("top") == F.col("peak"))), k, item=item).where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    judged = opened.join(total, "query_id").join(first, "query_id", "left")
    bound = F.col("total") - (F.col("peak") - F.col("top")) * F.col("q_weight")
    judged = judged.withColumn("left", F.col("reached").isNotNull() & (bound < F.col("reached") - SLACK))
    counts = judged.agg(F.count(F.lit(1)).alias("blocks"), F.sum("size").alias("postings"), F.count_if("left").alias("left_blocks"), F.coalesce(F.sum(F.when(F.col("left"), F.col("size"))), F.lit(0)).alias("left_postings"))
    return Found(retrieval.top_k(scored(judged.where("NOT left")).where("score > 0"), k, item=item), counts)
