"""A store of vectors by content: the key of a vector is the hash of its text and the encoder's identity.

A changed file, another selection or another chunk size encodes only texts that no run has met. Batches are appended; a text that two runs have encoded at the same
time has two equal vectors, of which one is read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.boundary import Encoder, encode
from docquarry.sources.files import read_or_empty


def vectors_for(chunks: DataFrame, encoder: Encoder, folder: str, item: str = "chunk_id") -> DataFrame:
    """item, embedding for chunks (item, text)."""
    path = f"{folder.rstrip('/')}/{hashlib.sha256(encoder.identity.encode()).hexdigest()[:24]}"
    form = "key string, embedding array<float>"
    keyed = chunks.select(item, F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), "text")
    known, _ = read_or_empty(chunks.sparkSession, path, form)
    fresh = keyed.groupBy("key").agg(F.first("text").alias("text")).join(known.select("key"), "key", "left_anti")
    if not fresh.isEmpty():
        encode(fresh, encoder, "key", "text").select("key", "embedding").write.mode("append").parquet(path)
        known, _ = read_or_empty(chunks.sparkSession, path, form)
    return keyed.select(item, "key").join(known.groupBy("key").agg(F.first("embedding").alias("embedding")), "key").select(item, "embedding")
