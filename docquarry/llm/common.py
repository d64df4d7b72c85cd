"""Pieces that several corpus operators share: scratch tables, distinct texts, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.scratch import scratch_dir

#: While a table is written its shuffle files go as soon as it is done.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and the shuffles behind it are freed."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = {k: spark.conf.get(k) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def named(name: str):
    """The column of that name, dots and backquotes in it taken as they are."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """A name like name that no column of df has, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """From now on the session's Python workers get their rows in batches of about 4 MB: texts are long, and the default of
    64 MB is held several times over, in the JVM and in each worker. Set before any plan that runs Python on texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{size}b")


class Rows:
    """Gathers columns of numpy arrays and gives them out as Arrow batches of a useful size."""

    def __init__(self, names: list[str], size: int = 65_536) -> None:
        self.names, self.size, self.held, self.count = names, size, [], 0

    def add(self, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.held.append(columns)
        self.count += len(columns[0])
        if self.count >= self.size:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*self.held, strict=True)], self.names)
        self.held, self.count = [], 0


def lower_ascii(text):
    """Lower-case A-Z only. A text of one byte a character takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest128(column):
    """First 16 bytes of SHA-256, as binary: an identity for texts at any corpus size."""
    return F.unhex(F.substring(F.sha2(column, 256), 1, 32))


def distinct_texts(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Collapse exact copies before anything is shuffled further.

    Returns (texts, members). texts: tid long, body binary, copies long, first_id; one row per
    distinct text (null counts as empty). members: the id of every input row with its tid.
    A group of copies, however large, is one row of texts; partial aggregation meets it in the map tasks.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("member_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))
    keyed = rows.select("member_id", F.unhex(F.substring(F.sha2("body", 256), 1, 32)).alias("digest"), "body")
    texts = keyed.groupBy("digest").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("copies"), F.min("member_id").alias("first_id"))
    texts = materialize(texts.withColumn("tid", F.monotonically_increasing_id()), "texts", {"compression": "zstd"})
    members = keyed.select("member_id", "digest").join(texts.select("digest", "tid"), "digest").select("member_id", "tid")
    return texts, members


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node it reaches.

    Alternating large-star and small-star rounds. Each round is two aggregations and joins on a node, so a
    node with very many neighbours is met by partial aggregation and by a join that Spark can split; nothing
    is gathered in one task or on the driver but one row a round. Rounds grow with the logarithm of the longest path, and end as soon as
    all components are stars round their smallest node.
    """
    a, b = F.col(left), F.col(right)
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and u <> v").distinct()
    now = materialize(now, "cc")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _stars(pairs: DataFrame) -> bool:
    """Whether each node of different pairs (u > v) is either the v of all its pairs or the u of a single one."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
    degrees = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
    return degrees.where("up > 1 OR up > least").isEmpty()
