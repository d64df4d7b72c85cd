"""Exact de-duplication through a log-structured merge index of digests. DataFrame operations only.

Each input partition is a memtable: its digests are flushed sorted, and together they are a run of level 0. A run carries a filter,
a bitmap of SPARSE bits for each entry, which is probed before the run is. When a level holds FANOUT runs they are merged
into one run of the next level that keeps one entry per digest (identifier that stays, number of rows). Digests that
occur twice, within a batch or in an older run, are hits; hits receive byte verification, and two texts that share a digest stop the job.
Only texts whose digest passes the filter of the hits travel, and copies meet in the map tasks before they do, so a group of copies of any size
sends one text from each task.
"""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import lower_ascii, materialize, named, scratch_path, unused

#: Runs of a level that are merged, bits of a filter for each entry, and bits of one row of a filter (set by Spark's bitmap functions).
FANOUT, SPARSE, ROW_BITS = 4, 16, 32_768
#: Rows of a filter that is broadcast, 4 KB each. A filter over more entries has fewer bits for each and lets more through, never less.
BROADCAST_ROWS = 8192
_PICK = {"smallest": F.min, "largest": F.max}


def normalised(text_col: str) -> Column:
    """The text that is compared: null is empty, A-Z lower-cased and nothing else."""
    return lower_ascii(F.coalesce(named(text_col).cast("string"), F.lit("")))


def digest_of(text_col: str) -> Column:
    return F.unhex(F.sha2(normalised(text_col), 256))


def flush_run(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """Write the partitions of df to path as sorted digests with their identifiers. No shuffle."""
    run = df.select(named(id_col).alias("doc"), digest_of(text_col).alias("digest")).sortWithinPartitions("digest")
    run.write.parquet(path)
    return df.sparkSession.read.schema(run.schema).parquet(path)


def compact(runs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One entry per digest of flushed rows: digest, keep_id, group_size. Copies meet in the map tasks first."""
    return runs.groupBy("digest").agg(_PICK[keep]("doc").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def merge(entries: DataFrame, keep: str) -> DataFrame:
    """Entries of several runs -> one entry per digest."""
    return entries.groupBy("digest").agg(_PICK[keep]("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _place(rows: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(rows * ROW_BITS))


def build_filter(entries: DataFrame, rows: int) -> DataFrame:
    """The digests of entries as a bitmap of rows rows: bucket, bits."""
    place = _place(rows)
    return entries.groupBy(F.floor(place / ROW_BITS).alias("bucket")).agg(F.bitmap_construct_agg((place % ROW_BITS).cast("long")).alias("bits"))


def filter_rows(entries: int) -> int:
    return max(1, -(-entries * SPARSE // ROW_BITS))


def probe(df: DataFrame, bitmap: DataFrame, rows: int, outside: bool = False) -> DataFrame:
    """Rows of df (digest, ...) whose digest may be in the bitmap; with outside, those whose digest is surely not."""
    place = _place(rows)
    if rows <= BROADCAST_ROWS:  # 32 MB at most
        bitmap = F.broadcast(bitmap)
    bucket, bits = unused(df, "bucket"), unused(df, "bits")
    bitmap = bitmap.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))
    met = df.join(bitmap, F.floor(place / ROW_BITS) == F.col(bucket), "left")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(place % ROW_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (place % 8).cast("int") + 1)) > 0, F.lit(False))
    return met.where(~set_ if outside else set_).drop(bucket, bits)


def verify(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """hits with texts: how many different byte strings of texts (digest, body) stand behind each digest (1, or the job must stop)."""
    kinds = texts.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"))
    return kinds.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).join(hits, "digest")


@dataclass(frozen=True)
class Run:
    """A run of an index: the folder of its entries and that of its filter, its level, and its entries."""

    name: str
    level: int
    rows: int


class DigestIndex:
    """Runs, their filters, one text per digest, and a manifest below a folder that all executors share.

    The manifest is a table that grows by one state at each commit; the last state counts. A batch that fails leaves files that no state names.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def state(self) -> tuple[int, str | None, list[Run]]:
        """Number of the last commit, which identifier stays, and the runs (a few for each level)."""
        try:
            states = self.spark.read.parquet(f"{self.path}/manifest")
        except AnalysisException:
            return 0, None, []
        last = states.agg(F.max("seq")).first()[0]
        rows = states.where(F.col("seq") == last).collect()
        return last, rows[0]["keep"], [Run(r["name"], r["level"], r["rows"]) for r in sorted(rows, key=lambda r: (r["level"], r["name"]))]

    def entries(self, run: Run) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{run.name}/entries")

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts/*")

    def lookup(self, digests: DataFrame, keep: str) -> DataFrame:
        """Entries of digests in all runs: digest, keep_id, group_size. Each run sees only what passes its filter."""
        found = []
        for run in self.state()[2]:
            bitmap = self.spark.read.parquet(f"{self.path}/{run.name}/filter")
            few = probe(digests.select("digest"), bitmap, filter_rows(run.rows))
            found.append(self.entries(run).join(few, "digest"))
        return merge(functools.reduce(DataFrame.unionByName, found), keep)

    def write(self, entries: DataFrame, level: int) -> Run:
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"run-{uuid.uuid4().hex}"
        entries.repartitionByRange(n, "digest").sortWithinPartitions("digest").write.parquet(f"{self.path}/{name}/entries")
        run = Run(name, level, self.spark.read.parquet(f"{self.path}/{name}/entries").count())
        build_filter(self.entries(run), filter_rows(run.rows)).write.parquet(f"{self.path}/{name}/filter")
        return run

    def commit(self, entries: DataFrame, fresh: DataFrame, keep: str) -> None:
        """Add a batch's entries as a run and its new texts (digest, body), merge full levels, and write the new state."""
        seq, _, runs = self.state()
        fresh.write.parquet(f"{self.path}/texts/batch-{uuid.uuid4().hex}")
        runs = [*runs, self.write(entries, 0)]
        level = 0
        while len(full := [r for r in runs if r.level == level]) >= FANOUT:
            merged = merge(functools.reduce(DataFrame.unionByName, [self.entries(r) for r in full]), keep)
            runs = [r for r in runs if r.level != level] + [self.write(merged, level + 1)]
            level += 1
        rows = [(seq + 1, keep, r.name, r.level, r.rows) for r in runs]
        self.spark.createDataFrame(rows, "seq long, keep string, name string, level int, rows long").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")


def _decided(df: DataFrame, id_col: str, text_col: str, keep: str, index: DigestIndex | None) -> tuple[DataFrame, DataFrame]:
    """(flushed rows of df: doc, digest; verified hits: digest, keep_id, group_size)."""
    spark = df.sparkSession
    runs = flush_run(df, id_col, text_col, scratch_path(spark, "digest-run"))
    mine = compact(runs, keep)
    old = None
    if index:
        mine = materialize(mine, "digest-entries")
        _, kept, live = index.state()
        if kept not in (None, keep):
            raise ValueError(f"the index keeps the {kept} identifier")
        if live:
            old = materialize(index.lookup(mine, keep), "digest-known")
    every = merge(mine.unionByName(old.join(mine.select("digest"), "digest")), keep) if old is not None else mine
    hits = materialize(every.where("group_size > 1"), "digest-hits")
    rows = min(filter_rows(hits.count()), BROADCAST_ROWS)
    texts = df.select(digest_of(text_col).alias("digest"), normalised(text_col).alias("body"))
    texts = probe(texts, build_filter(hits, rows), rows)
    if old is not None:
        texts = texts.unionByName(index.texts().join(hits.select("digest"), "digest").select("digest", "body"))
    checked = materialize(verify(texts, hits).select(
        "digest", "group_size", F.when(F.col("texts") == 1, F.col("keep_id")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest"))).alias("keep_id")), "digest-verified")
    if index:
        fresh = mine.select("digest") if old is None else mine.select("digest").join(old.select("digest"), "digest", "left_anti")
        bodies = df.select(digest_of(text_col).alias("digest"), normalised(text_col).alias("body")).groupBy("digest").agg(F.first("body").alias("body"))
        index.commit(mine, bodies.join(fresh, "digest"), keep)
    return runs, checked


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", index: str | None = None) -> DataFrame:
    """One row per input row: doc, keep_id, group_size, kept, text_sha256.

    keep: the identifier that stays in a group, "smallest" or "largest". Null texts equal the empty text.
    Rows that repeat an identifier and its text count one each in group_size, and all of them say kept.
    A row whose identifier is null joins its group; it stays only if the whole group has none.
    index: a folder in which the batches of several calls meet. Rows of df are then judged against all batches so far and their
    own; only they are returned, and the batch is added to the index. A later batch may bring an identifier that
    stays instead of one that was kept before: keep_id names the one that stays now.
    An empty table gives an empty result. Other columns of df are not read.
    """
    runs, checked = _decided(df, id_col, text_col, keep, DigestIndex(df.sparkSession, index) if index else None)
    out = runs.join(checked, "digest", "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc")).otherwise(F.col("keep_id"))
    return out.select("doc", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      F.col("doc").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_decided(df: DataFrame, id_col: str, text_col: str, decided: DataFrame) -> DataFrame:
    """df without the rows whose digest decided names, but for one row of keep_id and keep_digest. decided: digest, keep_id, keep_digest.

    Rows whose digest is not named stay where they are; only the others are joined.
    """
    rows = min(filter_rows(decided.count()), BROADCAST_ROWS)
    bitmap = materialize(build_filter(decided, rows), "digest-filter")
    names = [named(c) for c in df.columns]
    inner = df.select("*", digest_of(text_col).alias(unused(df, "digest"))).toDF(*(f"c{k}" for k in range(len(df.columns))), "digest")  # whatever the columns are named
    back = lambda part: part.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(df.columns)))
    met = probe(inner, bitmap, rows).join(decided.select(F.col("digest").alias("of"), "keep_id", "keep_digest"), F.col("digest") == F.col("of"), "left")
    single = met.where("of IS NULL")
    chosen = met.where((F.col("digest") == F.col("keep_digest")) & F.col(f"c{df.columns.index(id_col)}").eqNullSafe(F.col("keep_id")))
    parts = [probe(inner, bitmap, rows, outside=True), single, chosen.dropDuplicates(["digest"])]  # rows that repeat identifier and text are alike
    return functools.reduce(DataFrame.unionByName, map(back, parts)).select(*names)


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """df without all rows but one of each group of equal texts, with its own columns only.

    Rows that repeat identifier and text are copies of each other: one stays.
    """
    checked = _decided(df, id_col, text_col, keep, None)[1]
    return keep_decided(df, id_col, text_col, checked.select("digest", "keep_id", F.col("digest").alias("keep_digest")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, keep="largest").select(F.col("doc").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM n
"""
