"""Incremental import as one job in two phases: outputs under new names, then one pointer.

The manifest (states) says which file stands in which output, and in which batch of outputs its text is. A run writes the texts of
new and changed files as a batch that nothing points to, and then the manifest, in one commit. A run that dies before the commit has
changed nothing; one that is repeated after it finds everything cached. Unchanged texts are never written again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import safe_file_name
from docquarry.operators import ingest
from docquarry.scratch import materialize
from docquarry.sources import states

MANIFEST = "id string, name string, signature string, output_file string, batch string"
OUTPUTS = "output_file string, text string"


@dataclass(frozen=True)
class Imported:
    """files: id, name, status, output_file; counters: a row (checked, cached, new, changed, deleted, processed); version of the manifest."""

    files: DataFrame
    counters: DataFrame
    version: int


def outputs(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(f"{OUTPUTS}, batch string").parquet(f"{folder.rstrip('/')}/outputs")
    except AnalysisException:
        return spark.createDataFrame([], f"{OUTPUTS}, batch string")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """output_file, text of what the manifest points to."""
    manifest = states.load(spark, f"{folder.rstrip('/')}/manifest", MANIFEST)
    return outputs(spark, folder).join(manifest.select("output_file", "batch"), ["output_file", "batch"], "left_semi").select("output_file", "text")


def adopt(existing: DataFrame, folder: str) -> None:
    """Outputs (output_file, text) that stand without a manifest, for the next run to find. Numbers before a name count as taken."""
    existing.select("output_file", "text", F.lit("adopted").alias("batch")).write.mode("append").partitionBy("batch").parquet(f"{folder.rstrip('/')}/outputs")


def run_import(listing: DataFrame, folder: str, extract: Callable[[DataFrame], DataFrame], method: str) -> Imported:
    """Bring folder up to date with listing (id, name, signature, ord; one row a file).

    extract(files: id, name) gives id, text; a file without text is not written and stays as it was in the manifest. A changed file keeps its
    output's name, a new one takes the next free number. Files that are no longer listed leave the manifest. Where there is no manifest yet,
    files are paired with adopted outputs of their name and count as cached. Conflict, if another run has committed meanwhile.
    """
    spark, folder = listing.sparkSession, folder.rstrip("/")
    base, _ = states.current(spark, f"{folder}/manifest")
    manifest = states.load(spark, f"{folder}/manifest", MANIFEST)
    held = outputs(spark, folder).select("output_file", "batch").distinct()
    if base == 0:
        stem = lambda c: safe_file_name(F.regexp_replace(c, r"\.[^.]*$", ""))
        there = held.select("output_file", "batch", F.regexp_replace(F.regexp_replace("output_file", r"\.md$", ""), r"^[0-9]+_", "").alias("safe_name"))
        pairs = ingest.pair_with_existing(listing.withColumn("safe_name", stem(F.col("name"))), there)
        manifest = materialize(pairs.select("id", "name", "signature", "output_file", "batch"), "import-adopted")
    known = manifest.join(held.withColumn("there", F.lit(True)), ["output_file", "batch"], "left").withColumn("output_exists", F.coalesce("there", F.lit(False)))
    diff = materialize(ingest.snapshot_diff(listing, known.select("id", "signature", "output_file", "output_exists")), "import-diff")
    number = lambda df: df.select(F.regexp_extract("output_file", r"^([0-9]+)_", 1).try_cast("long").alias("number")).where("number IS NOT NULL")
    used = number(held).unionByName(number(manifest)).distinct()
    plan = materialize(ingest.write_plan(diff, listing, used), "import-plan")
    texts = extract(plan.select("id").join(listing.select("id", "name"), "id")).withColumn("text", F.trim("text")).where("text <> ''")
    batch = uuid.uuid4().hex
    made = plan.join(listing.select("id", "name", "signature"), "id").join(texts.select("id", "text"), "id")
    made = materialize(made.withColumn("body", ingest.document_text(F.col("name"), F.lit(method), F.concat("text", F.lit("\n")))), "import-texts")
    fresh = made.select("id", "name", "signature", "output_file", F.lit(batch).alias("batch"))
    if not made.isEmpty():
        made.select("output_file", F.col("body").alias("text"), F.lit(batch).alias("batch")).write.mode("append").partitionBy("batch").parquet(f"{folder}/outputs")
    stays = manifest.join(listing.select("id"), "id", "left_semi").join(fresh.select("id"), "id", "left_anti").select("id", "name", "signature", "output_file", "batch")
    version = states.save(stays.unionByName(fresh), f"{folder}/manifest", base)
    files = diff.where("status <> 'deleted'").select("id", "status", F.col("output_file").alias("old")).join(listing.select("id", "name"), "id").join(plan.select("id", F.col("output_file").alias("now")), "id", "left")
    files = files.select("id", "name", "status", F.coalesce("now", "old").alias("output_file")).join(made.select("id", F.lit(True).alias("made")), "id", "left").where("status = 'cached' OR made").drop("made")
    counters = ingest.import_counters(diff).drop("processed").withColumn("processed", F.lit(made.count()))
    return Imported(files, counters, version)
