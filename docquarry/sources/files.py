"""Reading and writing collections, sidecars, question sets, sheets, manifests and indexes.

Paths may be of any file system that Spark reads.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from docquarry.functions.text import decode_with_fallback, display_label
from docquarry.sources import postings, states

ROOT_NAMES = ("__root__", "uploaded_files")
DELIMITERS, SNIFF_CHARS = ",;\t|", 4096
QUESTION = "id string, collection string, question string, expected_answer string, accepted_answers array<string>, category string, source_document string"


def scan_collection(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    """relative_path, source, collection_name, collection_order, content of the markdown files below each name.

    The root names stand for all of root. A folder that is missing or without files stops the call.
    """
    out = None
    for order, name in enumerate(names):
        folder = root if name in ROOT_NAMES else f"{root.rstrip('/')}/{name}"
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
        base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
        relative = F.regexp_replace(F.col("path"), f"^.*?\\Q{base}\\E/", "")
        part = files.select(relative.alias("relative_path"), F.col("path").alias("source"), F.lit(name).alias("collection_name"), F.lit(order).alias("collection_order"), "content")
        if part.isEmpty():
            raise FileNotFoundError(f"no markdown files in {folder}")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no collection named")
    return out


def inventory(scanned: DataFrame) -> DataFrame:
    """relative_path, collection_name, sha256: one row per path; where collections overlap the last one names it."""
    last = Window.partitionBy("relative_path").orderBy(F.desc("collection_order"))
    once = scanned.select("relative_path", "collection_name", "collection_order", F.sha2("content", 256).alias("sha256")).withColumn("rn", F.row_number().over(last))
    return once.where("rn = 1").select("relative_path", "collection_name", "sha256")


def documents(scanned: DataFrame) -> DataFrame:
    """The scanned files as text; overlaps stay and are settled where chunks are made."""
    return scanned.withColumn("text", decode_with_fallback(F.col("content"))).drop("content")


def library(scanned: DataFrame) -> DataFrame:
    return scanned.select("relative_path", display_label(F.col("relative_path")).alias("label")).distinct().orderBy(F.lower("relative_path"), "relative_path")


def with_sidecars(docs: DataFrame, sidecars: DataFrame) -> DataFrame:
    """docs with sections of their sidecar; one made for another text stops the query.

    sidecars: relative_path, markdown_sha256, sections.
    """
    joined = docs.join(sidecars, "relative_path", "left")
    stale = F.col("markdown_sha256").isNotNull() & (F.col("markdown_sha256") != F.sha2("text", 256))
    return joined.withColumn("sections", F.when(stale, F.raise_error(F.lit("stale structure sidecar")).cast(dict(sidecars.dtypes)["sections"])).otherwise(F.col("sections"))).drop("markdown_sha256")


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions: trimmed ids, accepted answers once each. A blank required field, a repeated id or no question stops the call."""
    rows = spark.read.schema(QUESTION).json(path, multiLine=True)
    clean = rows.select(F.trim("id").alias("id"), *(F.trim(c).alias(c) for c in ("collection", "question", "expected_answer")), F.array_distinct(F.coalesce("accepted_answers", F.expr("cast(array() as array<string>)"))).alias("accepted_answers"), "category", "source_document")
    blank = F.lit(False)
    for c in ("id", "collection", "question", "expected_answer"):
        blank = blank | (F.coalesce(F.col(c), F.lit("")) == "")
    found = clean.agg(F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("blank"), F.count_distinct("id").alias("ids")).first()
    if not found["n"] or found["blank"] or found["ids"] != found["n"]:
        raise ValueError(f"question set {path}: {found['n']} rows, {found['blank']} with blank fields, {found['ids']} different ids")
    return clean


def only_questions(questions: DataFrame, ids: Sequence[str] | None) -> DataFrame:
    """The questions with these ids (all where none are given); a selection that leaves none stops the call."""
    if not ids:
        return questions
    left = questions.where(F.col("id").isin(*ids))
    if left.isEmpty():
        raise ValueError(f"no question among {', '.join(ids)}")
    return left


def save_state(df: DataFrame, path: str, base: int | None = None) -> int:
    """df as the newest state at path: manifests, chat states, sidecars. See states; base makes it a compare-and-swap."""
    return states.save(df, path, base)


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest state at path, or an empty one."""
    return states.load(spark, path, schema)


def save_sidecars(docs: DataFrame, path: str) -> None:
    """Sections of texts (relative_path, text, sections) with the hash of the text that they were made for. Sidecars of other texts stay; a text without sections loses its own."""
    kind = dict(docs.dtypes)["sections"]
    fresh = docs.where(F.size("sections") > 0).select("relative_path", F.sha2("text", 256).alias("markdown_sha256"), "sections")
    others = lambda old: old.join(docs.select("relative_path").distinct(), "relative_path", "left_anti")
    states.change(docs.sparkSession, path, f"relative_path string, markdown_sha256 string, sections {kind}", lambda old: others(old).unionByName(fresh))


def save_run(results: DataFrame, lines: DataFrame, folder: str, run_id: str, latest: bool = False) -> None:
    """A run's results as JSON lines and its report (line_no, line) as text below its id, and below latest too where asked."""
    for name in [run_id, "latest"] if latest else [run_id]:
        results.write.mode("overwrite").json(f"{folder}/{name}/results")
        lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(f"{folder}/{name}/report")  # parts in the order of their names


def read_csv_sheet(spark: SparkSession, path: str, sheet: str = "CSV") -> DataFrame:
    """sheet, physical, cells: all cells as text. The delimiter is guessed from the first characters of the file."""
    head = spark.read.text(path).limit(50).agg(F.array_join(F.collect_list("value"), "\n").alias("t")).first()["t"] or ""  # 50 lines
    try:
        delimiter = csv.Sniffer().sniff(head[:SNIFF_CHARS], DELIMITERS).delimiter
    except csv.Error:
        delimiter = ","
    rows = spark.read.csv(path, sep=delimiter, header=False, multiLine=True, inferSchema=False)
    cells = F.array(*(F.coalesce(F.col(c), F.lit("")) for c in rows.columns))
    return rows.select(F.lit(sheet).alias("sheet"), F.monotonically_increasing_id().alias("physical"), cells.alias("cells"))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, bool]:
    """A stored table, or an empty one where there is none; and whether there was one."""
    try:
        found = spark.read.parquet(path)
        return found, True
    except AnalysisException:
        return spark.createDataFrame([], schema), False


def fingerprint(files: DataFrame, settings: dict[str, object]) -> str:
    """The name of an index: depends on every file's path and hash and on the settings, not on their order."""
    total = files.select(F.conv(F.substring(F.sha2(F.concat_ws("\u001f", "relative_path", "sha256"), 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.sum("h"), F.count(F.lit(1))).first()
    spelt = "\u001f".join([*(f"{k}={settings[k]!r}" for k in sorted(settings)), *map(str, total)])
    spark = files.sparkSession
    return spark.range(1).select(F.sha2(F.lit(spelt), 256)).first()[0]


def save_index(chunks: DataFrame, index: DataFrame, folder: str, name: str) -> None:
    """The tables of an index below its fingerprint, the postings in sorted blocks; Spark commits each as a whole."""
    chunks.write.mode("overwrite").parquet(f"{folder}/{name}/chunks")
    postings.save(index, f"{folder}/{name}/postings")


def load_index(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame] | None:
    """The index of a fingerprint, or None where it is missing or not sound: repeated chunk ids, chunks without parent, weights that are negative or not finite."""
    try:
        chunks, index = spark.read.parquet(f"{folder}/{name}/chunks"), postings.load(spark, f"{folder}/{name}/postings")
        c = chunks.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("ids"), F.count_if(F.col("parent_id").isNull()).alias("orphans")).first()
        bad = index.where(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0) | (F.col("weight") == float("inf"))).limit(1).count()
    except AnalysisException:
        return None
    return None if c["n"] != c["ids"] or c["orphans"] or bad else (chunks, index)


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages kept by kept_pages(), by collection; what stood there before goes."""
    pages.write.mode("overwrite").partitionBy("collection").parquet(path)


def delete_documents(docs: DataFrame, paths: Sequence[str]) -> DataFrame:
    """docs without paths, each of which must be a markdown file below the root."""
    for p in paths:
        if not p.endswith(".md") or p.startswith("/") or ".." in p.split("/"):
            raise ValueError(f"not a document of this collection: {p}")
    return docs.where(~F.col("relative_path").isin(*paths)) if paths else docs
