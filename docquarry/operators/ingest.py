"""Incremental import: what a new listing changes, what is written where, and what kinds of files there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.scratch import scratch_dir

# File kinds by ending and by MIME type.
TEXT_ENDINGS, SHEET_ENDINGS, RICH_ENDINGS = ("md", "txt"), ("csv", "xlsx"), ("docx", "pptx", "html", "png", "jpg", "jpeg", "webp", "tiff", "bmp")
OFFICE = "application/vnd.openxmlformats-officedocument."
BINARY_MIMES = {
    "application/pdf": ".pdf", f"{OFFICE}wordprocessingml.document": ".docx", f"{OFFICE}presentationml.presentation": ".pptx", f"{OFFICE}spreadsheetml.sheet": ".xlsx",
    "text/csv": ".csv", "text/html": ".html", "text/markdown": ".md", "text/x-markdown": ".md",
    "image/png": ".png", "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/webp": ".webp", "image/tiff": ".tiff", "image/bmp": ".bmp",
}
EXPORT_MIMES = {
    "application/vnd.google-apps.document": (f"{OFFICE}wordprocessingml.document", ".docx"), "application/vnd.google-apps.spreadsheet": (f"{OFFICE}spreadsheetml.sheet", ".xlsx"),
    "application/vnd.google-apps.presentation": (f"{OFFICE}presentationml.presentation", ".pptx"), "application/vnd.google-apps.drawing": ("image/png", ".png"),
}
SHEET_MIMES = ("application/vnd.google-apps.spreadsheet", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "text/csv")
IMAGE_ENDINGS = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tiff")


def snapshot_diff(listing: DataFrame, manifest: DataFrame, key: str = "id") -> DataFrame:
    """key, status (cached, changed, new or deleted) and output_file, which a changed file keeps.

    listing: key, signature; manifest: key, signature, output_file, output_exists. A file is cached if its signature is the
    same and its output is still there.
    """
    now = listing.select(F.col(key).alias("k"), F.col("signature").alias("now"), F.lit(True).alias("listed"))
    before = manifest.select(F.col(key).alias("k"), F.col("signature").alias("was"), "output_file", "output_exists", F.lit(True).alias("held"))
    both = now.join(before, "k", "full_outer")
    status = F.when(F.col("listed").isNull(), "deleted").when(F.col("held").isNull(), "new").when((F.col("now") == F.col("was")) & F.col("output_exists"), "cached").otherwise("changed")
    return both.select(F.col("k").alias(key), status.alias("status"), "output_file")


def import_counters(diff: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return diff.agg(F.count_if(F.col("status") != "deleted").alias("checked"), *map(count, ("cached", "new", "changed", "deleted")), F.count_if(F.col("status").isin("new", "changed")).alias("processed"))


def _nth(df: DataFrame, order: list[Column], name: str = "nth", keys: list[str] | None = None) -> DataFrame:
    """df with its place in order. Without keys the places are counted range by range, so no task sees all rows."""
    if keys:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    spark = df.sparkSession
    scratch_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # read twice below, and another run could draw other ranges: one result is kept
    ranged = df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()).checkpoint()
    within = ranged.withColumn(name, F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))  # a row a partition
    return within.join(F.broadcast(before), "__range").withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")


def allocate_numbers(wanted: DataFrame, used: DataFrame, order: list[str], number: str = "number") -> DataFrame:
    """wanted with the smallest numbers from 1 that used does not have, in order; each only once."""
    n = wanted.count()
    spark = wanted.sparkSession
    free = spark.range(1, n + used.count() + 1).select(F.col("id").alias(number)).join(used.select(number).distinct(), number, "left_anti")
    places = _nth(free, [F.col(number)])
    return _nth(wanted, [F.col(c) for c in order]).join(places, "nth").drop("nth")


def pair_with_existing(files: DataFrame, existing: DataFrame, key: str = "safe_name") -> DataFrame:
    """The n-th file of a safe name with the n-th existing output of that stem. files: key, ord; existing: key, output_file."""
    left = _nth(files, [F.col("ord")], keys=[key])
    right = _nth(existing, [F.lower("output_file"), F.col("output_file")], keys=[key])
    return left.join(right, [key, "nth"]).drop("nth")


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; rows without a key all stay. Tasks keep one row of a key each before any travels."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("__row")).select("__row.*")
    return first.unionByName(df.where(F.col(key).isNull()))


def upload_route(name: Column) -> Column:
    """text, spreadsheet, pdf or rich by ending; null where no reader is."""
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(ending.isin(*TEXT_ENDINGS), "text").when(ending.isin(*SHEET_ENDINGS), "spreadsheet").when(ending == "pdf", "pdf").when(ending.isin(*RICH_ENDINGS), "rich")


def file_kind(mime: Column, name: Column) -> Column:
    kind = F.lower(F.coalesce(mime, F.lit("")))
    image = F.startswith(kind, F.lit("image/"))
    for ending in IMAGE_ENDINGS:
        image = image | F.endswith(F.lower(F.coalesce(name, F.lit(""))), F.lit(ending))
    return F.when(kind.isin(*SHEET_MIMES), "spreadsheet").when(image, "image").when(kind == "application/pdf", "pdf").otherwise("other")


def kind_summary(files: DataFrame, kind: str = "kind") -> DataFrame:
    return files.groupBy(kind).agg(F.count(F.lit(1)).alias("files"))


def ingest_outcome(files: DataFrame, text: str = "text", error: str = "error") -> DataFrame:
    """files with status saved or skipped and the reason; callers stop where nothing is saved."""
    reason = F.when(F.col("size") == 0, "empty file").when(F.col(error).isNotNull(), F.col(error)).when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "no text")
    return files.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "saved").otherwise("skipped"))


def sheet_or_generic(sheet_text: Column, generic_text: Column) -> Column:
    return F.coalesce(F.when(F.trim(sheet_text) != "", sheet_text), generic_text)


def file_plans(listing: DataFrame, mime: str = "mime_type", name: str = "name") -> DataFrame:
    """The files of a listing that can be read, with mode (download or export), export_mime and suffix; others are left out."""
    spark = listing.sparkSession
    known = [(m, "download", None, s) for m, s in BINARY_MIMES.items()] + [(m, "export", e, s) for m, (e, s) in EXPORT_MIMES.items()]
    plans = spark.createDataFrame(known, "plan_mime string, mode string, export_mime string, default_suffix string")
    joined = listing.join(F.broadcast(plans), F.lower(F.coalesce(F.col(mime), F.lit(""))) == F.col("plan_mime"))  # 18 rows
    own = F.lower(F.regexp_extract(F.col(name), r"(\.[^.]+)$", 1))
    suffix = F.when((F.col("mode") == "download") & (own != ""), own).otherwise(F.col("default_suffix"))
    return joined.withColumn("suffix", suffix).drop("plan_mime", "default_suffix")


def write_plan(diff: DataFrame, files: DataFrame, used: DataFrame, key: str = "id") -> DataFrame:
    """key, status, output_file for what is new or changed: changed files keep theirs, new ones get the next free number and their safe name.

    diff: snapshot_diff(); files: key, name, ord; used: number.
    """
    from docquarry.functions.text import safe_file_name

    todo = diff.where("status in ('new', 'changed')").join(files.select(key, "name", "ord"), key)
    stem = safe_file_name(F.regexp_replace("name", r"\.[^.]*$", ""))
    kept = todo.where("output_file is not null").select(key, "status", "output_file")
    fresh = allocate_numbers(todo.where("output_file is null").select(key, "status", "ord", stem.alias("stem")), used, ["ord", key])
    named = fresh.select(key, "status", F.concat(F.when(F.col("number") < 10, F.lpad(F.col("number").cast("string"), 2, "0")).otherwise(F.col("number").cast("string")), F.lit("_"), "stem", F.lit(".md")).alias("output_file"))
    return kept.unionByName(named)


def document_text(name: Column, method: Column, body: Column) -> Column:
    """An imported document as it is stored: title, how it was read, text."""
    return F.concat(F.lit("# "), name, F.lit("\n\nExtraction method: "), method, F.lit("\n\n"), body)
