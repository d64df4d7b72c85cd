"""Exact arithmetic over table rows, column profiles, header and sheet rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.numbers import format_number, profile_number, table_number
from docquarry.functions.text import collapse

MAX_ROWS, MAX_COLUMNS, MAX_SAMPLES = 1000, 40, 5


def rows_equal(row_values: Column, equals: dict[str, str]) -> Column:
    """Each named column equals its value, letter case apart; a missing column is an empty string."""
    out = F.lit(True)
    for key, value in equals.items():
        out = out & (F.lower(F.coalesce(F.try_element_at(row_values, F.lit(key)), F.lit(""))) == value.lower())
    return out


def aggregate_rows(rows: DataFrame, operation: str, column: str | None = None, equals: dict[str, str] | None = None, keep_ids: bool = False) -> DataFrame:
    """One row: operation, result (decimal), scanned_rows, matched_rows, and input_chunk_ids where keep_ids asks for them.

    rows: chunk_id, row_values (MAP). operation: count, sum, mean, min or max. No rows in scope, no matching
    row for a numeric operation, and a cell that is no number stop the query. keep_ids gathers all ids in one row
    and is meant for tables of spreadsheet size.
    """
    match = rows_equal(F.col("row_values"), equals or {})
    marked = rows.select("chunk_id", match.alias("hit"), F.when(match, F.try_element_at("row_values", F.lit(column)) if column else F.lit(None)).alias("cell"))
    value = F.when(F.col("hit"), table_number(F.col("cell")))
    total = F.sum(value).cast("decimal(38,8)")
    made = {"count": F.count_if("hit").cast("decimal(38,8)"), "sum": total, "mean": (total / F.count_if("hit")).cast("decimal(38,8)"), "min": F.min(value).cast("decimal(38,8)"), "max": F.max(value).cast("decimal(38,8)")}
    parts = [F.count(F.lit(1)).alias("scanned_rows"), F.count_if("hit").alias("matched_rows"), made[operation].alias("found")]
    if keep_ids:
        parts.append(F.sort_array(F.collect_list(F.when(F.col("hit"), F.col("chunk_id")))).alias("input_chunk_ids"))
    one = marked.agg(*parts)
    stop = lambda text: F.raise_error(F.lit(text)).cast("decimal(38,8)")
    result = F.when(F.col("scanned_rows") == 0, stop("No structured table rows in requested scope"))
    if operation != "count":
        result = result.when(F.col("matched_rows") == 0, stop("No matching rows for numeric aggregation"))
    kept = ["input_chunk_ids"] if keep_ids else []
    return one.select(F.lit(operation).alias("operation"), result.otherwise(F.col("found")).alias("result"), "scanned_rows", "matched_rows", *kept)


def column_profiles(cells: DataFrame, keys: list[str], header: str = "header", value: str = "value", order: str = "row_number") -> DataFrame:
    """keys, header, kind, numeric_count, total, low, high, samples: numbers where two or more values parse, else up to five first different ones.

    A row counts once per header, with its first non-empty value. Samples are found by two aggregations, never by
    gathering a column.
    """
    full = cells.where(F.coalesce(F.col(value), F.lit("")) != "").withColumn("number", profile_number(F.col(value))).withColumn("sample", F.substring(value, 1, 80))
    stats = full.groupBy(*keys, header).agg(F.count("number").alias("numeric_count"), F.sum("number").alias("total"), F.min("number").alias("low"), F.max("number").alias("high"))
    distinct = full.groupBy(*keys, header, "sample").agg(F.min(order).alias("first"))
    ranked = distinct.withColumn("rn", F.row_number().over(Window.partitionBy(*keys, header).orderBy("first", "sample"))).where(F.col("rn") <= MAX_SAMPLES)
    samples = ranked.groupBy(*keys, header).agg(F.array_sort(F.collect_list(F.struct("rn", "sample"))).alias("s"))
    numeric = F.col("numeric_count") >= 2
    joined = stats.join(samples, [*keys, header])
    return joined.select(*keys, header, F.when(numeric, "numeric").otherwise("samples").alias("kind"), "numeric_count", *(F.when(numeric, F.col(c)).alias(c) for c in ("total", "low", "high")),
                         F.when(~numeric, F.transform("s", lambda x: x["sample"])).alias("samples"))


def profile_line(header: Column, kind: Column, count: Column, total: Column, low: Column, high: Column, samples: Column) -> Column:
    numeric = F.concat(header, F.lit(": numeric count="), count, F.lit(", sum="), format_number(total), F.lit(", min="), format_number(low), F.lit(", max="), format_number(high))
    return F.when(kind == "numeric", numeric).otherwise(F.concat(header, F.lit(": sample values="), F.array_join(samples, "; ")))


def unique_headers(raw: DataFrame, keys: list[str], index: str = "index", header: str = "raw_header") -> DataFrame:
    """Headers of a sheet: blank ones named by place, repeats numbered from _2."""
    named = F.when(collapse(F.coalesce(F.col(header), F.lit(""))) == "", F.concat(F.lit("Column_"), F.col(index))).otherwise(collapse(F.col(header)))
    once = raw.withColumn("base", named).withColumn("n", F.row_number().over(Window.partitionBy(*keys, "base").orderBy(index)))
    return once.withColumn("header", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), "n"))).drop("base", "n")


def build_sheet(cells: DataFrame, key: str = "sheet") -> DataFrame:
    """sheet, row_number, row_values, omitted_rows from raw rows (sheet, physical, cells ARRAY<STRING>).

    The first row that is not blank gives at most MAX_COLUMNS headers; of the others MAX_ROWS stay and the rest are
    counted. Row numbers start at 2 and count rows that are not blank. Empty cells are left out.
    """
    full = cells.where(F.exists("cells", lambda c: F.coalesce(c, F.lit("")) != "")).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("physical")))
    head = full.where("n = 1").select(key, F.posexplode(F.slice("cells", 1, MAX_COLUMNS)).alias("i", "raw_header")).withColumn("index", F.col("i") + 1)
    headers = unique_headers(head, [key]).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "header"))), lambda x: x["header"]).alias("headers"))
    total = full.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("data_rows"))
    pairs = F.filter(F.arrays_zip("headers", F.slice("cells", 1, MAX_COLUMNS).alias("value")), lambda p: F.coalesce(p["value"], F.lit("")) != "")
    body = full.where((F.col("n") > 1) & (F.col("n") <= MAX_ROWS + 1)).join(headers, key).join(total, key)
    values = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["headers"], p["value"])))
    return body.select(key, F.col("n").alias("row_number"), values.alias("row_values"), F.greatest(F.col("data_rows") - MAX_ROWS, F.lit(0)).alias("omitted_rows"))
