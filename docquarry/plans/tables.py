"""Queries on table rows, profiles and spreadsheet documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.operators import spreadsheet, tables
from docquarry.plans.registry import query


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as table rows: prices as text with a comma, flags in small letters."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    comma = lambda c: F.replace(F.col(c).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    cells = F.create_map(F.lit("price"), comma("l_extendedprice"), F.lit("flag"), F.lower("l_returnflag"), F.lit("quantity"), comma("l_quantity"))
    return lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("chunk_id"), cells.alias("row_values"))


_SQL = """SELECT '{op}' AS operation, ({f})::{t} AS result, (SELECT count(*) FROM lineitem) AS scanned_rows, count(*) AS matched_rows FROM lineitem WHERE l_returnflag = 'R'"""
_PRICE = "l_extendedprice::DECIMAL(18,2)"


@query(_SQL.format(op="count", f="count(*)", t="DECIMAL(38,8)"))
def table_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.aggregate_rows(line_rows(spark, sf_dir), "count", equals={"flag": "R"})


@query(_SQL.format(op="sum", f=f"sum({_PRICE})", t="DECIMAL(38,8)"))
def table_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.aggregate_rows(line_rows(spark, sf_dir), "sum", "price", {"flag": "R"})


@query(_SQL.format(op="mean", f=f"round(sum({_PRICE})::DOUBLE / count(*), 4)", t="DOUBLE"))
def table_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.aggregate_rows(line_rows(spark, sf_dir), "mean", "price", {"flag": "R"}).withColumn("result", F.round(F.col("result").cast("double"), 4))


@query(_SQL.format(op="min", f=f"min({_PRICE})", t="DECIMAL(38,8)"))
def table_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.aggregate_rows(line_rows(spark, sf_dir), "min", "price", {"flag": "R"})


@query(_SQL.format(op="max", f=f"max({_PRICE})", t="DECIMAL(38,8)"))
def table_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.aggregate_rows(line_rows(spark, sf_dir), "max", "price", {"flag": "R"})


@query("""WITH c AS (SELECT p_partkey, unnest(['p_brand', 'p_size', 'p_retailprice']) AS header, unnest([p_brand, p_size::VARCHAR, replace(p_retailprice::DECIMAL(18,2)::VARCHAR, '.', ',')]) AS value FROM part),
 s AS (SELECT header, value, min(p_partkey) AS f FROM c WHERE header = 'p_brand' GROUP BY ALL), k AS (SELECT list(value ORDER BY f, value) AS v FROM s)
 SELECT header, CASE WHEN header = 'p_brand' THEN 'samples' ELSE 'numeric' END AS kind, CASE WHEN header = 'p_brand' THEN 0 ELSE count(*) END AS numeric_count,
 round(sum(try_cast(replace(value, ',', '.') AS DOUBLE)), 2) AS total, min(try_cast(replace(value, ',', '.') AS DOUBLE)) AS low, max(try_cast(replace(value, ',', '.') AS DOUBLE)) AS high,
 CASE WHEN header = 'p_brand' THEN (SELECT v[1:5] FROM k) END AS samples FROM c GROUP BY header""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    price = F.replace(F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    cells = part.select(F.lit(1).alias("sheet"), F.col("p_partkey").alias("row_number"), F.explode(F.create_map(F.lit("p_brand"), F.col("p_brand"), F.lit("p_size"), F.col("p_size").cast("string"), F.lit("p_retailprice"), price)).alias("header", "value"))
    return tables.column_profiles(cells, ["sheet"]).drop("sheet").withColumn("total", F.round("total", 2))


@query("""SELECT n_name AS sheet, c_custkey AS row_number, '- Spreadsheet file c.xlsx | Sheet ' || n_name || ' | Row ' || c_custkey || ': name=' || c_name || ' | segment=' || c_mktsegment AS line
 FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def sheet_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("n_nationkey") == F.col("c_nationkey"))
    pair = lambda h, c: F.struct(F.lit(h).alias("header"), F.col(c).alias("value"))
    made = rows.select(F.col("n_name").alias("sheet"), F.col("c_custkey").alias("row_number"), F.array(pair("name", "c_name"), pair("segment", "c_mktsegment")).alias("pairs"))
    return spreadsheet.render_rows(made, "c.xlsx")


@query("""WITH r AS (SELECT n_name AS sheet, c_custkey AS row_number, c_mktsegment AS segment, c_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT sheet, row_number, name, segment FROM r""")
def sheet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sheet_render(spark, sf_dir)
    parsed = lines.withColumn("r", spreadsheet.parse_row(F.expr("substring(line, 3)"), F.lit(""))).withColumn("v", spreadsheet.row_values(F.col("r.pairs")))
    return parsed.select("r.sheet", F.col("r.row_number").cast("long").alias("row_number"), F.col("v")["name"].alias("name"), F.col("v")["segment"].alias("segment"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS n FROM lineitem) SELECT l_orderkey, max(n)::INT AS last_order FROM r GROUP BY 1""")
def running_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("n", F.row_number().over(by) - 1)
    return rows.groupBy("l_orderkey").agg(F.max("n").alias("last_order"))
