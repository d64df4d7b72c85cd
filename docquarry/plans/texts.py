"""Queries on text, numbers in text, and what supports an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import numbers as N
from docquarry.functions import text as T
from docquarry.plans.passages import docs
from docquarry.plans.registry import query
from docquarry.plans.retrieval import _NORM, tokens_sql


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS norm_md5 FROM documents")
def identifier_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_identifier(F.col("text"))).alias("norm_md5"))


@query(f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def tokens_nostop(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = docs(spark, sf_dir).select("doc_id", T.search_tokens(F.col("text")).alias("t"))
    return made.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(r"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda l: regexp_replace(regexp_replace(l, '[\s\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')), lambda l: l <> ''), chr(10))) AS clean_md5 FROM documents""")
def whitespace_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_whitespace(F.col("text"))).alias("clean_md5"))


@query(r"SELECT doc_id, md5(lower(regexp_replace(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'), '^ | $', '', 'g'))) AS fold_md5 FROM documents")
def fold_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(T.fold(F.col("text"))).alias("fold_md5"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'), '^ | $', '', 'g') AS c FROM documents)
 SELECT doc_id, CASE WHEN length(c) > 200 THEN substr(c, 1, 197) || '...' ELSE c END AS cell, CASE WHEN length(c) > 34 THEN rtrim(substr(c, 1, 31)) || '...' ELSE c END AS title FROM t""")
def cell_and_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.normalize_cell(F.col("text")).alias("cell"), T.truncate_title(F.col("text")).alias("title"))


_KEEP = "WITH r AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)"


@query(f"{_KEEP} SELECT doc_id FROM r WHERE rn = 1")
def doc_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS n_bytes FROM documents")
def doc_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(r"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})(?:[^\p{L}\p{N}_]|$)', 1)) AS d FROM documents)
 SELECT doc_id, count(DISTINCT d) AS n FROM d GROUP BY doc_id""")
def dates_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docs(spark, sf_dir).select("doc_id", F.explode(F.filter(N.dates_in(F.col("text")), lambda v: v.rlike("^[0-9]{4}-")))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return found


@query("""SELECT doc_id, regexp_replace(trim(source || ' / ' || lang || ' é.pdf'), '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM documents""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.safe_file_name(F.concat("source", F.lit(" / "), "lang", F.lit(" é.pdf"))).alias("safe"))
