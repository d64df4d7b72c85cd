"""Queries on retrieval quality and evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import evaluate as E
from docquarry.plans.passages import docs
from docquarry.plans.registry import query

# a ranking to measure: per language and quarter of the corpus the documents by length, relevant where the label says so
_RANKED = """r AS (SELECT lang || '-' || (d.doc_id % 4) AS query_id, d.doc_id, source AS document_id, row_number() OVER (PARTITION BY lang, d.doc_id % 4 ORDER BY n_chars DESC, d.doc_id) AS rank,
 coalesce(l.quality, 0) = 1 AS relevant FROM documents d LEFT JOIN labels l USING (doc_id))"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    part = F.col("doc_id") % 4
    by = Window.partitionBy("lang", part).orderBy(F.desc("n_chars"), "doc_id")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = docs(spark, sf_dir).join(labels, "doc_id", "left")
    return rows.select(F.concat("lang", F.lit("-"), part).alias("query_id"), "doc_id", F.col("source").alias("document_id"), F.row_number().over(by).alias("rank"), (F.coalesce("quality", F.lit(0)) == 1).alias("relevant"))


@query(f"""WITH {_RANKED}, t AS (SELECT query_id, count(*) FILTER (relevant) AS total FROM r GROUP BY 1),
 h AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM r WHERE rank <= 10 AND relevant GROUP BY 1)
 SELECT query_id, CASE WHEN total > 0 THEN round(coalesce(hits, 0)::DOUBLE / total, 6) END AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr,
 CASE WHEN total > 0 THEN round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(10, total) + 1), lambda i: 1 / log2(i + 1))), 6) END AS ndcg FROM t LEFT JOIN h USING (query_id)""")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir)
    totals = rows.groupBy("query_id").agg(F.count_if("relevant").alias("relevant_total"))
    made = E.ranking_metrics(rows, totals)
    return made.select("query_id", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")))


@query(f"""WITH {_RANKED}, f AS (SELECT query_id, document_id, min(rank) AS chunk_rank FROM r GROUP BY ALL)
 SELECT query_id, document_id, chunk_rank::INT AS chunk_rank, (row_number() OVER (PARTITION BY query_id ORDER BY chunk_rank, document_id))::INT AS rank FROM f""")
def document_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.document_ranks(ranked(spark, sf_dir))


@query(f"""WITH {_RANKED}, f AS (SELECT query_id, document_id, min(rank) AS cr, bool_or(relevant) AS relevant FROM r GROUP BY ALL), d AS (SELECT query_id, relevant, row_number() OVER (PARTITION BY query_id ORDER BY cr, document_id) AS rank FROM f),
 t AS (SELECT query_id, count(*) FILTER (relevant) AS total FROM d GROUP BY 1), h AS (SELECT query_id, count(*) AS hits, min(rank) AS first FROM d WHERE rank <= 5 AND relevant GROUP BY 1)
 SELECT query_id, CASE WHEN total > 0 THEN round(coalesce(hits, 0)::DOUBLE / total, 6) END AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr FROM t LEFT JOIN h USING (query_id)""")
def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir)
    good = rows.groupBy("query_id", "document_id").agg(F.bool_or("relevant").alias("relevant"))
    ranks = E.document_ranks(rows).join(good, ["query_id", "document_id"])
    made = E.ranking_metrics(ranks, ranks.groupBy("query_id").agg(F.count_if("relevant").alias("relevant_total")), k=5)
    return made.select("query_id", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query(f"""WITH {_RANKED}, g AS (SELECT *, (row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) = 1)::INT AS fresh FROM r),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id ORDER BY rank) AS documents FROM g) SELECT query_id, arg_min(documents, rank)::BIGINT AS source_rank FROM s WHERE document_id IN ('src3', 'src4') GROUP BY query_id""")
def source_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.source_rank(ranked(spark, sf_dir), F.col("document_id").isin("src3", "src4"))


@query("""SELECT count(*) AS questions, count(*) FILTER (doc_id % 5 = 0) AS passed, count(*) FILTER (doc_id % 9 = 0) AS abstained, round(100 * avg((doc_id % 9 = 0)::INT), 2) AS abstained_percent, round(avg((doc_id % 4)::DOUBLE / 4), 4) AS mean_hit_rate FROM documents""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select(F.when(F.col("doc_id") % 5 == 0, "no_failure").otherwise("retrieval_failure").alias("failure"), (F.col("doc_id") % 9 == 0).alias("abstained"), (F.col("doc_id") % 4 / 4).alias("context_hit_rate"))
    return E.run_counters(rows)


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'no_failure' ELSE 'retrieval_failure' END AS failure, count(*) AS questions FROM documents GROUP BY 1")
def failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.failure_counts(docs(spark, sf_dir).select(F.when(F.col("doc_id") % 5 == 0, "no_failure").otherwise("retrieval_failure").alias("failure")))


@query("SELECT doc_id, lower(source) || '|' || lang || '|' || doc_id || '|' AS evidence_key FROM documents")
def evidence_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", E.evidence_key(F.col("source"), F.col("lang"), F.col("doc_id"), F.lit("")).alias("evidence_key"))
