"""Queries on rankings: dense, sparse, fused, reranked."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import STOPWORDS
from docquarry.operators import retrieval as R
from docquarry.plans.registry import query
from docquarry.scratch import scratch_dir
from docquarry.sources import postings

#: Every row whose identifier this divides asks a question; all rows are searched.
QUESTIONS = 20

_STOP = "'" + "', '".join(STOPWORDS) + "'"
_NORM = r"trim(regexp_replace(strip_accents(lower(coalesce({}, ''))), '[^a-z0-9]+', ' ', 'g'))"
TOKENS = "list_filter(string_split({n}, ' '), lambda t: length(t) > 1 AND NOT list_contains([{s}], t))"


def tokens_sql(column: str) -> str:
    return TOKENS.format(n=_NORM.format(column), s=_STOP)


_DENSE = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, v.label, list_dot_product(q.e, v.e) / (q.n * v.n) AS score FROM v q, v WHERE q.vec_id % 20 = 0)"""
_RANK = "(row_number() OVER (PARTITION BY query_id ORDER BY {} DESC, chunk_id))::INT"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "label", "embedding")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated question set: every twentieth vector; for terms, the texts of every twentieth benchmark item."""
    return vectors(spark, sf_dir).where(F.col("chunk_id") % QUESTIONS == 0).select(F.col("chunk_id").alias("query_id"), "embedding")


@query(f"WITH {_DENSE}, r AS (SELECT query_id, chunk_id, score, {_RANK.format('score')} AS rank FROM s) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 30")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense_top_k(vectors(spark, sf_dir), questions(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_DENSE}, r AS (SELECT query_id, chunk_id, score, {_RANK.format('score')} AS rank FROM s WHERE label IN (1, 3)) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 30")
def dense_topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = R.in_scope(vectors(spark, sf_dir), [1, 3], "label")
    return R.dense_top_k(pool, questions(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT 0::BIGINT AS query_id, 0::BIGINT AS chunk_id WHERE false")
def dense_empty_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense_top_k(vectors(spark, sf_dir).withColumnRenamed("label", "document_id"), questions(spark, sf_dir), scope=[]).select("query_id", "chunk_id")


_SPARSE = f"""w AS (SELECT doc_id AS chunk_id, unnest({tokens_sql('text')}) AS token FROM documents), p AS (SELECT token, chunk_id, 1 + ln(count(*)) AS weight FROM w GROUP BY ALL),
 qw AS (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS token FROM benchmark WHERE item_id % 20 = 0), q AS (SELECT query_id, token, 1 + ln(count(*)) AS weight FROM qw GROUP BY ALL),
 sp AS (SELECT query_id, chunk_id, sum(p.weight * q.weight) AS score FROM p JOIN q USING (token) GROUP BY ALL)"""


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.question_terms(spark.read.parquet(f"{sf_dir}/benchmark.parquet").where(F.col("item_id") % QUESTIONS == 0).select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = terms(spark, sf_dir)
    chunks = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    return R.sparse_top_k(R.postings(chunks, tokens=asked), asked)


_SPARSE_RANK = f"sr AS (SELECT query_id, chunk_id, round(score, 9) AS score, {_RANK.format('round(score, 9)')} AS rank FROM sp)"


@query(f"WITH {_SPARSE}, {_SPARSE_RANK} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM sr WHERE rank <= 30")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse(spark, sf_dir).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_SPARSE}, {_SPARSE_RANK} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM sr WHERE rank <= 30")
def posting_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over a stored index of all tokens."""
    path = f"{scratch_dir(spark)}/postings-{uuid.uuid4().hex}"
    chunks = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    postings.save(R.postings(chunks), path)
    return postings.search(spark, path, terms(spark, sf_dir)).rows.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_FUSED = f"""{_DENSE}, dr AS (SELECT query_id, chunk_id, {_RANK.format('score')} AS rank FROM s), {_SPARSE}, {_SPARSE_RANK},
 f AS (SELECT coalesce(d.query_id, x.query_id) AS query_id, coalesce(d.chunk_id, x.chunk_id) AS chunk_id, d.rank AS dense_rank, x.rank AS sparse_rank,
   coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + x.rank), 0) AS rrf_score
   FROM (SELECT * FROM dr WHERE rank <= 30) d FULL JOIN (SELECT * FROM sr WHERE rank <= 30) x ON d.query_id = x.query_id AND d.chunk_id = x.chunk_id),
 fr AS (SELECT *, {_RANK.format('rrf_score')} AS rank FROM f)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(R.dense_top_k(vectors(spark, sf_dir), questions(spark, sf_dir)), sparse(spark, sf_dir))


@query(f"WITH {_FUSED} SELECT query_id, chunk_id, dense_rank, sparse_rank, round(rrf_score, 9) AS rrf_score, rank FROM fr WHERE rank <= 30")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("query_id", "chunk_id", "dense_rank", "sparse_rank", F.round("rrf_score", 9).alias("rrf_score"), "rank")


_QT = tokens_sql("b.text")
_DT = tokens_sql("c.text")


@query(f"""WITH {_FUSED}, k AS (SELECT fr.*, round(len(list_intersect(list_distinct({_QT}), list_distinct({_DT}))) / greatest(len(list_distinct({_QT})), 1)::DOUBLE, 9) AS rerank_score
   FROM fr JOIN documents c ON c.doc_id = fr.chunk_id JOIN benchmark b ON b.item_id = fr.query_id WHERE rank <= 30)
 SELECT query_id, chunk_id, rank, rerank_score, {_RANK.format('rerank_score')} AS rerank_rank FROM k""")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("body"))
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where(F.col("item_id") % QUESTIONS == 0).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    joined = fused(spark, sf_dir).join(texts, "chunk_id").join(R.small(asked), "query_id")
    done = R.rerank(joined, F.round(R.token_overlap(F.col("query"), F.col("body")), 9))
    return done.select("query_id", "chunk_id", "rank", "rerank_score", "rerank_rank")


@query(f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
 c AS (SELECT v.*, d.text FROM v JOIN documents d ON d.doc_id = v.vec_id WHERE v.label IN (1, 3, 5)),
 a AS (SELECT b.item_id AS query_id, b.text AS query, v.e, v.n FROM benchmark b JOIN v ON v.vec_id = b.item_id WHERE b.item_id % 20 = 0),
 s AS (SELECT a.query_id, c.vec_id AS chunk_id, list_dot_product(a.e, c.e) / (a.n * c.n) AS score FROM a, c), dr AS (SELECT query_id, chunk_id, {_RANK.format('score')} AS rank FROM s),
 w AS (SELECT vec_id AS chunk_id, unnest({tokens_sql('text')}) AS token FROM c), p AS (SELECT token, chunk_id, 1 + ln(count(*)) AS weight FROM w GROUP BY ALL),
 qw AS (SELECT query_id, unnest({tokens_sql('query')}) AS token FROM a), q AS (SELECT query_id, token, 1 + ln(count(*)) AS weight FROM qw GROUP BY ALL),
 sp AS (SELECT query_id, chunk_id, sum(p.weight * q.weight) AS score FROM p JOIN q USING (token) GROUP BY ALL), {_SPARSE_RANK},
 f AS (SELECT coalesce(d.query_id, x.query_id) AS query_id, coalesce(d.chunk_id, x.chunk_id) AS chunk_id, d.rank AS dense_rank, x.rank AS sparse_rank,
   coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + x.rank), 0) AS rrf_score
   FROM (SELECT * FROM dr WHERE rank <= 30) d FULL JOIN (SELECT * FROM sr WHERE rank <= 30) x ON d.query_id = x.query_id AND d.chunk_id = x.chunk_id),
 fr AS (SELECT *, {_RANK.format('rrf_score')} AS rank FROM f),
 k AS (SELECT fr.query_id, fr.chunk_id, fr.dense_rank, fr.sparse_rank, fr.rrf_score, fr.rank, c.label AS document_id,
   round(len(list_intersect(list_distinct({tokens_sql('a.query')}), list_distinct({tokens_sql('c.text')}))) / greatest(len(list_distinct({tokens_sql('a.query')})), 1)::DOUBLE, 9) AS rerank_score
   FROM fr JOIN c ON c.vec_id = fr.chunk_id JOIN a USING (query_id) WHERE rank <= 30)
 SELECT query_id, chunk_id, dense_rank, sparse_rank, round(rrf_score, 9) AS rrf_score, rank, document_id, rerank_score, {_RANK.format('rerank_score')} AS rerank_rank FROM k""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole retrieval as one plan over documents that have a vector; scope: three labels."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    chunks = vectors(spark, sf_dir).withColumnRenamed("label", "document_id").join(texts, "chunk_id")
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where(F.col("item_id") % QUESTIONS == 0).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = R.hybrid_search(chunks, asked.join(questions(spark, sf_dir), "query_id"), lambda q, t: F.round(R.token_overlap(q, t), 9), scope=[1, 3, 5])
    return found.withColumn("rrf_score", F.round("rrf_score", 9))


_EACH = f"""v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
 c AS (SELECT v.*, d.text FROM v JOIN documents d ON d.doc_id = v.vec_id), a AS (SELECT b.item_id, b.text AS query, v.e, v.n FROM benchmark b JOIN v ON v.vec_id = b.item_id WHERE b.item_id % 20 = 0),
 s AS (SELECT a.item_id || ':' || c.label AS query_id, c.vec_id AS chunk_id, list_dot_product(a.e, c.e) / (a.n * c.n) AS score FROM a, c WHERE c.label IN (1, 3, 5)
   UNION ALL SELECT a.item_id || ':all', c.vec_id, list_dot_product(a.e, c.e) / (a.n * c.n) FROM a, c), dr AS (SELECT query_id, chunk_id, {_RANK.format('score')} AS rank FROM s),
 w AS (SELECT vec_id AS chunk_id, label, unnest({tokens_sql('text')}) AS token FROM c), p AS (SELECT token, chunk_id, label, 1 + ln(count(*)) AS weight FROM w GROUP BY ALL),
 qw AS (SELECT item_id, unnest({tokens_sql('query')}) AS token FROM a), q AS (SELECT item_id, token, 1 + ln(count(*)) AS weight FROM qw GROUP BY ALL),
 sp AS (SELECT q.item_id || ':' || p.label AS query_id, chunk_id, sum(p.weight * q.weight) AS score FROM p JOIN q USING (token) WHERE p.label IN (1, 3, 5) GROUP BY ALL
   UNION ALL SELECT q.item_id || ':all', chunk_id, sum(p.weight * q.weight) FROM p JOIN q USING (token) GROUP BY ALL), {_SPARSE_RANK},
 f AS (SELECT coalesce(d.query_id, x.query_id) AS query_id, coalesce(d.chunk_id, x.chunk_id) AS chunk_id, d.rank AS dense_rank, x.rank AS sparse_rank,
   coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + x.rank), 0) AS rrf_score
   FROM (SELECT * FROM dr WHERE rank <= 30) d FULL JOIN (SELECT * FROM sr WHERE rank <= 30) x ON d.query_id = x.query_id AND d.chunk_id = x.chunk_id),
 fr AS (SELECT *, {_RANK.format('rrf_score')} AS rank FROM f),
 k AS (SELECT split_part(fr.query_id, ':', 1)::BIGINT AS item_id, split_part(fr.query_id, ':', 2) AS part, fr.chunk_id, c.label AS document_id, fr.rank, fr.rrf_score,
   round(len(list_intersect(list_distinct({tokens_sql('a.query')}), list_distinct({tokens_sql('c.text')}))) / greatest(len(list_distinct({tokens_sql('a.query')})), 1)::DOUBLE, 9) AS rerank_score
   FROM fr JOIN c ON c.vec_id = fr.chunk_id JOIN a ON a.item_id = split_part(fr.query_id, ':', 1)::BIGINT WHERE rank <= 30),
 kr AS (SELECT *, (row_number() OVER (PARTITION BY item_id, part ORDER BY rerank_score DESC, chunk_id))::INT AS rerank_rank FROM k)"""


def each_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question within each of three labels, and over all; a search's name is its question and its label."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    chunks = vectors(spark, sf_dir).withColumn("document_id", F.col("label").cast("string")).drop("label").join(texts, "chunk_id")
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where(F.col("item_id") % QUESTIONS == 0).select("item_id", F.col("text").alias("query"))
    asked = asked.join(questions(spark, sf_dir).withColumnRenamed("query_id", "item_id"), "item_id")
    searches = asked.select("*", F.explode(F.array(F.lit("1"), F.lit("3"), F.lit("5"), F.lit("all"))).alias("part"))
    searches = searches.select(F.concat_ws(":", "item_id", "part").alias("query_id"), "query", "embedding", F.when(F.col("part") != "all", F.col("part")).alias("document_id"))
    index = R.postings(chunks, tokens=R.question_terms(searches)).join(chunks.select("chunk_id", "document_id"), "chunk_id")
    found = R.search_each(chunks, searches, index, lambda q, t: F.round(R.token_overlap(q, t), 9))
    return found.select(F.split_part("query_id", F.lit(":"), F.lit(1)).cast("long").alias("item_id"), F.split_part("query_id", F.lit(":"), F.lit(2)).alias("part"), "chunk_id", F.col("document_id").cast("int").alias("document_id"), "rank", "rrf_score", "rerank_score", "rerank_rank")


@query(f"WITH {_EACH} SELECT item_id, part, chunk_id, document_id, rank, round(rrf_score, 9) AS rrf_score, rerank_score, rerank_rank FROM kr")
def partition_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches of which each has its own scope and quota, as one plan."""
    return each_search(spark, sf_dir).withColumn("rrf_score", F.round("rrf_score", 9))


@query(f"""WITH {_EACH}, t AS (SELECT item_id, part, chunk_id, document_id, row_number() OVER (PARTITION BY item_id ORDER BY part, rerank_rank) AS rank, row_number() OVER (PARTITION BY item_id, part ORDER BY rerank_rank) AS nth FROM kr WHERE part <> 'all'),
 u AS (SELECT *, (count(*) FILTER (nth <= 8) OVER (PARTITION BY item_id ORDER BY rank)) AS used FROM t),
 m AS (SELECT *, count(*) FILTER (nth <= 8 AND used <= 20) OVER (PARTITION BY item_id, part ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mine FROM u)
 SELECT item_id, chunk_id, document_id, rank::INT AS rank, nth <= 8 AND used <= 20 AS admitted, CASE WHEN mine >= 8 THEN 'document_token_budget' WHEN used > 20 THEN 'token_budget' END AS reason FROM m""")
def partition_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of several documents in one context: eight of each at most, twenty in all, each of cost one."""
    from pyspark.sql import Window

    from docquarry.operators import context

    order = F.row_number().over(Window.partitionBy("item_id").orderBy("part", "rerank_rank"))  # three searches of a question, thirty rows each
    rows = each_search(spark, sf_dir).where("part <> 'all'").select("item_id", order.alias("rank"), F.col("chunk_id").alias("parent_id"), "document_id", F.lit(1).alias("cost"), F.lit(8).alias("quota"))
    done = context.admit(rows, 20, "quota", "item_id")
    return done.select("item_id", F.col("parent_id").cast("long").alias("chunk_id"), F.col("document_id").cast("int").alias("document_id"), "rank", "admitted", "reason")
