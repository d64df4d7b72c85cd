"""Queries on sections, passages and the choice of passages for a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import document_title, excerpt, stable_id
from docquarry.operators import chunking, context, evidence
from docquarry.plans.registry import query


_TOKENS = r"""p AS (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '[^\s\p{Z}]+[\s\p{Z}]*') AS t FROM documents)"""
_JOIN = r"regexp_replace(array_to_string(t[{a} + 1:{b}], ''), '[\s\p{{Z}}]+$', '')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(f"""WITH {_TOKENS}, c AS (SELECT doc_id, t, len(t) AS n, unnest(range(0, len(t), 1536)) AS parent_start FROM p),
 d AS (SELECT doc_id, t, parent_start, least(parent_start + 1536, n) AS stop, unnest(range(parent_start, least(parent_start + 1536, n), 384)) AS child_start FROM c),
 e AS (SELECT doc_id, t, parent_start, child_start, least(child_start + 384, stop) AS child_stop FROM d)
 SELECT doc_id, parent_start, child_start, child_stop, md5({_JOIN.format(a='child_start', b='child_stop')}) AS text_md5 FROM e""")
def chunk_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.children(chunking.parents(chunking.prose(docs(spark, sf_dir))))
    return made.select(F.col("document_id").alias("doc_id"), *(F.col(c).cast("long").alias(c) for c in ("parent_start", "child_start", "child_stop")), F.md5("text").alias("text_md5"))


@query(f"""WITH {_TOKENS}, c AS (SELECT doc_id, t, len(t) AS n, unnest(range(0, len(t), 1536)) AS parent_start FROM p),
 d AS (SELECT doc_id, t, parent_start, least(parent_start + 1536, n) AS parent_stop FROM c)
 SELECT doc_id, parent_start, parent_stop, md5({_JOIN.format(a='parent_start', b='parent_stop')}) AS text_md5 FROM d""")
def chunk_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.parents(chunking.prose(docs(spark, sf_dir)))
    return made.select(F.col("document_id").alias("doc_id"), *(F.col(c).cast("long").alias(c) for c in ("parent_start", "parent_stop")), F.md5("parent_text").alias("text_md5"))


_ID = "substr(sha256(concat_ws(chr(31), {})), 1, 24)"


@query(f"""WITH {_TOKENS}, v AS (SELECT doc_id, t, substr(sha256(coalesce(text, '')), 1, 24) AS version FROM p JOIN documents USING (doc_id)),
 c AS (SELECT doc_id, version, unnest(range(0, len(t), 1536)) AS s FROM v)
 SELECT doc_id, s AS parent_start, {_ID.format("doc_id, version, '0', s")} AS parent_id FROM c""")
def passage_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.parents(chunking.prose(docs(spark, sf_dir)))
    return made.select(F.col("document_id").alias("doc_id"), F.col("parent_start").cast("long").alias("parent_start"), "parent_id")


@query("SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?m)^# (.*)$', 1), ''), 'doc-' || doc_id || '.md') AS title FROM documents")
def doc_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", document_title(F.col("text"), F.concat(F.lit("doc-"), "doc_id", F.lit(".md"))).alias("title"))


@query(r"SELECT doc_id, substr(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), 1, 240) AS excerpt FROM documents")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", excerpt(F.col("text")).alias("excerpt"))


@query(f"SELECT doc_id, {_ID.format('lang, source, doc_id')} AS id FROM documents")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", stable_id(F.col("lang"), F.col("source"), F.col("doc_id")).alias("id"))


# candidates for the folds: per language a ranking of documents, ten to a parent
_CANDIDATES = r"""c AS (SELECT lang AS query_id, row_number() OVER (PARTITION BY lang, doc_id // 60 ORDER BY n_chars % 97, doc_id) AS rank, doc_id // 60 AS part, 'p' || (doc_id % 23) AS parent_id,
 's' || (doc_id % 3) AS document_id, cast(n_chars % 400 AS int) AS cost, doc_id FROM documents)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    part = F.expr("doc_id div 60")
    by = Window.partitionBy("lang", part).orderBy(F.col("n_chars") % 97, "doc_id")
    return docs(spark, sf_dir).select(F.concat("lang", F.lit("-"), part).alias("query_id"), F.row_number().over(by).alias("rank"), F.concat(F.lit("p"), F.col("doc_id") % 23).alias("parent_id"),
                                      F.concat(F.lit("s"), F.col("doc_id") % 3).alias("document_id"), (F.col("n_chars") % 400).cast("int").alias("cost"), F.col("doc_id").cast("string").alias("chunk_id"))


@query(f"""WITH RECURSIVE {_CANDIDATES}, q AS (SELECT query_id || '-' || part AS query_id, rank, parent_id, cost FROM c),
 r AS (SELECT query_id, 0::BIGINT AS rank, '' AS parent_id, 0 AS cost, false AS admitted, 0 AS used, []::VARCHAR[] AS known FROM (SELECT DISTINCT query_id FROM q)
 UNION ALL SELECT q.query_id, q.rank, q.parent_id, q.cost, NOT list_contains(r.known, q.parent_id) AND r.used + q.cost <= 1000,
 CASE WHEN NOT list_contains(r.known, q.parent_id) AND r.used + q.cost <= 1000 THEN r.used + q.cost ELSE r.used END,
 CASE WHEN NOT list_contains(r.known, q.parent_id) AND r.used + q.cost <= 1000 THEN list_append(r.known, q.parent_id) ELSE r.known END
 FROM r JOIN q ON q.query_id = r.query_id AND q.rank = r.rank + 1)
 SELECT query_id, rank::INT AS rank, parent_id, cost, admitted, used FROM r WHERE rank > 0""")
def context_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.admit(candidates(spark, sf_dir), budget=1000).select("query_id", "rank", "parent_id", "cost", "admitted", "used")


_TAKE = "NOT list_contains(r.known, q.parent_id) AND r.used + q.cost <= 1000 AND list_extract(r.per, q.d) + q.cost <= 400"


@query(f"""WITH RECURSIVE {_CANDIDATES}, q AS (SELECT query_id || '-' || part AS query_id, rank, parent_id, document_id, doc_id % 3 + 1 AS d, cost FROM c),
 r AS (SELECT query_id, 0::BIGINT AS rank, '' AS parent_id, '' AS document_id, 0 AS cost, false AS admitted, 0 AS used, NULL::VARCHAR AS reason, []::VARCHAR[] AS known, [0, 0, 0] AS per FROM (SELECT DISTINCT query_id FROM q)
 UNION ALL SELECT q.query_id, q.rank, q.parent_id, q.document_id, q.cost, {_TAKE}, CASE WHEN {_TAKE} THEN r.used + q.cost ELSE r.used END,
 CASE WHEN list_contains(r.known, q.parent_id) THEN 'known' WHEN list_extract(r.per, q.d) + q.cost > 400 THEN 'document_token_budget' WHEN r.used + q.cost > 1000 THEN 'token_budget' END,
 CASE WHEN {_TAKE} THEN list_append(r.known, q.parent_id) ELSE r.known END,
 CASE WHEN {_TAKE} THEN list_transform(r.per, lambda x, i: CASE WHEN i = q.d THEN x + q.cost ELSE x END) ELSE r.per END
 FROM r JOIN q ON q.query_id = r.query_id AND q.rank = r.rank + 1)
 SELECT query_id, rank::INT AS rank, parent_id, document_id, cost, admitted, used, reason FROM r WHERE rank > 0""")
def context_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.admit(candidates(spark, sf_dir), budget=1000, per_document=400)


@query(f"""WITH RECURSIVE {_CANDIDATES}, q AS (SELECT query_id || '-' || part AS query_id, rank, parent_id, cost FROM c),
 r AS (SELECT query_id, 0::BIGINT AS rank, '' AS parent_id, 0 AS cost, 0 AS b, 0 AS size, NULL::INT AS batch FROM (SELECT DISTINCT query_id FROM q)
 UNION ALL SELECT query_id, rank, parent_id, cost, nb, CASE WHEN cost <= 350 AND nb < 8 THEN CASE WHEN nb > b THEN 0 ELSE size END + cost WHEN nb > b THEN 0 ELSE size END,
   CASE WHEN cost <= 350 AND nb < 8 THEN nb END FROM (
   SELECT q.query_id, q.rank, q.parent_id, q.cost, r.b, r.size, r.b + CASE WHEN q.cost <= 350 AND r.size > 0 AND r.size + q.cost > 350 THEN 1 ELSE 0 END AS nb
   FROM r JOIN q ON q.query_id = r.query_id AND q.rank = r.rank + 1))
 SELECT query_id, rank::INT AS rank, parent_id, cost, batch FROM r WHERE rank > 0""")
def coverage_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.batches(candidates(spark, sf_dir), budget=350, max_batches=8, order="rank")


@query(f"""WITH {_CANDIDATES}, q AS (SELECT query_id || '-' || part AS query_id, rank, parent_id, doc_id FROM c)
 SELECT query_id, parent_id, list_transform(list_sort(list({{'r': rank, 'd': doc_id}})), lambda x: cast(x.d AS VARCHAR)) AS chunk_ids, count(*) AS occurrences FROM q GROUP BY ALL""")
def evidence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir)
    return context.evidence(context.admit(rows, budget=1 << 30), rows).select("query_id", "parent_id", "chunk_ids", "occurrences")


@query("""WITH s AS (SELECT user_id, epoch_us(ts) // 600000000 AS a, epoch_us(ts) // 600000000 + event_id % 90 AS b FROM events),
 m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
 i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
 SELECT user_id, min(a) AS "start", max(b) AS "end", count(*) AS parts FROM i GROUP BY user_id, island""")
def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 600")
    spans = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", at.alias("start"), (at + F.col("event_id") % 90).alias("end"))
    return evidence.merge_spans(spans, ["user_id"])
