"""Queries on claims, verdicts, quotes and focus: claims are the events of each user, quotes stand in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import context, evidence
from docquarry.plans.passages import _CANDIDATES, candidates, docs
from docquarry.plans.registry import query

_STATES = ("SUPPORTED", "CONTRADICTED", "PARTIALLY_SUPPORTED", "UNSUPPORTED")
_CLAIMS = """c AS (SELECT user_id AS query_id, event_id AS claim_id, CASE WHEN event_type = 'error' THEN []::VARCHAR[] ELSE ['E' || event_id % 7, 'E' || event_id % 11] END AS ids FROM events),
 u AS (SELECT query_id, claim_id, unnest(ids) AS evidence_id, generate_subscripts(ids, 1) AS pos FROM c)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda n: F.concat(F.lit("E"), F.col("event_id") % n)
    ids = F.when(F.col("event_type") == "error", F.expr("cast(array() as array<string>)")).otherwise(F.array(named(7), named(11)))
    return events(spark, sf_dir).select(F.col("user_id").alias("query_id"), F.col("event_id").alias("claim_id"), F.col("event_id").alias("claim_order"), ids.alias("evidence_ids"))


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("user_id").alias("query_id"), F.concat(F.lit("E"), F.col("event_id") % 9).alias("evidence_id")).distinct()


@query(f"""WITH {_CLAIMS}, k AS (SELECT user_id AS query_id, list(DISTINCT 'E' || event_id % 9) AS known FROM events GROUP BY 1),
 v AS (SELECT query_id, claim_id, len(ids) > 0 AND list_has_all(known, ids) AS valid FROM c JOIN k USING (query_id))
 SELECT query_id, claim_id, valid, CASE WHEN valid AND claim_id % 5 <> 0 THEN {list(_STATES)}[claim_id % 4 + 1] ELSE 'UNSUPPORTED' END AS status FROM v""")
def verdict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*map(F.lit, _STATES))
    verdicts = events(spark, sf_dir).where("event_id % 5 <> 0").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("claim_id"), F.element_at(states, (F.col("event_id") % 4 + 1).cast("int")).alias("status"))
    return evidence.claim_verdicts(claims(spark, sf_dir), verdicts, known(spark, sf_dir)).select("query_id", "claim_id", "valid", "status")


@query(f"""WITH {_CLAIMS}, f AS (SELECT query_id, evidence_id, min({{'c': claim_id, 'p': pos}}) AS spot FROM u GROUP BY ALL)
 SELECT query_id, evidence_id, (row_number() OVER (PARTITION BY query_id ORDER BY spot))::INT AS position FROM f""")
def cited_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.cited_order(claims(spark, sf_dir))


@query(f"WITH {_CLAIMS} SELECT query_id, claim_id, evidence_id FROM u WHERE evidence_id NOT IN (SELECT 'E' || event_id % 9 FROM events)")
def unknown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.check_references(claims(spark, sf_dir), known(spark, sf_dir)).select("query_id", "claim_id", "evidence_id")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity > 10 AS a, l_returnflag <> 'R' AS b, l_linestatus = 'F' AS c, CASE WHEN l_linenumber > 1 THEN l_discount < 0.05 END AS d FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN NOT a THEN 'abstained' WHEN NOT b OR c OR NOT coalesce(d, true) THEN 'partial' ELSE 'answered' END AS status FROM f""")
def claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [F.col("l_quantity") > 10, F.col("l_returnflag") != "R", F.col("l_linestatus") == "F", F.when(F.col("l_linenumber") > 1, F.col("l_discount") < 0.05)]
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", evidence.final_status(*flags).alias("status"))


_COUNT = r"len(regexp_extract_all({}, '[^\s\p{{Z}}]+'))"


@query(f"""WITH RECURSIVE {_CANDIDATES}, q AS (SELECT query_id || '-' || part AS query_id, rank AS ord, 'E' || doc_id AS evidence_id, {_COUNT.format('text')} AS cost0,
   CASE WHEN {_COUNT.format('text')} > 350 THEN {_COUNT.format('substr(text, 1, 8000)')} ELSE {_COUNT.format('text')} END AS cost FROM c JOIN documents USING (doc_id)),
 r AS (SELECT query_id, 0::BIGINT AS ord, '' AS evidence_id, 0::BIGINT AS cost, 0 AS batch, 0::BIGINT AS size FROM (SELECT DISTINCT query_id FROM q)
 UNION ALL SELECT q.query_id, q.ord, q.evidence_id, q.cost, r.batch + (r.size > 0 AND r.size + q.cost0 > 350)::INT, CASE WHEN r.size > 0 AND r.size + q.cost0 > 350 THEN 0 ELSE r.size END + q.cost
 FROM r JOIN q ON q.query_id = r.query_id AND q.ord = r.ord + 1)
 SELECT query_id, ord::INT AS ord, evidence_id, cost::INT AS cost, batch FROM r WHERE ord > 0""")
def focus_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("excerpt"))
    rows = candidates(spark, sf_dir).join(texts, "chunk_id").select("query_id", F.col("rank").alias("ord"), F.concat(F.lit("E"), "chunk_id").alias("evidence_id"), "excerpt")
    return context.focus_batches(rows, budget=350)


_WORDS = r"list_filter(regexp_split_to_array({q}, '[\s\p{{Z}}]+'), lambda w: w <> '')"
_FOUND = r"regexp_extract({t}, '(?i)' || array_to_string(list_transform(" + _WORDS + r", lambda w: regexp_escape(w)), '[\s\p{{Z}}]+'))"


def _span(text: str, quote: str) -> str:
    """CTEs m (with column m, what stands in the text) over s (with columns text and quote)."""
    return f"m AS (SELECT *, CASE WHEN len({_WORDS.format(q=quote)}) > 0 THEN nullif({_FOUND.format(t=text, q=quote)}, '') END AS m FROM s)"


@query(f"""WITH s AS (SELECT doc_id, text, lower(substr(text, 11, 40)) AS quote FROM documents), {_span('text', 'quote')}
 SELECT doc_id, (strpos(text, m) - 1)::INT AS "start", (strpos(text, m) - 1 + length(m))::INT AS "end" FROM m""")
def literal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = docs(spark, sf_dir).withColumn("s", evidence.literal_span(F.col("text"), F.trim(F.lower(F.substring("text", 11, 40)))))
    return made.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


@query(f"""WITH p AS (SELECT doc_id, text, unnest([1, 2, 3]) AS ord FROM documents), s AS (SELECT doc_id, text, ord, CASE ord WHEN 2 THEN 'C2' ELSE 'C1' END AS claim, CASE ord WHEN 1 THEN substr(text, 1, 30) WHEN 2 THEN substr(text, 21, 30) ELSE substr(text, 81, 20) END AS quote FROM p),
 {_span('text', 'quote')}, a AS (SELECT doc_id, text, ord, claim, strpos(text, m) - 1 AS a, strpos(text, m) - 1 + length(m) AS b FROM m WHERE m IS NOT NULL),
 i AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a),
 j AS (SELECT *, sum((before IS NULL OR a > before)::INT) OVER (PARTITION BY doc_id ORDER BY a, b, ord ROWS UNBOUNDED PRECEDING) AS island FROM i),
 k AS (SELECT doc_id, island, claim, min({{'a': a, 'b': b, 'o': ord}}) AS spot FROM j GROUP BY ALL), l AS (SELECT doc_id, island, list(claim ORDER BY spot) AS claim_ids FROM k GROUP BY ALL),
 g AS (SELECT doc_id, island, min(a) AS a, max(b) AS b, any_value(text) AS text FROM j GROUP BY ALL)
 SELECT doc_id::VARCHAR AS evidence_id, a::INT AS "start", b::INT AS "end", substr(text, a + 1, b - a) AS quote, claim_ids FROM g JOIN l USING (doc_id, island)""")
def focus_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("evidence_id"), F.col("text").alias("excerpt"))
    part = lambda claim, at, n, ord_: F.struct(F.lit(claim).alias("claim_id"), F.substring("excerpt", at, n).alias("quote"), F.lit(ord_).alias("ord"))
    picked = rows.select("evidence_id", F.inline(F.array(part("C1", 1, 30, 1), part("C2", 21, 30, 2), part("C1", 81, 20, 3), part("C9", 1, 9, 4))))
    held = events(spark, sf_dir).select(F.concat(F.lit("C"), F.col("event_id") % 2 + 1).alias("claim_id")).distinct()
    return evidence.focus_spans(picked, rows, held)
