"""Queries that run whole jobs: questions answered together, an import after another, a store of sidecars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import importing
from docquarry.answer import Answerer, Collection, Settings
from docquarry.boundary import RuleModel
from docquarry.operators import building
from docquarry.operators import retrieval as R
from docquarry.operators.chunking import token_count
from docquarry.plans.passages import docs
from docquarry.plans.registry import query
from docquarry.plans.retrieval import _RANK, _SPARSE_RANK, QUESTIONS, tokens_sql, vectors
from docquarry.scratch import materialize, scratch_dir
from docquarry.sources import files

_WIDTH = 64


def _first_axis(texts: list[str]) -> list[list[float]]:
    """Every question's vector is the first axis, so that SQL can say what comes nearest."""
    return [[1.0] + [0.0] * (_WIDTH - 1) for _ in texts]


def _every_second(role: str, payload: dict) -> dict:
    """A model that claims something of every passage, finds every second claim unsupported, and leaves these out when asked again."""
    if role == "plan":
        return {"intent": "single_fact", "queries": []}
    if role == "reason":
        return {"sufficient": True}
    if role == "answer":
        ids = [e["evidence_id"] for e in payload["evidence"]]
        return {"claims": [{"text": f"as {e} says", "evidence_ids": [e]} for e in (ids[::2] if payload.get("draft") else ids)]}
    if role == "verify":
        odd = lambda c: int(c["evidence_ids"][0][1:]) % 2
        return {"verdicts": [{"claim_id": c["claim_id"], "status": "SUPPORTED" if odd(c) else "UNSUPPORTED"} for c in payload["claims"]], "central_supported": True}
    return {"selections": []}


_RUN = f"""c AS (SELECT vec_id::VARCHAR AS chunk_id, d.text, embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS score FROM embeddings JOIN documents d ON d.doc_id = vec_id),
 a AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 20 = 0), dr AS (SELECT query_id, chunk_id, {_RANK.format('score')} AS rank FROM a, c),
 w AS (SELECT chunk_id, unnest({tokens_sql('text')}) AS token FROM c), p AS (SELECT token, chunk_id, 1 + ln(count(*)) AS weight FROM w GROUP BY ALL),
 qw AS (SELECT query_id, unnest({tokens_sql('query')}) AS token FROM a), q AS (SELECT query_id, token, 1 + ln(count(*)) AS weight FROM qw GROUP BY ALL),
 sp AS (SELECT query_id, chunk_id, sum(p.weight * q.weight) AS score FROM p JOIN q USING (token) GROUP BY ALL), {_SPARSE_RANK},
 f AS (SELECT coalesce(d.query_id, x.query_id) AS query_id, coalesce(d.chunk_id, x.chunk_id) AS chunk_id, coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + x.rank), 0) AS rrf_score
   FROM (SELECT * FROM dr WHERE rank <= 30) d FULL JOIN (SELECT * FROM sr WHERE rank <= 30) x ON d.query_id = x.query_id AND d.chunk_id = x.chunk_id),
 fr AS (SELECT *, {_RANK.format('rrf_score')} AS rank FROM f),
 k AS (SELECT fr.query_id, fr.chunk_id, round(len(list_intersect(list_distinct({tokens_sql('a.query')}), list_distinct({tokens_sql('c.text')}))) / greatest(len(list_distinct({tokens_sql('a.query')})), 1)::DOUBLE, 9) AS score
   FROM fr JOIN c USING (chunk_id) JOIN a USING (query_id) WHERE rank <= 30), kr AS (SELECT *, {_RANK.format('score')} AS r FROM k)"""


@query(f"WITH {_RUN} SELECT query_id AS item_id, 'B0C' || ((r + 1) // 2) AS claim_id, 'E' || r AS evidence_id, chunk_id, 'answered' AS status, 'evidence_sufficient' AS stop_reason, 1 AS hops, true AS repaired FROM kr WHERE r % 2 = 1")
def question_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth item as a question to all documents with a vector, in one frontier: search, admission, claims, verdicts, one repair."""
    texts = docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")
    chunks = vectors(spark, sf_dir).drop("label").join(texts, "chunk_id").select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("chunk_id").cast("string").alias("parent_id"), F.col("chunk_id").cast("string").alias("document_id"), "text", "embedding")
    chunks = materialize(chunks, "run-chunks")  # joined once; passages, postings and every search read them
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where(F.col("item_id") % QUESTIONS == 0).select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    terms = R.question_terms(asked.select(F.col("question_id").alias("query_id"), F.col("question").alias("query")))
    parents = materialize(chunks.select("parent_id", "text", token_count(F.col("text")).alias("cost")), "run-parents")
    collection = Collection(chunks, parents, materialize(R.postings(chunks, tokens=terms), "run-postings"), chunks.select("document_id"))
    scorer = lambda q, t: F.round(R.token_overlap(q, t), 9)
    done = Answerer(spark, collection, RuleModel(_every_second), _first_axis, scorer, Settings(context_tokens=1 << 30)).ask_all(asked)
    said = done.claims.where("accepted").select("question_id", "claim_id", F.explode("evidence_ids").alias("evidence_id"))
    rows = said.join(done.evidence.select("question_id", "evidence_id", "parent_id"), ["question_id", "evidence_id"]).join(done.questions.select("question_id", "status", "stop_reason", "hops", "repaired"), "question_id")
    return rows.select(F.col("question_id").alias("item_id"), "claim_id", "evidence_id", F.col("parent_id").alias("chunk_id"), "status", "stop_reason", "hops", "repaired")


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS nth FROM documents WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0),
 free AS (SELECT i, row_number() OVER (ORDER BY i) AS nth FROM range(1, (SELECT 2 * count(*) + 2 FROM documents)) r(i) WHERE i > (SELECT count(*) FROM a)),
 s AS (SELECT doc_id, n AS number, CASE WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'cached' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END AS said FROM a WHERE doc_id % 7 <> 0
   UNION ALL SELECT b.doc_id, free.i, 'new', 'second' FROM b JOIN free USING (nth))
 SELECT s.doc_id, status, CASE WHEN number < 10 THEN '0' ELSE '' END || number || '_file_' || s.doc_id || '.md' AS output_file, md5('# file ' || s.doc_id || '.txt' || chr(10) || chr(10) || 'Extraction method: plain' || chr(10) || chr(10) || said || ' ' || d.text_md5 || chr(10)) AS body_md5
 FROM s JOIN (SELECT doc_id, md5(text) AS text_md5 FROM documents) d USING (doc_id)""")
def import_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two imports, one after the other: of the second listing some files are new, some changed, and some that the first had are gone."""
    folder = f"{scratch_dir(spark)}/imports-{uuid.uuid4().hex}"
    rows = docs(spark, sf_dir).select("doc_id", F.md5("text").alias("text_md5"))
    listing = lambda df, signature: df.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("file "), "doc_id", F.lit(".txt")).alias("name"), signature.alias("signature"), F.col("doc_id").alias("ord"))
    said = lambda word: lambda todo: todo.join(rows.select(F.col("doc_id").cast("string").alias("id"), "text_md5"), "id").select("id", F.concat(F.lit(f"{word} "), "text_md5").alias("text"))
    importing.run_import(listing(rows.where("doc_id % 5 <> 0"), F.col("text_md5")), folder, said("first"), "plain")
    now = F.when(F.col("doc_id") % 3 == 0, F.concat("text_md5", F.lit("+"))).otherwise(F.col("text_md5"))
    done = importing.run_import(listing(rows.where("doc_id % 7 <> 0"), now), folder, said("second"), "plain")
    bodies = importing.documents(spark, folder)
    return done.files.join(bodies, "output_file").select(F.col("id").cast("long").alias("doc_id"), "status", "output_file", F.md5("text").alias("body_md5"))


@query("""SELECT doc_id, sha256(text) AS markdown_sha256, CASE WHEN doc_id % 3 = 0 THEN ['again', source] ELSE [lang, source] END AS sections FROM documents WHERE doc_id % 3 <> 1""")
def sidecar_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars of all documents; then new ones of a third, and none any more of another."""
    path = f"{scratch_dir(spark)}/sidecars-{uuid.uuid4().hex}"
    rows = docs(spark, sf_dir).select(F.concat("doc_id", F.lit(".md")).alias("relative_path"), "text", F.array("lang", "source").alias("sections"), (F.col("doc_id") % 3).alias("third"), "source")
    files.save_sidecars(rows, path)
    files.save_sidecars(rows.where("third < 2").withColumn("sections", F.when(F.col("third") == 0, F.array(F.lit("again"), F.col("source"))).otherwise(F.array().cast("array<string>"))), path)
    kept = files.load_state(spark, path, "relative_path string, markdown_sha256 string, sections array<string>")
    return kept.select(F.regexp_extract("relative_path", "^([0-9]+)", 1).cast("long").alias("doc_id"), "markdown_sha256", "sections")


_ROW = "'Spreadsheet file f | Sheet S | Row 2: Key=' || md5(text) || ' | Lang=' || lang"


@query(rf"""WITH s AS (SELECT doc_id, 0 AS sec, CASE WHEN doc_id % 3 = 0 THEN 'Head' ELSE 'Part' END AS title, replace(text, '#', '+') AS body FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT doc_id, 1, '', lang FROM documents WHERE doc_id % 3 = 1),
 p AS (SELECT doc_id, sec, title, regexp_extract_all(regexp_replace(body, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '[^\s\p{{Z}}]+[\s\p{{Z}}]*') AS t FROM s),
 c AS (SELECT doc_id, sec, title, t, len(t) AS n, unnest(range(0, len(t), 120)) AS parent_start FROM p),
 d AS (SELECT *, least(parent_start + 120, n) AS stop, unnest(range(parent_start, least(parent_start + 120, n), 50)) AS child_start FROM c),
 e AS (SELECT *, least(child_start + 50, stop) AS child_stop FROM d),
 x AS (SELECT doc_id, sec, title, 'section_detail' AS chunk_kind, parent_start, child_start, CASE WHEN title = '' THEN '' ELSE title || chr(10) END || regexp_replace(array_to_string(t[child_start + 1:child_stop], ''), '[\s\p{{Z}}]+$', '') AS text FROM e
   UNION ALL SELECT doc_id, 0, '', 'summary', 0, 0, 'Document type: Spreadsheet' FROM documents WHERE doc_id % 3 = 2 UNION ALL SELECT doc_id, 1, 'S', 'row_record', 0, 0, 'S' || chr(10) || {_ROW} FROM documents WHERE doc_id % 3 = 2)
 SELECT doc_id, title, chunk_kind, (row_number() OVER (PARTITION BY doc_id ORDER BY sec, parent_start, child_start) - 1)::INT AS chunk_order, parent_start::INT AS parent_start, child_start::INT AS child_start, md5(text) AS text_md5 FROM x""")
def mixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the one builder: a third under a heading, a third with a sidecar, a third as records of a spreadsheet."""
    third, body = F.col("doc_id") % 3, F.replace(F.col("text"), F.lit("#"), F.lit("+"))
    lines = F.concat_ws("\n", F.lit("x"), F.lit("Document type: Spreadsheet"), F.lit("## Sheet: S"), F.lit("Row records:"), F.concat(F.lit("- Spreadsheet file f | Sheet S | Row 2: Key="), F.md5("text"), F.lit(" | Lang="), "lang"))
    section = lambda title, text: F.struct(F.lit(title).alias("title"), text.alias("text"), F.lit(None).cast("string").alias("provenance"))
    rows = docs(spark, sf_dir).select(F.concat("doc_id", F.lit(".md")).alias("relative_path"), F.col("source").alias("source"), F.lit(0).alias("collection_order"),
                                      F.when(third == 0, F.concat(F.lit("# Head\n"), body)).when(third == 1, body).otherwise(lines).alias("text"),
                                      F.when(third == 1, F.array(section("Part", body), section("", F.col("lang")))).alias("sections"))
    made = building.build_chunks(rows, 120, 50)
    return made.select(F.regexp_extract("relative_path", "^([0-9]+)", 1).cast("long").alias("doc_id"), "title", "chunk_kind", F.col("chunk_order").cast("int").alias("chunk_order"), "parent_start", "child_start", F.md5("text").alias("text_md5"))
