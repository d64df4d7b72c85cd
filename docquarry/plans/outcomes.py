"""Queries on what a run of questions came to: stages, hits, support, grading, the report. Rankings are those of evaluation.ranked()."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import evaluate as E
from docquarry.operators import reports as R
from docquarry.plans.evaluation import _RANKED, ranked
from docquarry.plans.passages import docs
from docquarry.plans.registry import query
from docquarry.plans.retrieval import _NORM, tokens_sql

# stages of a question: the first 30, of the first 40 those whose rank 3 does not divide, of the first 10 the same
_STAGES = {"dense": "rank <= 30", "pool": "rank <= 40 AND rank % 3 <> 0", "context": "rank <= 10 AND rank % 3 <> 0"}


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir).where("rank <= 40")
    parts = F.filter(F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in _STAGES.items())), lambda x: x.isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct("rank", "doc_id")))  # 40 at most
    return rows.withColumn("stage", F.explode(parts)).groupBy("query_id", "stage").agg(F.transform(ordered, lambda x: x["doc_id"]).alias("candidate_ids"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).where("relevant AND rank <= 50").select("query_id", F.col("doc_id").alias("candidate_id"))


_AT = ", ".join(f"CASE WHEN {rule} THEN (count(*) FILTER ({rule}) OVER (PARTITION BY query_id ORDER BY rank))::INT END AS {name}" for name, rule in _STAGES.items())


@query(f"WITH {_RANKED}, p AS (SELECT query_id, doc_id AS candidate_id, relevant, rank, {_AT} FROM r) SELECT query_id, candidate_id, dense, pool, context FROM p WHERE relevant AND rank <= 50")
def rank_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rank_movement(hits(spark, sf_dir), E.stage_positions(stages(spark, sf_dir)), list(_STAGES))


@query(f"""WITH {_RANKED} SELECT query_id, doc_id AS candidate_id, CASE WHEN {_STAGES['dense']} OR {_STAGES['pool']} THEN 'not_selected' ELSE 'not_retrieved' END AS reason
 FROM r WHERE relevant AND rank <= 50 AND NOT ({_STAGES['context']})""")
def missed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = E.stage_positions(stages(spark, sf_dir))
    return E.missed_hits(hits(spark, sf_dir), positions, positions.where("stage = 'context'"))


_FLAGS = {"hits": "l_linenumber % 2", "explicit_scope": "l_returnflag = 'R'", "scope_excludes": "l_linestatus = 'O'", "retrieved_relevant": "l_quantity > 25", "in_pool": "l_discount < 0.07", "in_context": "l_tax < 0.05",
          "evidence_has_answer": "l_partkey % 2 = 0", "answer_has_expected": "l_suppkey % 3 = 0", "abstained": "l_partkey % 5 = 0"}
_FAILURE = """CASE WHEN hits = 0 THEN 'benchmark_data_mismatch' WHEN explicit_scope AND scope_excludes AND NOT retrieved_relevant THEN 'document_resolution_failure' WHEN NOT in_pool THEN 'retrieval_failure'
 WHEN NOT in_context THEN 'selection_failure' WHEN evidence_has_answer AND NOT answer_has_expected THEN 'generation_failure' WHEN abstained THEN 'retrieval_failure' ELSE 'no_failure' END"""


@query(f"WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(f'{v} AS {k}' for k, v in _FLAGS.items())} FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, {_FAILURE} AS failure FROM f")
def failure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", E.failure_class(*map(F.expr, _FLAGS.values())).alias("failure"))


@query(f"""WITH {_RANKED}, t AS (SELECT query_id, rank, text FROM r JOIN documents USING (doc_id)), g AS (SELECT query_id, rank // 5 AS g, substr(text, 1, 12) AS phrase FROM t WHERE rank IN (5, 10, 15)),
 c AS (SELECT g.query_id, g.g, bool_or(contains(t.text, g.phrase)) AS covered FROM g JOIN t ON t.query_id = g.query_id AND t.rank <= 10 GROUP BY ALL)
 SELECT query_id, avg(covered::INT) AS evidence_recall, bool_and(covered) AS complete FROM c GROUP BY query_id""")
def evidence_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    groups = rows.where("rank in (5, 10, 15)").select("query_id", F.expr("cast(rank div 5 as int)").alias("phrase_group"), F.array(F.substring("text", 1, 12)).alias("phrases"))
    return E.evidence_recall(rows.select("query_id", "rank", "text"), groups)


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN doc_id % 2 = 0 ELSE contains(lower(answer), lower(substr(text, 1, 4))) AND contains(lower(answer), lower(source)) END AS ok
 FROM (SELECT *, text || CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE '' END AS answer FROM documents)""")
def answer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.upper("source")).otherwise(""))
    terms = F.when(F.col("doc_id") % 7 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.substring("text", 1, 4), F.col("source")))
    return docs(spark, sf_dir).select("doc_id", E.answer_contains(terms, answer, F.col("doc_id") % 2 == 0).alias("ok"))


_ASKS = "CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN source ELSE lang || ' Báse' END"


@query(f"""WITH n AS (SELECT doc_id, {_NORM.format(_ASKS)} AS w, {_NORM.format("upper(source) || '_final.md'")} AS x, {_NORM.format("lang || ' base ' || doc_id")} AS y FROM documents)
 SELECT doc_id, w <> '' AND ((x <> '' AND (contains(x, w) OR contains(w, x))) OR (y <> '' AND (contains(y, w) OR contains(w, y)))) AS ok FROM n""")
def source_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("source")).otherwise(F.concat("lang", F.lit(" Báse")))
    return docs(spark, sf_dir).select("doc_id", E.source_matches(wanted, F.concat(F.upper("source"), F.lit("_final.md")), F.concat("lang", F.lit(" base "), "doc_id")).alias("ok"))


@query("""SELECT l_orderkey, round((count(DISTINCT l_partkey) FILTER (l_quantity > 25) + count(DISTINCT l_returnflag) FILTER (l_quantity > 25))::DOUBLE / count(*), 4) AS rate FROM lineitem GROUP BY l_orderkey""")
def context_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, flag, much = F.col("l_partkey").cast("string"), F.col("l_returnflag"), F.col("l_quantity") > 25
    every = [F.collect_list(part).alias("h"), F.collect_list(F.when(much, part)).alias("c"), F.collect_list(flag).alias("hk"), F.collect_list(F.when(much, flag)).alias("ck"), F.count(F.lit(1)).alias("n")]  # one order's lines
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(*every)
    return rows.select("l_orderkey", E.context_hit_rate(*(F.col(c) for c in ("h", "c", "hk", "ck", "n"))).alias("rate"))


# questions: the first four words of each benchmark item, or its first two, every fourth of one source only; the corpus: all documents
_FOUR, _TWO = r"regexp_extract(text, '^(\S+ \S+ \S+ \S+)', 1)", r"regexp_extract(text, '^(\S+ \S+)', 1)"
_ASKED = f"""a AS (SELECT item_id, item_id::VARCHAR AS id, {_FOUR} AS e, [{_FOUR}, {_TWO}, '  ' || {_FOUR}] AS every, CASE WHEN item_id % 4 = 0 THEN 'src' || item_id % 5 END AS source_document FROM benchmark),
 v0 AS (SELECT id, source_document, trim(unnest(every)) AS variant, generate_subscripts(every, 1) AS pos FROM a), v1 AS (SELECT *, {_NORM.format('variant')} AS key FROM v0),
 v AS (SELECT id, key, any_value(source_document) AS source_document, arg_min(variant, pos) AS variant FROM v1 WHERE key <> '' GROUP BY id, key)"""


def _level(plain: str, key: str, variant: str) -> str:
    """How a variant without numbers is supported by a text whose normalized form is plain."""
    words = tokens_sql(variant)
    return f"CASE WHEN {plain} = '' THEN 'not_found' WHEN contains({plain}, {key}) THEN 'explicit' WHEN len({words}) > 0 AND len(list_filter({words}, lambda w: NOT contains({plain}, w))) = 0 THEN 'implicit' ELSE 'not_found' END"


_HITS = f"""{_ASKED}, d AS MATERIALIZED (SELECT doc_id, source || '.md' AS name, {_NORM.format("source || '.md'")} AS plain_name, {_NORM.format('text')} AS plain FROM documents),
 x AS (SELECT v.id, d.doc_id, d.name, {_level('d.plain', 'v.key', 'v.variant')} AS level FROM v, d
   WHERE v.source_document IS NULL OR contains(d.plain_name, {_NORM.format('v.source_document')}) OR contains({_NORM.format('v.source_document')}, d.plain_name)),
 h AS (SELECT id, doc_id, name, min(level) AS level FROM x WHERE level <> 'not_found' GROUP BY ALL)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    four, two = F.regexp_extract("text", r"^(\S+ \S+ \S+ \S+)", 1), F.regexp_extract("text", r"^(\S+ \S+)", 1)
    source = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("src"), F.col("item_id") % 5))
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("item_id").cast("string").alias("id"), four.alias("expected_answer"), F.array(two, F.concat(F.lit("  "), four)).alias("accepted_answers"), source.alias("source_document"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("candidate_id"), F.concat("source", F.lit(".md")).alias("document_name"), "text")


@query(f"WITH {_ASKED} SELECT id, variant FROM v")
def expected_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.expected_variants(asked(spark, sf_dir))


@query(f"WITH {_HITS} SELECT id, doc_id::VARCHAR AS candidate_id, name AS document_name, level FROM h")
def corpus_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.corpus_hits(asked(spark, sf_dir), R.expected_variants(asked(spark, sf_dir)), corpus(spark, sf_dir)).select("id", "candidate_id", "document_name", "level")


_RESULTS = f"""{_HITS}, n AS (SELECT id, count(*) AS hits, count(*) FILTER (doc_id % 2 = 0) AS pool, count(*) FILTER (doc_id % 4 = 0) AS ctx, min(level) FILTER (doc_id % 4 = 0) AS level FROM h GROUP BY id),
 s AS (SELECT id, bool_or({_level("(CASE WHEN item_id % 3 = 0 THEN " + _NORM.format('a.e') + " ELSE 'nothing' END)", 'v.key', 'v.variant')} <> 'not_found') AS said FROM a JOIN v USING (id) GROUP BY id),
 o AS (SELECT a.id, item_id, coalesce(hits, 0) AS hits, coalesce(pool, 0) AS pool, coalesce(ctx, 0) AS ctx, coalesce(level, 'not_found') AS evidence_level, coalesce(said, false) AS said, item_id % 5 = 0 AS abstained FROM a LEFT JOIN n USING (id) LEFT JOIN s USING (id)),
 g AS (SELECT *, CASE WHEN evidence_level = 'explicit' AND said THEN 'grounded' WHEN evidence_level <> 'not_found' THEN 'weakly_grounded' ELSE 'unsupported' END AS grounding, (item_id % 10)::DOUBLE / 10 AS score FROM o),
 q AS (SELECT id, hits, pool > 0 AS in_pool, ctx > 0 AS in_context, evidence_level, grounding, CASE WHEN abstained THEN 0.0::DOUBLE WHEN grounding = 'grounded' THEN least(1.0::DOUBLE, score + 0.2::DOUBLE) WHEN grounding = 'weakly_grounded' THEN least(1.0::DOUBLE, score + 0.05::DOUBLE)
   ELSE greatest(0.0::DOUBLE, score - 0.25::DOUBLE) END AS confidence, CASE WHEN hits > 0 THEN round(ctx::DOUBLE / hits, 4) ELSE 0.0::DOUBLE END AS context_hit_rate, abstained,
   CASE WHEN hits = 0 THEN 'benchmark_data_mismatch' WHEN item_id % 2 = 0 AND item_id % 7 = 0 AND NOT pool > 0 THEN 'document_resolution_failure' WHEN NOT pool > 0 THEN 'retrieval_failure' WHEN NOT ctx > 0 THEN 'selection_failure'
   WHEN evidence_level <> 'not_found' AND NOT said THEN 'generation_failure' WHEN abstained THEN 'retrieval_failure' ELSE 'no_failure' END AS failure FROM g)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = asked(spark, sf_dir)
    found = R.corpus_hits(questions, R.expected_variants(questions), corpus(spark, sf_dir))
    number = F.col("candidate_id").cast("long")
    parts = F.filter(F.array(F.when(number % 2 == 0, F.lit("candidate_pool")), F.when(number % 4 == 0, F.lit("selected_context"))), lambda x: x.isNotNull())
    staged = found.select("id", "candidate_id", F.explode(parts).alias("stage")).groupBy(F.col("id").alias("query_id"), "stage").agg(F.collect_set("candidate_id").alias("candidate_ids"))
    item = F.col("item_id")
    answers = questions.select("id", F.when(item % 3 == 0, F.col("expected_answer")).otherwise("nothing").alias("answer"), (item % 5 == 0).alias("abstained"), (item % 10 / 10).alias("evidence_score"), (item % 2 == 0).alias("explicit_scope"), (item % 7 == 0).alias("scope_excludes"))
    return R.question_results(questions, found, staged, answers, corpus(spark, sf_dir))


@query(f"WITH {_RESULTS} SELECT id, hits, in_pool, in_context, evidence_level, grounding, round(confidence, 6) AS confidence, context_hit_rate, failure FROM q")
def question_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).drop("abstained").withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {_RESULTS} SELECT unnest(['# Evaluation', 'Questions: ' || count(*), 'Passed: ' || count(*) FILTER (failure = 'no_failure'), 'Abstained: ' || count(*) FILTER (abstained) || ' (' || round(100 * avg(abstained::INT), 2) || '%)', '| id | failure | grounding | confidence |']) AS line FROM q
 UNION ALL SELECT '| ' || id || ' | ' || failure || ' | ' || grounding || ' | ' || printf('%.2f', confidence) || ' |' FROM q""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.report_lines(results(spark, sf_dir)).select("line")


_GRADES = {"s": ("graded", "error"), "c": (*R.CORRECTNESS, "great"), "g": (*R.GROUNDING, "none"), "f": (*R.FAILURES, "other"), "e": (*R.SUPPORT, "maybe")}
_PICK = {"s": "l_linenumber % 7 = 0", "c": "l_partkey % 4", "g": "l_suppkey % 4", "f": "l_orderkey % 7", "e": "(l_orderkey + l_partkey) % 4"}


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 7 <> 0 AND l_partkey % 4 <> 3 AND l_suppkey % 4 <> 3 AND l_orderkey % 7 <> 6 AND (l_orderkey + l_partkey) % 4 <> 3 AND coalesce(CASE WHEN l_tax > 0 THEN l_discount * 12 END BETWEEN 0 AND 1, false)
 THEN 'graded' ELSE 'fallback' END AS status FROM lineitem""")
def grading_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = [F.element_at(F.array(*map(F.lit, _GRADES[k])), (F.expr(f"cast({_PICK[k]} as int)") + 1)) for k in "scgfe"]
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", R.checked_grading(*pick, F.when(F.col("l_tax") > 0, F.col("l_discount") * 12)).alias("status"))


@query("""WITH h AS (SELECT doc_id, text, substr(text, 1, 60) AS head FROM documents), l AS (SELECT *, 60 - strpos(reverse(head), ' ') AS last FROM h)
 SELECT doc_id, CASE WHEN length(text) <= 60 THEN text WHEN contains(head, ' ') AND last > 48 THEN left(head, last) || ' [...truncated]' ELSE trim(head) || ' [...truncated]' END AS cut FROM l""")
def cut_at_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", R.cut_at_word(F.col("text"), 60).alias("cut"))


@query(r"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '**MODO ' || upper(lang) || '**' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Para sair do modo use /x' WHEN 1 THEN text || chr(10) || 'para SAIR do modo z' ELSE '  ' || text END AS t FROM documents)
 SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(trim(t), '^\*\*[A-ZÁÉÍÓÚÀÃÕÂÊÔ ]+\*\*\s*\n+', ''), '(?is)\n+Para sair do modo.*$', ''), '^\s+|\s+$', '', 'g')) AS clean_md5 FROM t""")
def clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 3
    text = F.when(kind == 0, F.concat(F.lit("**MODO "), F.upper("lang"), F.lit("**\n\n"), "text", F.lit("\n\nPara sair do modo use /x"))).when(kind == 1, F.concat("text", F.lit("\npara SAIR do modo z"))).otherwise(F.concat(F.lit("  "), "text"))
    return docs(spark, sf_dir).select("doc_id", F.md5(R.clean_answer(text)).alias("clean_md5"))


@query("SELECT l_orderkey AS id FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING bool_and(coalesce(p_size < 40, false))")
def runnable_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda c: F.concat(F.lit("p"), c)
    cases = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(named("l_partkey")).alias("documents"))  # one order's lines
    return R.runnable(cases, spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size < 40").select(named("p_partkey").alias("document_name"))).select("id")


@query("""SELECT l.doc_id AS candidate_id, CASE WHEN l.doc_id % 3 = 0 AND d.doc_id IS NOT NULL THEN 'new-' || l.doc_id WHEN l.doc_id % 2 = 0 THEN d.source END AS document_name FROM labels l LEFT JOIN documents d USING (doc_id)""")
def candidate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("candidate_id"))
    rows = docs(spark, sf_dir).withColumnRenamed("doc_id", "candidate_id")
    catalog = rows.where("candidate_id % 3 = 0").select("candidate_id", F.concat(F.lit("new-"), "candidate_id").alias("document_name"), "text")
    return R.lookup_candidates(ids, catalog, rows.where("candidate_id % 2 = 0").select("candidate_id", F.col("source").alias("document_name"), "text")).select("candidate_id", "document_name")


@query("""WITH m AS (SELECT l_orderkey AS query_id, l_partkey::VARCHAR AS c, min({'h': l_linenumber, 'r': l_suppkey, 'c': l_partkey::VARCHAR}) AS spot FROM lineitem GROUP BY ALL) SELECT query_id, list(c ORDER BY spot) AS candidate_ids FROM m GROUP BY query_id""")
def pool_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return R.pool_union(rows.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("hop"), F.col("l_suppkey").alias("rank"), F.col("l_partkey").cast("string").alias("chunk_id")))


@query("SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN [text, role] ELSE [role] END AS queries FROM conversations")
def query_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("  "), "text", F.lit(" "))).otherwise("another question")
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", R.query_list(F.col("text"), original, F.array("role", "role")).alias("queries"))


@query(f"""WITH g AS (SELECT 0 AS grp, * FROM documents WHERE n_chars % 3 = 0 UNION ALL SELECT 1, * FROM documents WHERE n_chars % 2 = 0 UNION ALL SELECT 2, * FROM documents),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, doc_id % 50, substr({_NORM.format('text')}, 1, 500) ORDER BY grp, doc_id) AS nth FROM g)
 SELECT lang AS id, doc_id AS ord, doc_id % 50 AS candidate_id, source AS document_name, ['explicit', 'implicit', 'listed'][grp + 1] AS level FROM r WHERE nth = 1""")
def merged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping groups of hits as one list, copies of a text under one candidate once."""
    rows = docs(spark, sf_dir).select(F.col("lang").alias("id"), F.col("doc_id").alias("ord"), (F.col("doc_id") % 50).alias("candidate_id"), F.col("source").alias("document_name"), F.lit("section").alias("chunk_kind"), F.col("text").alias("excerpt"), "n_chars")
    groups = [rows.where(rule).withColumn("level", F.lit(name)) for name, rule in (("explicit", "n_chars % 3 = 0"), ("implicit", "n_chars % 2 = 0"), ("listed", "true"))]
    return E.merge_hits(*groups).select("id", "ord", "candidate_id", "document_name", "level")
