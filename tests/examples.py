"""Worked examples: operators on a few written-out rows, with the rows that they must give as VALUES."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import numbers as N
from docquarry.functions import text as T
from docquarry.functions import urls as U
from docquarry.operators import chunking, context, evidence, ingest, sessions, spreadsheet, tables, web
from docquarry.operators import evaluate as E
from docquarry.operators import reports as R

EXAMPLES: dict[str, tuple[Callable, str]] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        EXAMPLES[f.__name__] = (f, sql)
        return f

    return add


_STAGES = [("q1", "dense", ["a", "b", "c", "a"]), ("q1", "pool", ["b", "c", "d"]), ("q1", "context", ["d"]), ("q2", "dense", ["z"])]
_HITS = [("q1", "a"), ("q1", "d"), ("q1", "e"), ("q2", "y"), ("q1", "a")]


def stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_STAGES, "query_id string, stage string, candidate_ids array<string>")


def hits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_HITS, "query_id string, candidate_id string")


@query("SELECT * FROM (VALUES ('q1', 'a', 4, NULL, NULL), ('q1', 'd', NULL, 3, 1), ('q1', 'e', NULL, NULL, NULL), ('q2', 'y', NULL, NULL, NULL)) t(query_id, candidate_id, dense, pool, context)")
def rank_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rank_movement(hits(spark), E.stage_positions(stages(spark)), ["dense", "pool", "context"])


@query("SELECT * FROM (VALUES ('q1', 'a', 'not_selected'), ('q1', 'e', 'not_retrieved'), ('q2', 'y', 'not_retrieved')) t(query_id, candidate_id, reason)")
def missed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = spark.createDataFrame([("q1", "d")], "query_id string, candidate_id string")
    return E.missed_hits(hits(spark), E.stage_positions(stages(spark)), selected)


_FLAGS = ("hits", "explicit_scope", "scope_excludes", "retrieved_relevant", "in_pool", "in_context", "evidence_has_answer", "answer_has_expected", "abstained")


@query("""SELECT *, CASE WHEN hits = 0 THEN 'benchmark_data_mismatch' WHEN explicit_scope AND scope_excludes AND NOT retrieved_relevant THEN 'document_resolution_failure' WHEN NOT in_pool THEN 'retrieval_failure'
 WHEN NOT in_context THEN 'selection_failure' WHEN evidence_has_answer AND NOT answer_has_expected THEN 'generation_failure' WHEN abstained THEN 'retrieval_failure' ELSE 'no_failure' END AS failure
 FROM (SELECT i % 2 AS hits, (i // 2) % 2 = 1 AS explicit_scope, (i // 4) % 2 = 1 AS scope_excludes, (i // 8) % 2 = 1 AS retrieved_relevant, (i // 16) % 2 = 1 AS in_pool, (i // 32) % 2 = 1 AS in_context,
 (i // 64) % 2 = 1 AS evidence_has_answer, (i // 128) % 2 = 1 AS answer_has_expected, (i // 256) % 2 = 1 AS abstained FROM range(512) t(i))""")
def failure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda n: F.expr(f"(id div {2**n}) % 2")
    rows = spark.range(512).select(bit(0).alias("hits"), *((bit(n) == 1).alias(name) for n, name in enumerate(_FLAGS) if n))
    return rows.withColumn("failure", E.failure_class(*(F.col(c) for c in _FLAGS)))


@query("SELECT query_id, r::DOUBLE AS evidence_recall, complete FROM (VALUES ('q1', 0.5, false), ('q2', 1.0, true), ('q3', 0.0, false)) t(query_id, r, complete)")
def evidence_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.createDataFrame([("q1", 1, "alpha beta"), ("q1", 2, "gamma"), ("q1", 11, "delta"), ("q2", 1, "x y")], "query_id string, rank int, text string")
    groups = spark.createDataFrame([("q1", 1, ["beta", "zeta"]), ("q1", 2, ["delta"]), ("q2", 1, ["y"]), ("q3", 1, ["y"])], "query_id string, phrase_group int, phrases array<string>")
    return E.evidence_recall(found, groups)


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, false)) t(k, ok)")
def answer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, ["Ana", "10"], "ana tem 10", False), (2, ["Rui"], "ana", False), (3, [], "", True), (4, [], "algo", False)], "k int, terms array<string>, answer string, abstained boolean")
    return rows.select("k", E.answer_contains(F.col("terms"), F.col("answer"), F.col("abstained")).alias("ok"))


@query("SELECT * FROM (VALUES (1, true), (2, true), (3, false), (4, false)) t(k, ok)")
def source_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "Relatório 2024.pdf", "relatorio 2024 pdf"), (2, "relatório", "01_Relatório final.md"), (3, "x", "y"), (4, "", "y")], "k int, source string, name string")
    return rows.select("k", E.source_matches(F.col("source"), F.col("name"), F.lit(None).cast("string")).alias("ok"))


@query("SELECT k, r::DOUBLE AS rate FROM (VALUES (1, 0.6667), (2, 0.0), (3, 1.0)) t(k, r)")
def context_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, ["a", "b"], ["a"], ["k"], ["k", "m"], 3), (2, ["a"], [], ["k"], [], 0), (3, ["a"], ["a"], [], [], 1)], "k int, h array<string>, c array<string>, hk array<string>, ck array<string>, n int")
    return rows.select("k", E.context_hit_rate(*(F.col(c) for c in ("h", "c", "hk", "ck", "n"))).alias("rate"))


_QUESTIONS = [("1", "Ana Souza", ["ana souza", "A. Souza"], None), ("2", "R$ 5.500,00", [], "budget.md"), ("3", "blue", [], None), ("4", "red house", [], None)]
_CORPUS = [("c1", "team.md", "Coordinator: Ana Souza"), ("c2", "budget.md", "Total R$ 5.500,00"), ("c3", "other.md", "Total 5500,00 R$ 5.500,00"), ("c4", "house.md", "the house is red")]


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_QUESTIONS, "id string, expected_answer string, accepted_answers array<string>, source_document string")


def corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CORPUS, "candidate_id string, document_name string, text string")


@query("SELECT * FROM (VALUES ('1', 'Ana Souza'), ('1', 'A. Souza'), ('2', 'R$ 5.500,00'), ('3', 'blue'), ('4', 'red house')) t(id, variant)")
def expected_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.expected_variants(asked(spark))


@query("SELECT * FROM (VALUES ('1', 'c1', 'explicit'), ('2', 'c2', 'explicit'), ('4', 'c4', 'implicit')) t(id, candidate_id, level)")
def corpus_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.corpus_hits(asked(spark), R.expected_variants(asked(spark)), corpus(spark)).select("id", "candidate_id", "level")


def results(spark: SparkSession) -> DataFrame:
    hits = R.corpus_hits(asked(spark), R.expected_variants(asked(spark)), corpus(spark))
    staged = [("1", "candidate_pool", ["c1", "c2"]), ("1", "selected_context", ["c1"]), ("2", "candidate_pool", ["c2"]), ("2", "selected_context", ["c3"]), ("4", "candidate_pool", ["c4"]), ("4", "selected_context", ["c4"])]
    answers = [("1", "It is Ana Souza.", False, 0.6, False, False), ("2", "none", False, 0.5, False, False), ("3", "", True, None, False, False), ("4", "a green one", False, 0.1, False, False)]
    return R.question_results(asked(spark), hits, spark.createDataFrame(staged, "query_id string, stage string, candidate_ids array<string>"),
                              spark.createDataFrame(answers, "id string, answer string, abstained boolean, evidence_score double, explicit_scope boolean, scope_excludes boolean"), corpus(spark))


@query("""SELECT id, hits::BIGINT AS hits, in_pool, in_context, evidence_level, grounding, confidence::DOUBLE AS confidence, context_hit_rate::DOUBLE AS context_hit_rate, failure FROM (VALUES ('1', 1, true, true, 'explicit', 'grounded', 0.8, 1.0, 'no_failure'), ('2', 1, true, false, 'not_found', 'unsupported', 0.25, 0.0, 'selection_failure'),
 ('3', 0, false, false, 'not_found', 'unsupported', 0.0, 0.0, 'benchmark_data_mismatch'), ('4', 1, true, true, 'implicit', 'weakly_grounded', 0.15, 1.0, 'generation_failure')) t(id, hits, in_pool, in_context, evidence_level, grounding, confidence, context_hit_rate, failure)""")
def question_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark).drop("abstained")


@query("""SELECT * FROM (VALUES ('# Evaluation'), ('Questions: 4'), ('Passed: 1'), ('Abstained: 1 (25.0%)'), ('| id | failure | grounding | confidence |'), ('| 1 | no_failure | grounded | 0.80 |'), ('| 2 | selection_failure | unsupported | 0.25 |'),
 ('| 3 | benchmark_data_mismatch | unsupported | 0.00 |'), ('| 4 | generation_failure | weakly_grounded | 0.15 |')) t(line)""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.report_lines(results(spark)).select("line")


@query("SELECT * FROM (VALUES (1, 'graded'), (2, 'fallback'), (3, 'fallback'), (4, 'fallback'), (5, 'fallback')) t(k, status)")
def grading_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "graded", "correct", "grounded", "no_failure", "explicit", 0.5), (2, "graded", "great", "grounded", "no_failure", "explicit", 0.5), (3, "graded", "correct", "grounded", "no_failure", "explicit", 1.5), (4, "error", "correct", "grounded", "no_failure", "explicit", 0.5), (5, "graded", "correct", "grounded", "no_failure", "explicit", None)]
    made = spark.createDataFrame(rows, "k int, s string, c string, g string, f string, e string, p double")
    return made.select("k", R.checked_grading(*(F.col(c) for c in ("s", "c", "g", "f", "e", "p"))).alias("status"))


@query("SELECT * FROM (VALUES (1, 'short'), (2, 'aaaa bbbb [...truncated]'), (3, 'aaaaaaaaaa [...truncated]')) t(k, cut)")
def cut_at_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "short"), (2, "aaaa bbbb cc"), (3, "aaaaaaaaaaaaaa b")], "k int, t string")
    return rows.select("k", R.cut_at_word(F.col("t"), 10).alias("cut"))


@query("SELECT * FROM (VALUES (1, 'text'), (2, 'plain **X** y'), (3, 'a')) t(k, clean)")
def clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "**MODO CONSULTA**\n\ntext\n\nPara sair do modo use /x"), (2, " plain **X** y "), (3, "a\n\npara SAIR do modo\nz")], "k int, t string")
    return rows.select("k", R.clean_answer(F.col("t")).alias("clean"))


@query("SELECT * FROM (VALUES (1), (3)) t(id)")
def runnable_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([(1, ["a"]), (2, ["a", "z"]), (3, [])], "id int, documents array<string>")
    return R.runnable(cases, spark.createDataFrame([("a",), ("b",)], "document_name string")).select("id")


@query("SELECT * FROM (VALUES ('c1', 'new.md'), ('c2', 'budget.md'), ('zz', NULL)) t(candidate_id, document_name)")
def candidate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([("c1",), ("c2",), ("zz",)], "candidate_id string")
    catalog = spark.createDataFrame([("c1", "new.md", "t")], "candidate_id string, document_name string, text string")
    return R.lookup_candidates(ids, catalog, corpus(spark)).select("candidate_id", "document_name")


@query("SELECT * FROM (VALUES ('q', ['a', 'c', 'b'])) t(query_id, candidate_ids)")
def pool_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pool_union(spark.createDataFrame([("q", 1, 2, "c"), ("q", 2, 1, "b"), ("q", 1, 1, "a"), ("q", 2, 2, "a")], "query_id string, hop int, rank int, chunk_id string"))


@query("SELECT * FROM (VALUES (1, ['What is  it', 'b']), (2, ['b']), (3, ['x'])) t(k, queries)")
def query_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "What is  it", "what is it", ["b", "What is  it"]), (2, "x", "y", ["b", "b"]), (3, "x", "y", [])], "k int, r string, o string, p array<string>")
    return rows.select("k", R.query_list(F.col("r"), F.col("o"), F.col("p")).alias("queries"))


_HEADED = "a\n# T1\nx\n\n##\nT2\ny z\n### T3\n\n# T4 \nlast  "


@query("""SELECT * FROM (VALUES (1, 0, '', 'a', 0, 2), (1, 1, 'T1', 'x', 6, 10), (1, 2, 'T2', 'y z', 15, 20), (1, 3, 'T4 ', 'last', 33, 40),
 (2, 0, '', 'plain text', 0, 10)) t(doc, section_index, title, body, text_start, text_end)""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, _HEADED), (2, "plain text"), (3, "# only a heading\n"), (4, None)], "doc int, text string")
    return chunking.sections(rows)


@query("""SELECT * FROM (VALUES ('q', 1, 'E1', 3, 0), ('q', 2, 'E2', 2, 0), ('q', 3, 'E3', 4, 1), ('q', 4, 'E4', 7, 2), ('q', 5, 'E5', 1, 3)) t(query_id, ord, evidence_id, cost, batch)""")
def focus_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("q", 1, "E1", "a b c"), ("q", 2, "E2", "d e"), ("q", 3, "E3", "f g h i"), ("q", 4, "E4", "1 2 3 4 5 6 7"), ("q", 5, "E5", "z")]
    return context.focus_batches(spark.createDataFrame(rows, "query_id string, ord int, evidence_id string, excerpt string"), budget=5)


@query("""SELECT * FROM (VALUES (1, 8, 36), (2, 0, 5), (3, NULL, NULL), (4, NULL, NULL), (5, 4, 11), (6, 2, 5)) t(k, "start", "end")""")
def literal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "Before. The budget is\n one thousand. After", "The budget is one thousand.  "), (2, "Alpha beta", "ALPHA"), (3, "Alpha beta", "gamma"), (4, "Alpha", "  "), (5, "say a.b (c) now", "a.B (C)"), (6, "x été y", "ÉtÉ ")]
    made = spark.createDataFrame(rows, "k int, text string, quote string").withColumn("s", evidence.literal_span(F.col("text"), F.trim("quote")))
    return made.select("k", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


@query("""SELECT * FROM (VALUES ('E1', 0, 19, 'alpha beta gamma de', ['C1', 'C2']), ('E1', 24, 27, 'eps', ['C2']), ('E2', 5, 10, 'other', ['C1'])) t(evidence_id, "start", "end", quote, claim_ids)""")
def focus_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = [("C1", "E1", "Alpha  beta gamma", 1), ("C2", "E1", "gamma de", 2), ("C2", "E1", "eps", 3), ("C9", "E1", "alpha", 4), ("C1", "E9", "alpha", 5), ("C1", "E2", "other", 6), ("C1", "E2", "missing", 7)]
    return evidence.focus_spans(
        spark.createDataFrame(picked, "claim_id string, evidence_id string, quote string, ord int"),
        spark.createDataFrame([("E1", "alpha beta gamma delta  eps"), ("E2", "some other text")], "evidence_id string, excerpt string"),
        spark.createDataFrame([("C1",), ("C2",)], "claim_id string"))


_CLAIMS = [("q1", "B0C1", 1, ["E1", "E2"]), ("q1", "B0C2", 2, ["E2"]), ("q1", "B0C3", 3, []), ("q1", "B0C4", 4, ["E9"]), ("q2", "B0C1", 1, ["E1"]), ("q2", "B0C2", 2, ["E1"])]
_VERDICTS = [("q1", "B0C1", "SUPPORTED"), ("q1", "B0C2", "CONTRADICTED"), ("q1", "B0C3", "SUPPORTED"), ("q1", "B0C4", "SUPPORTED"), ("q2", "B0C1", "PARTIALLY_SUPPORTED")]


def claims(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CLAIMS, "query_id string, claim_id string, claim_order int, evidence_ids array<string>")


@query("""SELECT * FROM (VALUES ('q1', 'B0C1', true, 'SUPPORTED'), ('q1', 'B0C2', true, 'CONTRADICTED'), ('q1', 'B0C3', false, 'UNSUPPORTED'), ('q1', 'B0C4', false, 'UNSUPPORTED'),
 ('q2', 'B0C1', true, 'PARTIALLY_SUPPORTED'), ('q2', 'B0C2', true, 'UNSUPPORTED')) t(query_id, claim_id, valid, status)""")
def verdict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("q1", "E1"), ("q1", "E2"), ("q2", "E1")], "query_id string, evidence_id string")
    verdicts = spark.createDataFrame(_VERDICTS, "query_id string, claim_id string, status string")
    return evidence.claim_verdicts(claims(spark), verdicts, known).select("query_id", "claim_id", "valid", "status")


@query("""SELECT * FROM (VALUES ('q1', 'E1', 1), ('q1', 'E2', 2), ('q1', 'E9', 3), ('q2', 'E1', 1)) t(query_id, evidence_id, position)""")
def cited_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.cited_order(claims(spark))


@query("""SELECT * FROM (VALUES ('q1', 'E9')) t(query_id, evidence_id)""")
def unknown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("E1",), ("E2",)], "evidence_id string")
    return evidence.check_references(claims(spark), known).select("query_id", "evidence_id")


@query("""SELECT a, b, c, d, CASE WHEN NOT a THEN 'abstained' WHEN NOT b OR c OR NOT coalesce(d, true) THEN 'partial' ELSE 'answered' END AS status
 FROM (VALUES (true), (false)) t1(a), (VALUES (true), (false)) t2(b), (VALUES (true), (false)) t3(c), (VALUES (true), (false), (NULL)) t4(d)""")
def claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    two, three = [True, False], [True, False, None]
    rows = [(a, b, c, d) for a in two for b in two for c in two for d in three]
    made = spark.createDataFrame(rows, "a boolean, b boolean, c boolean, d boolean")
    return made.withColumn("status", evidence.final_status(*(F.col(x) for x in "abcd")))


@query("""SELECT * FROM (VALUES (1, 1, 'Name'), (1, 2, 'Column_2'), (1, 3, 'Name_2'), (1, 4, 'a b'), (1, 5, 'Name_3'), (2, 1, 'Column_1'), (2, 2, 'Column_2')) t(sheet, "index", header)""")
def header_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, 1, "Name"), (1, 2, ""), (1, 3, " Name "), (1, 4, "a  b"), (1, 5, "Name"), (2, 1, None), (2, 2, " ")]
    return tables.unique_headers(spark.createDataFrame(rows, "sheet int, index int, raw_header string"), ["sheet"]).select("sheet", "index", "header")


@query("""SELECT sheet, row_number, pairs, o::BIGINT AS omitted_rows FROM (VALUES ('S', 2, ['a=1', 'c=3'], 0), ('S', 3, ['a=4'], 0)) t(sheet, row_number, pairs, o)""")
def sheet_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = [("S", 1, ["", ""]), ("S", 2, ["a", "b", "c"]), ("S", 5, ["1", "", "3"]), ("S", 6, ["", "", ""]), ("S", 9, ["4"])]
    made = tables.build_sheet(spark.createDataFrame(raw, "sheet string, physical int, cells array<string>"))
    pairs = F.array_sort(F.transform(F.map_entries("row_values"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return made.select("sheet", "row_number", pairs.alias("pairs"), "omitted_rows")


_SHEET = """# budget.xlsx
Extraction method: spreadsheet
Total sheets: 1

## Sheet: Team
Spreadsheet file: budget.xlsx
Data rows indexed: 3

Column profiles:
- Pay: numeric count=2, sum=3, min=1, max=2

People index:
- Person: Ana Souza | Role: Analista | Sheet: Team | Row: 2
- Role: nobody

Row records:
- Spreadsheet file budget.xlsx | Sheet Team | Row 2: Name=Ana Souza | Cargo=Analista | Pay=1
- Spreadsheet file budget.xlsx | Sheet Team | Row 3: Name=Rui Costa | Pay=2 | Cargo=Gestor | Pay=9
- Spreadsheet file budget.xlsx | Sheet Team | Row 4: Name=Total | Pay=3
"""


def sheet_lines(spark: SparkSession) -> DataFrame:
    return spreadsheet.parse_lines(spark.createDataFrame([("d1", _SHEET)], "document_id string, text string"))


@query("""SELECT kind, n::BIGINT AS n FROM (VALUES ('summary', 2), ('sheet_summary', 2), ('column_profile', 1), ('people_index', 2), ('row_record', 3)) t(kind, n)""")
def sheet_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet_lines(spark).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT * FROM (VALUES ('Ana Souza', 'Analista', 'Team', 2), ('Rui Costa', 'Gestor', 'Team', 3)) t(name, role, sheet, row_number)""")
def sheet_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spreadsheet.people(sheet_lines(spark)).select("name", "role", "sheet", "row_number")


@query("""SELECT * FROM (VALUES (2, ['Cargo=Analista', 'Name=Ana Souza', 'Pay=1']), (3, ['Cargo=Gestor', 'Name=Rui Costa', 'Pay=9']), (4, ['Name=Total', 'Pay=3'])) t(row_number, cells)""")
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spreadsheet.chunks(sheet_lines(spark)).where("kind = 'row_record'")
    return made.select("row_number", F.array_sort(F.transform(F.map_entries("row_values"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("cells"))


@query("""SELECT * FROM (VALUES (0, 'summary', NULL), (1, 'sheet_summary', NULL), (2, 'column_profile', NULL), (3, 'people_index', 'Ana Souza'), (4, 'people_index', 'Rui Costa'),
 (5, 'row_record', 'Ana Souza'), (6, 'row_record', 'Rui Costa'), (7, 'row_record', NULL)) t(chunk_order, kind, entity_name)""")
def sheet_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spreadsheet.chunks(sheet_lines(spark)).select("chunk_order", "kind", "entity_name")


@query("""SELECT kind, n::BIGINT AS n FROM (VALUES ('summary', 0), ('sheet_summary', 3), ('column_profile', 1), ('people_index', 1), ('row_record', 2)) t(kind, n) WHERE n > 0""")
def sheet_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rendered spreadsheet document, read back by the parser."""
    rows = spark.createDataFrame([("S", 2, [("Name", "Ana Souza"), ("Pay", "1")]), ("S", 3, [("Name", "Total")])], "sheet string, row_number int, pairs array<struct<header:string,value:string>>")
    profiles = spark.createDataFrame([("S", 1, "Pay: numeric count=2")], "sheet string, ord int, line string")
    who = spark.createDataFrame([("S", 2, "Ana Souza", None)], "sheet string, row_number int, name string, role string")
    lines = spreadsheet.render_document(rows, profiles, who, "f.xlsx")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet", "part", "ord", "line"))), lambda x: x["line"]), "\n")  # one small document
    whole = lines.agg(F.concat(F.lit("# f.xlsx\n"), text).alias("text")).select(F.lit("d").alias("document_id"), "text")
    return spreadsheet.parse_lines(whole).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT * FROM (VALUES (1, 'https://a.org/x'), (2, 'https://a.org/'), (3, NULL), (4, 'http://A.org/b'), (5, 'https://docs.a.org/')) t(k, url)""")
def url_edge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, " a.org/x/?q=1#f "), (2, "https://a.org"), (3, "https:///x"), (4, "http://A.org/b//"), (5, "docs.a.org")]
    return spark.createDataFrame(rows, "k int, raw string").select("k", U.normalize_url(F.col("raw")).alias("url"))


_VOTES = [("https://a.org/x", "https://a.org/docs/1"), ("https://a.org/x", "https://a.org/docs/2"), ("https://a.org/x", "https://docs.a.org/z"), ("https://a.org/x", "https://b.org/docs/1"), ("https://a.org/x", "https://a.org/help/docs/3"), ("https://a.org/x", "https://a.org/help/4"), ("https://a.org/x", "https://a.org/plain")]


@query("SELECT page, root, votes::BIGINT AS votes FROM (VALUES (1, 'https://a.org/docs', 2), (2, 'https://a.org/help', 1)) t(page, root, votes)")
def root_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, *v) for v in _VOTES] + [(2, "https://a.org/x", "https://a.org/help/x"), (2, "https://a.org/x", "https://a.org/learn/x")]
    return web.root_vote(spark.createDataFrame(rows, "page int, base string, target string"))


@query("SELECT * FROM (VALUES (1, ['__root__', 'alpha', 'Beta'], ['__root__', 'alpha'], ['alpha', 'Beta']), (2, ['b'], ['b', 'Beta'], ['b'])) t(k, names, toggled, kept)")
def selection_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, [" Beta", "alpha", "", "__root__", "Beta"], ["alpha", "Beta"]), (2, ["b", "b "], ["b"])], "k int, raw array<string>, available array<string>")
    names = sessions.normalize_selection(F.col("raw"))
    return rows.select("k", names.alias("names"), sessions.toggle_selection(names, F.lit("Beta")).alias("toggled"), sessions.available_selection(F.col("raw"), F.col("available")).alias("kept"))


_TURNS = [(1, 1, "quais pdfs existem"), (1, 2, "e quais sao"), (1, 3, "liste os arquivos da base"), (1, 4, "qual o prazo do contrato"), (1, 5, "de qual pasta vieram"), (1, 6, "qual extrator foi usado"), (1, 7, "mostre as imagens"), (1, 8, "quantas planilhas"), (1, 9, "os nomes")]


def asked_turns(spark: SparkSession) -> DataFrame:
    made = spark.createDataFrame(_TURNS, "conv_id int, turn int, text string").withColumn("intent", sessions.collection_intent(F.col("text")))
    return sessions.with_follow_ups(made)


@query("""SELECT * FROM (VALUES (1, 'pdfs', 'pdfs'), (2, NULL, 'pdfs'), (3, 'files', 'files'), (4, NULL, NULL), (5, 'folder', 'folder'), (6, 'extractor', 'extractor'), (7, 'images', 'images'), (8, 'spreadsheets', 'spreadsheets'), (9, NULL, 'spreadsheets')) t(turn, intent, resolved)""")
def collection_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked_turns(spark).select("turn", "intent", "resolved")


@query("""SELECT * FROM (VALUES (1, 1, 'a.pdf'), (2, 1, 'a.pdf'), (3, 3, 'a.pdf'), (3, 3, 'b.csv'), (3, 3, 'c.csv'), (7, 0, NULL), (8, 2, 'b.csv'), (8, 2, 'c.csv'), (9, 2, 'b.csv'), (9, 2, 'c.csv')) t(turn, files, name)""")
def inventory_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame([("c.csv", "spreadsheet"), ("a.pdf", "pdf"), ("b.csv", "spreadsheet")], "name string, kind string")
    return sessions.inventory_answer(asked_turns(spark), files).select("turn", "files", "name")


@query("""SELECT * FROM (VALUES (2, 7), (0, 1), (0, 1), (0, 3)) t(sessions, next_id)""")
def stored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ['{"sessions": [{"id": "chat_1"}, {"id": "chat_2"}], "next_chat_session_id": 7}', "not json", '{"next_chat_session_id": -4}', '{"sessions": null, "next_chat_session_id": 3}']
    return sessions.read_state(spark.createDataFrame([(r,) for r in rows], "value string")).select(F.size("sessions").alias("sessions"), "next_id")


@query("""SELECT * FROM (VALUES ('1', 'download', NULL, '.pdf'), ('2', 'download', NULL, '.docx'), ('3', 'export', 'image/png', '.png'), ('5', 'download', NULL, '.jpeg')) t(id, mode, export_mime, suffix)""")
def file_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("1", "a", "application/pdf"), ("2", "b.DOCX", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), ("3", "c.x", "application/vnd.google-apps.drawing"), ("4", "d.zip", "application/zip"), ("5", "e.JPEG", "IMAGE/JPEG"), ("6", "f", None)]
    return ingest.file_plans(spark.createDataFrame(rows, "id string, name string, mime_type string")).select("id", "mode", "export_mime", "suffix")


@query("""SELECT * FROM (VALUES (1, ['^/docs$', '^/docs/.*$']), (2, ['^/a/b$', '^/a/b/.*$']), (3, NULL), (4, ['^/$', '^//.*$'])) t(k, paths)""")
def include_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "https://a.org/docs/x"), (2, "https://a.org/a/b/"), (3, "https://a.org/"), (4, "https://docs.a.org/x")]
    return spark.createDataFrame(rows, "k int, url string").select("k", U.include_paths(F.col("url")).alias("paths"))


@query("SELECT 18 AS next_id")
def next_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.next_session_id(spark.createDataFrame([("chat_3",), ("chat_17",), ("other_99",), ("chat_x",)], "id string"))


_NUMBERS = ["1.234,56", "1,234.56", "1.234", "1,234", "0.125", "5%", "R$ 10,00", "abc", "", "-7", "1.234.567", "12,5", "R$ 5.500,00", "1,234,567"]


@query("""SELECT raw, table_value::DOUBLE AS table_value, profile_value::DOUBLE AS profile_value, evidence_value FROM (VALUES ('1.234,56', 1234.56, 1234.56, '1234.56'), ('1,234.56', 1.23456, 1234.56, '1234.56'), ('1.234', 1.234, 1.234, '1234'), ('1,234', 1.234, 1.234, '1234'),
 ('0.125', 0.125, 0.125, '125'), ('5%', NULL, 5, '5'), ('R$ 10,00', 10, 10, '10'), ('abc', NULL, NULL, NULL), ('', NULL, NULL, NULL), ('-7', -7, -7, '-7'),
 ('1.234.567', NULL, NULL, '1234567'), ('12,5', 12.5, 12.5, '12.5'), ('R$ 5.500,00', 5500, 5500, '5500'), ('1,234,567', NULL, NULL, NULL)) t(raw, table_value, profile_value, evidence_value)""")
def number_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three readings side by side; the table reading is the lenient one here, since it stops on what is no number."""
    rows = spark.createDataFrame([(x,) for x in _NUMBERS], "raw string")
    return rows.select("raw", N.table_text(F.col("raw")).try_cast(N.MONEY).cast("double").alias("table_value"), N.profile_number(F.col("raw")).alias("profile_value"), N.evidence_number(F.col("raw")).alias("evidence_value"))


_TEXTS = [(1, "Paid R$ 5.500,00 on 03/04/24, then 12,5% of 1.000 in 2023-7-9"), (2, "no values"), (3, "v1.2 x3 -4 and 4 and 4,0; RS 10 rs 7"), (4, None), (5, "a 31-12-1999 b 7% 7 %")]


@query("""SELECT * FROM (VALUES (1, ['1000', '12.5', '2023', '24', '3', '4', '5500', '7', '9']::VARCHAR[], ['12.5']::VARCHAR[], ['5500']::VARCHAR[], ['2023-07-09', '2024-04-03']::VARCHAR[]),
 (2, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], []::VARCHAR[]),
 (3, ['-4', '10', '2', '4', '7']::VARCHAR[], []::VARCHAR[], ['10', '7']::VARCHAR[], []::VARCHAR[]),
 (4, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], []::VARCHAR[]),
 (5, ['12', '1999', '31', '7']::VARCHAR[], ['7']::VARCHAR[], []::VARCHAR[], ['1999-12-31']::VARCHAR[])) t(k, numbers, percents, amounts, dates)""")
def values_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return spark.createDataFrame(_TEXTS, "k int, text string").select("k", N.numbers_in(t).alias("numbers"), N.percentages_in(t).alias("percents"), N.currencies_in(t).alias("amounts"), N.dates_in(t).alias("dates"))


_SUPPORT = [(1, "O valor foi R$ 5.500,00 no contrato", "5500,00"), (2, "O valor foi R$ 5.400,00", "5500,00"), (3, "Coordenação Geral", "coordenacao geral"), (4, "geral da coordenação", "coordenação geral"), (5, "", "x"), (6, "prazo 10 dias úteis", "10 dias"), (7, "taxa de 12,5%", "12,5%"), (8, "início 03/04/2024", "2024-04-03"), (9, "outra coisa", "")]


@query("""SELECT * FROM (VALUES (1, 'implicit'), (2, 'not_found'), (3, 'explicit'), (4, 'implicit'), (5, 'not_found'), (6, 'explicit'), (7, 'explicit'), (8, 'implicit'), (9, 'not_found')) t(k, level)""")
def support_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_SUPPORT, "k int, text string, variant string")
    return rows.select("k", E.support_level(F.col("text"), F.col("variant")).alias("level"))


_PEOPLE = [(1, "Maria da Silva", True), (2, "MARIA SILVA", False), (3, "Total geral", False), (4, "Ana 2", False), (5, "RH direto bolsas", False), (6, "Ana", False), (7, "José Álvares", True), (8, "Nome", False), (9, None, False)]


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, false), (5, false), (6, false), (7, true), (8, false), (9, false)) t(k, person)")
def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_PEOPLE, "k int, value string, want boolean").select("k", T.is_person_name(F.col("value")).alias("person"))


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, false), (5, true), (6, false)) t(k, role)")
def role_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "Coordenador"), (2, "12,5"), (3, "2024-01-02 Analista"), (4, "UFC"), (5, "Analista de Sistemas II"), (6, "")]
    return spark.createDataFrame(rows, "k int, value string").select("k", T.is_role(F.col("value")).alias("role"))


@query("SELECT * FROM (VALUES (1, 'héé'), (2, 'olé'), (3, 'café')) t(k, text)")
def decode_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, bytearray("﻿héé".encode())), (2, bytearray("olé".encode())), (3, bytearray("café".encode("latin-1")))]
    return spark.createDataFrame(rows, "k int, content binary").select("k", T.decode_with_fallback(F.col("content")).alias("text"))
