"""An evaluation run as one job: questions in, a judged row for each and counters out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.answer import Answerer, Answers
from docquarry.operators import evaluate, reports
from docquarry.scratch import materialize


@dataclass(frozen=True)
class BenchmarkRun:
    answers: Answers
    results: DataFrame
    counters: DataFrame
    failures: DataFrame


def stages_of(answers: Answers) -> DataFrame:
    """query_id, stage, candidate_ids: what each question's searches brought (candidate_pool), and what entered its context (selected_context)."""
    pool = answers.trace.groupBy(F.col("question_id").alias("query_id")).agg(F.array_sort(F.collect_set("chunk_id")).alias("candidate_ids")).withColumn("stage", F.lit("candidate_pool"))
    chosen = answers.evidence.select(F.col("question_id").alias("query_id"), F.explode("chunk_ids").alias("c")).groupBy("query_id").agg(F.array_sort(F.collect_set("c")).alias("candidate_ids"))
    return pool.unionByName(chosen.withColumn("stage", F.lit("selected_context"))).select("query_id", "stage", "candidate_ids")


def run(answerer: Answerer, questions: DataFrame, corpus: DataFrame, in_tasks: bool = True) -> BenchmarkRun:
    """questions: id, question, expected_answer, accepted_answers, source_document, and optionally history; corpus: candidate_id (the chunk), document_id, document_name, text.

    All questions run in one frontier. A question that fails is judged as one that abstained. Where an explicit scope leaves out every document that the named
    source fits, scope_excludes is true.
    """
    asked = questions.select(F.col("id").alias("question_id"), "question", *(["history"] if "history" in questions.columns else []))
    answers = answerer.ask_all(asked, in_tasks)
    hits = materialize(reports.corpus_hits(questions, reports.expected_variants(questions), corpus), "benchmark-hits")
    named = corpus.select("document_id", "document_name").distinct()
    sources = questions.select("source_document").where("source_document <> ''").distinct()
    fits = reports.fitting_names(named.select("document_name").distinct(), sources).join(named, "document_name").select("source_document", "document_id")
    scoped = answers.questions.where("scope IS NOT NULL").select(F.col("question_id").alias("id"), F.explode("scope").alias("document_id"))
    inside = scoped.join(questions.select("id", "source_document"), "id").join(fits, ["source_document", "document_id"]).select("id").distinct().withColumn("inside", F.lit(True))
    score = answers.trace.groupBy(F.col("question_id").alias("id")).agg(F.max("rerank_score").alias("evidence_score"))
    ended = answers.questions.select(F.col("question_id").alias("id"), "answer", F.col("status").isin("abstained", "failed").alias("abstained"), F.col("scope").isNotNull().alias("explicit_scope"))
    ended = ended.join(score, "id", "left").join(inside, "id", "left").join(questions.select("id", "source_document"), "id")
    ended = ended.select("id", F.coalesce("answer", F.lit("")).alias("answer"), "abstained", F.coalesce("evidence_score", F.lit(0.0)).alias("evidence_score"), "explicit_scope",
                         (F.col("explicit_scope") & (F.coalesce("source_document", F.lit("")) != "") & F.col("inside").isNull()).alias("scope_excludes"))
    results = materialize(reports.question_results(questions, hits, stages_of(answers), ended, corpus), "benchmark-results")
    return BenchmarkRun(answers, results, evaluate.run_counters(results), evaluate.failure_counts(results))
