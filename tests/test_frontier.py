"""Many questions at once: each ends as it would alone, and the trace is that of a plain search."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docquarry.answer import Answerer, Settings, load
from docquarry.boundary import HashEncoder, RuleModel, overlap_reranker
from docquarry.operators import context

TEXTS = [("a1", "a", "pa1", "atlas project code zx741 lake"), ("a2", "a", "pa2", "atlas project atlas project schedule"), ("a3", "a", "pa3", "atlas project atlas project staff list"), ("b1", "b", "pb1", "zx741 financed by aurora fund"), ("b2", "b", "pb2", "atlas summary of aurora fund")]


def rule(role, payload):
    """Replies by what the question says."""
    q = payload.get("question", "")
    if role == "plan":
        plan = {"intent": "single_fact", "queries": []}
        if "hello" in q:
            return {"intent": "casual", "reply": "hi " + str(len(payload["history"]))}
        if "which" in q:
            return {"intent": "single_fact", "ambiguous": True, "clarification": "which one"}
        if "nowhere" in q:
            return plan | {"document_ids": ["zz"]}
        if "empty" in q:
            return plan | {"document_ids": []}
        if "both" in q:
            return plan | {"document_ids": ["a", "b"]}
        if "summary" in q:
            return plan | {"intent": "summary", "document_ids": ["a", "b"] if "pair" in q else None}
        return plan | {"requires_multi_hop": "single" not in q}
    if role == "reason":
        if "broken" in q:
            raise RuntimeError("no model")
        facts = [{"text": "x", "evidence_ids": ["E9" if "invented" in q else "E1"]}]
        return {"sufficient": len(payload["evidence"]) > 1, "established_facts": facts}
    if role == "research":
        return {"queries": [q if "repeat" in q else "zx741 financed"]}
    if role == "answer":
        ids = [e["evidence_id"] for e in payload["evidence"]]
        if "unknown" in q:
            return {"claims": [{"text": "Made up.", "evidence_ids": ["E999"]}]}
        if "mended" in q:
            return {"claims": [{"text": "Good.", "evidence_ids": ids[:1]}] + ([] if payload.get("draft") else [{"text": "Bad.", "evidence_ids": ids[:1]}])}
        return {"claims": [{"text": f"About {' '.join(ids)}.", "evidence_ids": ids}, {"text": "Same in every batch.", "evidence_ids": ids[:1]}]}
    if role == "verify":
        return {"verdicts": [{"claim_id": c["claim_id"], "status": "UNSUPPORTED" if c["text"] == "Bad." else "SUPPORTED"} for c in payload["claims"]], "central_supported": True}
    if any("blurred" in c["text"] for s in payload["sources"] for c in s["claims"]):
        raise RuntimeError("no focus")
    return {"selections": [{"claim_id": s["claims"][0]["claim_id"], "evidence_id": s["evidence_id"], "quote": "FINANCED  by aurora"} for s in payload["sources"]]}


def focus_fails(role, payload):
    if role == "focus":
        raise RuntimeError("no focus")
    return rule(role, payload)


QUESTIONS = {1: "atlas lake two hops", 2: "unknown atlas", 3: "repeat atlas", 4: "which atlas", 5: "hello", 6: "nowhere atlas", 7: "both atlas project", 8: "summary atlas", 9: "broken atlas", 10: "invented atlas", 11: "single atlas", 12: "mended atlas lake", 13: "empty atlas", 14: "summary pair atlas", 15: "qqq www"}


@pytest.fixture(scope="module")
def collection(spark):
    rows = [(c, d, p, t, t) for c, d, p, t in TEXTS]
    return load(spark, spark.createDataFrame(rows, "chunk_id string, document_id string, parent_id string, parent_text string, text string"), HashEncoder())


def answerer(spark, collection, model, **settings):
    encode = lambda texts: HashEncoder().encode(texts)[0]
    return Answerer(spark, collection, RuleModel(model), encode, overlap_reranker, Settings(search_k=1, rerank_k=1, child_tokens=5, parent_tokens=8, **settings))


@pytest.fixture(scope="module")
def got(spark, collection):
    turns = [{"role": "user", "content": str(k)} for k in range(8)]
    df = spark.createDataFrame([(k, q, turns if k == 5 else None) for k, q in QUESTIONS.items()], "question_id long, question string, history array<map<string,string>>")
    return answerer(spark, collection, rule, context_tokens=10).ask_all(df)


def test_every_question_ends_as_it_should(got):
    done = {r["question_id"]: r for r in got.questions.collect()}
    assert len(done) == len(QUESTIONS)
    ends = {k: (r["status"], r["stop_reason"], r["hops"]) for k, r in done.items()}
    assert ends[1] == ("answered", "evidence_sufficient", 2)
    assert ends[2][0] == "abstained" and done[2]["repaired"]
    assert ends[3][1:] == ("repeated_query", 1)
    assert ends[4] == ("clarify", "ambiguous", 0) and done[4]["answer"] == "which one"
    assert ends[5] == ("answered", "casual", 0) and done[5]["answer"] == "hi 6"
    assert ends[6][0] == "failed" and "unknown documents" in done[6]["error"]
    assert ends[9][0] == "failed" and "no model" in done[9]["error"]
    assert ends[10][0] == "failed" and "unknown evidence" in done[10]["error"]
    assert ends[11][1:] == ("single_pass", 1)
    assert done[12]["repaired"] and ends[12][0] == "answered" and done[12]["answer"].startswith("Good.") and "Bad" not in done[12]["answer"]
    assert ends[13] == ("abstained", "insufficient_scope", 0)
    assert done[1]["queries"] == ["atlas lake two hops", "zx741 financed"]


def test_both_documents_give_evidence_where_one_dominates(got):
    rows = [r for r in got.evidence.collect() if r["question_id"] == 7]
    assert {r["document_id"] for r in rows} == {"a", "b"}
    searched = [r for r in got.trace.collect() if r["question_id"] == 7 and r["hop"] == 1]
    assert sorted(r["document_id"] for r in searched) == ["a", "b"] and all(r["quota"] == 5 for r in searched)


def test_broad_questions_read_their_scope_in_batches(got):
    for k in (8, 14):
        claims = [r for r in got.claims.collect() if r["question_id"] == k]
        batches = sorted({r["batch"] for r in claims})
        assert len(batches) == 3 and {e for r in claims for e in r["evidence_ids"]} == {f"E{j}" for j in range(1, 6)}
        assert sum(r["accepted"] for r in claims if r["text"].startswith("Same")) == 1  # a claim counts once
        assert sum(r["accepted"] for r in claims) == 4


def test_focus_is_literal_and_leaves_the_answer(spark, collection, got):
    focus = {(r["question_id"], r["evidence_id"]): r["status"] for r in got.focus.collect()}
    spans = [r for r in got.spans.collect() if r["question_id"] == 1]
    assert [(r["evidence_id"], r["quote"], r["claim_ids"]) for r in spans] == [("E2", "financed by aurora", ["B0C1"])]
    assert focus[1, "E2"] == "focused" and focus[1, "E1"] == "fallback"
    df = spark.createDataFrame([(1, QUESTIONS[1])], "question_id long, question string")
    other = answerer(spark, collection, focus_fails, context_tokens=10).ask_all(df)
    assert {r["status"] for r in other.focus.collect()} == {"unavailable"} and other.spans.count() == 0
    assert other.questions.first()["answer"] == next(r["answer"] for r in got.questions.collect() if r["question_id"] == 1)


def plain_search(query, within=None):
    """The best chunk of a query, by the definitions."""
    pool = [t for t in TEXTS if within in (None, t[1])]
    unit = lambda text: [x / math.sqrt(sum(y * y for y in v)) for v in HashEncoder().encode([text])[0] for x in v]
    weight = lambda text: {w: 1 + math.log(n) for w, n in Counter(text.split()).items()}
    dense = {c: sum(x * y for x, y in zip(unit(query), unit(t), strict=True)) for c, _, _, t in pool}
    asked = weight(query)
    sparse = {c: sum(w * weight(t).get(k, 0) for k, w in asked.items()) for c, _, _, t in pool}
    best = lambda scores: [c for c, s in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))][:1]
    first, second = best(dense), best({c: s for c, s in sparse.items() if s > 0})
    rrf = Counter()
    for c in first + second:
        rrf[c] += 1 / 61
    c = min(rrf, key=lambda c: (-rrf[c], c))
    return c, 1 if c in first else None, 1 if c in second else None, round(rrf[c], 9)


def test_trace_of_two_hops(got):
    trace = sorted((r["hop"], r["part"], r["chunk_id"], r["dense_rank"], r["sparse_rank"], round(r["rrf_score"], 9)) for r in got.trace.collect() if r["question_id"] == 1)
    assert trace == [(1, 0, *plain_search("atlas lake two hops")), (2, 0, *plain_search("zx741 financed"))]
    both = sorted((r["part"], r["chunk_id"], r["dense_rank"], r["sparse_rank"], round(r["rrf_score"], 9)) for r in got.trace.collect() if r["question_id"] == 7 and r["hop"] == 1)
    assert both == [(k, *plain_search("both atlas project", d)) for k, d in enumerate("ab")]


def test_identifiers_must_differ(spark, collection):
    with pytest.raises(ValueError, match="twice"):
        answerer(spark, collection, rule, context_tokens=10).ask_all(spark.createDataFrame([(1, "a"), (1, "b")], "question_id long, question string"))


def fold_batches(items, budget, most):
    """Next fit, item after item."""
    out, batch, size = [], 0, 0
    for key, cost in items:
        if cost > budget:
            out.append((key, None))
            continue
        if size and size + cost > budget:
            batch, size = batch + 1, 0
        if batch >= most:
            out.append((key, None))
            continue
        out.append((key, batch))
        size += cost
    return out


@pytest.mark.parametrize("seed", range(3))
def test_batches_against_the_fold(spark, monkeypatch, seed):
    monkeypatch.setattr(context, "RANGE_ROWS", 40)
    draw = random.Random(seed)
    groups = {g: [(f"p{k:05d}", draw.choice([0, 1, 5, 9, 40, 120])) for k in range(draw.choice([1, 30, 600]))] for g in "xyz"}
    rows = [(g, k, c) for g, items in groups.items() for k, c in items]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "query_id string, parent_id string, cost int").withColumn("ord", F.col("parent_id"))
    cut = context.batches(df, 100, 4)
    assert sorted((r["query_id"], r["parent_id"], -1 if r["batch"] is None else r["batch"]) for r in cut.collect()) == sorted((g, k, -1 if b is None else b) for g, items in groups.items() for k, b in fold_batches(items, 100, 4))


def test_no_task_orders_a_whole_scope(spark, monkeypatch):
    monkeypatch.setattr(context, "RANGE_ROWS", 500)
    df = spark.range(20_000).select(F.lit(0).alias("query_id"), F.format_string("p%06d", "id").alias("ord"), F.format_string("p%06d", "id").alias("parent_id"), F.lit(7).alias("cost"))
    ranged = []
    keep = context.materialize
    monkeypatch.setattr(context, "materialize", lambda d, label: ranged.append(keep(d, label)) or ranged[-1])
    cut = context.batches(df, 70, 3)
    assert cut.where("batch IS NOT NULL").count() == 30 and cut.count() == 20_000
    assert max(r["count"] for r in ranged[0].groupBy("__range").count().collect()) <= 1_500


def test_benchmark_run(spark, collection):
    from docquarry import benchmark

    data = [("q1", "atlas lake two hops", "financed by aurora", None, None), ("q2", "unknown atlas", "aurora", ["fund"], None), ("q3", "both atlas project", "staff list", None, "doc a"), ("q4", "hello", "no such words", None, None), ("q5", "broken atlas", "schedule", None, "doc a")]
    questions = spark.createDataFrame(data, "id string, question string, expected_answer string, accepted_answers array<string>, source_document string")
    corpus = spark.createDataFrame([(c, d, f"doc {d}", t) for c, d, _, t in TEXTS], "candidate_id string, document_id string, document_name string, text string")

    def extractive(role, payload):
        if role == "answer" and "unknown" not in payload["question"]:
            return {"claims": [{"text": e["text"], "evidence_ids": [e["evidence_id"]]} for e in payload["evidence"]]}
        return rule(role, payload)

    made = benchmark.run(answerer(spark, collection, extractive, context_tokens=10), questions, corpus)
    got = {r["id"]: r for r in made.results.collect()}
    assert len(got) == 5
    assert (got["q1"]["hits"], got["q1"]["in_context"], got["q1"]["grounding"], got["q1"]["failure"]) == (1, True, "grounded", "no_failure")
    assert got["q2"]["hits"] == 2 and got["q2"]["abstained"] and got["q2"]["failure"] in ("retrieval_failure", "generation_failure")
    assert got["q3"]["hits"] == 1 and not got["q3"]["in_pool"] and got["q3"]["failure"] == "retrieval_failure"
    assert got["q4"]["failure"] == "benchmark_data_mismatch"
    assert got["q5"]["abstained"] and got["q5"]["hits"] == 1
    counters = made.counters.first()
    assert (counters["questions"], counters["passed"], counters["abstained"]) == (5, 1, 2)
    assert sum(r["questions"] for r in made.failures.collect()) == 5
