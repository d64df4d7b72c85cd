"""The driver loop with a scripted model: hops, stop reasons, rejected claims."""

from __future__ import annotations

import pytest

from docquarry.answer import Answerer, Settings, load
from docquarry.boundary import HashEncoder, ScriptedModel, overlap_reranker


@pytest.fixture(scope="module")
def collection(spark):
    rows = [("c1", "d1", "p1", "project code ABC belongs to the lake study", "project code ABC belongs to the lake study"), ("c2", "d2", "p2", "code ABC budget is one thousand", "code ABC budget is one thousand")]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, parent_id string, parent_text string, text string")
    return load(spark, chunks, HashEncoder())


def run(spark, collection, replies, question="what is the budget of the lake study", **settings):
    model = ScriptedModel(replies)
    encode = lambda texts: HashEncoder().encode(texts)[0]
    made = Answerer(spark, collection, model, encode, overlap_reranker, Settings(rerank_k=1, search_k=1, **settings)).ask(question)
    return made, model


PLAN = {"intent": "question", "queries": []}
CLAIM = {"claims": [{"text": "One thousand.", "evidence_ids": ["E2"]}]}


def test_second_hop_finds_the_answer(spark, collection):
    got, _ = run(spark, collection, {"plan": [PLAN], "reason": [{"sufficient": False}, {"sufficient": True}], "research": [{"queries": ["code ABC budget thousand"]}], "answer": [CLAIM], "verify": [{"verdicts": [{"claim_id": "B0C1", "status": "SUPPORTED"}], "central_supported": True}]})
    assert (got.hops, got.status, got.stop_reason) == (2, "answered", "evidence_sufficient") and "[E2]" in got.answer


def test_unknown_evidence_is_not_accepted(spark, collection):
    claim = {"claims": [{"text": "x", "evidence_ids": ["E9"]}]}
    got, _ = run(spark, collection, {"plan": [PLAN], "reason": [{"sufficient": True}], "answer": [claim], "verify": [{"verdicts": [{"claim_id": "B0C1", "status": "SUPPORTED"}], "central_supported": True}]})
    assert got.status == "abstained" and not got.claims


def test_repeated_query_stops(spark, collection):
    got, model = run(spark, collection, {"plan": [PLAN], "reason": [{"sufficient": False}], "research": [{"queries": ["What is  the BUDGET of the lake study"]}], "answer": [{"claims": []}], "verify": [{"verdicts": []}]})
    assert got.stop_reason == "repeated_query" and got.hops == 1 and [c["role"] for c in model.calls][:3] == ["plan", "reason", "research"]


def test_early_exits(spark, collection):
    assert run(spark, collection, {"plan": [{"intent": "casual", "reply": "hi"}]})[0].answer == "hi"
    assert run(spark, collection, {"plan": [{"intent": "q", "ambiguous": True}]})[0].status == "clarify"
    assert run(spark, collection, {"plan": [{"intent": "q", "document_ids": []}]})[0].stop_reason == "insufficient_scope"
    with pytest.raises(ValueError, match="unknown documents"):
        run(spark, collection, {"plan": [{"intent": "q", "document_ids": ["d9"]}]})


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Settings(child_tokens=2000)
