"""Stored states, runs and indexes: what is written is what is read."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docquarry import answer
from docquarry.boundary import HashEncoder
from docquarry.operators import context, sessions
from docquarry.sources import files


def test_states_replace_each_other(spark, tmp_path):
    path, schema = f"file:{tmp_path}/manifest", "id string, n int"
    assert files.load_state(spark, path, schema).count() == 0
    for n in (1, 2):
        files.save_state(spark.createDataFrame([("a", n), ("b", n)][:n], schema), path)
    assert sorted(map(tuple, files.load_state(spark, path, schema).collect())) == [("a", 2), ("b", 2)]


def test_chat_states_round_trip(spark):
    raw = [('{"sessions": [{"id": "chat_1", "title": "t", "messages": [{"role": "user", "content": "x"}]}], "next_chat_session_id": 2}',), ("broken",)]
    states = sessions.read_state(spark.createDataFrame(raw, "value string"))
    again = sessions.read_state(sessions.state_json(states))
    assert sorted(map(str, states.collect())) == sorted(map(str, again.collect()))
    assert sorted(r["sessions"][0]["messages"][0]["content"] for r in again.collect() if r["sessions"]) == ["x"]


def test_sidecars_go_with_their_text(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "one", ["s"]), ("b.md", "two", [])], "relative_path string, text string, sections array<string>")
    files.save_sidecars(docs, f"file:{tmp_path}/side")
    kept = files.load_state(spark, f"file:{tmp_path}/side", "relative_path string, markdown_sha256 string, sections array<string>")
    got = files.with_sidecars(docs.drop("sections"), kept)
    assert {r["relative_path"]: r["sections"] for r in got.collect()} == {"a.md": ["s"], "b.md": None}
    with pytest.raises(Exception, match="stale"):
        files.with_sidecars(docs.drop("sections").withColumn("text", F.lit("changed")), kept).collect()


def test_runs_are_written(spark, tmp_path):
    results = spark.createDataFrame([("q1", 0.5)], "id string, confidence double")
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "line_no int, line string")
    files.save_run(results, lines, f"file:{tmp_path}", "r1", latest=True)
    for name in ("r1", "latest"):
        assert spark.read.text(f"file:{tmp_path}/{name}/report").count() == 2
        assert [json.loads(x) for p in (tmp_path / name / "results").glob("part-*") for x in p.read_text().splitlines()] == [{"id": "q1", "confidence": 0.5}]


def test_questions_by_id(spark):
    asked = spark.createDataFrame([("1",), ("2",)], "id string")
    assert files.only_questions(asked, None).count() == 2 and files.only_questions(asked, ["2"]).count() == 1
    with pytest.raises(ValueError, match="no question"):
        files.only_questions(asked, ["9"])


def test_traces_take_the_place_of_fields(spark):
    messages = spark.createDataFrame([(1, "old", "hi"), (2, "old", "ho")], "message_id int, status string, content string")
    traces = spark.createDataFrame([(1, "answered", ["E1"], "no field of a trace")], "message_id int, status string, evidence array<string>, other string")
    got = {r["message_id"]: (r["status"], r["evidence"]) for r in sessions.with_trace(messages, traces).collect()}
    assert got == {1: ("answered", ["E1"]), 2: (None, None)} and "other" not in sessions.with_trace(messages, traces).columns


def test_an_unchanged_collection_is_indexed_once(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "d1", "p1", "one two", "one two"), ("c2", "d2", "p2", "three", "three")], "chunk_id string, document_id string, parent_id string, parent_text string, text string")
    inventory = spark.createDataFrame([("a.md", "x")], "relative_path string, sha256 string")
    name = files.fingerprint(inventory, {"child": 1})

    class Once(HashEncoder):
        pass

    first = answer.load(spark, chunks, Once(), folder=f"file:{tmp_path}", name=name)
    again = answer.load(spark, chunks.limit(0), None, folder=f"file:{tmp_path}", name=name)  # neither chunks nor encoder are asked
    for table in ("chunks", "parents", "postings", "documents"):
        assert sorted(map(str, getattr(first, table).collect())) == sorted(map(str, getattr(again, table).collect()))
    assert files.fingerprint(inventory, {"child": 2}) != name


def test_items_behind_full_batches_are_not_folded(spark):
    rows = [("q", k, f"p{k}", 7 if k % 9 else 99) for k in range(400)]
    df = spark.createDataFrame(rows, "query_id string, ord int, parent_id string, cost int")
    got = {r["ord"]: r["batch"] for r in context.batches(df, budget=20, max_batches=3).collect()}
    want, batch, size = {}, 0, 0
    for _, k, _, cost in rows:
        if cost > 20:
            want[k] = None
            continue
        if size and size + cost > 20:
            batch, size = batch + 1, 0
        want[k] = batch if batch < 3 else None
        size += cost if batch < 3 else 0
    assert got == want
