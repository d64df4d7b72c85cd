"""Answering a table of questions together: one plan a hop for all that are open.

Each question is a row of a state table: what it asks next, what it has asked, hop, status. A hop searches for all open questions at once (each
search within one document or the collection, with a quota of its own), admits passages into each question's budget, and
asks the model, in tasks, what is still missing. Finished questions leave the frontier. Every step is a table, written and
read again, so the number of plans depends on max_hops alone, and the driver holds counts.

The stages of every search stay together in one trace: ranks, scores, admission and its reason.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.boundary import LanguageModel, structured
from docquarry.functions.text import fold
from docquarry.operators import context, evaluate, evidence, retrieval, tables
from docquarry.operators.chunking import token_count
from docquarry.scratch import materialize

BROAD = ("summary", "list_extraction", "document_expansion", "aggregation")
NO_ANSWER = "No sufficient evidence was found."
QUOTE_CHARS, RECENT = 240, 6
#: What a reply of each role must have, and its form.
ROLES = {
    "plan": ("intent", "intent string, question string, queries array<string>, document_ids array<string>, ambiguous boolean, clarification string, reply string, requires_multi_hop boolean, single_pass boolean,"
                       " aggregation struct<operation: string, column: string, equals: map<string,string>>"),
    "reason": ("sufficient", "sufficient boolean, unanswerable boolean, requires_additional_retrieval boolean, established_facts array<struct<text: string, evidence_ids: array<string>>>"),
    "research": ("queries", "queries array<string>"),
    "answer": ("claims", "claims array<struct<text: string, evidence_ids: array<string>>>"),
    "verify": ("verdicts", "verdicts array<struct<claim_id: string, status: string, reason: string>>, central_supported boolean"),
    "focus": ("selections", "selections array<struct<claim_id: string, evidence_id: string, quote: string>>"),
}
_STATE = ["question_id", "question", "history", "resolved", "intent", "scope", "multi_hop", "aggregation", "queries", "keys", "asked", "hops", "status", "stop_reason", "answer", "error"]


@dataclass(frozen=True)
class Answers:
    """What a run has led to. questions: a row a question; the others have question_id."""

    questions: DataFrame
    evidence: DataFrame
    claims: DataFrame
    spans: DataFrame
    focus: DataFrame
    trace: DataFrame
    calculations: DataFrame | None = None


def ask(df: DataFrame, model: LanguageModel, role: str, payload: Column, in_tasks: bool, keys: Sequence[str]) -> DataFrame:
    """df with reply (a struct of the role's form, null where there is none) and failure (why not).

    The model is asked in the tasks, row by row, twice if its reply is unsound; or by the driver, for the few questions of one
    conversation whose model lives there. A failed row fails alone.
    """
    needed, form = ROLES[role]

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return json.dumps(structured(model, role, json.loads(text), lambda r: r[needed])), None
        except Exception as wrong:  # whatever a model may raise belongs to its question
            return None, f"{type(wrong).__name__}: {wrong}"

    @F.pandas_udf("text string, failure string")
    def in_task(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["text", "failure"])

    sent = df.withColumn("__payload", F.to_json(payload, {"ignoreNullFields": "false"}))
    if in_tasks:
        got = sent.withColumn("__got", in_task.asNondeterministic()("__payload"))
    else:
        rows = [(*(r[k] for k in keys), one(r["__payload"])) for r in sent.select(*keys, "__payload").orderBy(*keys).collect()]  # one conversation
        kinds = dict(df.dtypes)
        answered = df.sparkSession.createDataFrame(rows, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", __got struct<text: string, failure: string>")
        got = sent.join(answered, list(keys))
    return materialize(got.select(*df.columns, F.from_json("__got.text", form).alias("reply"), F.col("__got.failure").alias("failure")), f"reply-{role}")


def _gathered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, *columns: str) -> DataFrame:
    """keys and an array of structs of columns, in order. What is gathered is bounded by a question's budget."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.struct(*columns).alias("__row"))))
    return df.groupBy(*keys).agg(F.transform(ordered, lambda x: x["__row"]).alias(name))


class Frontier:
    """Runs questions against a collection (answer.Collection). encode gives vectors of texts, scorer is a reranker expression."""

    def __init__(self, spark: SparkSession, collection, model: LanguageModel, encode: Callable[[list[str]], list[list[float]]], scorer, settings, in_tasks: bool = True) -> None:
        self.spark, self.collection, self.model, self.encode, self.scorer, self.settings, self.in_tasks = spark, collection, model, encode, scorer, settings, in_tasks
        self.index = collection.postings.select("token", "chunk_id", "weight").join(collection.chunks.select("chunk_id", "document_id"), "chunk_id")

    def _ask(self, df: DataFrame, role: str, payload: Column, *keys: str) -> DataFrame:
        return ask(df, self.model, role, payload, self.in_tasks, keys or ("question_id",))

    def run(self, questions: DataFrame) -> Answers:
        """questions: question_id, question, and optionally history (array of structs, of which the last six count). A repeated identifier stops the job."""
        state = self.plan(questions)
        none = self.spark.createDataFrame([], "question_id " + dict(state.dtypes)["question_id"] + ", seq int, parent_id string, document_id string, cost int, hop int, chunk_ids array<string>")
        held, traces = none, []
        for hop in range(1, self.settings.max_hops + 1):
            if state.where("status = 'open'").isEmpty():
                break
            state, held, trace = self.hop(state, held, hop)
            traces.append(trace)
        if state.where("status = 'ready'").isEmpty():
            return self.without_evidence(state)
        calculations = self.calculate(state)
        trace = functools.reduce(DataFrame.unionByName, traces)
        return self.conclude(state, held, trace, calculations)

    def without_evidence(self, state: DataFrame) -> Answers:
        """The answers where every question ended before a search."""
        kind = dict(state.dtypes)["question_id"]
        none = lambda form: self.spark.createDataFrame([], f"question_id {kind}, {form}")
        questions = state.select("question_id", "question", "resolved", "intent", "scope", "hops", F.col("asked").alias("queries"), "status", "stop_reason", "answer", "error", F.lit(False).alias("repaired"), F.lit(True).alias("complete"))
        return Answers(questions, none("seq int, parent_id string, document_id string, cost int, hop int, chunk_ids array<string>, evidence_id string"),
                       none("claim_id string, batch int, claim_order int, text string, evidence_ids array<string>, status string, accepted boolean"),
                       none("evidence_id string, start int, end int, quote string, claim_ids array<string>"), none("evidence_id string, status string"), none("hop int, chunk_id string, admitted boolean"))

    def plan(self, questions: DataFrame) -> DataFrame:
        """The state table after the planner: open, or done with a reason."""
        once = questions.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if not once.isEmpty():
            raise ValueError("a question's identifier occurs twice")
        turns = F.col("history") if "history" in questions.columns else F.lit(None).cast("array<map<string,string>>")
        size = F.coalesce(F.size(turns), F.lit(0))
        recent = F.when(size > 0, F.slice(turns, F.greatest(size - RECENT + 1, F.lit(1)), F.lit(RECENT))).otherwise(turns)
        rows = questions.select("question_id", "question", F.to_json(recent).alias("history"))
        turns = F.coalesce(F.from_json("history", "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
        got = self._ask(rows, "plan", F.struct("question", turns.alias("history")))
        known = self.collection.documents.select(F.col("document_id").cast("string").alias("d"))
        named = got.select("question_id", F.explode("reply.document_ids").alias("d"))
        unknown = named.join(known, "d", "left_anti").select("question_id").distinct().withColumn("unknown", F.lit(True))
        r = F.col("reply")
        resolved = F.coalesce(r["question"], "question")
        planned = F.coalesce(r["queries"], F.array().cast("array<string>"))
        first = F.when(fold(resolved) == fold(F.col("question")), F.array(resolved)).otherwise(F.array().cast("array<string>"))
        queries = F.array_distinct(F.concat(first, planned))
        state = got.join(unknown, "question_id", "left").select(
            "question_id", "question", "history", resolved.alias("resolved"), r["intent"].alias("intent"), F.array_distinct(r["document_ids"]).alias("scope"),
            F.coalesce(r["requires_multi_hop"], ~F.coalesce(r["single_pass"], F.lit(False))).alias("multi_hop"), r["aggregation"].alias("aggregation"),
            F.when(F.size(queries) > 0, queries).otherwise(F.array(resolved)).alias("queries"), F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("asked"), F.lit(0).alias("hops"),
            F.when(r.isNull() | F.col("unknown"), "failed").when(r["intent"] == "casual", "answered").when(r["ambiguous"], "clarify").when(F.size(r["document_ids"]) == 0, "abstained").otherwise("open").alias("status"),
            F.when(r.isNull() | F.col("unknown"), F.lit(None)).when(r["intent"] == "casual", "casual").when(r["ambiguous"], "ambiguous").when(F.size(r["document_ids"]) == 0, "insufficient_scope").alias("stop_reason"),
            F.when(r["intent"] == "casual", F.coalesce(r["reply"], F.lit(""))).when(r["ambiguous"], F.coalesce(r["clarification"], F.lit(""))).when(F.size(r["document_ids"]) == 0, NO_ANSWER).alias("answer"),
            F.when(F.col("unknown"), "the plan names unknown documents").otherwise(F.col("failure")).alias("error"))
        return materialize(state.select(*_STATE), "frontier-state")

    def searches(self, state: DataFrame, hop: int) -> DataFrame:
        """The searches of all open questions: of the first queries_per_hop queries those not asked before, once for each document where several are in scope."""
        s = self.settings
        said = state.where("status = 'open'").select("question_id", "scope", "keys", F.posexplode(F.slice("queries", 1, s.queries_per_hop)).alias("qpos", "query"))
        said = said.withColumn("key", fold(F.col("query"))).where("key <> '' AND NOT array_contains(keys, key)")
        fresh = said.withColumn("nth", F.row_number().over(Window.partitionBy("question_id", "key").orderBy("qpos"))).where("nth = 1")  # queries_per_hop rows at most
        several = F.size("scope") > 1
        fresh = fresh.select("question_id", "qpos", "query", "key", F.posexplode(F.coalesce("scope", F.array(F.lit(None).cast("string")))).alias("part", "document_id"), F.when(several, F.floor(F.lit(s.context_tokens) / F.size("scope")).cast("int")).alias("quota"))
        encode = self.encode

        @F.pandas_udf("array<double>")
        def vectors(texts: pd.Series) -> pd.Series:
            return pd.Series([[float(x) for x in v] for v in encode(texts.tolist())])

        return materialize(fresh.withColumn("query_id", F.concat_ws(":", "question_id", F.lit(hop), "qpos", "part")).withColumn("embedding", vectors("query")), "frontier-searches")

    def hop(self, state: DataFrame, held: DataFrame, hop: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(state, evidence, trace) after one hop of all open questions."""
        s, c = self.settings, self.collection
        searches = self.searches(state, hop)
        found = retrieval.search_each(c.chunks.withColumn("document_id", F.col("document_id").cast("string")), searches.select("query_id", "query", "embedding", "document_id"), self.index.withColumn("document_id", F.col("document_id").cast("string")), self.scorer, s.search_k, s.rrf_k, s.rerank_k)
        where = searches.select("query_id", "question_id", "qpos", "part", "query", "quota")
        hits = found.join(where, "query_id").join(c.chunks.select("chunk_id", "parent_id"), "chunk_id").join(c.parents.select("parent_id", "cost"), "parent_id")
        last = held.groupBy("question_id").agg(F.max("seq").alias("last"))
        order = F.row_number().over(Window.partitionBy("question_id").orderBy("qpos", "part", "rerank_rank"))  # a question's searches times rerank_k rows
        hits = hits.join(last, "question_id", "left").withColumn("rank", (F.coalesce("last", F.lit(0)) + order).cast("int")).drop("last")
        hits = materialize(hits, "frontier-hits")
        before = held.join(searches.select("question_id").distinct(), "question_id", "left_semi")
        both = hits.select("question_id", "rank", "parent_id", "document_id", "cost", "quota").unionByName(before.select("question_id", F.col("seq").alias("rank"), "parent_id", "document_id", "cost", F.lit(None).cast("int").alias("quota")))
        admitted = materialize(context.admit(both, s.context_tokens, "quota", "question_id"), "frontier-admitted")
        trace = hits.join(admitted.select("question_id", "rank", "admitted", "used", "reason"), ["question_id", "rank"]).withColumn("hop", F.lit(hop))
        number = F.row_number().over(Window.partitionBy("question_id").orderBy("rank")).cast("int")
        taken = admitted.where("admitted").select("question_id", number.alias("seq"), "rank", "parent_id", "document_id", "cost")
        chunks = hits.groupBy("question_id", "parent_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("c")).select("question_id", "parent_id", F.array_distinct("c.chunk_id").alias("now"))
        old = held.select("question_id", "parent_id", F.col("hop").alias("old_hop"), F.col("chunk_ids").alias("old"))
        empty = F.array().cast("array<string>")
        now = taken.join(old, ["question_id", "parent_id"], "left").join(chunks, ["question_id", "parent_id"], "left").select(
            "question_id", "seq", "parent_id", "document_id", "cost", F.coalesce("old_hop", F.lit(hop)).alias("hop"), F.array_union(F.coalesce("old", empty), F.coalesce("now", empty)).alias("chunk_ids"))
        held = materialize(now.unionByName(held.join(searches.select("question_id").distinct(), "question_id", "left_anti")), "frontier-evidence")
        asked = searches.where("part = 0").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("qpos", "query", "key"))).alias("a"))
        added = held.where(F.col("hop") == hop).groupBy("question_id").agg(F.count(F.lit(1)).alias("added"))
        now = state.join(asked, "question_id", "left").join(added, "question_id", "left")
        open_, searched = F.col("status") == "open", F.col("a").isNotNull()
        now = now.withColumn("keys", F.concat("keys", F.coalesce("a.key", empty))).withColumn("asked", F.concat("asked", F.coalesce("a.query", empty))).withColumn("hops", F.when(open_ & searched, F.lit(hop)).otherwise(F.col("hops")))
        stop = F.when(~searched, "repeated_query").when(F.col("added").isNull(), "no_new_evidence")
        now = now.withColumn("stop_reason", F.when(open_, stop).otherwise(F.col("stop_reason"))).withColumn("status", F.when(open_ & stop.isNotNull(), "ready").otherwise(F.col("status")))
        return self.think(materialize(now.select(*_STATE), "frontier-state"), held, hop), held, trace

    def payload(self, held: DataFrame) -> DataFrame:
        """question_id and its evidence as the model sees it, in order."""
        texts = held.join(self.collection.parents.select("parent_id", "text"), "parent_id").withColumn("evidence_id", F.concat(F.lit("E"), "seq"))
        return _gathered(texts, ["question_id"], ["seq"], "evidence", "evidence_id", "document_id", "text")

    def think(self, state: DataFrame, held: DataFrame, hop: int) -> DataFrame:
        """Reasoning for the questions with new evidence, and new queries for those that go on."""
        still = state.where("status = 'open'").join(self.payload(held), "question_id")
        got = self._ask(still, "reason", F.struct(F.col("resolved").alias("question"), "evidence"))
        r = F.col("reply")
        known = F.transform("evidence", lambda e: e["evidence_id"])
        unsound = F.exists(F.coalesce(r["established_facts"], F.array().cast("array<struct<text:string,evidence_ids:array<string>>>")), lambda f: (F.coalesce(F.size(f["evidence_ids"]), F.lit(0)) < 1) | (F.size(F.array_except(f["evidence_ids"], known)) > 0))
        more = F.col("multi_hop") | F.coalesce(r["requires_additional_retrieval"], F.lit(False))
        reason = F.when(r["sufficient"], "evidence_sufficient").when(r["unanswerable"], "unanswerable").when(F.lit(hop >= self.settings.max_hops), "max_hops").when(~more, "single_pass")
        error = F.coalesce("failure", F.when(unsound, "the reasoning names unknown evidence"))
        got = materialize(got.select(*(c for c in got.columns if c not in ("stop_reason", "status", "error", "failure")), error.alias("error"), F.when(error.isNull(), reason).alias("stop_reason"),
                                     F.when(error.isNotNull(), "failed").when(reason.isNotNull(), "ready").otherwise("open").alias("status")), "frontier-reasoned")
        on = self._ask(got.where("status = 'open'").withColumnRenamed("reply", "reasoning"), "research", F.struct(F.col("resolved").alias("question"), "reasoning", F.col("asked").alias("previous")))
        on = on.withColumn("queries", F.coalesce("reply.queries", F.array().cast("array<string>"))).withColumn("error", F.col("failure")).withColumn("status", F.when(F.col("failure").isNull(), "open").otherwise("failed"))
        return materialize(state.where("status <> 'open'").unionByName(got.where("status <> 'open'").select(*_STATE)).unionByName(on.select(*_STATE)), "frontier-state")

    def calculate(self, state: DataFrame) -> DataFrame | None:
        """Table arithmetic that plans ask for: question_id, table (JSON). Few different calculations stand behind many questions, so each is worked out once."""
        if self.collection.rows is None:
            return None
        asked = state.where("aggregation IS NOT NULL AND status <> 'failed'").select("question_id", F.to_json(F.struct("aggregation", F.array_sort("scope").alias("scope"))).alias("what"))
        out = []
        for r in asked.select("what").distinct().limit(self.settings.calculations + 1).collect():
            if len(out) >= self.settings.calculations:
                raise ValueError(f"more than {self.settings.calculations} different calculations in a run")
            what = json.loads(r["what"])
            a = what["aggregation"]
            rows = retrieval.in_scope(self.collection.rows, what.get("scope"))
            one = tables.aggregate_rows(rows, a["operation"], a.get("column"), a.get("equals"))
            out.append(one.select(F.lit(r["what"]).alias("what"), F.to_json(F.struct(*one.columns)).alias("table")))
        if not out:
            return None
        return materialize(asked.join(functools.reduce(DataFrame.unionByName, out), "what").select("question_id", "table"), "frontier-tables")

    def cover(self, state: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(evidence, batches: question_id, batch, seq; complete: question_id, complete). Broad questions read their whole scope in batches, others what they found as one.

        Questions with one scope share its batches, which are cut once.
        """
        s, c = self.settings, self.collection
        ready = state.where("status = 'ready'").join(held.select("question_id").distinct(), "question_id", "left_semi")
        broad = ready.where(F.col("intent").isin(*BROAD) | F.col("aggregation").isNotNull()).select("question_id", F.array_sort("scope").alias("scope")).withColumn("scope_key", F.sha2(F.coalesce(F.to_json("scope"), F.lit("")), 256))
        rest = held.join(ready.select("question_id"), "question_id", "left_semi").join(broad.select("question_id"), "question_id", "left_anti").select("question_id", F.lit(0).alias("batch"), "seq")
        if broad.isEmpty():
            return held, rest, broad.select("question_id", F.lit(True).alias("complete"))
        scopes = broad.dropDuplicates(["scope_key"]).select("scope_key", "scope")
        homes = c.chunks.groupBy("parent_id").agg(F.min(F.col("document_id").cast("string")).alias("document_id"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
        named = scopes.where("scope IS NOT NULL").select("scope_key", F.explode("scope").alias("document_id")).join(homes.select("parent_id", "document_id"), "document_id").select("scope_key", "parent_id")
        whole = scopes.where("scope IS NULL").select("scope_key")  # one row at most
        everything = homes.select("parent_id").join(F.broadcast(whole)) if not whole.isEmpty() else named.limit(0)
        pool = named.unionByName(everything.select("scope_key", "parent_id")).join(c.parents.select("parent_id", "cost"), "parent_id")
        cut = materialize(context.batches(pool.withColumn("ord", F.col("parent_id")), s.context_tokens, s.max_batches, "scope_key"), "frontier-batches")
        skipped = cut.where("batch IS NULL").select("scope_key").distinct().withColumn("skipped", F.lit(True))
        complete = broad.join(skipped, "scope_key", "left").select("question_id", F.col("skipped").isNull().alias("complete"))
        mine = broad.select("question_id", "scope_key").join(cut.where("batch IS NOT NULL"), "scope_key").join(held.select("question_id", "parent_id", "seq"), ["question_id", "parent_id"], "left")
        last = held.groupBy("question_id").agg(F.max("seq").alias("last"))
        order = F.row_number().over(Window.partitionBy("question_id", F.col("seq").isNull()).orderBy("batch", "ord"))  # max_batches times the budget at most
        mine = mine.join(last, "question_id").withColumn("number", F.coalesce("seq", F.col("last") + order).cast("int"))
        mine = materialize(mine.join(homes, "parent_id").select("question_id", "batch", "number", "seq", "parent_id", "document_id", "cost", "chunk_ids"), "frontier-cover")
        fresh = mine.where("seq IS NULL").select("question_id", F.col("number").alias("seq"), "parent_id", "document_id", "cost", F.lit(0).alias("hop"), "chunk_ids")
        return materialize(held.unionByName(fresh), "frontier-evidence"), mine.select("question_id", "batch", F.col("number").alias("seq")).unionByName(rest), complete

    def draft(self, work: DataFrame, texts: DataFrame, name: str, payload: list) -> DataFrame:
        """Claims of each batch with their verdicts: question_id, batch, central, failure, claims (array), of which an unknown or missing citation is never supported."""
        got = self._ask(work, "answer", F.struct(*payload), "question_id", "batch")
        claims = got.select("question_id", "batch", F.posexplode("reply.claims").alias("claim_order", "c")).select(
            "question_id", "batch", "claim_order", F.concat(F.lit("B"), "batch", F.lit("C"), F.col("claim_order") + 1).alias("claim_id"), "c.text", F.coalesce("c.evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"))
        claims = materialize(claims, f"{name}-claims")
        cited = claims.select("question_id", "claim_id", F.posexplode("evidence_ids").alias("at", "evidence_id")).join(texts, ["question_id", "evidence_id"])
        cited = _gathered(cited, ["question_id", "claim_id"], ["at"], "cited_evidence", "evidence_id", "text")
        shown = claims.join(cited, ["question_id", "claim_id"], "left").where(F.size("evidence_ids") == F.size("cited_evidence"))
        asked = got.drop("reply").join(_gathered(shown, ["question_id", "batch"], ["claim_order"], "claims", "claim_id", "text", "evidence_ids", "cited_evidence"), ["question_id", "batch"], "left")
        empty = F.array().cast("array<struct<claim_id:string,text:string,evidence_ids:array<string>,cited_evidence:array<struct<evidence_id:string,text:string>>>>")
        judged = self._ask(asked.withColumn("claims", F.coalesce("claims", empty)).where("failure IS NULL").drop("failure"), "verify", F.struct("question", "claims", "table"), "question_id", "batch")
        verdicts = judged.select("question_id", F.explode("reply.verdicts").alias("v")).select("question_id", "v.claim_id", "v.status").dropDuplicates(["question_id", "claim_id"])
        checked = evidence.claim_verdicts(claims, verdicts, texts.select("question_id", "evidence_id"), "question_id")
        rows = _gathered(checked, ["question_id", "batch"], ["claim_order"], "claims", "claim_id", "claim_order", "text", "evidence_ids", "status")
        done = got.select("question_id", "batch", F.col("failure").alias("first")).join(judged.select("question_id", "batch", "failure", F.coalesce("reply.central_supported", F.lit(False)).alias("central")), ["question_id", "batch"], "left")
        return materialize(done.join(rows, ["question_id", "batch"], "left").select("question_id", "batch", F.coalesce("central", F.lit(False)).alias("central"), F.coalesce("first", "failure").alias("failure"), "claims"), name)

    def repair(self, work: DataFrame, drafts: DataFrame, weak: DataFrame, texts: DataFrame) -> DataFrame:
        """drafts with the batches of weak (one a question) drafted once more, with what was wrong in sight."""
        again = work.join(drafts.join(weak, ["question_id", "batch"], "left_semi").select("question_id", "batch", F.col("claims").alias("draft")), ["question_id", "batch"])
        mended = self.draft(again, texts.select("question_id", "evidence_id", "text"), "frontier-repairs", ["question", "evidence", "table", "draft"])
        return materialize(drafts.join(weak, ["question_id", "batch"], "left_anti").unionByName(mended), "frontier-final")

    def conclude(self, state: DataFrame, held: DataFrame, trace: DataFrame, calculations: DataFrame | None) -> Answers:
        """Synthesis, verification, one repair a question, final status, and the places in the sources that the claims stand on."""
        held, batches, complete = self.cover(state, held)
        texts = held.join(self.collection.parents.select("parent_id", "text"), "parent_id").withColumn("evidence_id", F.concat(F.lit("E"), "seq")).select("question_id", "seq", "evidence_id", "document_id", "text")
        table = calculations if calculations is not None else self.spark.createDataFrame([], f"question_id {dict(state.dtypes)['question_id']}, table string")
        work = _gathered(batches.join(texts, ["question_id", "seq"]), ["question_id", "batch"], ["seq"], "evidence", "evidence_id", "document_id", "text")
        work = materialize(work.join(state.select("question_id", F.col("resolved").alias("question")), "question_id").join(table, "question_id", "left"), "frontier-work")
        drafts = self.draft(work, texts.select("question_id", "evidence_id", "text"), "frontier-drafts", ["question", "evidence", "table"])
        weak = drafts.where(F.exists("claims", lambda c: c["status"] != "SUPPORTED")).groupBy("question_id").agg(F.min("batch").alias("batch"))
        final = drafts
        if not weak.isEmpty():
            final = self.repair(work, drafts, weak, texts)
        claims = final.select("question_id", "batch", F.explode("claims").alias("c")).select("question_id", "batch", "c.*")
        judged = final.groupBy("question_id").agg(F.bool_or("central").alias("central"), F.bool_or(F.coalesce(F.exists("claims", lambda c: c["status"] != "SUPPORTED"), F.lit(False))).alias("rejected"), F.min("failure").alias("trouble"))
        kept = claims.where("status = 'SUPPORTED'").withColumn("nth", F.row_number().over(Window.partitionBy("question_id", fold(F.col("text"))).orderBy("batch", "claim_order"))).withColumn("stays", F.col("nth") == 1)
        claims = claims.join(kept.where("stays").select("question_id", "claim_id", "stays"), ["question_id", "claim_id"], "left").withColumn("accepted", F.coalesce("stays", F.lit(False))).drop("stays")
        claims = materialize(claims, "frontier-claims")
        line = F.concat("text", F.lit(" "), F.array_join(F.transform("evidence_ids", lambda e: F.concat(F.lit("["), e, F.lit("]"))), " "))
        said = _gathered(claims.where("accepted").withColumn("line", line), ["question_id"], ["batch", "claim_order"], "lines", "line").select("question_id", F.array_join(F.col("lines.line"), "\n\n").alias("said"))
        repaired = weak.select("question_id", F.lit(True).alias("repaired"))
        done = functools.reduce(lambda a, b: a.join(b, "question_id", "left"), [judged, said, repaired, complete], state)
        no = F.coalesce("rejected", F.lit(False))
        status = evidence.final_status(F.col("said").isNotNull(), F.coalesce("central", F.lit(False)), no, F.coalesce("complete", F.lit(True)))
        ready = F.col("status") == "ready"
        failed = ready & F.col("trouble").isNotNull() & F.col("said").isNull()
        questions = done.select("question_id", "question", "resolved", "intent", "scope", "hops", F.col("asked").alias("queries"), F.when(failed, "failed").when(ready, status).otherwise(F.col("status")).alias("status"), "stop_reason",
                                F.when(ready, F.coalesce("said", F.lit(NO_ANSWER))).otherwise(F.col("answer")).alias("answer"), F.coalesce("error", "trouble").alias("error"), F.coalesce("repaired", F.lit(False)).alias("repaired"), F.coalesce("complete", F.lit(True)).alias("complete"))
        spans, focus = self.focus(claims.where("accepted"), texts)
        evidence_rows = held.withColumn("evidence_id", F.concat(F.lit("E"), "seq"))
        return Answers(materialize(questions, "frontier-questions"), evidence_rows, claims, spans, focus, trace, calculations)

    def focus(self, claims: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(spans: question_id, evidence_id, start, end, quote, claim_ids; focus: question_id, evidence_id, status) of the cited evidence.

        One request for each batch of cited passages. A quote counts where it stands in the passage; a failed request leaves its
        passages unavailable, and the answer is as it was.
        """
        if claims.isEmpty():
            kind = dict(claims.dtypes)["question_id"]
            none = lambda form: self.spark.createDataFrame([], f"question_id {kind}, evidence_id string, {form}")
            return none("start int, end int, quote string, claim_ids array<string>"), none("status string")
        ordered = claims.withColumn("claim_order", F.row_number().over(Window.partitionBy("question_id").orderBy("batch", "claim_order")))
        cited = evidence.cited_order(ordered, "question_id").join(texts.select("question_id", "evidence_id", F.col("text").alias("excerpt")), ["question_id", "evidence_id"])
        cut = context.focus_batches(cited.select("question_id", F.col("position").alias("ord"), "evidence_id", "excerpt"), self.settings.context_tokens, "question_id")
        cited = materialize(cut.select("question_id", "evidence_id", "batch", "ord").join(cited.select("question_id", "evidence_id", "excerpt"), ["question_id", "evidence_id"]), "focus-cited")
        shown = F.when(token_count(F.col("excerpt")) > self.settings.context_tokens, F.substring("excerpt", 1, context.FOCUS_CHARS)).otherwise(F.col("excerpt"))
        about = ordered.select("question_id", "claim_order", "claim_id", "text", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
        about = _gathered(about, ["question_id", "evidence_id"], ["claim_order"], "claims", "claim_id", "text")
        sources = _gathered(cited.join(about, ["question_id", "evidence_id"]).withColumn("excerpt", shown), ["question_id", "batch"], ["ord"], "sources", "evidence_id", "excerpt", "claims")
        got = self._ask(sources, "focus", F.struct("sources"), "question_id", "batch")
        picked = got.select("question_id", "batch", F.posexplode("reply.selections").alias("at", "s")).select("question_id", (F.col("batch") * 100_000 + F.col("at")).alias("ord"), "s.*").where(F.length(F.trim("quote")) <= QUOTE_CHARS)
        one = lambda c: F.to_json(F.struct("question_id", c))  # noqa: E731  claims and evidence of all questions in one go
        spans = evidence.focus_spans(picked.select(one("claim_id").alias("claim_id"), one("evidence_id").alias("evidence_id"), "quote", "ord"), cited.select(one("evidence_id").alias("evidence_id"), "excerpt"), claims.select(one("claim_id").alias("claim_id")))
        kind = dict(claims.dtypes)["question_id"]
        read = F.from_json("evidence_id", f"question_id {kind}, evidence_id string")
        spans = materialize(spans.select(read["question_id"].alias("question_id"), read["evidence_id"].alias("evidence_id"), "start", "end", "quote", F.transform("claim_ids", lambda c: F.get_json_object(c, "$.claim_id")).alias("claim_ids")), "focus-spans")
        hit = spans.select("question_id", "evidence_id").distinct().withColumn("hit", F.lit(True))
        lost = got.where("failure IS NOT NULL").select("question_id", "batch", F.lit(True).alias("lost"))
        status = F.when(F.col("hit"), "focused").when(F.col("lost"), "unavailable").otherwise("fallback")
        return spans, cited.join(hit, ["question_id", "evidence_id"], "left").join(lost, ["question_id", "batch"], "left").select("question_id", "evidence_id", status.alias("status"))
