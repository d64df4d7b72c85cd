"""A loaded collection, and answers to questions about it.

The plan, reasoning, new queries, claims and verdicts come from a language model (see boundary); retrieval, context
selection, checks and the status come from the operators. Questions are answered by frontier, many at a time or one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.boundary import LanguageModel
from docquarry.frontier import NO_ANSWER, Answers, Frontier
from docquarry.operators import retrieval
from docquarry.scratch import materialize

__all__ = ["NO_ANSWER", "Answerer", "Answers", "Collection", "Run", "Settings", "load"]


@dataclass(frozen=True)
class Settings:
    search_k: int = 30
    rrf_k: int = 60
    rerank_k: int = 30
    max_hops: int = 3
    queries_per_hop: int = 3
    context_tokens: int = 3000
    max_batches: int = 16
    child_tokens: int = 384
    parent_tokens: int = 1536
    calculations: int = 1000

    def __post_init__(self) -> None:
        if self.parent_tokens < self.child_tokens or self.parent_tokens > self.context_tokens:
            raise ValueError("parent passages must hold child passages and fit the context")


@dataclass
class Run:
    """What one question has led to so far."""

    question: str
    status: str = "running"
    stop_reason: str | None = None
    answer: str = ""
    queries: list[str] = field(default_factory=list)
    evidence: list[dict] = field(default_factory=list)
    claims: list[dict] = field(default_factory=list)
    verdicts: list[dict] = field(default_factory=list)
    table: dict | None = None
    hops: int = 0
    spans: list[dict] = field(default_factory=list)
    focus: dict[str, str] = field(default_factory=dict)
    trace: DataFrame | None = None


@dataclass
class Collection:
    """Tables of a loaded collection: chunks (chunk_id, document_id, parent_id, text, embedding), parents (parent_id, text, cost), postings."""

    chunks: DataFrame
    parents: DataFrame
    postings: DataFrame
    documents: DataFrame
    rows: DataFrame | None = None


class Answerer:
    """ask() runs one question of a conversation, ask_all() a table of them. encode gives query vectors, scorer is a reranker expression."""

    def __init__(self, spark: SparkSession, collection: Collection, model: LanguageModel, encode: Callable[[list[str]], list[list[float]]], scorer, settings: Settings | None = None) -> None:
        self.spark, self.collection, self.model, self.encode, self.scorer = spark, collection, model, encode, scorer
        self.settings = settings or Settings()

    def set_model(self, model: LanguageModel) -> None:
        """Another language model; the index stays."""
        self.model = model

    def ask_all(self, questions: DataFrame, in_tasks: bool = True) -> Answers:
        """questions: question_id, question, optionally history. The model is asked in the tasks, so it must be one that can be sent there."""
        return Frontier(self.spark, self.collection, self.model, self.encode, self.scorer, self.settings, in_tasks).run(questions)

    def ask(self, question: str, history: list[dict] | None = None) -> Run:
        """One question; the model is asked by the driver. A failure that belongs to the question is raised."""
        turns = [{k: str(v) for k, v in t.items()} for t in history or []]
        got = self.ask_all(self.spark.createDataFrame([(0, question, turns)], "question_id int, question string, history array<map<string,string>>"), in_tasks=False)
        done = got.questions.first()
        if done["status"] == "failed":
            raise ValueError(done["error"])
        texts = got.evidence.join(self.collection.parents.select("parent_id", "text"), "parent_id").orderBy("seq")
        verdicts = [r.asDict(recursive=True) for r in got.claims.orderBy("batch", "claim_order").collect()]
        table = got.calculations.first() if got.calculations is not None else None
        return Run(question, done["status"], done["stop_reason"], done["answer"], list(done["queries"]), [r.asDict() for r in texts.collect()], [v for v in verdicts if v["accepted"]], verdicts,
                   json.loads(table["table"]) if table else None, done["hops"], [r.asDict(recursive=True) for r in got.spans.orderBy("evidence_id", "start").collect()],
                   {r["evidence_id"]: r["status"] for r in got.focus.collect()}, got.trace)


def load_collection(spark: SparkSession, root: str, names: Sequence[str], encoder, folder: str, sidecars: DataFrame | None = None, settings: Settings | None = None) -> Collection:
    """The collection of the markdown files below names, scanned, cut and indexed below folder.

    The index is found by the fingerprint of files, sidecars (relative_path, markdown_sha256, sections) and settings. Where it has to be made, only texts that the
    store of vectors has not met are encoded, so another subset, or one changed file among many, costs what is new.
    """
    from docquarry.operators import building
    from docquarry.sources import files, vectors

    s, folder = settings or Settings(), folder.rstrip("/")
    scanned = files.scan_collection(spark, root, names)
    listed = files.inventory(scanned).select("relative_path", "sha256")
    if sidecars is not None:
        beside = sidecars.join(listed.select("relative_path"), "relative_path", "left_semi")
        listed = listed.unionByName(beside.select(F.concat("relative_path", F.lit(".structure")).alias("relative_path"), F.sha2(F.to_json(F.struct("markdown_sha256", "sections")), 256).alias("sha256")))
    name = files.fingerprint(listed, {"child": s.child_tokens, "parent": s.parent_tokens, "encoder": encoder.identity})
    if files.load_index(spark, folder, name) is None:
        docs = files.documents(scanned)
        made = materialize(building.build_chunks(files.with_sidecars(docs, sidecars) if sidecars is not None else docs, s.parent_tokens, s.child_tokens), "collection-chunks")
        if made.isEmpty():
            raise ValueError("no text to index")
        full = made.join(vectors.vectors_for(made, encoder, f"{folder}/vectors"), "chunk_id")
        files.save_index(full, retrieval.postings(made), folder, name)
    return load(spark, spark.createDataFrame([], "chunk_id string"), encoder, folder=folder, name=name)


def load(spark: SparkSession, chunks: DataFrame, encoder, rows: DataFrame | None = None, folder: str | None = None, name: str | None = None) -> Collection:
    """Index chunks (chunk_id, document_id, parent_id, parent_text, text): vectors, postings and parents with their token counts.

    folder and name (files.fingerprint() of the inventory and the settings): the index is read from there if a sound one stands
    there, else made and stored, so an unchanged collection is never indexed again.
    """
    from docquarry.boundary import encode
    from docquarry.operators.chunking import token_count
    from docquarry.sources import files

    def made() -> tuple[DataFrame, DataFrame]:
        vectors = encode(chunks.select("chunk_id", "text"), encoder, "chunk_id", "text").select("chunk_id", "embedding")
        return chunks.select("chunk_id", "document_id", "parent_id", "parent_text", "text").join(vectors, "chunk_id"), retrieval.postings(chunks)

    if folder and name:
        found = files.load_index(spark, folder, name)
        if found is None:
            files.save_index(*made(), folder, name)
            found = files.load_index(spark, folder, name)
        full, postings = found
    else:
        full, postings = (materialize(df, "index") for df in made())
    parents = materialize(full.groupBy("parent_id").agg(F.min("parent_text").alias("text")).withColumn("cost", token_count(F.col("text"))), "parents")
    return Collection(full.drop("parent_text"), parents, postings, full.select("document_id").distinct(), rows)
