"""What the engine asks of models, and deterministic stand-ins for tests.

No model is shipped. An encoder gives vectors and term weights, a reranker a score, a language model a reply. The
stand-ins are plainly artificial; nothing is to be concluded about quality from them.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.operators.retrieval import token_overlap


class Encoder(Protocol):
    identity: str

    def encode(self, texts: Sequence[str]) -> tuple[list[list[float]], list[dict[str, float]]]: ...


class Reranker(Protocol):
    def __call__(self, query: Column, text: Column) -> Column: ...


class LanguageModel(Protocol):
    identity: str

    def reply(self, role: str, payload: dict) -> dict: ...


@dataclass(frozen=True)
class HashEncoder:
    """Stand-in: each word adds one to a bin of the vector; term weights are counts."""

    width: int = 32
    identity: str = "hash-encoder-1"

    def encode(self, texts: Sequence[str]) -> tuple[list[list[float]], list[dict[str, float]]]:
        import zlib

        dense, sparse = [], []
        for text in texts:
            vector, weights = [0.0] * self.width, {}
            for word in (text or "").lower().split():
                vector[zlib.crc32(word.encode()) % self.width] += 1.0
                weights[word] = weights.get(word, 0.0) + 1.0
            dense.append(vector)
            sparse.append(weights)
        return dense, sparse


def encode(df: DataFrame, encoder: Encoder, id_col: str, text_col: str, batch: int = 8) -> DataFrame:
    """id, embedding, weights for each row; the encoder is set up once in each task and sees batches of texts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            dense, sparse = [], []
            for k in range(0, len(part), batch):
                d, s = encoder.encode(part["text"].iloc[k : k + batch].fillna("").tolist())
                dense += d
                sparse += s
            yield pd.DataFrame({"id": part["id"], "embedding": dense, "weights": sparse})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, embedding array<float>, weights map<string,double>").withColumnRenamed("id", id_col)


def overlap_reranker(query: Column, text: Column) -> Column:
    return token_overlap(query, text)


@dataclass
class ScriptedModel:
    """Stand-in: answers each role with the next of its scripted replies, and keeps what it was asked."""

    replies: dict[str, list[dict]]
    identity: str = "scripted-1"
    calls: list[dict] = field(default_factory=list)

    def reply(self, role: str, payload: dict) -> dict:
        began = time.perf_counter()
        left = self.replies.get(role, [])
        status = "ok" if left else "empty"
        self.calls.append({"role": role, "payload": json.dumps(payload, default=str), "status": status, "seconds": time.perf_counter() - began})
        if not left:
            raise ValueError(f"{role}: empty reply")
        return left.pop(0) if len(left) > 1 else left[0]


@dataclass(frozen=True)
class RuleModel:
    """Stand-in without memory: rule(role, payload) is the reply. It can be sent to tasks."""

    rule: Callable[[str, dict], dict]
    identity: str = "rule-1"

    def reply(self, role: str, payload: dict) -> dict:
        return self.rule(role, payload)


def structured(model: LanguageModel, role: str, payload: dict, check: Callable[[dict], None], attempts: int = 2) -> dict:
    """A reply that passes check, with one repair: the second attempt is told what was wrong with the first."""
    for attempt in range(attempts):
        got = model.reply(role, payload)
        try:
            check(got)
            return got
        except (KeyError, TypeError, ValueError) as wrong:
            if attempt + 1 == attempts:
                raise
            payload = {**payload, "repair": str(wrong)}
    raise AssertionError
