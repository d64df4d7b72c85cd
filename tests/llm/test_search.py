"""Ranked search against a plain index."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from docquarry.llm import lexical

TERM = re.compile(lexical.TERM)


def terms_of(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, k=50):
    """(item, rank, doc, score) of every item, by the formulas alone."""
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, every = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, c in counts:
            m = 100 - 50 + 50 * c.total() * n // every
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def found(spark, docs, items, k=50):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = lexical.build_index(df)
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), k).collect()
    return sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0, r[1])), index


@pytest.mark.parametrize("shard", [16 << 20, 900])
@pytest.mark.parametrize("block", [100_000, 7])
def test_against_a_plain_index(spark, monkeypatch, shard, block):
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "SLICE", 64)
    draw = random.Random(3)
    word = lambda: draw.choice(["Été", "ÀB", "a", "b", "naïve", "X1"]) if draw.random() < 0.2 else f"w{min(300, int(draw.paretovariate(0.6)))}"
    docs = [(k * 3, draw.choice([" ", ", ", "_", "\x7f", "\n"]).join(word() for _ in range(draw.randint(1, 90)))) for k in range(200)]
    docs += [(k, "same words in every copy w1") for k in range(1, 300, 3)]  # far more ties than places
    docs += [(None, "same words w2"), (None, None), (7, None), (5, ""), (5, " ,;_ "), (9, "w1 " * 3000), (9, "w1 " * 3000)]
    items = [(k, " ".join(word() for _ in range(draw.randint(1, 12)))) for k in range(12)] + [(3, "copy words"), (20, None), (21, "unheard of"), (22, ""), (None, "w2"), (None, "same")]
    got, index = found(spark, docs, items, 20)
    assert got == plain(docs, items, 20)
    assert index.documents == sum(bool(terms_of(t)) for _, t in docs) and (index.shards.count() > 10) == (shard == 900)


def test_nothing_to_search(spark):
    assert found(spark, [], [(1, "a")])[0] == [] == found(spark, [(1, "a")], [])[0] == found(spark, [(1, None)], [(1, "a")])[0]


def test_cut_by_place_at_equal_scores():
    draw = np.random.default_rng(4)
    for _ in range(300):
        score = draw.integers(0, 5, draw.integers(0, 60))
        k = int(draw.integers(1, 12))
        want = sorted(np.flatnonzero(score), key=lambda p: (-score[p], p))[:k]
        assert sorted(lexical._best(score, k).tolist()) == sorted(want)


def test_scores_of_very_long_documents_stay_whole():
    assert lexical.length_measure(10**9, 10**12, 10**14) == 50 + 50 * 10**9 * 10**12 // 10**14
    big = lexical.length_measure(10**9, 10**12, 10**14)
    assert lexical.impacts(np.array([10**6]), np.int64(big)).tolist() == [10**15 // (10**9 + 20 * big)]
