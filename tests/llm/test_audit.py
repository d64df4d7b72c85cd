"""The filter audit against filters applied one after another."""

from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict

import pytest

from docquarry.llm import filter_audit


def plain_flags(docs):
    """Failures of (doc_id, text, lang) rows, straight from their definitions."""
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append((lang or "", {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}, d))
    return out


def replay(flags, good, toxic):
    parts = defaultdict(list)
    for part, fails, d in flags:
        parts[part].append((fails, d in good, d in toxic))
    out = set()
    for part, rows in parts.items():
        share, steps = defaultdict(int), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if r[0][f]], [r for r in left if not r[0][f]]
                share[f] += len(gone)
                alone = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                steps.append((order, step, f, len(left), len(gone), sum(r[0][f] for r in rows) - len(gone), alone, sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out |= {(part, *s, share[s[2]]) for s in steps}
    return out


def corpus(seed):
    draw = random.Random(seed)
    rows = []
    for k in range(250):
        n = draw.choice([0, 5, 99, 100, 101, 180])
        pool = [f"w{j}" for j in range(draw.choice([20, 90, 400]))]
        text = draw.choice([" ", "\n", "\x0b\x0c", "\t "]).join(draw.choice(pool) for _ in range(n))
        text = text.upper() if draw.random() < 0.2 else text + draw.choice(["", "", " $", "|", "   x "])
        rows.append((draw.choice([k, k, k, 7, None]), draw.choice([text, text, None]), draw.choice(["en", "en", "fr", None, ""])))
    for k in range(120):
        rows.append((1000 + k, "one text in many copies " * 30, draw.choice(["en", "fr", None])))
    return rows + [(1000, "one text in many copies " * 30, "de"), (None, "one text in many copies " * 30, "de")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_replayed_orders(spark, seed):
    rows = corpus(seed)
    draw = random.Random(seed)
    labels = [(k, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for k in [*range(0, 250, 2), *range(1000, 1050), 7, 7, None]]
    good, toxic = ({d for d, *v in labels if v[i] == 1 and d is not None} for i in (0, 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    flagged = filter_audit.flagged(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = filter_audit.audit(flagged).collect()
    want = replay(plain_flags(rows), good, toxic)
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_any_filters(spark):
    """Three filters of one's own; a null flag passes."""
    rows = [("p", True, False, None, 5, 1), ("p", True, True, True, 2, 0), ("p", False, False, False, 9, 4), ("p", None, True, False, 1, 1)]
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(spark.createDataFrame(rows, "part string, x boolean, y boolean, z boolean, n long, w long"), "xyz", ("w",)).collect()}
    assert len(got) == 18
    r = got["xyz", 2]
    assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["w_lost"]) == (9, 1, 2, 1, 1)
    assert {f: next(r["shapley"] for r in got.values() if r["filter"] == f) for f in "xyz"} == {"x": 34, "y": 10, "z": 4}
    with pytest.raises(ValueError):
        filter_audit.audit(spark.createDataFrame(rows, "part string, x boolean, y boolean, z boolean, n long, w long"), "xx", ("w",))
