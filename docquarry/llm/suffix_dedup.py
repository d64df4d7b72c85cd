"""Repeated substrings by enhanced suffix arrays over groups of suffixes.

A suffix belongs to the group of its first SPAN bytes' minimiser: the 64-byte gram with the smallest hash in them. Two
suffixes that share SPAN bytes share the minimiser, so all occurrences of a repeat meet in one group, and neighbouring
suffixes with one minimiser travel as one stretch of text. Groups that hold one stretch once hold no repeat and go
early; of equal stretches one travels, with their number as its weight. Each group becomes a small sorted suffix array, whose
common-prefix intervals are found with a stack; an interval whose suffixes differ in the byte before them is a maximal
repeat, and all its occurrences are given out. The array of a group whose stretches are all equal is that stretch,
weighted, and its one maximal repeat the whole of it, so its text need not be fetched.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import Rows, distinct_texts, materialize

SPAN, GRAM = 200, 64
#: Different stretches that one suffix array takes, 3 MB of text; a group with more counts its windows by hash, in the shuffle.
GROUP = 8192
_CHUNK, _LOW = 1 << 19, np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(64).integers(0, 2**64, 256, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _CHUNK + SPAN), _powers(_INVERSE, _CHUNK + SPAN)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each gram of data, by differences of running sums."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _DOWN[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _UP[: len(sums) - gram]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every width neighbours, by doubling."""
    step = 1
    while step * 2 <= width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    rest = width - step
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def stretches(body: bytes, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group key, first suffix and number of suffixes of each stretch of body."""
    keys, firsts, counts = [], [], []
    for base in range(0, max(1, len(body) - span + 1), _CHUNK):
        data = np.frombuffer(body, np.uint8, min(len(body) - base, _CHUNK + span - 1), base) if body else np.zeros(0, np.uint8)
        if len(data) < span:
            continue
        h = gram_hashes(data, gram)
        at = (sliding_minimum((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), span - gram + 1) & _LOW).astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        keys.append(h[at[cut]].view(np.int64))
        firsts.append(cut + base)
        counts.append(np.diff(np.append(cut, len(at))))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *keys]), np.concatenate([none, *firsts]), np.concatenate([none, *counts])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = Rows(["akey"])
    for batch in batches:
        for body in batch["body"].to_pylist():
            yield from rows.add([stretches(body)[0]])
    yield from rows.flush()


def _marks(body: bytes, first: list[int], stop: list[int]) -> np.ndarray:
    """128 bits of a cryptographic hash for each body[first:stop]: equal marks stand for equal bytes at any corpus size."""
    full = hashlib.blake2b
    return np.frombuffer(b"".join([full(body[x:y], digest_size=16).digest() for x, y in zip(first, stop, strict=True)]), np.int64).reshape(-1, 2)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = Rows(["akey", "hi", "lo", "tid", "first", "n"])
    for batch in batches:
        for tid, body in zip(batch["tid"].to_pylist(), batch["body"].to_pylist(), strict=True):
            key, first, n = stretches(body)
            if len(key):
                marks = _marks(body, first.tolist(), (first + n - 1 + SPAN).tolist())
                yield from rows.add([key, marks[:, 0], marks[:, 1], np.full(len(key), tid), first.astype(np.int32), n.astype(np.int32)])
    yield from rows.flush()


def suffix_array(parts: list[tuple[bytes, int]], span: int = SPAN) -> tuple[list[tuple[int, int]], list[int]]:
    """Suffixes (part, offset) of the parts in order, and the common prefix of each with the one before (0 where shorter than span)."""
    buckets: dict[bytes, list[tuple[int, int]]] = {}
    for p, (body, n) in enumerate(parts):
        for j in range(n):
            buckets.setdefault(body[j : j + 2], []).append((p, j))
    where: list[tuple[int, int]] = []
    common: list[int] = []
    for first in sorted(buckets):  # the suffixes of one bucket at a time are in memory
        mine = [(parts[p][0][j:], p, j) for p, j in buckets.pop(first)]
        mine.sort()
        where += [(p, j) for _, p, j in mine]
        common.append(0)
        for (x, _, _), (y, _, _) in itertools.pairwise(mine):
            if x[:span] != y[:span]:
                common.append(0)
                continue
            low, high = span, min(len(x), len(y))
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if x[span:mid] == y[span:mid] else (low, mid - 1)
            common.append(low)
    return where, common


_DIVERSE = -1


def repeat_intervals(parts: list[tuple[bytes, int]], weights: list[int], span: int = SPAN) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """The suffixes (part, offset) in order, and (length, left, right) of each maximal repeat: suffixes left to right - 1 share that length.

    Intervals within others come before these. Each carries whether its suffixes have one byte before them, handed on from
    the intervals within it, so the scan is linear. A part of weight two or more is a repeat as a whole. Before a part stands
    a byte of its own.
    """
    where, common = suffix_array(parts, span)
    before = [parts[p][0][j - 1] if j else _DIVERSE if weights[p] > 1 else _DIVERSE - 1 - p for p, j in where]
    found = [(len(parts[p][0]), i, i + 1) for i, (p, j) in enumerate(where) if not j and weights[p] > 1]
    stack: list[list[int]] = [[0, 0, before[0] if before else 0]]  # length, left, the byte before all or _DIVERSE
    for i in range(1, len(where) + 1):
        now, left, sign = common[i] if i < len(where) else 0, i - 1, before[i - 1]
        while stack[-1][0] > now:
            length, left, mine = stack.pop()
            sign = mine if mine == sign else _DIVERSE
            if sign == _DIVERSE:
                found.append((length, left, i))
        if stack[-1][0] < now:
            stack.append([now, left, sign])
        elif stack[-1][2] != sign:
            stack[-1][2] = _DIVERSE
    return where, found


def maximal_repeats(parts: list[tuple[bytes, int]], span: int = SPAN) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Length and all occurrences (part, offset) of each maximal repeat of at least span bytes among the parts' first n suffixes."""
    where, found = repeat_intervals(parts, [1] * len(parts), span)
    for length, left, right in found:
        yield length, where[left:right]


def covered(parts: list[tuple[bytes, int]], weights: list[int], span: int = SPAN) -> list[list[tuple[int, int]]]:
    """The byte spans of each part that its maximal repeats cover. Of the repeats at one suffix the longest is taken: it comes first."""
    where, found = repeat_intervals(parts, weights, span)
    spans: list[list[tuple[int, int]]] = [[] for _ in parts]
    after = list(range(len(where) + 1))  # the next suffix from here on that no repeat has taken
    for length, left, right in found:
        i = left
        trail = []
        while True:
            while after[i] != i:
                trail.append(i)
                i = after[i]
            if i >= right:
                break
            p, j = where[i]
            spans[p].append((j, j + length))
            after[i] = i + 1
        for x in trail:
            after[x] = i
    return [_merged(s) for s in spans]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_KEYS = ["akey", "hi", "lo"]
_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _group_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted stretches -> the byte spans of each that maximal repeats of its group cover."""
    rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in (*_KEYS, "c", "n", "body")), strict=True))
    out: list[tuple] = []
    for key, group in itertools.groupby(rows, key=lambda r: r[0]):
        held = list(group)  # GROUP at most
        spans = covered([(r[5], r[4]) for r in held], [r[3] for r in held])
        out += [(key, r[1], r[2], [{"a": a, "b": b} for a, b in s]) for r, s in zip(held, spans, strict=True) if s]
        if len(out) >= 2000:
            yield _span_batch(out)
            out = []
    if out:
        yield _span_batch(out)


def _span_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int64(), _SPANS], strict=True)], [*_KEYS, "spans"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*_KEYS, "c", "whi", "wlo", "j"]
    for b in batches:
        for *keys, c, n, body in zip(*(b[x].to_pylist() for x in (*_KEYS, "c", "n", "body")), strict=True):
            marks = _marks(body, list(range(n)), list(range(SPAN, n + SPAN)))
            fixed = [pa.array(np.full(n, v, np.int64)) for v in (*keys, c)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.ascontiguousarray(marks[:, 0])), pa.array(np.ascontiguousarray(marks[:, 1])), pa.array(np.arange(n, dtype=np.int32))], names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of the bodies that rows name: akey, hi, lo, c, kinds, n, body."""
    for b in batches:
        body = [b["body"][k].as_py()[(f := b["first"][k].as_py()) : f + b["n"][k].as_py() - 1 + SPAN] for k in range(len(b))]
        yield pa.RecordBatch.from_arrays([*(b[c] for c in (*_KEYS, "c", "kinds", "n")), pa.array(body, pa.binary())], [*_KEYS, "c", "kinds", "n", "body"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for tid, body, copies, spans in zip(*(b[c].to_pylist() for c in ("tid", "body", "copies", "spans")), strict=True):
            gone = [(0, len(body))] if copies > 1 and len(body) >= SPAN else _merged([(s["a"], s["b"]) for s in spans or ()])
            left, digest = 0, hashlib.sha256()
            for x, y in gone:
                digest.update(body[left:x])
                left = y
            digest.update(body[left:])
            out.append((tid, len(body), sum(y - x for x, y in gone), len(gone), digest.hexdigest(), [{"a": x, "b": y} for x, y in gone]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPANS]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], ["tid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def covered_spans(texts: DataFrame) -> DataFrame:
    """texts (tid, body) of distinct bodies -> tid, spans: byte spans that repeats of SPAN bytes or more cover, not yet merged."""
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    layout = "akey long, hi long, lo long, tid long, first int, n int"
    every = texts.select("tid", "body").mapInArrow(_emit, layout)
    anchors = texts.select("body").mapInArrow(_anchors, "akey long")
    shared = materialize(anchors.groupBy("akey").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("akey"), "anchors")
    met = materialize(every.join(shared.hint("merge"), "akey"), "stretches")
    kinds = met.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n"), F.min(F.struct("tid", "first")).alias("at"))
    kinds = materialize(kinds, "stretch-kinds")
    counts = kinds.groupBy("akey").agg(F.count(F.lit(1)).alias("kinds"))
    counted = kinds.join(counts, "akey").select(*_KEYS, "kinds", "c", "n", F.col("at.tid").alias("tid"), F.col("at.first").alias("first"))
    bodies = counted.where("kinds > 1").join(texts.select("tid", "body").hint("merge"), "tid")
    bodies = materialize(bodies.select(*_KEYS, "c", "kinds", "n", "first", "body").mapInArrow(_cut, "akey long, hi long, lo long, c long, kinds long, n int, body binary"), "stretch-bodies")
    kind = "akey long, hi long, lo long, spans array<struct<a:int,b:int>>"
    small = bodies.where(F.col("kinds") <= GROUP).drop("kinds").repartition(n, "akey").sortWithinPartitions("akey")
    arrays = small.mapInArrow(_group_repeats, kind)
    windows = bodies.where(F.col("kinds") > GROUP).select(*_KEYS, "c", "n", "body").mapInArrow(_windows, "akey long, hi long, lo long, c long, whi long, wlo long, j int")
    twice = windows.groupBy("whi", "wlo").agg(F.sum("c").alias("all")).where("all > 1").select("whi", "wlo")
    hashed = windows.join(twice, ["whi", "wlo"]).groupBy(*_KEYS).agg(F.collect_list(F.struct(F.col("j").alias("a"), (F.col("j") + SPAN).alias("b"))).alias("spans"))
    equal = counted.where("kinds = 1 and c > 1").select(*_KEYS, F.array(F.struct(F.lit(0).alias("a"), (F.col("n") + (SPAN - 1)).alias("b"))).alias("spans"))
    found = materialize(equal.unionByName(arrays).unionByName(hashed), "stretch-spans")
    at = met.join(found.hint("merge"), _KEYS).select("tid", "first", F.explode("spans").alias("s"))
    return at.groupBy("tid").agg(F.collect_list(F.struct((F.col("first") + F.col("s.a")).alias("a"), (F.col("first") + F.col("s.b")).alias("b"))).alias("spans"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, n_bytes, n_removed, n_spans, kept_sha256, removed (byte spans) for each row.

    A byte goes if a string of SPAN bytes that covers it starts anywhere else too, judged on the input; matches do not
    cross rows. Null texts are empty. Rows that repeat an identifier are rows like others, so a repeated text of SPAN bytes
    or more goes whole. An empty table gives an empty result.
    """
    texts, members = distinct_texts(df, id_col, text_col)
    spans = materialize(covered_spans(texts), "covered")
    done = texts.select("tid", "body", "copies").join(spans.hint("merge"), "tid", "left").select("tid", "body", "copies", "spans")
    done = materialize(done.mapInArrow(_removed, "tid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<a:int,b:int>>"), "kept")
    return members.join(done, "tid").select(F.col("member_id").alias("doc"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).drop("removed").withColumnRenamed("doc", "doc_id")
