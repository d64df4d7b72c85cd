"""Ranked lexical search over postings that are sharded by document.

Each task turns the documents that it reads into shards of a bounded number of bytes: compressed sparse rows, term by term, of document
places and whole-number impacts, worked out beforehand. Texts are never shuffled. A search sends the questions' terms, in blocks, to all shards. A shard
adds impacts term at a time into a dense array of its documents and gives out its best for each question, cut by
argpartition so that equal scores fall to the smaller identifier; the shards' lists are merged by rank.

All arithmetic on scores is in whole numbers, so neither the sharding nor the order of addition decides anything.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import LOWER, UPPER, materialize, named, small_batches

TOP = 50
#: A term is a longest run of characters that are no ASCII control, space or punctuation.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text after which a shard is closed, and bytes of one text that are split at a time.
SHARD_BYTES, SLICE = 16 << 20, 1 << 20
#: Terms of questions in a block, and in all blocks when these are sent to every task.
BLOCK_TERMS, BROADCAST_TERMS = 100_000, 2_000_000
#: Scale of an impact, and the numbers of the weighting: saturation per occurrence, weight of the length, share of the length that counts (hundredths).
SCALE, PER_TERM, PER_LENGTH, LENGTH_SHARE = 1_000_000_000, 1000, 20, 50

#: Lower-cases A-Z, and makes a space of every byte that no term holds.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SHARD = ["size", "terms", "frequency", "starts", "places", "impacts", "docs"]


@dataclass(frozen=True)
class Lexicon:
    """Shards of an index, the number of documents that hold a term, and that of all their terms."""

    shards: DataFrame
    documents: int
    terms: int


def lower_terms(text: Column) -> Column:
    """All terms of a text in a row, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def term_counts(body: bytes) -> tuple[Counter, int]:
    """Occurrences of the terms of a text, and their sum. A long text is split a slice at a time."""
    found, at = Counter(), 0
    while at < len(body):
        to = at + SLICE
        while to < len(body) and _BYTES[body[to]] != 32:
            to += 1
        found.update(body[at:to].translate(_BYTES).split())
        at = to
    return found, found.total()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a batch have a term, and how many terms they have: places where a term begins, found in all bytes of the batch at once."""
    inside = np.frombuffer(_BYTES, np.uint8) != 32
    for b in batches:
        bodies = b["body"]
        if not len(bodies):
            continue
        offsets = np.frombuffer(bodies.buffers()[1], np.int64 if pa.types.is_large_binary(bodies.type) else np.int32)[bodies.offset : bodies.offset + len(bodies) + 1]
        held = inside[np.frombuffer(bodies.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
        begins = held.copy()
        begins[1:] &= ~held[:-1]
        first = (offsets[:-1] - offsets[0])[offsets[:-1] < offsets[1:]]  # a text does not go on with the one before
        begins[first] = held[first]
        upto = np.concatenate(([0], np.cumsum(begins)))[offsets - offsets[0]]
        yield pa.RecordBatch.from_arrays([pa.array([int((np.diff(upto) > 0).sum())]), pa.array([int(upto[-1])])], ["documents", "terms"])
    pa.default_memory_pool().release_unused()


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SCALE * tf // (PER_TERM * tf + PER_LENGTH * m)


def length_measure(n: int, documents: int, terms: int) -> int:
    return 100 - LENGTH_SHARE + LENGTH_SHARE * n * documents // terms


class _Shard:
    """Postings of the documents met so far, and their compressed rows."""

    def __init__(self, documents: int, terms: int) -> None:
        self.totals = documents, terms
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.columns: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs: list = []
        self.size = 0

    def add(self, doc: pa.Scalar, body: bytes) -> None:
        counts, n = term_counts(body)
        if not n:
            return
        known = self.known
        ids = np.fromiter((known.setdefault(t, len(known)) for t in counts), np.int32, len(counts))
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        m = length_measure(n, *self.totals)
        self.columns.append((ids, impacts(tf, np.int64(m)).astype(np.int32)))
        self.docs.append(doc)
        self.size += len(body)

    def close(self, kind: pa.DataType) -> pa.RecordBatch:
        """The shard as one row: documents in the order of their identifiers (none last), terms in that of their bytes."""
        docs = pa.array(self.docs, kind)
        order = pc.sort_indices(docs, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        names = pa.array(list(self.known), pa.binary())
        rank = np.empty(len(names), np.int32)
        by_name = pc.sort_indices(names)
        rank[by_name.to_numpy()] = np.arange(len(names), dtype=np.int32)
        term = rank[np.concatenate([c[0] for c in self.columns])]
        where = np.repeat(place, [len(c[0]) for c in self.columns])
        impact = np.concatenate([c[1] for c in self.columns])
        sort = np.lexsort((where, term))
        frequency = np.bincount(term, minlength=len(names)).astype("<i4")
        starts = np.concatenate(([0], np.cumsum(frequency, dtype=np.int64))).astype("<i8")
        ids = docs.take(pa.array(order))
        one = lambda x: pa.array([x.tobytes()], pa.binary())
        wrap = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        row = [pa.array([len(docs)], pa.int64()), wrap(names.take(by_name)), wrap(pa.array(frequency, pa.int32())), one(starts), one(where[sort].astype("<i4")), one(impact[sort].astype("<i4")), wrap(ids)]
        self.clear()
        return pa.RecordBatch.from_arrays(row, _SHARD)


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Postings of all terms of all rows, in shards that are written to the shared folder.

    A null text has no term; a row without terms is in no shard and counts nowhere. Every row is a document of its own, whatever its identifier. Two passes
    over the texts: totals first, since impacts depend on them.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(named(id_col).alias("doc"), named(text_col).cast("string").alias("body")).where("body IS NOT NULL")
    each = rows.select(F.col("body").cast("binary").alias("body")).mapInArrow(_counted, "documents long, terms long")
    totals = each.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    documents, terms = totals["documents"], totals["terms"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, kind = _Shard(documents, terms), None
        for b in batches:
            kind = b["doc"].type
            for doc, body in zip(b["doc"], b["body"], strict=True):
                shard.add(doc.as_py(), body.as_buffer().to_pybytes())
                if shard.size >= SHARD_BYTES:
                    yield shard.close(kind)
        if shard.docs:
            yield shard.close(kind)
        pa.default_memory_pool().release_unused()

    kind = dict(rows.dtypes)["doc"]
    shards = rows.select("doc", F.col("body").cast("binary").alias("body")).mapInArrow(cut, f"size long, terms array<binary>, frequency array<int>, starts binary, places binary, impacts binary, docs array<{kind}>")
    return Lexicon(materialize(shards, "lexical-shards", {"parquet.block.size": str(32 << 20), "compression": "zstd"}), documents, terms)


def document_frequencies(index: Lexicon, terms: DataFrame) -> DataFrame:
    """term, df over all shards, for the terms (binary) of a table that has each of them once. Reads the shards' dictionaries alone."""
    entries = index.shards.select(F.explode(F.arrays_zip("terms", "frequency")).alias("e")).select(F.col("e.terms").alias("term"), F.col("e.frequency").cast("long").alias("frequency"))
    return entries.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("frequency").alias("df"))


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, in any order; of equal ones at the edge the first places."""
    at = np.flatnonzero(score)
    if len(at) <= k:
        return at
    here = score[at]
    edge = here[np.argpartition(here, len(here) - k)[len(here) - k]]
    above = at[here > edge]
    return np.concatenate((above, at[here == edge][: k - len(above)]))


def _search(k: int, kind: pa.DataType | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                row = {c: b[c][r] for c in b.schema.names}
                names = row["terms"].values
                asked, wanted, weight = row["item"].values, row["term"].values, row["weight"].values.to_numpy()
                starts, places, impact = (np.frombuffer(row[c].as_buffer(), t) for c, t in (("starts", "<i8"), ("places", "<i4"), ("impacts", "<i4")))
                found = pc.index_in(wanted, value_set=names).to_numpy(zero_copy_only=False)
                edges = row["cuts"].values.to_numpy()
                score, items, at, scores = np.zeros(row["size"].as_py(), np.int64), [], [], []
                for q, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    here = found[a:z]
                    if np.isnan(here).all():
                        continue
                    score[:] = 0
                    for t, w in zip(here.tolist(), weight[a:z].tolist(), strict=True):
                        if t == t:
                            x, y = starts[int(t)], starts[int(t) + 1]
                            score[places[x:y]] += w * impact[x:y].astype(np.int64)
                    best = _best(score, k)
                    items.append(np.full(len(best), q))
                    at.append(best)
                    scores.append(score[best])
                if items:
                    q, p = np.concatenate(items), np.concatenate(at)
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(q)), row["docs"].values.take(pa.array(p)), pa.array(np.concatenate(scores))], ["item", "doc", "score"])

    return run


def search(index: Lexicon, questions: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, rank, doc, score: for each item the k documents of highest score above 0, equal scores by ascending identifier (none last).

    An item's terms are those of all rows that name it, once each; a null text adds none, and rows without an item's identifier
    are one item. Items without a term that occurs give no rows. Items go in blocks against all shards; their number changes neither the plan nor what the
    driver holds, which is two counts.
    """
    spark = questions.sparkSession
    asked = questions.select(named(id_col).alias("item"), F.explode(lower_terms(named(text_col).cast("string")).cast("array<binary>")).alias("term")).distinct()
    asked = materialize(asked, "lexical-questions")
    total = asked.count()
    few = F.broadcast if total <= BROADCAST_TERMS else lambda df: df
    frequency = document_frequencies(index, few(asked.select("term").distinct()))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked.join(frequency, "term").select("item", "term", weight.alias("weight"))
    per_item = weighted.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("t"))
    blocks = max(1, -(-total // BLOCK_TERMS))
    grouped = per_item.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("item", "t")).alias("q"))
    flat = F.flatten("q.t")
    cuts = F.aggregate(F.col("q"), F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.size(x["t"]))))
    block = materialize(grouped.select(F.col("q.item").alias("item"), flat.alias("t"), cuts.alias("cuts")).select("item", F.col("t.term").alias("term"), F.col("t.weight").alias("weight"), "cuts"), "lexical-blocks")
    met = index.shards.select("size", "terms", "starts", "places", "impacts", "docs").crossJoin(few(block))  # a stated set of questions, in blocks, against all shards
    kinds = dict(asked.dtypes)["item"], dict(index.shards.dtypes)["docs"].removeprefix("array<").removesuffix(">")
    found = met.mapInArrow(_search(k), f"item {kinds[0]}, doc {kinds[1]}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "doc", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = search(build_index(docs), items)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
 p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY ALL), g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
 m AS (SELECT doc_id, 100 - 50 + (50 * n * docs) // terms AS m FROM n, g), d AS (SELECT term, count(*) AS df FROM p GROUP BY ALL),
 w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM d, g),
 q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
 r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""
