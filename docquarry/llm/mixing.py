"""Mixing sources to target weights by Pfair scheduling of blocks.

A source's documents, in a seeded random order, form blocks of equal row counts. With weight w, block j of a
source is released at slot floor(j / w) and due by slot ceil((j + 1) / w); earliest deadline first keeps every source
within less than one block of its weight at every slot. Weights are exact fractions, so nothing drifts however long the
schedule is. Blocks, not rows, are scheduled: the driver keeps a count for each source at the start of every epoch of
slots, and tasks work out the epochs side by side from these counts.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import materialize, named, quoted

#: Rows in a block, rows in one window group, blocks in an epoch, and sources up to which their table is broadcast.
BLOCK_ROWS, GROUP_ROWS, EPOCH, FEW_SOURCES = 32, 4_000, 1 << 16, 100_000


def whole_weights(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of weights (floats are fractions of powers of two)."""
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(1, *(w.denominator for w in exact))
    return [int(w * scale) for w in exact]


def pfair(share: list[int], blocks: list[int], counts: list[int], slot: int, upto: int) -> tuple[list[tuple[int, int, int]], int]:
    """The next blocks, upto at most, as (source, block, slot), and the slot behind them; counts goes on with them.

    counts: blocks of each source that have been scheduled. A slot for which only sources that have run dry had a block is skipped.
    """
    total = sum(share)
    released = lambda k: counts[k] * total // share[k]
    due = lambda k: -(-(counts[k] + 1) * total // share[k])
    ready: list[tuple[int, int]] = []
    later: list[tuple[int, int]] = []
    for k in range(len(share)):
        if counts[k] < blocks[k]:
            heapq.heappush(*((ready, (due(k), k)) if released(k) <= slot else (later, (released(k), k))))
    out: list[tuple[int, int, int]] = []
    while len(out) < upto and (ready or later):
        if not ready:
            slot = max(slot, later[0][0])
        while later and later[0][0] <= slot:
            k = heapq.heappop(later)[1]
            heapq.heappush(ready, (due(k), k))
        k = heapq.heappop(ready)[1]
        out.append((k, counts[k], slot))
        counts[k] += 1
        slot += 1
        if counts[k] < blocks[k]:
            heapq.heappush(*((ready, (due(k), k)) if released(k) <= slot else (later, (released(k), k))))
    return out, slot


def epochs(share: list[int], blocks: list[int], size: int) -> Iterator[tuple[int, int, list[int]]]:
    """(blocks before, first slot, counts) at the start of each epoch of size blocks."""
    counts, slot, total = [0] * len(share), 0, sum(blocks)
    for done in range(0, total, size):
        yield done, slot, list(counts)
        if done + size >= total:
            break
        left = [k for k in range(len(share)) if counts[k] < blocks[k]]
        if len(left) == 1:  # the last source stands at its releases: no need to walk
            k = left[0]
            counts[k] += size
            slot = max(slot + size, (counts[k] - 1) * sum(share) // share[k] + 1)
        else:
            _, slot = pfair(share, blocks, counts, slot, size)


def _slots(spark: SparkSession, share: list[int], blocks: list[int], size: int) -> DataFrame:
    """k (number of the source), block, slot, turn (blocks before it), on_target of every block."""
    sent = spark.sparkContext.broadcast((share, blocks))  # two numbers a source
    starts = [(d, str(s), bytearray(np.array(c, np.int64).tobytes())) for d, s, c in epochs(share, blocks, size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, blocks = sent.value
        for b in batches:
            for done, slot, counts in zip(b["done"].to_pylist(), b["slot"].to_pylist(), b["counts"].to_pylist(), strict=True):
                now = np.frombuffer(counts, np.int64).tolist()
                dry = any(c >= n for c, n in zip(now, blocks, strict=True))
                made, _ = pfair(share, blocks, now, int(slot), size)
                k, block, at = np.array(made, np.int64).reshape(-1, 3).T
                last = np.flatnonzero(block + 1 == np.array(blocks)[k])
                good = np.zeros(len(k), bool) if dry else np.arange(len(k)) <= (last[0] if len(last) else len(k))
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(block), pa.array(at), pa.array(done + np.arange(len(k))), pa.array(good)], ["k", "block", "slot", "turn", "on_target"])

    table = spark.createDataFrame(starts, "done long, slot string, counts binary")
    return materialize(table.repartition(max(1, len(starts)), "done").mapInArrow(run, "k int, block long, slot long, turn long, on_target boolean"), "mix-slots")


def _name(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _split_hot(dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dealt, sizes: k, grp, size) with no group much above GROUP_ROWS. Rows of one identifier, or without any, share a group; where they are too many
    for it they are told apart by their place in a written table, and groups of their own stand in that group's place."""
    sizes = dealt.groupBy("k", "grp").agg(F.count(F.lit(1)).alias("size"))
    hot = sizes.where(F.col("size") > 2 * GROUP_ROWS)
    if hot.isEmpty():
        return dealt, sizes
    kept = materialize(dealt.withColumn("uid", F.monotonically_increasing_id()), "mix-rows")
    parts = materialize(hot.select("k", "grp", F.ceil(F.col("size") / GROUP_ROWS).alias("parts")), "mix-hot")
    split = kept.join(parts, ["k", "grp"], "left").withColumn("sub", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("uid"), F.col("parts"))))
    split = split.withColumn("grp", F.struct("grp", "sub")).drop("uid", "parts", "sub")
    return split, split.groupBy("k", "grp").agg(F.count(F.lit(1)).alias("size"))


def mix_sources(df: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
                block_rows: int = BLOCK_ROWS, epoch: int = EPOCH, seed: int = 11) -> DataFrame:
    """Every row of df, as struct column row, with source, block, slot, turn, nth, place and on_target.

    weights: target share of each source (None names the rows without one), positive; sources left out weigh as the least
    of those given, and where none are given all weigh the square root of their row count. The order is (slot, place).
    No row is dropped or repeated: when a source runs dry the slots that would be its own stay empty and the others keep
    their proportions; on_target is true for the slots up to where the first source ends, within which the targets hold to
    less than one block. turn counts the blocks before a block's slot, so it has no gaps. Repeated rows are mixed like
    others; rows of one identifier stand together in their source (near one another, if
    they are more than a group holds), in no fixed order among themselves. The driver holds two numbers a
    source. An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = df.select(F.struct(*[named(c).alias(c) for c in df.columns]).alias("row"), _name(named(source_col)).alias("src"), F.xxhash64(named(id_col), F.lit(seed)).alias("toss"))
    counts = sorted((r["src"], r["n"]) for r in rows.groupBy("src").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a source
    given = {"" if k is None else f"={k}": float(w) for k, w in (weights or {}).items()}
    if any(not 0 < w < math.inf for w in given.values()):
        raise ValueError("weights are positive numbers")
    share = whole_weights([given.get(src, min(given.values())) if given else n**0.5 for src, n in counts])
    slots = _slots(spark, share, [-(-n // block_rows) for _, n in counts], max(epoch, 16 * len(counts)))
    plan = spark.createDataFrame([(src, k, -(-n // GROUP_ROWS)) for k, (src, n) in enumerate(counts)], "src string, k int, groups long")
    dealt = rows.join(F.broadcast(plan) if len(counts) <= FEW_SOURCES else plan, "src").withColumn("grp", F.pmod(F.shiftrightunsigned("toss", 7), F.col("groups")))
    dealt, sizes = _split_hot(dealt)
    before = sizes.select("k", "grp", (F.sum("size").over(Window.partitionBy("k").orderBy("grp")) - F.col("size")).alias("before"))
    number = F.row_number().over(Window.partitionBy("k", "grp").orderBy("toss", F.col(f"row.{quoted(id_col)}"))) - 1
    ranked = dealt.withColumn("rn", number).join(before, ["k", "grp"]).withColumn("nth", (F.col("before") + F.col("rn")).cast("long"))
    placed = ranked.withColumn("block", F.floor(F.col("nth") / block_rows)).join(slots, ["k", "block"])
    return placed.select("row", F.col(f"row.{quoted(source_col)}").alias("source"), "block", "slot", "turn", "nth", (F.col("nth") % block_rows).cast("int").alias("place"), "on_target")


def in_mixed_order(df: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """df in the mixed order: range-partitioned by slot and sorted, so files read one after another give the mixture."""
    mixed = mix_sources(df, weights, id_col, source_col)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(n, "turn", "place").sortWithinPartitions("turn", "place").select("row.*")


def with_turns(df: DataFrame, turn: str, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """df and, in a column named turn, each row's place in the mixed order: whole numbers, no two alike, gaps only where a source's last block is short."""
    mixed = mix_sources(df, weights, id_col, source_col)
    return mixed.select("row.*", (F.col("turn") * BLOCK_ROWS + F.col("place")).alias(turn))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix_sources(docs).select(F.col("row.doc_id").alias("doc_id"), "source", "block", "slot", "place", "on_target")
