"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits have a common neighbour at distance one or less from each.
Every distinct fingerprint emits the 65 members of its ball of radius one; the shuffle on these variants brings
the pair together. All fingerprints at one variant lie within two bits of each other, so a bucket holds 65 at most
whatever the corpus is, and linking each to the smallest of its bucket loses no component.

near_copies() finds texts whose five-word shingles are SIMILARITY alike. An edited word changes one word of a text but
five of its shingles, so its fingerprints are over single words, short, and several; each is hashed together with a smallest shingle of the text, which keeps
texts of common words apart. Pairs that collide in a ball are verified by the exact similarity of their shingles.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm import exact_dedup
from docquarry.llm.common import connected_components, materialize, named, small_batches

SEED, WIDTH, BITS = 42, 3, 64
#: Words of a shingle, similarity of near copies, short fingerprints over single words that propose them and their bits, smallest shingles that they are hashed with, and
#: rounds in which members of a bucket of rarest shingles meet one of its texts, before all that is left meets.
SHINGLE, SIMILARITY, TABLES, SHORT, SPLITS, ROUNDS = 5, 0.8, 2, 16, 3, 3
#: Bits of a sketch that tells pairs apart before their shingles are compared.
SKETCH = 512


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The SimHash of one text as an unsigned number; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        h = xxhash.xxh64_intdigest
        hashes = [h(line[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    packed = np.array(hashes, dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(packed), 65536):
        ones += np.unpackbits(packed[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(packed), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(x.as_py()) for x in batch["body"]), np.uint64, len(batch))
        yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(prints.view(np.int64))], ["doc", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, fp (the 64 bits as a signed long) for each row."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))
    kind = dict(rows.dtypes)["doc"]
    return rows.mapInArrow(_fingerprints, f"doc {kind}, fp long")


def ball_links(prints: DataFrame) -> DataFrame:
    """Distinct fp -> links (fp, other), each of at most two differing bits, that connect whatever such links connect."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(BITS)])
    variants = prints.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    shared = variants.groupBy("variant").agg(F.collect_set("fp").alias("ball")).where(F.size("ball") > 1)
    pairs = shared.select(F.array_min("ball").alias("other"), F.explode("ball").alias("fp")).where("fp <> other").distinct()
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2)


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, fp, component_id for each row; component_id is the smallest identifier reachable over links.

    Null texts and texts without words have fingerprint zero and link like any other. Rows that repeat an
    identifier come out once each. Equal fingerprints are one node however many rows share them. A null identifier is
    never a component's name unless the component has no other. An empty table gives an empty result.
    """
    return _rooted(df, id_col, text_col).select("doc", "fp", "component_id")


def _rooted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, fp, root (one fingerprint of the component), component_id for each row."""
    rows = materialize(fingerprints(df, id_col, text_col), "simhash")
    prints = rows.groupBy("fp").agg(F.min("doc").alias("least"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = connected_components(ball_links(prints.select("fp").repartition(n, F.xxhash64("fp"))), "fp", "other")  # n tasks emit the variants, however few bytes they read
    named = prints.join(groups, prints["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = materialize(named, "simhash-roots")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(names, "root").select("fp", "root", "component_id")
    return rows.join(by_print, "fp").select("doc", "fp", "root", "component_id")


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def short_fingerprints(hashes: np.ndarray) -> list[int]:
    """TABLES fingerprints of SHORT bits over the single words of a text, repeats included: blocks of one SimHash. Zeros without words."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(_mixed(hashes[k : k + 65536]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])
    return [bits >> SHORT * k & (1 << SHORT) - 1 for k in range(TABLES)]


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """The different hashes of the five-word shingles; of a shorter text that of all its words, of one without words a zero."""
    if not len(hashes):
        return np.zeros(1, np.uint64)
    width = min(SHINGLE, len(hashes))
    n = len(hashes) - width + 1
    line = np.full(n, SEED + width, np.uint64)
    for k in range(width):
        line = _mixed(line * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return np.unique(line)


def least_shingles(shingles: np.ndarray) -> list[int]:
    """The smallest shingle under each of SPLITS hash functions."""
    return [int((_mixed(shingles ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(1)).min()) for k in range(1, SPLITS + 1)]


def _near_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [word_hashes(x.as_py()) for x in b["body"]]
        prints = pa.array([short_fingerprints(w) for w in words], pa.list_(pa.int32()))
        least = pa.array([least_shingles(shingle_hashes(w)) for w in words], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b["doc"], b["digest"], prints, least], ["doc", "digest", "prints", "least"])
    pa.default_memory_pool().release_unused()


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_hashes(word_hashes(x.as_py())).tobytes() for x in b["body"]]
        yield pa.RecordBatch.from_arrays([b["nid"], pa.array(sets, pa.binary())], ["nid", "shingles"])
    pa.default_memory_pool().release_unused()


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for mine, theirs in zip(b["mine"], b["theirs"], strict=True):
            x, y = np.frombuffer(mine.as_py(), np.uint64), np.frombuffer(theirs.as_py(), np.uint64)
            if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
                keep.append(False)
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= SIMILARITY * (len(x) + len(y) - both))
        yield b.select(["member", "rep"]).filter(pa.array(keep, pa.bool_()))
    pa.default_memory_pool().release_unused()


def _relabelled(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """labels (nid, label: the smallest nid of its component) after more links (member, rep). Only the components that these links touch are worked out, as
    nodes of their own, so a round costs what it finds and not all links again."""
    if labels is None:
        return materialize(connected_components(found, "member", "rep").select(F.col("node").alias("nid"), F.col("component").alias("label")), "near-labels")
    of = lambda c: labels.select(F.col("nid").alias(c), F.col("label").alias(f"{c}_label"))
    ends = found.join(of("member"), "member", "left").join(of("rep"), "rep", "left")
    moved = connected_components(ends.select(F.coalesce("member_label", "member").alias("a"), F.coalesce("rep_label", "rep").alias("b")), "a", "b")
    # a label is the smallest nid of its component and has a row of its own, so what labels lack is a text that was alone
    both = labels.join(moved.withColumnRenamed("node", "label"), "label", "full_outer").select(F.coalesce("nid", "label").alias("nid"), F.coalesce("component", "label").alias("label"))
    return materialize(both, "near-labels")


def _unsettled(met: DataFrame, labels: DataFrame | None) -> DataFrame:
    """met with label (component by links) of the buckets whose members are not of one component yet."""
    rows = met.drop("label")
    labelled = rows.withColumn("label", F.col("nid")) if labels is None else rows.join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    apart = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    return materialize(labelled.join(apart, "bucket"), "near-open")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = np.fromiter((len(x.as_py()) // 8 for x in b["shingles"]), np.int64, len(b))
        flat = np.frombuffer(b"".join(x.as_py() for x in b["shingles"]), np.int64)
        told = [np.repeat(c, sizes) for c in (b["nid"].to_numpy(), b["label"].to_numpy(), sizes)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*told, flat)], ["nid", "label", "size", "bucket"])


def _needed(size, other):
    """Shingles that texts of these sizes must share to be SIMILARITY alike; a little less than the bound, for rounding in doubles."""
    return F.ceil((size + other) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6)


def _rarest(met: DataFrame, sets: DataFrame) -> DataFrame:
    """bucket, nid, label, nth, size: the texts of met by their rarest shingles, as many as two that are SIMILARITY alike must share one of: all but ceil(SIMILARITY * n), and one more.

    No alike texts of different components are lost. Shingles that one component alone has come first and need no rows; a text of which they fill all places is like
    none of another component.
    """
    held = sets.join(met.select("nid", "label").distinct(), "nid").select("nid", "label", "shingles")
    every = materialize(held.mapInArrow(_exploded, "nid long, label long, size long, bucket long"), "near-shingles")
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket", "n")
    held = every.join(shared, "bucket")
    of = Window.partitionBy("nid")
    alone = F.col("size") - F.count(F.lit(1)).over(of)
    # a little more than the bound, for rounding in doubles
    places = F.col("size") - F.ceil(F.col("size") * SIMILARITY - 1e-6) + 1
    nth = (F.row_number().over(of.orderBy("n", "bucket")) + alone).alias("nth")
    return held.select("bucket", "nid", "label", nth, "size", places.alias("places")).where("nth <= places").drop("places")


def _may_meet(nth, size, other_nth, other_size):
    """Whether texts of these sizes that are alike may first meet in shingles at these places: each has room for what both must share from there on."""
    need = _needed(size, other_size)
    return (nth <= size - need + 1) & (other_nth <= other_size - need + 1)


def _by_hub(met: DataFrame, turn: int) -> DataFrame:
    """member, rep: the texts of each bucket of rarest shingles with one of them, where they may be alike. The bucket's shingle stands first in the text that has the
    fewest rarer ones, which is the one that the others were made from or nearest to it; later turns take others."""
    first = F.struct(F.when(F.lit(turn == 0), F.col("nth")).otherwise(F.xxhash64("nid", F.lit(turn))).alias("turn"), "nid", "label", "nth", "size")
    reps = met.groupBy("bucket").agg(F.min(first).alias("r"))
    near = met.join(reps, "bucket").where((F.col("label") != F.col("r.label")) & _may_meet(F.col("nth"), F.col("size"), F.col("r.nth"), F.col("r.size")))
    return near.select(F.greatest("nid", "r.nid").alias("member"), F.least("nid", "r.nid").alias("rep")).distinct()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SKETCH bits of each text: whether an odd number of its shingles falls on the bit. What two texts share cancels out, so they differ in as many shingles as in bits, or more."""
    for b in batches:
        odd = [np.bincount((_mixed(np.frombuffer(x.as_py(), np.uint64)) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) % 2 for x in b["shingles"]]
        yield pa.RecordBatch.from_arrays([b["nid"], pa.array([np.packbits(o.astype(bool)).view(np.int64) for o in odd], pa.list_(pa.int64()))], ["nid", "sketch"])


def _across(met: DataFrame, sets: DataFrame) -> DataFrame:
    """member, rep: all pairs of members of different components that may be alike, by their places in a bucket and by their sketches. What is outside a bucket's
    largest component meets the whole bucket, so no pairs within the largest are ever made."""
    sketches = sets.join(met.select("nid").distinct(), "nid").select("nid", "shingles").mapInArrow(_sketches, "nid long, sketch array<long>")
    met = materialize(met.join(sketches, "nid"), "near-sketched")
    largest = met.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    others = met.join(largest, "bucket").where("label <> largest").select("bucket", *[F.col(c).alias(f"{c}_a") for c in ("nid", "label", "nth", "size", "sketch")])
    apart = functools.reduce(Column.__add__, [F.bit_count(F.col("sketch")[k].bitwiseXOR(F.col("sketch_a")[k])) for k in range(SKETCH // 64)])
    near = _may_meet(F.col("nth_a"), F.col("size_a"), F.col("nth"), F.col("size")) & (apart <= F.col("size_a") + F.col("size") - 2 * _needed(F.col("size_a"), F.col("size")))
    pairs = others.join(met, "bucket").where((F.col("label_a") != F.col("label")) & near)
    return pairs.select(F.greatest("nid_a", "nid").alias("member"), F.least("nid_a", "nid").alias("rep")).distinct()


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: doc, digest, nid of each row; links: member, rep, the nids of different texts that are SIMILARITY alike or more).

    Each distinct text emits the ball of radius one round each of its short fingerprints, once for each of its smallest shingles: two
    alike texts share one of SPLITS smallest shingles, and a fingerprint within two bits, with a probability that does not fall with their length. A
    variant that two texts have is a bucket, whose members are compared with first texts. Then the texts of buckets that are not
    joined yet meet by their rarest shingles: with the text of each bucket that is nearest to the others, and then in all pairs that no link joins yet and
    whose places and sketches allow it: every pair of a bucket is joined by links or unlike.
    """
    rows, links, _ = _near(df, id_col, text_col)
    return rows, links


def _near(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """near_copies() and labels (nid, label: the smallest nid that links reach) of the nids that have a link."""
    spark = df.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(named(id_col).alias("doc"), exact_dedup.digest_of(text_col).alias("digest"), exact_dedup.normalised(text_col).cast("binary").alias("body"))
    prints = materialize(rows.mapInArrow(_near_prints, f"doc {dict(rows.dtypes)['doc']}, digest binary, prints array<int>, least array<long>"), "near-prints")
    nodes = prints.groupBy("digest").agg(F.first("prints").alias("prints"), F.first("least").alias("least")).withColumn("nid", F.monotonically_increasing_id())
    nodes = materialize(nodes, "near-nodes")
    masks = F.array(F.lit(0), *[F.lit(1 << k) for k in range(SHORT)])
    every = nodes.repartition(n, F.xxhash64("nid")).select("nid", "least", F.posexplode("prints").alias("tab", "fp")).select("nid", "tab", "fp", F.posexplode("least").alias("fn", "low"))
    every = every.select("nid", "tab", "fp", "fn", "low", F.explode(masks).alias("mask")).select(F.xxhash64("tab", "fn", "low", F.col("fp").bitwiseXOR(F.col("mask"))).alias("bucket"), "nid")
    shared = every.groupBy("bucket").agg(F.min("nid").alias("n1"), F.max("nid").alias("n2")).where("n1 <> n2").select("bucket")
    shared = materialize(shared, "near-buckets")
    size = min(exact_dedup.filter_rows(shared.count()), exact_dedup.BROADCAST_ROWS)
    few = exact_dedup.probe(every.select(F.col("bucket").alias("digest"), "nid"), exact_dedup.build_filter(shared.withColumnRenamed("bucket", "digest"), size), size)
    met = materialize(few.withColumnRenamed("digest", "bucket").join(shared.hint("merge"), "bucket"), "near-members")
    wanted = materialize(met.select("nid").distinct().join(nodes.select("nid", "digest"), "nid"), "near-wanted")
    size = min(exact_dedup.filter_rows(wanted.count()), exact_dedup.BROADCAST_ROWS)
    bodies = exact_dedup.probe(rows.select("digest", "body"), exact_dedup.build_filter(wanted, size), size)
    bodies = bodies.groupBy("digest").agg(F.first("body").alias("body")).join(wanted.hint("merge"), "digest").select("nid", "body")
    sets = materialize(bodies.mapInArrow(_with_sets, "nid long, shingles binary"), "near-sets")
    side = lambda of, name: sets.select(F.col("nid").alias(of), F.col("shingles").alias(name)).hint("merge")
    links, tried, labels = [], [], None
    told = lambda tables: functools.reduce(DataFrame.unionByName, tables)

    def verified(pairs: DataFrame) -> bool:
        """Whether any of pairs, which are different from those before, are alike."""
        nonlocal labels
        both = pairs.join(side("member", "mine"), "member").join(side("rep", "theirs"), "rep").select("member", "rep", "mine", "theirs")
        found = materialize(both.mapInArrow(_alike, "member long, rep long"), "near-links")
        tried.append(pairs)
        if found.isEmpty():
            return False
        links.append(found)
        labels = _relabelled(labels, found)
        return True

    fresh = lambda pairs: pairs.join(told(tried), ["member", "rep"], "left_anti") if tried else pairs

    def by_first(met: DataFrame, turn: int) -> DataFrame:
        """Each member with two of its buckets' first texts."""
        reps = met.groupBy("bucket").agg(F.min(F.struct("nid", "label")).alias("r"))
        placed = met.join(reps, "bucket").where("label <> r.label").select(F.col("nid").alias("member"), F.col("r.nid").alias("rep"))
        return placed.groupBy("member").agg(F.array_distinct(F.array(F.min("rep"), F.max("rep"))).alias("reps")).select("member", F.explode("reps").alias("rep"))

    def rounds(met: DataFrame, proposed: Callable[[DataFrame, int], DataFrame], most: int) -> DataFrame:
        """What is unsettled of met after so many rounds at most, or once one finds no link."""
        met = _unsettled(met, labels)
        for turn in range(most):
            if not verified(materialize(fresh(proposed(met, turn)), "near-pairs")):
                break
            met = _unsettled(met, labels)
        return met

    left = rounds(rounds(met, by_first, 1).transform(_rarest, sets), _by_hub, ROUNDS)
    verified(materialize(fresh(_across(left, sets)), "near-rest"))
    none = lambda columns: spark.createDataFrame([], columns)
    return prints.select("doc", "digest").join(nodes.select("digest", "nid"), "digest"), told(links or [none("member long, rep long")]), none("nid long, label long") if labels is None else labels


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of texts that links of near_copies() connect: the one with the smallest identifier.

    Rows are judged one by one: different texts under one identifier, or under none, stay apart unless they are alike. A row without
    an identifier stays only if its whole group has none. Equal texts are one group; letter case A-Z makes no difference. Texts of fewer words than a
    shingle are alike if all their words are. An empty table gives an empty result.
    """
    rows, _, labels = _near(df, id_col, text_col)
    grouped = materialize(rows.join(labels, "nid", "left").select("doc", "digest", F.coalesce("label", "nid").alias("root")), "near-groups")
    first = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc").isNull(), "doc", "digest")).alias("one")).where("n > 1")
    decided = grouped.select("digest", "root").distinct().join(first, "root").select("digest", F.col("one.doc").alias("keep_id"), F.col("one.digest").alias("keep_digest"))
    return exact_dedup.keep_decided(df, id_col, text_col, materialize(decided, "near-decided"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = simhash_components(docs)
    return found.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
