"""Audit of text filters that a corpus passes one after another, in every order at once.

One aggregation counts, for each of the 2^k sets of filters, the rows that fail all filters of the set: a sum of products of
failure flags. Everything else is arithmetic on these joint-failure counts, a row for each part of the corpus:

* Möbius inversion (inclusion and exclusion) gives the rows that pass any set of filters, hence what each step of any order removes,
  what it leaves, and which failures it meets too late.
* The Harsanyi dividend of a set, in the game whose worth is the number of rows removed, is its joint-failure count with
  alternating sign; shared out evenly among the set's members it gives the Shapley value.

No order is replayed on rows, so k! orders cost what one does.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import UPPER, named, quoted

LETTERS = "ABCDE"
#: Bounds of the five filters: least words, least share of distinct words and greatest share of capitals (hundredths), characters of code or markup.
LEAST_WORDS, DISTINCT_SHARE, CAPITALS_SHARE, MARKUP = 100, 80, 10, "[#$%&*|]"
_SPACE = " \t\n\x0b\f\r"
#: Rows without an identifier meet no label and are dealt over so many keys on the way to the labels.
SALT = 4096
WEIGHTS = ("n", "good", "toxic")


def text_flags(words: Column, text: Column) -> dict[str, Column]:
    """The failure conditions that a text decides alone: too short, repetitive, capitals, markup. words: its words."""
    n, capitals = F.size(words), F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_SHARE * n,
        "C": 100 * capitals > CAPITALS_SHARE * F.char_length(text),
        "D": text.rlike(MARKUP),
    }


def flagged(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", label_id: str = "doc_id") -> DataFrame:
    """part, A to E (failures), n, good, toxic: how many rows of a text in a part have these flags, and how many of them are labelled so.

    A null text is the empty text, a null part the empty string. E fails where a smaller identifier has the same text anywhere in the
    table; a row without identifier never fails it, nor do the rows that share the smallest one. A row is good (toxic) if any row of labels says so
    (quality 1, toxic 1) of its identifier. Copies meet in the map tasks, by the digest of their text: a group of
    copies of any size is a row for each part by the time its smallest identifier is looked for.
    """
    said = labels.where(named(label_id).isNotNull()).groupBy(named(label_id).alias("label_of"))
    said = said.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    rows = df.select(named(id_col).alias("doc"), F.coalesce(named(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("body"))
    body = F.col("body")
    trimmed = F.btrim(body, F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))
    split = rows.select("doc", "part", "body", F.unhex(F.sha2(body, 256)).alias("digest"), words.alias("words"))
    one = split.select("doc", "part", "digest", *(c.alias(k) for k, c in text_flags(F.col("words"), body).items()))
    one = one.withColumn("salt", F.when(F.col("doc").isNull(), F.pmod(F.xxhash64("digest", F.monotonically_increasing_id()), F.lit(SALT))).otherwise(F.lit(0).cast("long")))
    met = one.join(said.withColumn("label_salt", F.lit(0).cast("long")), (F.col("doc") == F.col("label_of")) & (F.col("salt") == F.col("label_salt")), "left")
    flags = list(LETTERS[:4])
    sums = [F.sum(F.coalesce("is_good", F.lit(False)).cast("long")).alias("good"), F.sum(F.coalesce("is_toxic", F.lit(False)).cast("long")).alias("toxic")]
    by_id = met.groupBy("digest", "part", "doc").agg(F.count(F.lit(1)).alias("n"), *sums, *(F.max(c).alias(c) for c in flags))
    counts = F.struct(*WEIGHTS)
    missing = [F.coalesce(F.sum(F.when(F.col("doc").isNull(), F.col(w))), F.lit(0)).alias(f"{w}_missing") for w in WEIGHTS]
    groups = by_id.groupBy("digest", "part").agg(F.min("doc").alias("low"), F.min_by(counts, "doc").alias("first"), *missing, *(F.sum(w).alias(w) for w in WEIGHTS), *(F.max(c).alias(c) for c in flags))
    groups = groups.withColumn("least", F.min("low").over(Window.partitionBy("digest")))
    original = [(F.col(f"{w}_missing") + F.when(F.col("low") == F.col("least"), F.col(f"first.{w}")).otherwise(F.lit(0))).alias(w) for w in WEIGHTS]
    sides = groups.select("part", *flags, *(F.col(w).alias(f"all_{w}") for w in WEIGHTS), F.struct(*original).alias("kept"))
    side = lambda late: F.struct(F.lit(late).alias("E"), *((F.col(f"all_{w}") - F.col(f"kept.{w}") if late else F.col(f"kept.{w}")).alias(w) for w in WEIGHTS))
    return sides.select("part", *flags, F.explode(F.array(side(False), side(True))).alias("s")).select("part", *flags, "s.*").where("n > 0")


def joint_failures(rows: DataFrame, filters: Sequence[str] = LETTERS, weights: Sequence[str] = WEIGHTS) -> DataFrame:
    """part, and for each weight an array: at mask the weight of the rows that fail every filter of the mask (bit k: the k-th filter)."""
    masks = range(1 << len(filters))
    fails = rows.select("part", *(F.col(w).cast("long").alias(f"w{i}") for i, w in enumerate(weights)), *(F.col(f).cast("long").alias(f"f{k}") for k, f in enumerate(filters)))
    product = lambda mask: " * ".join(f"f{k}" for k in range(len(filters)) if mask >> k & 1) or "1"
    sums = fails.groupBy("part").agg(*(F.expr(f"sum(w{i} * {product(mask)}) AS s{i}_{mask}") for i in range(len(weights)) for mask in masks))
    return sums.select("part", *(F.array(*(f"s{i}_{mask}" for mask in masks)).alias(w) for i, w in enumerate(weights)))


def _subsets(mask: int) -> list[int]:
    return [s for s in range(mask + 1) if s & mask == s]


def _sums(column: str, rows: list[list[tuple[int, int]]]) -> Column:
    """An array of weighted sums of entries of an array column: (factor, mask) for each term."""
    return F.expr("array(" + ", ".join(" + ".join(f"{factor} * {quoted(column)}[{mask}]" for factor, mask in terms) for terms in rows) + ")")


def _sign(mask: int) -> int:
    return (-1) ** mask.bit_count()


def survivors(joint: str, k: int) -> Column:
    """Möbius inversion: an array with, at mask, the weight of the rows that fail no filter of the mask."""
    return _sums(joint, [[(_sign(s), s) for s in _subsets(mask)] for mask in range(1 << k)])


def unique_failures(joint: str, k: int) -> Column:
    """An array with the weight of the rows that fail each filter and no other."""
    others = lambda f: (1 << k) - 1 ^ 1 << f
    return _sums(joint, [[(_sign(s), s | 1 << f) for s in _subsets(others(f))] for f in range(k)])


def shapley(joint: str, k: int) -> Column:
    """An array with k! times the Shapley value of each filter, in whole numbers: dividends shared out among the members of their sets."""
    share = lambda s: -_sign(s) * math.factorial(k) // s.bit_count()
    return _sums(joint, [[(share(s), s) for s in range(1 << k) if s >> f & 1] for f in range(k)])


def audit(rows: DataFrame, filters: Sequence[str] = LETTERS, lost: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """One row per part, order of the filters, and step.

    rows: part, a boolean column of each filter (true: fails; null: passes), n and the weights of lost, all of them counts. Columns: part, filter_order, step, filter,
    kept, removed, redundant, unique_fails, <weight>_lost, shapley. Names of filters are single letters, six at most, none a comma. No rows give no rows.
    """
    k = len(filters)
    if not 0 < k <= 6 or any(len(f) != 1 for f in filters) or len(set(filters)) != k:
        raise ValueError("one to six filters, each named by a letter of its own")
    rows = rows.select("part", "n", *lost, *(F.coalesce(F.col(f), F.lit(False)).alias(f) for f in filters))
    joint = joint_failures(rows, filters, ("n", *lost))
    known = joint.select("part", F.col("n").alias("failing"), survivors("n", k).alias("left"), unique_failures("n", k).alias("alone"), shapley("n", k).alias("worth"), *(survivors(w, k).alias(f"left_{w}") for w in lost))
    orders = F.explode(F.split(F.lit(",".join("".join(o) for o in itertools.permutations(filters))), ","))
    steps = known.select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    steps = steps.withColumn("filter", F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    earlier = functools.reduce(operator.add, [F.when(F.instr("filter_order", f) < F.col("step"), F.lit(1 << b)).otherwise(F.lit(0)) for b, f in enumerate(filters)])
    steps = steps.withColumn("at", F.instr(F.lit("".join(filters)), F.col("filter")) - 1).withColumn("before", earlier)
    steps = steps.withColumn("bit", F.expr("shiftleft(1, at)")).withColumn("after", F.col("before") + F.col("bit"))
    gone = lambda left: left[F.col("before")] - left[F.col("after")]
    removed = gone(F.col("left"))
    return steps.select("part", "filter_order", "step", "filter", F.col("left")[F.col("after")].alias("kept"), removed.alias("removed"), (F.col("failing")[F.col("bit")] - removed).alias("redundant"),
                        F.col("alone")[F.col("at")].alias("unique_fails"), *(gone(F.col(f"left_{w}")).alias(f"{w}_lost") for w in lost), F.col("worth")[F.col("at")].alias("shapley"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit(flagged(docs, labels)).drop("filter")


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
 w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
 l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
 f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, MAP {
   'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
   'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
   'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > least, false)} AS fails FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
 k AS (SELECT part, fails['A'] AS a, fails['B'] AS b, fails['C'] AS c, fails['D'] AS d, fails['E'] AS e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
 x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
 o AS (SELECT p.c || q.c || r.c || s.c || u.c AS filter_order FROM x p, x q, x r, x s, x u WHERE len(list_distinct([p.c, q.c, r.c, s.c, u.c])) = 5),
 g AS (SELECT part, n, good, toxic, filter_order, step, substring(filter_order, step, 1) AS filter,
   list_filter(range(1, 6), lambda i: CASE substring(filter_order, i, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS failing
   FROM k, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
 h AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (len(failing) = 0 OR failing[1] > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (failing[1] = step), 0)::BIGINT AS removed,
   coalesce(sum(n) FILTER (list_contains(failing, step) AND failing[1] < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failing = [step]), 0)::BIGINT AS unique_fails,
   coalesce(sum(good) FILTER (failing[1] = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (failing[1] = step), 0)::BIGINT AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM h
"""
