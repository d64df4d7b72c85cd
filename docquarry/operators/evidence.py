"""Claims, verdicts, evidence and quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_references(facts: DataFrame, known: DataFrame, ids: str = "evidence_ids", key: str = "evidence_id") -> DataFrame:
    """Rows (ids exploded) that name an unknown key. Callers stop where this is not empty."""
    return facts.withColumn(key, F.explode(ids)).join(known.select(key).distinct(), key, "left_anti")


def require_references(facts: DataFrame, known: DataFrame, ids: str = "evidence_ids", key: str = "evidence_id") -> DataFrame:
    if not check_references(facts, known, ids, key).isEmpty():
        raise ValueError(f"unknown {key}")
    return facts


def claim_verdicts(claims: DataFrame, verdicts: DataFrame, known: DataFrame, group: str = "query_id") -> DataFrame:
    """Claims with status: their verdict's, or UNSUPPORTED where there is none or an evidence id is missing or unknown.

    claims: group, claim_id, evidence_ids; verdicts: group, claim_id, status; known: group, evidence_id. A claim id that
    occurs twice stops the query.
    """
    ids = known.groupBy(group).agg(F.collect_set("evidence_id").alias("known_ids"))
    once = claims.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(group, "claim_id")))
    once = once.withColumn("claim_id", F.when(F.col("n") == 1, F.col("claim_id")).otherwise(F.raise_error(F.lit("claim id occurs twice")).cast(dict(claims.dtypes)["claim_id"]))).drop("n")
    joined = once.join(verdicts.select(group, "claim_id", F.col("status").alias("verdict")), [group, "claim_id"], "left").join(ids, group, "left")
    unknown = F.array_except("evidence_ids", F.coalesce("known_ids", F.array().cast("array<string>")))
    valid = (F.size("evidence_ids") > 0) & (F.size(unknown) == 0)
    return joined.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn("status", F.when(F.col("valid"), F.coalesce("verdict", F.lit("UNSUPPORTED"))).otherwise("UNSUPPORTED")).drop("verdict", "known_ids")


def supported(claims: DataFrame) -> DataFrame:
    return claims.where("status = 'SUPPORTED'")


def cited_order(claims: DataFrame, group: str = "query_id") -> DataFrame:
    """group, evidence_id, position: evidence in the order in which claims first cite it. claims: group, claim_order, evidence_ids."""
    cited = claims.select(group, "claim_order", F.posexplode("evidence_ids").alias("pos", "evidence_id"))
    first = cited.groupBy(group, "evidence_id").agg(F.min(F.struct("claim_order", "pos")).alias("at"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy("at"))).drop("at")


def final_status(has_claims: Column, central_supported: Column, any_rejected: Column, coverage_complete: Column) -> Column:
    partial = ~central_supported | any_rejected | ~F.coalesce(coverage_complete, F.lit(True))
    return F.when(~has_claims, F.lit("abstained")).when(partial, F.lit("partial")).otherwise(F.lit("answered"))


def literal_span(text: Column, quote: Column) -> Column:
    """STRUCT<start, end> of the first place where quote stands in text, white space and case apart; null where it does not.

    Offsets are those of text, from 0, end exclusive.
    """
    words = F.filter(F.split(quote, r"(?U)\s+"), lambda w: w != "")
    pattern = F.concat(F.lit("(?iuU)"), F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), r"\s+"))
    found = F.regexp_substr(text, pattern)
    start = F.regexp_instr(text, pattern) - 1
    return F.when((F.size(words) > 0) & found.isNotNull(), F.struct(start.cast("int").alias("start"), (start + F.length(found)).cast("int").alias("end")))


def merge_spans(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Spans that overlap or touch as one: keys, start, end, parts. Gaps and islands over the running maximum of the ends."""
    by = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("fresh", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    island = marked.withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")).drop("island")


def focus_spans(selections: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """evidence_id, start, end, quote, claim_ids: selections with a known claim, known evidence and a literal quote, merged.

    selections: claim_id, evidence_id, quote, ord; evidence: evidence_id, excerpt; claims: claim_id.
    """
    known = selections.join(claims.select("claim_id").distinct(), "claim_id", "left_semi").join(evidence.select("evidence_id", "excerpt"), "evidence_id")
    placed = known.withColumn("span", literal_span(F.col("excerpt"), F.trim("quote"))).where("span is not null").select("evidence_id", "claim_id", "ord", "excerpt", "span.*")
    by = Window.partitionBy("evidence_id").orderBy("start", "end", "ord")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = placed.withColumn("fresh", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)).withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "ord", "claim_id")))
    merged = island.groupBy("evidence_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("excerpt").alias("excerpt"), F.array_distinct(F.transform(ordered, lambda x: x["claim_id"])).alias("claim_ids"))
    return merged.select("evidence_id", "start", "end", F.expr("substring(excerpt, start + 1, end - start)").alias("quote"), "claim_ids")


def valid_spans(spans: Column, excerpt: Column) -> Column:
    """The spans that lie within the excerpt, sorted."""
    return F.array_sort(F.filter(spans, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(excerpt))))
