"""Retrieval metrics, support of expected answers, failure classes and report counters."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.numbers import currencies_in, dates_in, let, numbers_in, percentages_in
from docquarry.functions.text import normalize_identifier, search_tokens

# Words that structured matches pass over.
UNITS = ("a ao aos as com da das de do dos e em maxima maximo minima minimo no nos o os para por r rs").split()


def _gain(position: Column) -> Column:
    return F.lit(1.0) / F.log2(position + 1)


def _ideal(k: int, relevant: Column) -> Column:
    """The largest possible gain of k places of which so many can be relevant."""
    gains = F.array(*[F.lit(1.0) / F.log2(F.lit(float(i + 2))) for i in range(k)])
    return F.aggregate(F.slice(gains, F.lit(1), F.least(F.lit(k), relevant).cast("int")), F.lit(0.0), lambda s, x: s + x)


def ranking_metrics(ranked: DataFrame, totals: DataFrame, k: int = 10, group: str = "query_id") -> DataFrame:
    """group, recall, mrr, ndcg. ranked: group, rank (from 1), relevant; totals: group, relevant_total.

    Without anything relevant in the corpus recall and nDCG are null; MRR is then 0.
    """
    hits = ranked.where((F.col("rank") <= k) & F.col("relevant")).groupBy(group).agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(_gain(F.col("rank"))).alias("dcg"))
    joined = totals.join(hits, group, "left").select(group, "relevant_total", F.coalesce("hits", F.lit(0)).alias("hits"), "first", F.coalesce("dcg", F.lit(0.0)).alias("dcg"))
    some = F.col("relevant_total") > 0
    return joined.select(group, F.when(some, F.col("hits") / F.col("relevant_total")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(some, F.col("dcg") / _ideal(k, F.col("relevant_total"))).alias("ndcg"))


def evidence_recall(found: DataFrame, groups: DataFrame, k: int = 10, group: str = "query_id") -> DataFrame:
    """group, evidence_recall, complete: the share of phrase groups of which a phrase stands in the first k texts.

    found: group, rank, text; groups: group, phrase_group, phrases ARRAY<STRING>. Questions without groups do not occur.
    """
    top = found.where(F.col("rank") <= k).select(F.col(group).alias("g"), "text")
    held = groups.join(top, F.col(group) == F.col("g"), "left")
    covered = held.groupBy(group, "phrase_group").agg(F.bool_or(F.coalesce(F.exists("phrases", lambda p: F.contains(F.col("text"), p)), F.lit(False))).alias("covered"))
    return covered.groupBy(group).agg(F.avg(F.col("covered").cast("int")).alias("evidence_recall"), F.bool_and("covered").alias("complete"))


def document_ranks(ranked: DataFrame, group: str = "query_id", document: str = "document_id") -> DataFrame:
    """Ranks of chunks as ranks of documents: each document where it comes first, numbered anew."""
    first = ranked.groupBy(group, document).agg(F.min("rank").alias("chunk_rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("chunk_rank", document)))


def source_rank(ranked: DataFrame, matches: Column, group: str = "query_id", document: str = "document_id") -> DataFrame:
    """group, source_rank: how many different documents have been seen at the first row that matches."""
    seen = Window.partitionBy(group, document).orderBy("rank")
    running = Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    counted = ranked.withColumn("fresh", (F.row_number().over(seen) == 1).cast("int")).withColumn("documents", F.sum("fresh").over(running))
    return counted.where(matches).groupBy(group).agg(F.min(F.struct("rank", "documents")).alias("m")).select(group, F.col("m.documents").alias("source_rank"))


def stage_positions(stages: DataFrame) -> DataFrame:
    """query_id, stage, candidate_id, position from query_id, stage, candidate_ids; of repeats the last counts."""
    placed = stages.select("query_id", "stage", F.posexplode("candidate_ids").alias("pos", "candidate_id"))
    return placed.groupBy("query_id", "stage", "candidate_id").agg((F.max("pos") + 1).alias("position"))


def rank_movement(hits: DataFrame, positions: DataFrame, stages: list[str]) -> DataFrame:
    """query_id, candidate_id and one column per stage with the hit's position there, null where it was not."""
    once = hits.select("query_id", "candidate_id").distinct()
    return once.join(positions, ["query_id", "candidate_id"], "left").groupBy("query_id", "candidate_id").pivot("stage", stages).agg(F.first("position"))


def missed_hits(hits: DataFrame, positions: DataFrame, selected: DataFrame) -> DataFrame:
    """Hits that the context lacks: not_selected where some stage had them, else not_retrieved."""
    seen = positions.select("query_id", "candidate_id").distinct().withColumn("seen", F.lit(True))
    left = hits.select("query_id", "candidate_id").distinct().join(selected.select("query_id", "candidate_id"), ["query_id", "candidate_id"], "left_anti").join(seen, ["query_id", "candidate_id"], "left")
    return left.select("query_id", "candidate_id", F.when(F.col("seen"), "not_selected").otherwise("not_retrieved").alias("reason"))


def _subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def features(text: Column) -> Column:
    """What support is judged by, worked out once per text: normalized form, numbers, percentages, amounts, dates, words."""
    return F.struct(normalize_identifier(text).alias("plain"), numbers_in(text).alias("numbers"), percentages_in(text).alias("percents"), currencies_in(text).alias("amounts"), dates_in(text).alias("dates"), search_tokens(text).alias("words"))


def judged_by(text: Column) -> Column:
    """features() of a text without its words, which only variants need. A text without a digit has no figures."""
    none = F.expr("cast(array() as array<string>)")
    some = text.rlike(r"\p{Nd}")
    figures = {"numbers": numbers_in, "percents": percentages_in, "amounts": currencies_in, "dates": dates_in}
    return F.struct(normalize_identifier(text).alias("plain"), *(F.when(some, of(text)).otherwise(none).alias(name) for name, of in figures.items()))


def telling_words(variant: Column) -> Column:
    """The words of a variant (features()) that any text that supports it contains: those that are neither figures nor units, where it has figures."""
    valued = (F.size(variant["numbers"]) > 0) | (F.size(variant["percents"]) > 0) | (F.size(variant["amounts"]) > 0) | (F.size(variant["dates"]) > 0)
    return F.when(valued, F.filter(variant["words"], lambda w: ~w.isin(*UNITS) & ~w.rlike("^[0-9]+$"))).otherwise(variant["words"])


def support_of(text: Column, variant: Column) -> Column:
    """explicit where the variant stands in the text, implicit where its values and telling words do, else not_found. Both are features()."""
    t, v = text, variant
    valued = (F.size(v["numbers"]) > 0) | (F.size(v["percents"]) > 0) | (F.size(v["amounts"]) > 0) | (F.size(v["dates"]) > 0)
    same = _subset(v["amounts"], F.array_union(t["amounts"], t["numbers"])) & _subset(v["percents"], F.array_union(t["percents"], t["numbers"])) & _subset(v["dates"], t["dates"]) & _subset(v["numbers"], t["numbers"])
    by_values = same & F.forall(telling_words(v), lambda w: F.contains(t["plain"], w))
    by_words = (F.size(v["words"]) > 0) & F.forall(v["words"], lambda w: F.contains(t["plain"], w))
    implicit = F.when(valued, by_values).otherwise(by_words)
    return F.when(t["plain"] == "", "not_found").when((v["plain"] != "") & F.contains(t["plain"], v["plain"]), "explicit").when(implicit, "implicit").otherwise("not_found")


def support_level(text: Column, variant: Column) -> Column:
    return let(F.struct(features(text).alias("t"), features(variant).alias("v")), lambda x: support_of(x["t"], x["v"]))


def source_matches(source: Column, *names: Column) -> Column:
    """The source names one of the candidate's names, or one contains the other, both normalized."""
    wanted, out = normalize_identifier(source), F.lit(False)
    for name in map(normalize_identifier, names):
        out = out | ((name != "") & (F.contains(name, wanted) | F.contains(wanted, name)))
    return (wanted != "") & out


def evidence_key(document: Column, kind: Column, order: Column, text: Column) -> Column:
    return F.concat_ws("|", normalize_identifier(document), normalize_identifier(kind), F.coalesce(order.cast("string"), F.lit("")), F.substring(normalize_identifier(text), 1, 500))


def merge_hits(*groups: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """The hits of several groups as one list, each once: of equal ones that of the first group that has it, and of these the first.

    Groups have key, order, candidate_id, document_name, chunk_kind, excerpt and columns of their own, which are alike. Hits are equal whose candidate, document, kind
    and first 500 normalized characters are. Tasks keep one of each before any travels.
    """
    columns = groups[0].columns
    every = functools.reduce(DataFrame.unionByName, (g.withColumn("__group", F.lit(k)) for k, g in enumerate(groups)))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    same = [F.col(key), named("candidate_id").alias("__c"), named("document_name").alias("__d"), named("chunk_kind").alias("__k"), F.substring(normalize_identifier(F.col("excerpt")), 1, 500).alias("__e")]
    first = every.select("__group", *columns, *same[1:]).groupBy(key, "__c", "__d", "__k", "__e").agg(F.min_by(F.struct(*columns), F.struct("__group", order)).alias("__row"))
    return first.select("__row.*")


def failure_class(hits: Column, explicit_scope: Column, scope_excludes: Column, retrieved_relevant: Column, in_pool: Column, in_context: Column, evidence_has_answer: Column, answer_has_expected: Column, abstained: Column) -> Column:
    """The first rule that holds, in order of the path of an answer: data, document, retrieval, selection, generation."""
    return (
        F.when(hits == 0, "benchmark_data_mismatch")
        .when(explicit_scope & scope_excludes & ~retrieved_relevant, "document_resolution_failure")
        .when(~in_pool, "retrieval_failure")
        .when(~in_context, "selection_failure")
        .when(evidence_has_answer & ~answer_has_expected, "generation_failure")
        .when(abstained, "retrieval_failure")
        .otherwise("no_failure")
    )


def context_hit_rate(hit_ids: Column, context_ids: Column, hit_keys: Column, context_keys: Column, total: Column) -> Column:
    found = F.size(F.array_intersect(hit_ids, context_ids)) + F.size(F.array_intersect(hit_keys, context_keys))
    return F.when(total > 0, F.round(found / total, 4)).otherwise(F.lit(0.0))


def answer_contains(terms: Column, answer: Column, abstained: Column) -> Column:
    """All terms stand in the answer, letter case apart; without terms the answer must abstain."""
    return F.when(F.size(terms) == 0, abstained).otherwise(F.forall(terms, lambda t: F.contains(F.lower(answer), F.lower(t))))


def run_counters(results: DataFrame) -> DataFrame:
    share = lambda c: F.round(100 * F.avg(c.cast("int")), 2)
    return results.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("failure") == "no_failure").alias("passed"), F.count_if("abstained").alias("abstained"), share(F.col("abstained")).alias("abstained_percent"), F.round(F.avg("context_hit_rate"), 4).alias("mean_hit_rate"))


def failure_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("failure").agg(F.count(F.lit(1)).alias("questions"))
