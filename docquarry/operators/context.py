"""Choosing passages for a token budget. Order-dependent folds over ordered arrays, one array a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.scratch import materialize

CONTEXT_TOKENS, MAX_BATCHES, FOCUS_CHARS = 3000, 16, 8000
#: Items in a range when a scope is cut into batches.
RANGE_ROWS = 20_000


def _ordered(df: DataFrame, group: list[str], order: str, *columns: str) -> DataFrame:
    """One row per group with items: its rows in order. A question's candidates are few (search_k), so the array is bounded."""
    return df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("ord"), *columns))).alias("items"))


def admit(df: DataFrame, budget: int = CONTEXT_TOKENS, per_document: int | str | None = None, group: str = "query_id") -> DataFrame:
    """Greedy admission in rank order: a parent already in costs nothing, one that does not fit is passed over, later ones still may.

    df: group, rank, parent_id, document_id, cost. Gives rank, parent_id, cost, admitted, used (tokens after the row) and
    reason (known, token_budget, document_token_budget or null). per_document limits the tokens of each document: a number, or a
    column of df that has the number, or null for none, on each row.
    """
    quota = F.col(per_document) if isinstance(per_document, str) else F.lit(per_document)
    items = _ordered(df, [group], "rank", "parent_id", "document_id", "cost", F.coalesce(quota.cast("int"), F.lit(2**31 - 1)).alias("quota"))
    zero = F.struct(F.lit(0).alias("used"), F.expr("cast(map() as map<string,int>)").alias("per"), F.expr("cast(array() as array<string>)").alias("known"),
                    F.expr("cast(array() as array<struct<rank:int,parent_id:string,document_id:string,cost:int,admitted:boolean,used:int,reason:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        parent, doc, cost = x["parent_id"].cast("string"), x["document_id"].cast("string"), x["cost"].cast("int")
        known = F.array_contains(acc["known"], parent)
        mine = F.coalesce(F.try_element_at(acc["per"], doc), F.lit(0))
        over_doc, over = mine + cost > x["quota"], acc["used"] + cost > budget
        take = ~known & ~over & ~over_doc
        used = acc["used"] + F.when(take, cost).otherwise(0)
        per = F.when(take, F.map_concat(F.map_filter(acc["per"], lambda k, v: k != doc), F.create_map(doc, mine + cost))).otherwise(acc["per"])
        reason = F.when(known, F.lit("known")).when(over_doc, F.lit("document_token_budget")).when(over, F.lit("token_budget"))
        row = F.struct(x["ord"].cast("int").alias("rank"), parent.alias("parent_id"), doc.alias("document_id"), cost.alias("cost"), take.alias("admitted"), used.alias("used"), reason.alias("reason"))
        return F.struct(used.alias("used"), per.alias("per"), F.when(take, F.array_append(acc["known"], parent)).otherwise(acc["known"]).alias("known"), F.array_append(acc["out"], row).alias("out"))

    done = items.select(group, F.aggregate("items", zero, step, lambda a: a["out"]).alias("out"))
    return done.select(group, F.inline("out"))


def evidence(admitted: DataFrame, candidates: DataFrame, group: str = "query_id") -> DataFrame:
    """One row per admitted parent: evidence_id (E1, E2 ... in order of admission), the chunks that led to it and their number.

    candidates: group, rank, parent_id, chunk_id.
    """
    from pyspark.sql import Window

    taken = admitted.where("admitted").select(group, "parent_id", F.col("rank").alias("first_rank"))
    named = taken.withColumn("evidence_id", F.concat(F.lit("E"), F.row_number().over(Window.partitionBy(group).orderBy("first_rank"))))
    hits = candidates.join(named, [group, "parent_id"]).groupBy(group, "parent_id", "evidence_id", "first_rank")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
    return hits.agg(F.array_distinct(F.transform(ordered, lambda x: x["chunk_id"])).alias("chunk_ids"), F.count(F.lit(1)).alias("occurrences"))


def batches(df: DataFrame, budget: int = CONTEXT_TOKENS, max_batches: int = MAX_BATCHES, group: str = "query_id", order: str = "ord", item: str = "parent_id") -> DataFrame:
    """Next-fit batches for full coverage: group, order, item, cost, batch (null where skipped).

    An item above the budget is skipped, a full batch closes, and nothing enters once max_batches are closed. What stands
    behind max_batches full batches cannot enter, so only the items before that are folded: a number that the budget bounds. They are found by
    prefix sums range by range: ranges of about RANGE_ROWS items, sums of whole ranges, then sums within the few ranges where a group's
    bound may lie. No task orders a whole group.
    """
    rows = df.select(group, order, item, F.col("cost").cast("int").alias("cost"))
    n = max(1, -(-rows.count() // RANGE_ROWS))
    ranged = materialize(rows.repartitionByRange(n, group, order).withColumn("__range", F.spark_partition_id()), "batch-ranges")
    weight = F.when(F.col("cost") <= budget, F.col("cost")).otherwise(0)
    sums = ranged.groupBy(group, "__range").agg(F.sum(weight).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    placed = ranged.join(sums.select(group, "__range", before.alias("__before")), [group, "__range"])
    open_ = F.col("__before") <= budget * max_batches
    within = Window.partitionBy(group, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.where(open_).withColumn("__sofar", F.col("__before") + F.coalesce(F.sum(weight).over(within), F.lit(0)))
    inner = inner.withColumn("__near", (F.col("cost") <= budget) & (F.col("__sofar") <= budget * max_batches))
    marked = inner.select(group, order, item, "cost", "__near").unionByName(placed.where(~open_).select(group, order, item, "cost", F.lit(False).alias("__near")))
    behind = marked.where("not __near").select(group, order, item, "cost", F.lit(None).cast("int").alias("batch"))
    items = _ordered(marked.where("__near"), [group], order, item, "cost")
    zero = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("size"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        cost = x["cost"].cast("int")
        large = cost > budget
        turn = ~large & (acc["size"] > 0) & (acc["size"] + cost > budget)
        batch = acc["batch"] + turn.cast("int")
        size = F.when(turn, 0).otherwise(acc["size"])
        enters = ~large & (batch < max_batches)
        return F.struct(batch.alias("batch"), F.when(enters, size + cost).otherwise(size).alias("size"), F.array_append(acc["out"], F.when(enters, batch)).alias("out"))

    done = items.select(group, "items", F.aggregate("items", zero, step, lambda a: a["out"]).alias("b"))
    rows = done.select(group, F.inline(F.zip_with("items", "b", lambda x, b: F.struct(x["ord"].alias(order), x[item].alias(item), x["cost"].alias("cost"), b.alias("batch")))))
    return rows.unionByName(behind)


def focus_batches(df: DataFrame, budget: int = CONTEXT_TOKENS, group: str = "query_id") -> DataFrame:
    """Next-fit batches of cited excerpts: one above the budget is cut to FOCUS_CHARS characters and still goes in.

    df: group, ord, evidence_id, excerpt.
    """
    from docquarry.operators.chunking import token_count

    cut = df.withColumn("cost0", token_count(F.col("excerpt"))).withColumn("excerpt", F.when(F.col("cost0") > budget, F.substring("excerpt", 1, FOCUS_CHARS)).otherwise(F.col("excerpt")))
    items = cut.withColumn("cost", token_count(F.col("excerpt")))
    held = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("ord", "evidence_id", "cost0", "cost"))).alias("items"))
    zero = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("size"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        turn = (acc["size"] > 0) & (acc["size"] + x["cost0"] > budget)
        batch = acc["batch"] + turn.cast("int")
        return F.struct(batch.alias("batch"), (F.when(turn, 0).otherwise(acc["size"]) + x["cost"]).alias("size"), F.array_append(acc["out"], batch).alias("out"))

    done = held.select(group, "items", F.aggregate("items", zero, step, lambda a: a["out"]).alias("b"))
    return done.select(group, F.inline(F.zip_with("items", "b", lambda x, b: F.struct(x["ord"].alias("ord"), x["evidence_id"].alias("evidence_id"), x["cost"].alias("cost"), b.alias("batch")))))
