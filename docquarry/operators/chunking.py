"""From documents to sections, parent passages and child passages.

Everything is row-local: a tile is a slice of the array of tokens with the white space behind them, joined again, so
neither tokens nor offsets are ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import document_title, stable_id

PARENT_TOKENS, CHILD_TOKENS = 1536, 384
_HEADING = r"(?mdU)^#{1,6}\s+(.+)$"
_OUTER = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _OUTER, "")


def tokens_with_space(text: Column) -> Column:
    """Tokens of text in order, each with the white space behind it."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+\s*"), 0)


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"), 0))


def sections(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per section of a headed text: section_index, title, body, text_start, text_end (before trimming) and df's other columns.

    What stands before the first heading has an empty title; blank bodies are left out and take no index.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bodies, titles = F.split(text, _HEADING, -1), F.regexp_extract_all(text, F.lit(_HEADING), 1)
    whole = F.regexp_extract_all(text, F.lit(_HEADING), 0)
    lengths = F.zip_with(F.concat(F.array(F.lit("")), whole), bodies, lambda h, b: F.struct(F.length(h).alias("h"), F.length(b).alias("b")))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x["h"] + x["b"])
    block = lambda i: F.floor(i / 256).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), block(F.size(lengths) - 1)), lambda n: total(F.slice(lengths, n * 256 + 1, F.lit(256))))  # so a text of very many headings stays cheap
    upto = lambda i: F.aggregate(F.slice(blocks, F.lit(1), block(i)), F.lit(0), lambda a, x: a + x) + total(F.slice(lengths, block(i) * 256 + 1, i % 256 + 1))
    placed = F.transform(bodies, lambda b, i: F.struct(
        F.when(i == 0, F.lit("")).otherwise(F.try_element_at(titles, i)).alias("title"), b.alias("raw"),
        (upto(i) - F.length(b)).alias("text_start")))
    full = F.filter(placed, lambda s: strip(s["raw"]) != "")
    others = [c for c in df.columns if c != text_col]
    return df.select(*others, F.posexplode(full).alias("section_index", "s")).select(
        *others, "section_index", F.col("s.title").alias("title"), strip(F.col("s.raw")).alias("body"), F.col("s.text_start").alias("text_start"), (F.col("s.text_start") + F.length("s.raw")).alias("text_end"))


def _tiles(tokens: Column, size: Column) -> Column:
    """ARRAY<STRUCT<at, part>>: tokens cut into tiles of size. Each tile carries its own tokens, so a long text is not copied for each."""
    return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(0), F.size(tokens) - 1, size), lambda at: F.struct(at.alias("at"), F.slice(tokens, at + 1, size).alias("part"))))


def _text(tokens: Column) -> Column:
    return F.regexp_replace(F.array_join(tokens, ""), r"(?U)\s+$", "")


def _titled(title: Column, body: Column) -> Column:
    return F.when(title == "", body).otherwise(strip(F.concat(title, F.lit("\n"), body)))


def parents(df: DataFrame, parent_tokens: int = PARENT_TOKENS, child_tokens: int = CHILD_TOKENS) -> DataFrame:
    """One row per parent passage: parent_start, parent_stop (tokens of the section), parent_id, parent_text, tokens (its own).

    df has document_id, version, section_index, title, body and chunk_kind (null for prose; any other kind is one whole record).
    """
    cut = df.withColumn("all_tokens", tokens_with_space(strip(F.col("body"))))
    size = F.when(F.col("chunk_kind").isNull(), F.lit(parent_tokens)).otherwise(F.greatest(F.size("all_tokens"), F.lit(1)))
    cut = cut.withColumn("tile", F.explode(_tiles(F.col("all_tokens"), size))).drop("all_tokens")
    cut = cut.withColumn("parent_start", F.col("tile.at")).withColumn("tokens", F.col("tile.part")).withColumn("parent_stop", F.col("parent_start") + F.size("tokens")).drop("tile")
    text = _titled(F.col("title"), _text(F.col("tokens")))
    return cut.withColumn("parent_id", stable_id(F.col("document_id"), F.col("version"), F.col("section_index"), F.col("parent_start"))).withColumn("parent_text", text)


def children(df: DataFrame, child_tokens: int = CHILD_TOKENS) -> DataFrame:
    """One row per child passage of parents(): child_start, child_stop, chunk_id, text. Tiles begin anew in each parent."""
    size = F.when(F.col("chunk_kind").isNull(), F.lit(child_tokens)).otherwise(F.size("tokens"))
    cut = df.withColumn("tile", F.explode(F.transform(_tiles(F.col("tokens"), size), lambda t: F.struct(t["at"].alias("at"), F.size(t["part"]).alias("n"), _text(t["part"]).alias("text"))))).drop("tokens")
    cut = cut.withColumn("child_start", F.col("parent_start") + F.col("tile.at")).withColumn("child_stop", F.col("child_start") + F.col("tile.n"))
    cut = cut.withColumn("text", _titled(F.col("title"), F.col("tile.text"))).drop("tile")
    return cut.withColumn("chunk_id", stable_id(F.col("parent_id"), F.col("child_start"), F.col("text")))


def prose(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without headings as one section each, ready for parents()."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("document_id"), F.substring(F.sha2(body, 256), 1, 24).alias("version"), F.lit(0).alias("section_index"),
                     F.lit("").alias("title"), body.alias("body"), F.lit(None).cast("string").alias("chunk_kind"))


def chunk_documents(df: DataFrame, parent_tokens: int = PARENT_TOKENS, child_tokens: int = CHILD_TOKENS) -> DataFrame:
    """Chunks of documents (relative_path, source, collection_name, text): the first row of a path wins, ids come from path and content.

    chunk_order counts a document's chunks from 0.
    """
    from pyspark.sql import Window

    first = df.withColumn("rn", F.row_number().over(Window.partitionBy("relative_path").orderBy("collection_order"))).where("rn = 1").drop("rn")
    named = first.select(stable_id(F.col("relative_path")).alias("document_id"), document_title(F.col("text"), F.regexp_extract("relative_path", "([^/]*)$", 1)).alias("document_name"),
                         "relative_path", "source", F.substring(F.sha2("text", 256), 1, 24).alias("version"), "text")
    made = children(parents(sections(named).withColumn("chunk_kind", F.lit(None).cast("string")), parent_tokens), child_tokens)
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("section_index", "parent_start", "child_start")) - 1
    return made.withColumn("chunk_order", order)
