"""One chunk builder for all documents of a collection: spreadsheets by their records, texts with a sidecar by its sections, others by their headings."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import document_title, stable_id
from docquarry.operators import chunking, spreadsheet

SHEET_MARK = "document type: spreadsheet"
_SECTION = "struct<title: string, text: string, provenance: string>"
_COLUMNS = ["document_id", "document_name", "relative_path", "source", "version", "section_index", "title", "body", "chunk_kind", "provenance", "text_start", "text_end", "row_number", "row_values", "entity_name", "entity_role"]


def _identified(df: DataFrame) -> DataFrame:
    """The first row of each path (in order of collection_order), with the document's identity."""
    rows = df if "sections" in df.columns else df.withColumn("sections", F.lit(None).cast(f"array<{_SECTION}>"))
    once = rows.groupBy("relative_path").agg(F.min_by(F.struct("source", "text", "sections"), "collection_order").alias("r")).select("relative_path", "r.*")
    some = F.coalesce(F.size("sections"), F.lit(0)) > 0
    text = F.coalesce("text", F.lit(""))
    version = F.when(some, stable_id(text, F.to_json("sections"))).otherwise(F.substring(F.sha2(text, 256), 1, 24))
    kind = F.when(F.contains(F.lower(text), F.lit(SHEET_MARK)), "sheet").when(some, "sidecar").otherwise("headings")
    return once.select(stable_id(F.col("relative_path")).alias("document_id"), document_title(text, F.regexp_extract("relative_path", "([^/]*)$", 1)).alias("document_name"), "relative_path", "source", version.alias("version"), text.alias("text"), "sections", kind.alias("kind"))


def catalog(df: DataFrame) -> DataFrame:
    """document_id, document_name, relative_path of every document, also of one without chunks."""
    return _identified(df).select("document_id", "document_name", "relative_path")


def _filled(df: DataFrame) -> DataFrame:
    kinds = {"chunk_kind": "string", "provenance": "string", "text_start": "int", "text_end": "int", "row_number": "int", "row_values": "map<string,string>", "entity_name": "string", "entity_role": "string"}
    for name, kind in kinds.items():
        df = df.withColumn(name, (F.col(name) if name in df.columns else F.lit(None)).cast(kind))
    return df.select(*_COLUMNS)


def section_rows(df: DataFrame) -> DataFrame:
    """The sections of all documents, whichever way each is cut. A spreadsheet is one even where it has a sidecar; a sidecar without sections is none."""
    base = _identified(df)
    own = ["document_id", "document_name", "relative_path", "source", "version"]
    headed = chunking.sections(base.where("kind = 'headings'").select(*own, "text"))
    told = base.where("kind = 'sidecar'").select(*own, F.posexplode("sections").alias("section_index", "s"))
    told = told.select(*own, "section_index", F.coalesce("s.title", F.lit("")).alias("title"), F.coalesce("s.text", F.lit("")).alias("body"), F.col("s.provenance").alias("provenance"))
    sheets = base.where("kind = 'sheet'")
    records = spreadsheet.chunks(spreadsheet.parse_lines(sheets.select("document_id", "text")))
    records = records.select(F.col("document").alias("document_id"), F.col("chunk_order").alias("section_index"), F.coalesce("sheet", F.lit("")).alias("title"), F.col("text").alias("body"), F.col("kind").alias("chunk_kind"), "row_number", "row_values", "entity_name", "entity_role")
    records = records.join(sheets.select(*own), "document_id")
    return functools.reduce(DataFrame.unionByName, map(_filled, (headed, told, records)))


def build_chunks(df: DataFrame, parent_tokens: int = chunking.PARENT_TOKENS, child_tokens: int = chunking.CHILD_TOKENS) -> DataFrame:
    """Chunks of documents (relative_path, source, collection_order, text, and sections where files.with_sidecars() has joined them).

    Records of a spreadsheet stay whole, however long. chunk_order counts a document's chunks from 0; ids come from path, content and place.
    """
    made = chunking.children(chunking.parents(section_rows(df), parent_tokens), child_tokens)
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("section_index", "parent_start", "child_start")) - 1  # one document's chunks
    return made.withColumn("chunk_order", order).withColumn("chunk_kind", F.coalesce("chunk_kind", F.lit("section_detail")))
