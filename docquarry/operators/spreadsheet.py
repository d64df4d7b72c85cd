"""Spreadsheet documents in their line form: parsing, people, chunks and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import collapse, is_person_name, is_role, normalize_identifier, stable_id

_SECTIONS = {"Column profiles:": "column_profile", "People index:": "people_index", "Row records:": "row_record"}
_PAIR = "struct<header:string,value:string>"


def parse_lines(df: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """document, line_no, sheet, kind, line: what each line of a spreadsheet document is.

    kind: summary, sheet_summary, column_profile, people_index or row_record. The first line and the marker lines are left
    out. The state of a line is the last marker before it, one window per document.
    """
    raw = df.select(F.col(id_col).alias("document"), F.posexplode(F.split(F.replace(F.col(text_col), F.lit("\r\n"), F.lit("\n")), "\n")).alias("at", "raw"))
    # each line is cleaned as a row: a text of very many lines is not held again and again as an array
    full = raw.select("document", "at", collapse(F.col("raw")).alias("line")).where("line <> ''")
    lines = full.withColumn("line_no", F.row_number().over(Window.partitionBy("document").orderBy("at")) - 1).where("line_no > 0").select("document", "line_no", "line")
    by = Window.partitionBy("document").orderBy("line_no")
    is_sheet = F.startswith("line", F.lit("## Sheet: "))
    marker = F.when(is_sheet, F.lit("sheet_summary"))
    for text, kind in _SECTIONS.items():
        marker = marker.when(F.col("line") == text, F.lit(kind))
    sheets = lines.withColumn("sheet", F.last(F.when(is_sheet, F.trim(F.substring("line", 11, 1 << 30))), ignorenulls=True).over(by))
    state = sheets.withColumn("marker", marker).withColumn("state", F.last("marker", ignorenulls=True).over(by))
    item = F.startswith("line", F.lit("- ")) & F.col("state").isin(*_SECTIONS.values()) & (F.col("line") != "No non-empty data rows were indexed.")
    kind = F.when(F.col("sheet").isNull(), F.lit("summary")).when(item, F.col("state")).otherwise(F.lit("sheet_summary"))
    # before the first sheet the other markers are ordinary lines
    out = state.where(F.col("sheet").isNull() | F.col("marker").isNull())
    return out.select("document", "line_no", "sheet", kind.alias("kind"), F.when(item & F.col("sheet").isNotNull(), F.trim(F.substring("line", 3, 1 << 30))).otherwise(F.col("line")).alias("line"))


def _parts(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r" \| "), lambda p: F.trim(p)), lambda p: p != "")


def _after(parts: Column, name: str) -> Column:
    """What follows name: in the last part that begins with it."""
    found = F.filter(parts, lambda p: F.startswith(p, F.lit(f"{name}:")))
    return F.trim(F.regexp_extract(F.try_element_at(found, F.lit(-1)), "^[^:]*:(.*)$", 1))


def parse_person(line: Column, sheet: Column) -> Column:
    """STRUCT<name, role, sheet, row_number> of a people line, null without a person."""
    parts = _parts(line)
    row = _after(parts, "Row")
    name = _after(parts, "Person")
    return F.when(name != "", F.struct(name.alias("name"), _after(parts, "Role").alias("role"), F.coalesce(_after(parts, "Sheet"), sheet).alias("sheet"), F.when(row.rlike("^[0-9]+$"), row.cast("int")).alias("row_number")))


def parse_row(line: Column, sheet: Column) -> Column:
    """STRUCT<sheet, row_number, pairs> of a row line. A later part that begins like a marker is taken for one, as the grammar has it."""
    parts = _parts(line)
    rest = F.filter(parts, lambda p, i: ~((i == 0) & F.startswith(p, F.lit("Spreadsheet file "))))
    sheets = F.filter(rest, lambda p: F.startswith(p, F.lit("Sheet ")))
    rows = F.filter(F.transform(F.filter(rest, lambda p: F.startswith(p, F.lit("Row "))), lambda p: F.trim(F.regexp_extract(p, "^Row ([^:]*)", 1))), lambda n: n.rlike("^[0-9]+$"))
    texts = F.transform(F.filter(rest, lambda p: ~F.startswith(p, F.lit("Sheet "))), lambda p: F.when(F.startswith(p, F.lit("Row ")), F.trim(F.regexp_extract(p, "^[^:]*:(.*)$", 1))).otherwise(p))
    pairs = F.filter(F.transform(texts, lambda t: F.struct(F.trim(F.regexp_extract(t, "^([^=]*)=", 1)).alias("header"), F.trim(F.regexp_extract(t, "^[^=]*=(.*)$", 1)).alias("value"))), lambda p: (p["header"] != "") & (p["value"] != ""))
    return F.struct(F.coalesce(F.trim(F.substring(F.try_element_at(sheets, F.lit(-1)), 7, 1 << 30)), sheet).alias("sheet"), F.try_element_at(rows, F.lit(-1)).cast("int").alias("row_number"), pairs.alias("pairs"))


def row_values(pairs: Column) -> Column:
    """Pairs as a map in which the last of equal headers counts."""
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.lit(1 << 20)), lambda q: q["header"] == p["header"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["header"], p["value"])))


def person_of(pairs: Column) -> Column:
    """STRUCT<name, role> where the first pair looks like a person, else null; the role is the first later value that looks like one."""
    first = F.try_element_at(pairs, F.lit(1))["value"]
    roles = F.filter(F.slice(pairs, 2, 1 << 20), lambda p: is_role(p["value"]))
    return F.when(is_person_name(first), F.struct(first.alias("name"), F.try_element_at(roles, F.lit(1))["value"].alias("role")))


def people(lines: DataFrame) -> DataFrame:
    """document, sheet, name, role, row_number: people lines, then people of rows, each (name, role, row) of a sheet once."""
    listed = lines.where("kind = 'people_index'").select("document", F.col("sheet").alias("in_sheet"), "line_no", parse_person(F.col("line"), F.col("sheet")).alias("p"))
    rows = lines.where("kind = 'row_record'").select("document", F.col("sheet").alias("in_sheet"), "line_no", parse_row(F.col("line"), F.col("sheet")).alias("r")).withColumn("q", person_of(F.col("r.pairs")))
    one = listed.where("p is not null").select("document", "in_sheet", F.lit(0).alias("part"), "line_no", "p.name", "p.role", "p.sheet", "p.row_number")
    two = rows.where("q is not null").select("document", "in_sheet", F.lit(1).alias("part"), "line_no", "q.name", "q.role", "r.sheet", "r.row_number")
    both = one.unionByName(two)
    first = Window.partitionBy("document", "in_sheet", "name", "role", "row_number").orderBy("part", "line_no")
    return both.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def chunks(lines: DataFrame) -> DataFrame:
    """Whole-record chunks: document, sheet, kind, text, row_number, row_values, entity_name, entity_role, search_text, chunk_order, chunk_id.

    Order: summary, then for each sheet its summary, column profiles, people and rows.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")  # one sheet's summary: a few lines
    none = [F.lit(None).cast("int").alias("row_number"), F.lit(None).cast("map<string,string>").alias("row_values"), F.lit(None).cast("string").alias("entity_name"), F.lit(None).cast("string").alias("entity_role")]
    starts = lines.where("sheet is not null").groupBy("document", "sheet").agg(F.min("line_no").alias("sheet_at"))
    summary = lines.where("kind in ('summary', 'sheet_summary')").groupBy("document", "sheet", "kind").agg(text.alias("text")).select("document", "sheet", "kind", "text", *none, F.lit(0).alias("part"), F.lit(0).alias("line_no"))
    profiles = lines.where("kind = 'column_profile'").select("document", "sheet", "kind", F.col("line").alias("text"), *none, F.lit(1).alias("part"), "line_no")
    who = people(lines).select("document", F.col("in_sheet").alias("sheet"), F.lit("people_index").alias("kind"), F.when(F.coalesce("role", F.lit("")) != "", F.concat("name", F.lit("\nCargo: "), "role")).otherwise(F.col("name")).alias("text"),
                               "row_number", none[1], F.col("name").alias("entity_name"), F.col("role").alias("entity_role"), F.col("part") + 2, "line_no").toDF(*summary.columns)
    parsed = lines.where("kind = 'row_record'").withColumn("r", parse_row(F.col("line"), F.col("sheet"))).withColumn("q", person_of(F.col("r.pairs")))
    rows = parsed.select("document", "sheet", "kind", F.col("line").alias("text"), "r.row_number", row_values(F.col("r.pairs")).alias("row_values"), F.col("q.name").alias("entity_name"), F.col("q.role").alias("entity_role"), F.lit(4).alias("part"), "line_no")
    every = summary.unionByName(profiles).unionByName(who).unionByName(rows).join(starts, ["document", "sheet"], "left")
    order = Window.partitionBy("document").orderBy(F.coalesce("sheet_at", F.lit(-1)), "part", "line_no")
    numbered = every.withColumn("chunk_order", F.row_number().over(order) - 1).withColumn("search_text", normalize_identifier(F.col("text")))
    return numbered.withColumn("chunk_id", stable_id(F.col("document"), F.col("chunk_order"), F.col("text"))).drop("sheet_at", "part", "line_no")


def render_rows(rows: DataFrame, file_name: str) -> DataFrame:
    """sheet, row_number, line: the line form that parse_row reads. rows: sheet, row_number, pairs."""
    pairs = F.array_join(F.transform("pairs", lambda p: F.concat(p["header"], F.lit("="), p["value"])), " | ")
    return rows.select("sheet", "row_number", F.concat(F.lit(f"- Spreadsheet file {file_name} | Sheet "), "sheet", F.lit(" | Row "), "row_number", F.lit(": "), pairs).alias("line"))


def render_document(rows: DataFrame, profiles: DataFrame, who: DataFrame, file_name: str) -> DataFrame:
    """sheet, part, ord, line: a whole spreadsheet document in the line form that parse_lines reads; in order of sheet, part, ord.

    rows: sheet, row_number, pairs; profiles: sheet, ord, line; who: sheet, row_number, name, role.
    """
    sheets = rows.groupBy("sheet").agg(F.count(F.lit(1)).alias("n"))
    head = sheets.select("sheet", F.lit(0).alias("part"), F.posexplode(F.array(F.concat(F.lit("## Sheet: "), "sheet"), F.lit(f"Spreadsheet file: {file_name}"), F.concat(F.lit("Sheet name: "), "sheet"), F.concat(F.lit("Data rows indexed: "), "n"))).alias("ord", "line"))
    mark = lambda df, part, text: df.select("sheet").distinct().select("sheet", F.lit(part).alias("part"), F.lit(0).alias("ord"), F.lit(text).alias("line"))
    columns = profiles.select("sheet", F.lit(2).alias("part"), "ord", F.concat(F.lit("- "), "line").alias("line"))
    role = F.when(F.coalesce("role", F.lit("")) != "", F.concat(F.lit(" | Role: "), "role")).otherwise(F.lit(""))
    persons = who.select("sheet", F.lit(4).alias("part"), F.col("row_number").alias("ord"), F.concat(F.lit("- Person: "), "name", role, F.lit(" | Sheet: "), "sheet", F.lit(" | Row: "), "row_number").alias("line"))
    body = render_rows(rows, file_name).select("sheet", F.lit(6).alias("part"), F.col("row_number").alias("ord"), "line")
    out = head
    for part in (mark(profiles, 1, "Column profiles:"), columns, mark(who, 3, "People index:"), persons, mark(rows, 5, "Row records:"), body):
        out = out.unionByName(part)
    return out
