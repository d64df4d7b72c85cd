"""Queries on spreadsheets and the values in them: customers are the rows, nations the sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import numbers as N
from docquarry.functions import text as T
from docquarry.operators import evaluate as E
from docquarry.operators import spreadsheet, tables
from docquarry.plans.passages import docs
from docquarry.plans.registry import query
from docquarry.plans.retrieval import _NORM, tokens_sql


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))


_HEADERS = """h AS (SELECT n_name AS sheet, c_custkey AS i, CASE c_custkey % 4 WHEN 0 THEN 'Column_' || c_custkey ELSE c_mktsegment END AS base FROM customer JOIN nation ON n_nationkey = c_nationkey),
 r AS (SELECT *, row_number() OVER (PARTITION BY sheet, base ORDER BY i) AS n FROM h)"""


@query(f"""WITH {_HEADERS} SELECT sheet, i AS "index", CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS header FROM r""")
def header_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 4 == 0, F.lit(" ")).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).otherwise(F.col("c_mktsegment"))
    return tables.unique_headers(customers(spark, sf_dir).select(F.col("n_name").alias("sheet"), F.col("c_custkey").alias("index"), raw.alias("raw_header")), ["sheet"]).select("sheet", "index", "header")


@query(f"""WITH c AS (SELECT n_name AS sheet, c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment, row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) AS n, count(*) OVER (PARTITION BY n_name) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 5 <> 0)
 SELECT sheet, (n + 1)::INT AS row_number, CASE WHEN segment = '' THEN ['name=' || c_name] ELSE ['name=' || c_name, 'segment=' || segment] END AS pairs, greatest(total - {tables.MAX_ROWS}, 0) AS omitted_rows FROM c WHERE n <= {tables.MAX_ROWS}""")
def sheet_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets with a header, blank rows between, and blank cells."""
    rows = customers(spark, sf_dir)
    blank = F.col("c_custkey") % 5 == 0
    cell = lambda c: F.when(blank, F.lit("")).otherwise(c)
    body = rows.select(F.col("n_name").alias("sheet"), (F.col("c_custkey") + 2).alias("physical"), F.array(cell(F.col("c_name")), cell(F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")))).alias("cells"))
    head = rows.select(F.col("n_name").alias("sheet")).distinct().select("sheet", F.lit(1).cast("long").alias("physical"), F.array(F.lit("name"), F.lit("segment")).alias("cells"))
    made = tables.build_sheet(body.withColumn("physical", F.col("physical").cast("long")).unionByName(head))
    pairs = F.array_sort(F.transform(F.map_entries("row_values"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return made.select("sheet", "row_number", pairs.alias("pairs"), "omitted_rows")


# a document for each nation: people are two of three customers, of whom every other one has a role; the others are totals
_ROWS = """c AS (SELECT n_name AS sheet, c_custkey::INT AS row_number, CASE WHEN c_custkey % 3 = 0 THEN 'Total' ELSE 'Ana ' || c_mktsegment END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'Analista ' || c_mktsegment ELSE '2024-01-02' END AS role FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def sheet_rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    name = F.when(key % 3 == 0, "Total").otherwise(F.concat(F.lit("Ana "), "c_mktsegment"))
    role = F.when(key % 2 == 0, F.concat(F.lit("Analista "), "c_mktsegment")).otherwise("2024-01-02")
    pair = lambda h, c: F.struct(F.lit(h).alias("header"), c.alias("value"))
    return customers(spark, sf_dir).select(F.col("n_name").alias("sheet"), key.cast("int").alias("row_number"), F.array(pair("Name", name), pair("Cargo", role)).alias("pairs"), name.alias("name"), role.alias("role"))


def sheet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows rendered as one document for each sheet, and its lines parsed again. A document is one text, as it is stored."""
    rows = sheet_rows_of(spark, sf_dir)
    profiles = rows.select("sheet").distinct().select("sheet", F.lit(1).alias("ord"), F.lit("Name: sample values=Ana").alias("line"))
    who = rows.where("name <> 'Total'").select("sheet", "row_number", "name", F.when(F.col("row_number") % 2 == 0, F.col("role")).alias("role"))
    lines = spreadsheet.render_document(rows.select("sheet", "row_number", "pairs"), profiles, who, "f.xlsx")
    joined = lambda *order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n")
    # pieces of a thousand places are joined wherever they are; the task of a sheet meets these and not its lines
    pieces = lines.groupBy("sheet", "part", F.floor(F.col("ord") / 1000).alias("piece")).agg(joined("ord").alias("line"))
    return spreadsheet.parse_lines(pieces.groupBy("sheet").agg(F.concat(F.lit("# f.xlsx\n"), joined("part", "piece")).alias("text")).select(F.col("sheet").alias("document_id"), "text"))


@query(f"""WITH {_ROWS} SELECT sheet, unnest(['sheet_summary', 'column_profile', 'people_index', 'row_record']) AS kind, unnest([3, 1, count(*) FILTER (name <> 'Total'), count(*)]) AS n FROM c GROUP BY sheet""")
def sheet_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet_lines(spark, sf_dir).groupBy(F.col("document").alias("sheet"), "kind").agg(F.count(F.lit(1)).alias("n")).where("n > 0")


@query(f"WITH {_ROWS} SELECT DISTINCT sheet, row_number, name, coalesce(CASE WHEN row_number % 2 = 0 THEN role END, '-') AS role FROM c WHERE name <> 'Total'")
def sheet_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spreadsheet.people(sheet_lines(spark, sf_dir)).select("sheet", "row_number", "name", F.coalesce(F.nullif("role", F.lit("")), F.lit("-")).alias("role"))
    return found.distinct()


@query(f"WITH {_ROWS} SELECT sheet, row_number, ['Cargo=' || role, 'Name=' || name] AS cells, CASE WHEN name <> 'Total' THEN name END AS entity_name FROM c")
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spreadsheet.chunks(sheet_lines(spark, sf_dir)).where("kind = 'row_record'")
    return made.select("sheet", "row_number", F.array_sort(F.transform(F.map_entries("row_values"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("cells"), "entity_name")


@query(f"""WITH {_ROWS}, o AS (SELECT sheet, row_number, name, row_number() OVER (PARTITION BY sheet ORDER BY row_number) AS n, count(*) OVER (PARTITION BY sheet) AS total FROM c)
 SELECT sheet, row_number, name = 'Total' AS is_total FROM o""")
def sheet_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each sheet in the order of their chunks, which must be that of the rows."""
    made = spreadsheet.chunks(sheet_lines(spark, sf_dir)).where("kind = 'row_record'")
    from pyspark.sql import Window

    before = F.lag("row_number").over(Window.partitionBy("document").orderBy("chunk_order"))
    checked = made.withColumn("row_number", F.when(before.isNull() | (before < F.col("row_number")), F.col("row_number")))
    return checked.select("sheet", "row_number", F.col("entity_name").isNull().alias("is_total"))


@query(f"WITH {_ROWS} SELECT count(*) AS rows_, count(DISTINCT sheet) AS sheets, count(*) FILTER (name <> 'Total') AS people FROM c")
def sheet_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rendered document says of itself: rows indexed, sheets, people lines."""
    lines = sheet_lines(spark, sf_dir)
    told = F.regexp_extract("line", "^Data rows indexed: ([0-9]+)$", 1).try_cast("long")
    return lines.agg(F.sum(told).alias("rows_"), F.count_if(F.startswith("line", F.lit("Sheet name: "))).alias("sheets"), F.count_if(F.col("kind") == "people_index").alias("people"))


_P = "l_extendedprice::DECIMAL(18,2)::VARCHAR"
_SHORT = f"regexp_replace(regexp_replace({_P}, '0+$', ''), '[.]$', '')"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 4 < 3 THEN l_extendedprice::DECIMAL(18,2)::DOUBLE END AS table_value, CASE WHEN l_linenumber % 4 < 3 THEN l_extendedprice::DECIMAL(18,2)::DOUBLE ELSE l_quantity::INT::DOUBLE END AS profile_value,
 CASE WHEN l_linenumber % 4 < 3 THEN {_SHORT} ELSE l_quantity::INT::VARCHAR END AS evidence_value FROM lineitem""")
def number_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three readings side by side; the table reading is the lenient one here, since it stops on what is no number."""
    price, kind = F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.col("l_linenumber") % 4
    comma = F.replace(price, F.lit("."), F.lit(","))
    raw = F.when(kind == 0, price).when(kind == 1, comma).when(kind == 2, F.concat(F.lit("R$ "), comma)).otherwise(F.concat(F.col("l_quantity").cast("int"), F.lit("%")))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("raw", raw)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", N.table_text(F.col("raw")).try_cast(N.MONEY).cast("double").alias("table_value"), N.profile_number(F.col("raw")).alias("profile_value"), N.evidence_number(F.col("raw")).alias("evidence_value"))


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, {_SHORT} AS price, l_quantity::INT::VARCHAR AS q, l_shipdate::DATE AS d FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, list_sort(list_distinct([price, q, year(d)::VARCHAR, month(d)::VARCHAR, day(d)::VARCHAR])) AS numbers, [q] AS percents, [price] AS amounts, [d::VARCHAR] AS dates FROM t""")
def values_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.replace(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    text = F.concat(F.lit("Paid R$ "), price, F.lit(" on "), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(", then "), F.col("l_quantity").cast("int"), F.lit("% of it"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", text.alias("text"))  # written once, read by four
    text = F.col("text")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", N.numbers_in(text).alias("numbers"), N.percentages_in(text).alias("percents"), N.currencies_in(text).alias("amounts"), N.dates_in(text).alias("dates"))


# a text against its own beginning, two of its words turned round, or words that stand nowhere
_W = r"regexp_extract(text, '^(\S+) (\S+) (\S+)', {})"
_TURNED = f"{_W.format(3)} || ' ' || {_W.format(1)}"
_VARIANT = f"CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 25) WHEN doc_id % 3 = 1 AND NOT regexp_matches({_TURNED}, '[0-9$%]') THEN {_TURNED} ELSE 'qqqq zzzz' END"


@query(f"""WITH t AS (SELECT doc_id, {_NORM.format('text')} AS plain, {_NORM.format(_VARIANT)} AS key, {tokens_sql(_VARIANT)} AS words FROM documents)
 SELECT doc_id, CASE WHEN plain = '' THEN 'not_found' WHEN key <> '' AND contains(plain, key) THEN 'explicit' WHEN len(words) > 0 AND len(list_filter(words, lambda w: NOT contains(plain, w))) = 0 THEN 'implicit' ELSE 'not_found' END AS level FROM t""")
def support_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda n: F.regexp_extract("text", r"^(\S+) (\S+) (\S+)", n)
    turned, kind = F.concat(word(3), F.lit(" "), word(1)), F.col("doc_id") % 3
    variant = F.when(kind == 0, F.substring("text", 1, 25)).when((kind == 1) & ~turned.rlike("[0-9$%]"), turned).otherwise("qqqq zzzz")
    return docs(spark, sf_dir).select("doc_id", E.support_level(F.col("text"), variant).alias("level"))


@query("SELECT c_custkey, c_custkey % 6 = 0 AS person, c_custkey % 6 IN (0, 2) AS role, c_custkey % 6 IN (0, 2) AS import_role FROM customer WHERE c_custkey % 6 <> 5 UNION ALL SELECT c_custkey, false, true, false FROM customer WHERE c_custkey % 6 = 5")
def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and roles: a name, a name with digits that is no number, a total, capitals alone, nothing, a header's word."""
    value = F.element_at(F.array(F.concat(F.lit("Maria "), "c_mktsegment"), F.lit("12,5"), F.lit("Total geral"), F.lit("UFC"), F.lit(""), F.lit("Column")), (F.col("c_custkey") % 6 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", T.is_person_name(value).alias("person"), T.is_role(value).alias("role"), T.is_role(value, T.ROLE_BLOCKED_IMPORT).alias("import_role"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 3 = 0 AS role FROM lineitem")
def role_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("Analista "), "l_returnflag")).when(F.col("l_linenumber") % 3 == 1, F.date_format("l_shipdate", "yyyy-MM-dd 'Analista'")).otherwise(F.col("l_quantity").cast("string"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", T.is_role(value).alias("role"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[^\x{00}-\x{FF}]', '', 'g')) AS text_md5 FROM documents")
def decode_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as UTF-8 with and without a byte order mark, and as Latin-1."""
    text, kind = F.regexp_replace("text", r"[^\x{00}-\x{FF}]", ""), F.col("doc_id") % 3
    content = F.when(kind == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).when(kind == 1, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    return docs(spark, sf_dir).select("doc_id", F.md5(T.decode_with_fallback(content)).alias("text_md5"))


_LISTED = lambda words: ", ".join(f"'{w}'" for w in words)
_VALUES = "v AS (SELECT 'part' AS kind, p_partkey AS key, p_name AS value FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation UNION ALL SELECT 'page', page_id, url FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents)"
_COLLAPSED = r"trim(regexp_replace(value, '[\s\p{Z}]+', ' ', 'g'))"


@query(rf"""WITH {_VALUES}, n AS (SELECT kind, key, {_COLLAPSED} AS t, {_NORM.format('value')} AS name FROM v), w AS (SELECT *, len(regexp_extract_all(t, '[A-Za-zÀ-ÿ]+')) AS words FROM n)
 SELECT kind, key, length(t) >= 5 AND NOT regexp_matches(t, '\p{{Nd}}') AND regexp_matches(t, '\p{{Ll}}') AND name <> '' AND name NOT IN ({_LISTED(T.PERSON_BLOCKED)}) AND words >= 2
   AND NOT ({" OR ".join(f"starts_with(name, '{p}')" for p in T.PERSON_PREFIXES)}) AS person,
  name <> '' AND name NOT IN ({_LISTED(T.ROLE_BLOCKED)}) AND NOT regexp_matches(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND words BETWEEN 1 AND 12 AS role FROM w""")
def people_in_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names, addresses and texts of five tables pass for a person's name, and which for a role; none of them is a number."""
    columns = (("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"), ("pages", "page_id", "url"), ("documents", "doc_id", "text"))
    every = None
    for table, key, value in columns:
        kind = {"pages": "page", "documents": "document"}.get(table, table)
        one = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("key"), F.col(value).alias("value"))
        every = one if every is None else every.unionByName(one)
    return every.select("kind", "key", T.is_person_name(F.col("value")).alias("person"), T.is_role(F.col("value")).alias("role"))
