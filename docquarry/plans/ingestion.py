"""Queries on imports, pages, links, conversations and stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import urls as U
from docquarry.operators import ingest, sessions, web
from docquarry.plans.passages import docs
from docquarry.plans.registry import query

# two states of the orders as files: a later listing with dear urgent ones and without low ones, an earlier manifest without finished ones
_SNAPSHOT = """n AS (SELECT o_orderkey AS id, sha256(o_orderstatus || '|' || CASE WHEN o_totalprice > 300000 THEN 'x' ELSE o_orderpriority END) AS signature FROM orders WHERE o_orderpriority NOT LIKE '5%'),
 m AS (SELECT o_orderkey AS id, sha256(o_orderstatus || '|' || o_orderpriority) AS signature, 'f' || o_orderkey || '.md' AS output_file, o_totalprice > 50000 AS output_exists FROM orders WHERE o_orderstatus <> 'F'),
 d AS (SELECT coalesce(n.id, m.id) AS id, CASE WHEN n.id IS NULL THEN 'deleted' WHEN m.id IS NULL THEN 'new' WHEN n.signature = m.signature AND output_exists THEN 'cached' ELSE 'changed' END AS status, output_file
   FROM n FULL JOIN m ON n.id = m.id)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sign = lambda p: F.sha2(F.concat_ws("|", "o_orderstatus", p), 256).alias("signature")
    key = F.col("o_orderkey").alias("id")
    listing = orders.where("o_orderpriority NOT LIKE '5%'").select(key, sign(F.when(F.col("o_totalprice") > 300000, F.lit("x")).otherwise(F.col("o_orderpriority"))))
    manifest = orders.where("o_orderstatus <> 'F'").select(key, sign(F.col("o_orderpriority")), F.concat(F.lit("f"), "o_orderkey", F.lit(".md")).alias("output_file"), (F.col("o_totalprice") > 50000).alias("output_exists"))
    return listing, manifest


@query(f"WITH {_SNAPSHOT} SELECT id, status, output_file FROM d")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.snapshot_diff(*snapshots(spark, sf_dir))


@query(f"WITH {_SNAPSHOT}, c AS (SELECT count(*) FILTER (status <> 'deleted') AS checked, count(*) FILTER (status = 'cached') AS cached, count(*) FILTER (status = 'new') AS \"new\", count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'deleted') AS deleted FROM d) SELECT *, \"new\" + changed AS processed FROM c")
def import_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.import_counters(ingest.snapshot_diff(*snapshots(spark, sf_dir)))


@query("""WITH u AS (SELECT p_partkey AS number FROM part WHERE p_size <= 15), w AS (SELECT p_name, p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS n FROM part),
 f AS (SELECT i AS number, row_number() OVER (ORDER BY i) AS n FROM range(1, (SELECT count(*) FROM w) + (SELECT count(*) FROM u) + 1) t(i) WHERE i NOT IN (SELECT number FROM u))
 SELECT p_partkey, number FROM w JOIN f USING (n)""")
def number_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    used = part.where("p_size <= 15").select(F.col("p_partkey").alias("number"))
    return ingest.allocate_numbers(part.select("p_partkey", "p_name"), used, ["p_name", "p_partkey"]).select("p_partkey", "number")


@query("""WITH a AS (SELECT c_custkey AS id, 's' || c_nationkey AS safe_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer),
 b AS (SELECT 's' || s_nationkey AS safe_name, s_name AS output_file, row_number() OVER (PARTITION BY s_nationkey ORDER BY lower(s_name), s_name) AS n FROM supplier)
 SELECT id, output_file FROM a JOIN b USING (safe_name, n)""")
def bootstrap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"), F.concat(F.lit("s"), "c_nationkey").alias("safe_name"))
    have = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("s"), "s_nationkey").alias("safe_name"), F.col("s_name").alias("output_file"))
    return ingest.pair_with_existing(files, have).select("id", "output_file")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


_URL = r"regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', {n})"


def _part(u: str, n: int) -> str:
    return _URL.format(u=u, n=n)


def _normal(u: str) -> str:
    short = f"regexp_replace({_part(u, 3)}, '/+$', '')"
    return f"CASE WHEN {_part(u, 2)} <> '' THEN lower({_part(u, 1)}) || '://' || {_part(u, 2)} || CASE WHEN {short} = '' THEN '/' ELSE {short} END END"


@query(f"SELECT page_id, {_normal('url')} AS url FROM pages")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.normalize_url(F.col("url")).alias("url"))


_LINKS = f"""h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*?href="([^"]+)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a [^>]*?href="([^"]+)"', 1), 1) - 1 AS pos FROM pages),
 r AS (SELECT page_id AS page, pos, href, url AS base, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN {_part('url', 1)} || ':' || href
   WHEN href LIKE '/%' THEN lower({_part('url', 1)}) || '://' || {_part('url', 2)} || href WHEN regexp_matches(href, '^[?#]') THEN lower({_part('url', 1)}) || '://' || {_part('url', 2)} || {_part('url', 3)} || href
   ELSE lower({_part('url', 1)}) || '://' || {_part('url', 2)} || coalesce(nullif(regexp_replace({_part('url', 3)}, '[^/]*$', ''), ''), '/') || href END AS target0 FROM h),
 l AS (SELECT page, pos, href, base, {_normal('target0')} AS target FROM r)"""


@query(f"WITH {_LINKS} SELECT page, pos::INT AS pos, href, target FROM l")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.links(pages(spark, sf_dir)).select("page", "pos", "href", "target")


@query(f"""WITH {_LINKS} SELECT page, pos::INT AS pos FROM l WHERE regexp_matches(lower({_part('target', 3)}), '[.](png|jpg|jpeg|gif|svg|webp|ico|css|js|xml|json|txt|zip|mp4|mov|avi|webm)$')""")
def static_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.links(pages(spark, sf_dir)).where(U.is_static(U.path(F.col("target")))).select("page", "pos")


@query(f"""WITH p AS (SELECT page_id, {_part('url', 2)} AS host, {_part('url', 3)} AS path FROM pages), s AS (SELECT page_id, host, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM p),
 m AS (SELECT page_id, host, seg, list_position(list_transform(seg, lambda x: lower(x) IN ('docs', 'documentation', 'guide', 'guides', 'manual', 'help', 'learn')), true) AS k FROM s)
 SELECT page_id, CASE WHEN lower(string_split(host, '.')[1]) = 'docs' THEN '/' WHEN k > 0 THEN '/' || array_to_string(seg[1:k], '/') WHEN len(seg) > 0 THEN '/' || seg[1] ELSE '/' END AS prefix FROM m""")
def docs_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", U.docs_scope(F.col("url")).alias("prefix"))


@query(f"""WITH {_LINKS}, o AS (SELECT page, base, target, {_part('target', 2)} AS th, {_part('base', 2)} AS bh FROM l)
 SELECT page, count(*) AS links FROM o WHERE th = bh OR ends_with(th, '.' || bh) OR ends_with(bh, '.' || th) GROUP BY page""")
def same_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = web.links(pages(spark, sf_dir))
    return found.where(U.same_site(U.host(F.col("base")), U.host(F.col("target")))).groupBy("page").agg(F.count(F.lit(1)).alias("links"))


@query(f"""WITH {_LINKS}, f AS (SELECT page, target AS url, lower({_part('base', 1)}) || '://' || {_part('base', 2)} || '/' AS root FROM l), g AS (SELECT DISTINCT page, url, root FROM f
   WHERE {_part('url', 2)} = {_part('root', 2)} AND NOT regexp_matches(lower({_part('url', 3)}), '[.](png|jpg|jpeg|gif|svg|webp|ico|css|js|xml|json|txt|zip|mp4|mov|avi|webm)$')
   UNION SELECT page, root, root FROM f)
 SELECT page, url, (row_number() OVER (PARTITION BY page ORDER BY (url <> root)::INT, len(list_filter(string_split({_part('url', 3)}, '/'), lambda x: x <> '')), url))::INT AS place FROM g""")
def docs_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = web.links(pages(spark, sf_dir))
    root = F.concat(U.scheme(F.col("base")), F.lit("://"), U.host(F.col("base")), F.lit("/"))
    return web.docs_links(found.select("page", "target", root.alias("root"), F.lit("/").alias("prefix")))


@query("SELECT min(page_id) AS page_id FROM pages WHERE trim(html) <> '' GROUP BY regexp_replace(url, '[?#].*$', '')")
def kept_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"), F.col("html").alias("markdown"), F.col("page_id").alias("ord"))
    return web.kept_pages(rows).select("page_id")


@query("SELECT page_id, ((row_number() OVER (ORDER BY page_id) - 1) // 25)::INT AS batch FROM pages")
def page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.in_batches(pages(spark, sf_dir).select("page_id"), "page_id").select("page_id", "batch")


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6""")
def history_last6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.recent_history(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select("conv_id", "turn", "role")


_DAY = "CASE WHEN date_diff('day', ts::DATE, DATE '2024-01-20') <= 0 THEN 'Today' WHEN date_diff('day', ts::DATE, DATE '2024-01-20') = 1 THEN 'Yesterday' ELSE 'Older' END"


@query(f"SELECT {_DAY} AS section, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def day_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    section = sessions.day_section(F.col("ts"), F.lit("2024-01-20").cast("date"))
    return events.groupBy(section.alias("section")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


_NAMES = "'f' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.csv' WHEN 2 THEN '.png' WHEN 3 THEN '.md' WHEN 4 THEN '.docx' ELSE '.exe' END"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = F.array(*map(F.lit, (".PDF", ".csv", ".png", ".md", ".docx", ".exe")))
    return docs(spark, sf_dir).select("doc_id", F.concat(F.lit("f"), "doc_id", F.element_at(endings, (F.col("doc_id") % 6 + 1).cast("int"))).alias("name"))


@query(f"""WITH f AS (SELECT doc_id, lower(regexp_extract({_NAMES}, '[.]([^.]+)$', 1)) AS e FROM documents)
 SELECT doc_id, CASE WHEN e IN ('md', 'txt') THEN 'text' WHEN e IN ('csv', 'xlsx') THEN 'spreadsheet' WHEN e = 'pdf' THEN 'pdf' WHEN e IN ('docx', 'png') THEN 'rich' END AS route FROM f""")
def upload_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("doc_id", ingest.upload_route(F.col("name")).alias("route"))


@query("SELECT CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'spreadsheet' WHEN 2 THEN 'image' ELSE 'other' END AS kind, count(*) AS files FROM documents GROUP BY 1")
def type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("application/pdf", "text/csv", "image/png", "text/markdown", "x", "y")))
    rows = named(spark, sf_dir).withColumn("kind", ingest.file_kind(F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")), F.col("name")))
    return ingest.kind_summary(rows)


@query("""SELECT doc_id, CASE WHEN n_chars = 0 OR doc_id % 17 = 0 THEN 'skipped' ELSE 'saved' END AS status, CASE WHEN doc_id % 17 = 0 THEN 'empty file' WHEN n_chars = 0 THEN 'no text' END AS reason FROM documents""")
def ingest_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", "text", F.when(F.col("doc_id") % 17 == 0, 0).otherwise(1).alias("size"), F.lit(None).cast("string").alias("error"))
    return ingest.ingest_outcome(rows).select("doc_id", "status", "reason")


@query("""SELECT source, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source""")
def collection_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


@query(f"""WITH {_SNAPSHOT}, t AS (SELECT id, status, output_file FROM d WHERE status IN ('new', 'changed')), w AS (SELECT id, status, row_number() OVER (ORDER BY id) AS n FROM t WHERE output_file IS NULL),
 f AS (SELECT i AS number, row_number() OVER (ORDER BY i) AS n FROM range(1, (SELECT count(*) FROM w) + 4) t(i) WHERE i NOT IN (1, 4, 5))
 SELECT id, status, output_file FROM t WHERE output_file IS NOT NULL UNION ALL SELECT id, status, CASE WHEN number < 10 THEN '0' ELSE '' END || number || '_order_' || id || '.md' FROM w JOIN f USING (n)""")
def import_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole incremental import up to what is written where."""
    listing, manifest = snapshots(spark, sf_dir)
    files = listing.select("id", F.concat(F.lit("order "), "id", F.lit(".pdf")).alias("name"), F.col("id").alias("ord"))
    used = spark.createDataFrame([(1,), (4,), (5,)], "number long")
    return ingest.write_plan(ingest.snapshot_diff(listing, manifest), files, used)


@query("SELECT l_linenumber AS k, CASE WHEN l_linenumber = 7 THEN 100 ELSE least(99, floor(100.0 * l_linenumber / 5))::INT END AS percent FROM lineitem GROUP BY l_linenumber")
def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_linenumber").alias("k")).distinct()
    return rows.select("k", sessions.progress_percent(F.col("k"), F.lit(5), F.col("k") == 7).alias("percent"))


@query("""SELECT conv_id, count(*) AS sound FROM conversations WHERE role IN ('user', 'assistant', 'system') AND trim(text) <> '' GROUP BY conv_id""")
def sound_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.array(F.struct("role", F.col("text").alias("content")))  # message by message, however long a conversation is
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.size(sessions.sound_messages(one)).alias("n"))
    return rows.groupBy("conv_id").agg(F.sum("n").alias("sound")).where("sound > 0")
