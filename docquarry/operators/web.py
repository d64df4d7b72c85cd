"""Pages and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import urls as U

BATCH, DISCOVERY_LIMIT = 25, 120


def links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page, pos, href, target: the anchors of each page in document order; target is the normalized absolute URL, null without a host."""
    found = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("base"), F.posexplode(U.hrefs(F.col(html_col))).alias("pos", "href"))
    # step by step, so that no step repeats the expressions of the one before and all stay in generated code
    whole = found.withColumn("absolute", U.resolve(F.col("base"), F.col("href")))
    parts = whole.select("*", U.scheme(F.col("absolute")).alias("s"), U.host(F.col("absolute")).alias("h"), F.regexp_replace(U.path(F.col("absolute")), "/+$", "").alias("p"))
    target = F.when(F.col("h") != "", F.concat("s", F.lit("://"), "h", F.when(F.col("p") == "", F.lit("/")).otherwise(F.col("p"))))
    return parts.select("page", "pos", "href", target.alias("target"), "base")


def docs_links(found: DataFrame, root: str = "root", prefix: str = "prefix") -> DataFrame:
    """page, url, place: links on the root's host, below its prefix and no static files, each once; the root leads, then by depth and text.

    found: page, target, root, prefix.
    """
    below = (F.col(prefix) == "/") | (U.path(F.col("target")) == F.col(prefix)) | F.startswith(U.path(F.col("target")), F.concat(F.col(prefix), F.lit("/")))
    good = found.where((U.host(F.col("target")) == U.host(F.col(root))) & ~U.is_static(U.path(F.col("target"))) & below).select("page", F.col("target").alias("url"), root)
    every = good.unionByName(found.select("page", F.col(root).alias("url"), root)).distinct()
    order = Window.partitionBy("page").orderBy((F.col("url") != F.col(root)).cast("int"), U.depth(F.col("url")), "url")
    return every.withColumn("place", F.row_number().over(order)).select("page", "url", "place")


def root_vote(found: DataFrame) -> DataFrame:
    """page, root, votes: the documentation root that most links of a page on its own site point to; ties by depth, then text.

    found: page, base, target.
    """
    own = found.where(F.col("target").isNotNull() & U.same_site(U.host(F.col("base")), U.host(F.col("target"))))
    named = own.withColumn("prefix", U.docs_prefix(F.col("target"))).where("prefix is not null")
    votes = named.groupBy("page", F.concat(U.scheme(F.col("target")), F.lit("://"), U.host(F.col("target")), F.col("prefix")).alias("root")).agg(F.count(F.lit(1)).alias("votes"))
    order = Window.partitionBy("page").orderBy(F.desc("votes"), F.greatest(U.depth(F.col("root")), F.lit(1)), "root")
    return votes.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def kept_pages(pages: DataFrame, text: str = "markdown", url: str = "url", order: str = "ord") -> DataFrame:
    """Pages with text, the first of each URL (all without one), numbered by their place in the input, so gaps remain."""
    full = pages.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    named = full.where(F.coalesce(F.col(url), F.lit("")) != "")
    with_url = named.groupBy(url).agg(F.min_by(F.struct(*pages.columns), F.col(order)).alias("__row")).select("__row.*")  # one page of a URL leaves each task
    return with_url.unionByName(full.where(F.coalesce(F.col(url), F.lit("")) == ""))


def in_batches(df: DataFrame, order: str, size: int = BATCH, group: str | None = None) -> DataFrame:
    """df with its batch of size rows in order, from 0."""
    from docquarry.operators.ingest import _nth

    placed = _nth(df, [F.col(order)], "__nth", [group] if group else None)
    return placed.withColumn("batch", F.floor((F.col("__nth") - 1) / size).cast("int")).drop("__nth")
