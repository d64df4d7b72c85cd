"""The stored index against the plain one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import retrieval
from docquarry.sources import postings


@pytest.fixture(scope="module")
def index(spark):
    draw = random.Random(1)
    rows = [(f"t{t}", d, 1.0 + draw.choice([0, 0, 0, 0.69, 1.1, 2.3])) for t in range(60) for d in range(400) if draw.random() < (0.9 if t < 2 else 0.1)]
    rows += [("rare", d, 30.0) for d in range(3)] + [("zero", 5, 0.0)]
    return spark.createDataFrame(rows, "token string, chunk_id long, weight double").repartition(4)


@pytest.mark.parametrize("block", [512, 16])
def test_rows_are_those_of_the_plain_search(spark, index, tmp_path, monkeypatch, block):
    monkeypatch.setattr(postings, "BLOCK", block)
    path = f"file:{tmp_path}/p"
    postings.save(index, path)
    assert sorted(map(tuple, postings.load(spark, path).collect())) == sorted(map(tuple, index.collect()))
    asked = spark.createDataFrame([(1, "t0", 1.0), (1, "t5", 2.0), (2, "rare", 1.0), (2, "t1", 1.5), (3, "nothing", 1.0), (4, "t1", 1.0), (4, "t0", 1.0), (4, "t7", 1.0), (5, "zero", 1.0)], "query_id int, token string, weight double")
    for k in (3, 30):
        found = postings.search(spark, path, asked, k)
        assert sorted(map(tuple, found.rows.collect())) == sorted(map(tuple, retrieval.sparse_top_k(index, asked, k).select(*found.rows.columns).collect()))
    if block == 16:
        met = postings.search(spark, path, asked, 3).met.first()
        assert met["left_blocks"] > 0 and 0 < met["left_postings"] < met["postings"]


def test_a_search_reads_its_buckets_alone(spark, index, tmp_path):
    path = f"file:{tmp_path}/p"
    postings.save(index, path)
    asked = spark.createDataFrame([(1, "rare", 1.0), (1, "t9", 1.0)], "query_id int, token string, weight double")
    some = postings.wanted(spark, path, asked)
    read = lambda df: df.select(F.input_file_name().alias("f")).distinct().count()
    assert read(some) <= 4 < read(postings.blocks(spark, path))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan and "In(token" in plan


def test_no_postings(spark, tmp_path):
    path = f"file:{tmp_path}/p"
    postings.save(spark.createDataFrame([("a", 1, 1.0)], "token string, chunk_id long, weight double"), path)
    none = spark.createDataFrame([], "query_id int, token string, weight double")
    assert postings.search(spark, path, none).rows.count() == 0
    assert postings.search(spark, path, spark.createDataFrame([(1, "b", 1.0)], "query_id int, token string, weight double")).rows.count() == 0
    assert postings.load(spark, path).select(F.sum("weight")).first()[0] == 1.0


def test_saving_makes_each_posting_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from docquarry.sources import postings

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def weight(k):
        made.add(1)
        return float(k)

    rows = spark.range(500).select(F.concat(F.lit("t"), F.col("id") % 7).alias("token"), F.col("id").alias("chunk_id"), weight("id").alias("weight"))
    postings.save(rows, str(tmp_path / "index"))
    assert made.value == 500 and postings.load(spark, str(tmp_path / "index")).count() == 500
