"""Tables that a job writes and reads again, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, as in tests, one beside the warehouse, which is shared too; it is set for the session."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df as a table: lineage ends there, lost executors cost nothing before it, and what is not deterministic is settled."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
