"""Small tables of which the newest version counts: manifests, chat states, sidecars, pointers.

A version is a folder of its own, and stands once a marker with its number is there. Data goes first and the marker last; it is
created only where none of that number is, so of two writers that started from one version the second fails and may try again on the
new one. What a writer left without a marker is never read. An empty table is a version like any other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since the version that this one started from."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and folder of the newest version; 0 and None where there is none."""
    at, fs = _path(spark, f"{path.rstrip('/')}/commits")
    if not fs.exists(at):
        return 0, None
    names = sorted((m.getPath().getName() for m in fs.listStatus(at) if m.getLen()), reverse=True)  # a marker without content is not written yet
    names = [n for n in names if n.isdigit()]
    if not names:
        return 0, None
    marker, _ = _path(spark, f"{path.rstrip('/')}/commits/{names[0]}")
    stream = fs.open(marker)
    try:
        return int(names[0]), stream.readUTF()
    finally:
        stream.close()


def save(df: DataFrame, path: str, base: int | None = None) -> int:
    """Write df as the version after base (default: after the newest) and return its number; Conflict if that number is taken."""
    spark, path = df.sparkSession, path.rstrip("/")
    base = current(spark, path)[0] if base is None else base
    folder = f"{path}/versions/{base + 1:012d}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    marker, fs = _path(spark, f"{path}/commits/{base + 1:012d}")
    try:
        stream = fs.create(marker, False)
    except Py4JJavaError as wrong:
        raise Conflict(f"{path} has moved on from version {base}") from wrong
    stream.writeUTF(folder)
    stream.close()
    return base + 1


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version at path, or an empty table."""
    folder = current(spark, path)[1]
    return spark.createDataFrame([], schema) if folder is None else spark.read.schema(schema).parquet(folder)


def change(spark: SparkSession, path: str, schema: str, how: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
    """Replace the newest version by how(it). Where another writer comes first, how is asked again on what that one left."""
    for left in range(tries - 1, -1, -1):
        base, folder = current(spark, path)
        old = spark.createDataFrame([], schema) if folder is None else spark.read.schema(schema).parquet(folder)
        try:
            return save(how(old), path, base)
        except Conflict:
            if not left:
                raise
    raise AssertionError
