"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_inside: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``. Where that is unset, a local folder in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = _local[0]
    return f"{base}/tidemill-{name}-{uuid.uuid4().hex}"


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the tables written inside on leaving, all but those taken out of the list that it gives."""
    paths: list[str] = []
    _inside.append(paths)
    try:
        yield paths
    finally:
        _inside.remove(paths)
    for path in paths:
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet there and read it back: no lost executor loses it, no reader computes it again."""
    path = shared_path(df.sparkSession, name)
    for paths in _inside:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
