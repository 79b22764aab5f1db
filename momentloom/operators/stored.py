"""Intermediate tables: written once to shared storage when several branches of a plan read them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

_TAKEN: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new folder below the session's checkpoint folder, which all executors must share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    path = f"{base.rstrip('/')}/{name}-{os.urandom(6).hex()}"
    _TAKEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete every folder taken so far in this application; frames that read them are no longer usable."""
    jvm = spark.sparkContext._jvm
    for path in _TAKEN.pop(spark.sparkContext.applicationId, []):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage ends, columns stay prunable, sizes are known."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
