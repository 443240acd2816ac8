"""Versions of a table in a folder of any file system: whole ones only, the newest first."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"step-(\d{12})-[0-9a-f]{12}$")


def _folder(spark: SparkSession, folder: str):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(context._jsc.hadoopConfiguration())


def generations(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(step, path) of the versions that were written to their end, newest first; of a step
    that was written twice both. A version counts once its writer has left its mark of
    success, which comes after all files have their final names."""
    path, system = _folder(spark, folder)
    if not system.exists(path):
        return []
    found = []
    for status in system.listStatus(path):
        own = status.getPath()
        if (m := _NAME.search(own.toString())) and system.exists(own.suffix("/_SUCCESS")):
            found.append((int(m[1]), own.toString()))
    return sorted(found, reverse=True)


def commit(df: DataFrame, folder: str, step: int, keep: int = 2) -> DataFrame:
    """Writes df as the version of a step and reads it back, cut from its lineage. Older
    versions than the newest keep go, once this one is whole."""
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/step-{step:012d}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)
    for _, old in generations(spark, folder)[keep:]:
        own, system = _folder(spark, old)
        system.delete(own, True)
    return spark.read.schema(df.schema).parquet(path)


def latest(spark: SparkSession, folder: str) -> tuple[int, DataFrame] | None:
    """The newest whole version and its step."""
    found = generations(spark, folder)
    return (found[0][0], spark.read.parquet(found[0][1])) if found else None
