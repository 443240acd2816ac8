"""Tables cut from their lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share. Where the session
    has none (tests, local mode) a temporary folder is made and put into its setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomscape-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/loomscape"


def work_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written to the shared folder as Parquet and read again: cuts the lineage and
    survives the loss of executors."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def cut_by(df: DataFrame, key: str, buckets: int, name: str = "cut") -> DataFrame:
    """As cut(), in that many buckets by key: joins and groups by key that are of as many
    partitions read it without a shuffle."""
    path = work_path(df.sparkSession, name)
    table = f"loomscape_{path.rpartition('/')[2].replace('-', '_')}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("compression", "zstd").option("path", path).saveAsTable(table)
    out = df.sparkSession.table(table)
    out._cut_path, out._cut_table = path, table
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes the files of tables that cut() and cut_by() wrote and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_cut_path", None):
            if table := getattr(df, "_cut_table", None):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
            context = df.sparkSession.sparkContext
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
