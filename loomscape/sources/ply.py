"""Point clouds as ASCII PLY."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ply_rows(points: DataFrame, cameras: DataFrame, point: str, frame: str) -> DataFrame:
    """part, ord and line: points in grey, then camera centres in red."""
    xyz = [F.col(c) for c in ("x", "y", "z")]
    a = points.select(F.lit(0).cast("long").alias("part"), F.col(point).cast("long").alias("ord"), F.format_string("%.6f %.6f %.6f 200 200 200", *xyz).alias("line"))
    b = cameras.select(F.lit(1).cast("long").alias("part"), F.col(frame).cast("long").alias("ord"), F.format_string("%.6f %.6f %.6f 255 40 40", *xyz).alias("line"))
    return a.unionByName(b)


def write_ply(points: DataFrame, cameras: DataFrame, path: str, point: str = "pt", frame: str = "frame") -> None:
    """One text file: range-sorted in all tasks, then written in order by the last one."""
    rows = ply_rows(points, cameras, point, frame)
    n = points.count() + cameras.count()
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *(f"property float {c}" for c in "xyz"), *(f"property uchar {c}" for c in ("red", "green", "blue")), "end_header"]
    spark = points.sparkSession
    first = spark.createDataFrame([(-1, i, x) for i, x in enumerate(head)], "part long, ord long, line string")
    first.unionByName(rows).orderBy("part", "ord").select("line").coalesce(1).write.mode("overwrite").text(path)
