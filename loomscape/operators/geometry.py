"""Aggregations over observations: normal equations, residuals and focal sweeps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscape.functions.vectors import upper_median


def hartley(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Each key's centroid (m_*) and the scale that makes the mean distance from it the
    root of the number of dimensions: two aggregations, joined on the key."""
    centre = rows.groupBy(*keys).agg(*(F.avg(n).alias(f"m_{n}") for n in names))
    off = sum(((F.col(n) - F.col(f"m_{n}")) ** 2 for n in names[1:]), (F.col(names[0]) - F.col(f"m_{names[0]}")) ** 2)
    far = rows.join(centre, keys).groupBy(*keys).agg(F.avg(F.sqrt(off)).alias("far"))
    return centre.join(far, keys).select(*keys, *(f"m_{n}" for n in names), F.when(F.col("far") > 0, float(len(names)) ** 0.5 / F.col("far")).alias("scale"))


def gram(rows: DataFrame, keys: list[str], names: Sequence[str]) -> DataFrame:
    """Upper half of each key's sum of outer products."""
    return rows.groupBy(*keys).agg(*(F.sum(F.col(a) * F.col(b)).alias(f"g_{a}{b}") for i, a in enumerate(names) for b in names[i:]))


def residuals(obs: DataFrame, focal: float, cx: float, cy: float) -> DataFrame:
    """Adds residuals (ru, rv) and their derivatives by the camera-space point (x, y, z)."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    parts = {"ru": focal * x / z + cx - F.col("u"), "rv": focal * y / z + cy - F.col("v"), "jux": focal / z, "juz": -focal * x / (z * z), "jvy": focal / z, "jvz": -focal * y / (z * z)}
    return obs.withColumns(parts)


def point_blocks(obs: DataFrame, point: str, focal: float, cx: float, cy: float) -> DataFrame:
    """The 3 x 3 normal matrix and gradient of every point; one shuffle, combined before it."""
    c = F.col
    sums = {
        "h_xx": c("jux") * c("jux"), "h_yy": c("jvy") * c("jvy"), "h_xz": c("jux") * c("juz"), "h_yz": c("jvy") * c("jvz"), "h_zz": c("juz") * c("juz") + c("jvz") * c("jvz"),
        "g_x": c("jux") * c("ru"), "g_y": c("jvy") * c("rv"), "g_z": c("juz") * c("ru") + c("jvz") * c("rv"),
    }
    return residuals(obs, focal, cx, cy).groupBy(point).agg(F.count("*").alias("n"), *(F.sum(e).alias(n) for n, e in sums.items()))


def schur(obs: DataFrame, point: str, camera: str, focal: float, cx: float, cy: float) -> DataFrame:
    """Camera by camera sums over shared points, with each point's block eliminated.

    Blocks are summed by point and camera first; cameras of one point then meet in an
    equi-join on the point, so that work follows the points' numbers of cameras.
    """
    r = residuals(obs, focal, cx, cy)
    w = r.groupBy(point, camera).agg(F.sum(F.col("jux") * F.col("ru")).alias("a"), F.sum(F.col("jvy") * F.col("rv")).alias("b"))
    h = r.groupBy(point).agg(F.sum(F.col("jux") * F.col("jux") + F.col("jvy") * F.col("jvy")).alias("h"))
    i = w.join(h, point).select(point, F.col(camera).alias("cam_i"), (F.col("a") / F.col("h")).alias("ai"), (F.col("b") / F.col("h")).alias("bi"))
    j = w.select(point, F.col(camera).alias("cam_j"), F.col("a").alias("aj"), F.col("b").alias("bj"))
    return i.join(j, point).where("cam_j >= cam_i").groupBy("cam_i", "cam_j").agg(F.sum(F.col("ai") * F.col("aj") + F.col("bi") * F.col("bj")).alias("s"))


def rmse(obs: DataFrame, keys: list[str], focal: float, cx: float, cy: float) -> DataFrame:
    """Root mean square reprojection error and count of points before the camera."""
    r = residuals(obs.where("z > 1e-9"), focal, cx, cy)
    return r.groupBy(*keys).agg(F.sqrt(F.sum(F.col("ru") ** 2 + F.col("rv") ** 2) / F.count("*")).alias("rmse"), F.count("*").alias("n"))


def drop_outliers(obs: DataFrame, point: str, most: float, focal: float, cx: float, cy: float, least: int = 2) -> DataFrame:
    """Observations within most pixels, of points that keep least of them."""
    near = residuals(obs, focal, cx, cy).where(F.sqrt(F.col("ru") ** 2 + F.col("rv") ** 2) < most)
    enough = near.groupBy(point).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(point)
    return near.join(enough, point, "left_semi").select(*obs.columns)


def sweep(rows: DataFrame, pair: str, multipliers: Sequence[float], cost: Callable[[Column], Column]) -> DataFrame:
    """Each pair's mean cost at each multiplier; all of them in one pass over the rows."""
    sums = rows.groupBy(pair).agg(*(F.avg(cost(F.lit(m))).alias(f"_{k}") for k, m in enumerate(multipliers)))
    curve = F.array(*(F.struct(F.lit(m).alias("mult"), F.col(f"_{k}").alias("cost")) for k, m in enumerate(multipliers)))
    return sums.select(pair, F.explode(curve).alias("c")).select(pair, "c.mult", "c.cost")


def normalised_sum(curve: DataFrame, pair: str) -> DataFrame:
    """Curves over their own upper median, summed by multiplier."""
    middle = upper_median(F.collect_list("cost").over(Window.partitionBy(pair)))
    return curve.withColumn("_mid", middle).groupBy("mult").agg(F.sum(F.col("cost") / F.col("_mid")).alias("total"), F.count("*").alias("pairs"))
