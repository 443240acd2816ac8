"""Devices, their budgets, and views around a scene."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Words of device names by maker, in order of precedence.
VENDOR_WORDS = {
    "apple": ["apple"],
    "nvidia": ["nvidia", "geforce", "quadro"],
    "amd": ["amd", "radeon", "firepro", "vega"],
    "intel": ["intel", "iris", "hd graphics", "uhd graphics"],
}
# Share of the working set that may be used; most primitives; most and per GiB.
SHARES = {"nvidia": 0.6, "amd": 0.7}
CEILINGS = {"nvidia": 1_000_000, "intel": 750_000, "unknown": 500_000}
SCALED = {"amd": (4_000_000, 1_000_000), "apple": (6_000_000, 750_000)}
TILES = {"nvidia": 16, "amd": 32, "intel": 16, "apple": 32, "unknown": 16}
# Precision of stored and of computed numbers.
PRECISIONS = {"nvidia": ("fp16", "fp32"), "amd": ("fp16", "fp32"), "intel": ("fp16", "fp32"), "apple": ("fp16", "fp16"), "unknown": ("fp32", "fp32")}


def vendor(name: Column) -> Column:
    low = F.lower(name)
    out = F
    for maker, words in VENDOR_WORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, maker)
    return out.otherwise("unknown")


def pick_device(devices: DataFrame, host: str) -> DataFrame:
    """Each host's device: not a low-power one if it can be, then the largest working set."""
    w = Window.partitionBy(host).orderBy("low_power", F.desc("working_set"), "id")
    return devices.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def decide(devices: DataFrame) -> DataFrame:
    """Adds vendor, budget in bytes, the most primitives that a device should hold, the
    side of its tiles, and the precisions that it stores and computes with."""
    out = devices.withColumn("vendor", vendor(F.col("name")))
    v, ws = F.col("vendor"), F.col("working_set")
    share, ceiling = F, F
    for k, s in SHARES.items():
        share = share.when(v == k, s)
    for k, n in CEILINGS.items():
        ceiling = ceiling.when(v == k, n)
    for k, (most, each) in SCALED.items():
        ceiling = ceiling.when(v == k, F.least(F.lit(most), F.greatest(F.lit(250_000), F.floor(ws / float(1 << 30) * each))))
    def of(table: dict) -> Column:
        pick = F
        for k, x in table.items():
            pick = pick.when(v == k, F.lit(x))
        return pick

    own = {"budget": F.floor(ws * share.otherwise(0.5)), "ceiling": ceiling.cast("long"), "tile": of(TILES)}
    return out.withColumns(own | {"stored": of({k: a for k, (a, _) in PRECISIONS.items()}), "computed": of({k: b for k, (_, b) in PRECISIONS.items()})})


def older(version: Column, than: tuple[int, int, int]) -> Column:
    """Versions compare by their parts in turn; version is a struct of three."""
    kind = "struct<a:bigint,b:bigint,c:bigint>"
    return version.cast(kind) < F.struct(*(F.lit(v).cast("bigint").alias(n) for v, n in zip(than, "abc", strict=True)))


def turntable(spark: SparkSession, steps: int, distance: float, elevation: float, height: int, fov: float = 50.0) -> DataFrame:
    """step, eye and focal length of views around the origin; +y is down, +z ahead."""
    up = math.radians(max(-89.0, min(89.0, elevation)))
    r = max(distance, 1e-4)
    turn = 2 * math.pi * F.col("step") / steps
    focal = F.lit(height / 2 / math.tan(math.radians(fov) / 2))
    return spark.range(steps).select(F.col("id").alias("step")).withColumns({"ex": r * math.cos(up) * F.sin(turn), "ey": F.lit(-r * math.sin(up)), "ez": -r * math.cos(up) * F.cos(turn), "focal": focal})


def orbit(azimuth: Column, elevation: Column, d_azimuth: Column, d_elevation: Column) -> tuple[Column, Column]:
    most = math.radians(89)
    return azimuth + d_azimuth, F.least(F.greatest(elevation + d_elevation, F.lit(-most)), F.lit(most))


def zoom(distance: Column, factor: Column) -> Column:
    return F.greatest(distance * factor, F.lit(1e-4))
