"""Nearest neighbours on grids of several resolutions against all pairs."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomscape.operators import splats as S


def by_hand(points, need):
    out = {}
    for i, p in points.items():
        d = sorted(math.dist(p, q) for j, q in points.items() if j != i)[:need]
        out[i] = sum(d) / len(d) if d else 0.0
    return out


@pytest.mark.parametrize("size", [2, 3])
def test_clusters_and_outliers(spark, size):
    """Clusters of different density, a line, equal points, and outliers 1e6 cells away."""
    rng = random.Random(size)
    found = [[rng.gauss(0, 0.2) for _ in range(size)] for _ in range(150)] + [[rng.gauss(-400, 30) for _ in range(size)] for _ in range(80)]
    found += [[5.0 * k] + [0.0] * (size - 1) for k in range(60)] + [[7.5] * size] * 6
    found += [[1e6] + [0.0] * (size - 1), [-1e6, 3.0] + [0.0] * (size - 2), [1e6 + 20] + [0.0] * (size - 1)]
    points = dict(enumerate(found))
    names = ["x", "y", "z"][:size]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in points.items()], "pt int, " + ", ".join(f"{n} double" for n in names))
    got = {r.id: r.radius for r in S.nearest_radius(df, "pt", names, 1.0).collect()}
    want = by_hand(points, 3)
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) / max(1, want[i]) for i in want) < 1e-9


def test_few_points(spark):
    for n in (0, 1, 2, 3):
        df = spark.createDataFrame([(i, float(i * i), 0.0) for i in range(n)], "pt int, x double, y double")
        got = {r.id: r.radius for r in S.nearest_radius(df, "pt", ["x", "y"], 0.1).collect()}
        assert got == pytest.approx(by_hand({i: (float(i * i), 0.0) for i in range(n)}, 3))


def test_points_without_coordinates_have_no_row(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, None, 0.0), (4, float("nan"), 0.0)], "pt int, x double, y double")
    assert sorted(map(tuple, S.nearest_radius(df, "pt", ["x", "y"], 1.0).collect())) == [(1, 5.0), (2, 5.0)]


def test_an_outlier_does_not_meet_every_point(spark):
    """100,000 points on a plane and one far away: its radius by a plain scan."""
    df = spark.range(100_000).select("id", (F.col("id") % 400).cast("double").alias("x"), (F.col("id") / 400).cast("long").cast("double").alias("y"))
    df = df.unionByName(spark.createDataFrame([(-1, 1e6, 10.0)], "id long, x double, y double"))
    got = S.nearest_radius(df, "id", ["x", "y"], 1.5).where("id = -1").first().radius
    assert got == pytest.approx((2 * math.hypot(1e6 - 399, 1) + 1e6 - 399) / 3, rel=1e-12)


def test_cells_of_very_many_points(spark):
    """40,000 points in one cell, some of them in one place, are not all compared."""
    points = {i: ((i * 7919 % 40_000) / 4e4, (i * 104_729 % 39_989) / 4e4) for i in range(40_000)} | {40_000 + i: (0.5, 0.25 + (i % 2) / 4) for i in range(20_000)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], "pt int, x double, y double")
    began = time.time()
    got = {r.id: r.radius for r in S.nearest_radius(df, "pt", ["x", "y"], 8.0).collect()}
    assert time.time() - began < 60 and got.keys() == points.keys() and not any(got[i] for i in range(40_000, 60_000))
    xy = np.array(list(points.values()))
    for i in range(0, 40_000, 997):
        d = np.sort(np.hypot(*(xy - xy[i]).T))[1:4]
        assert got[i] == pytest.approx(d.mean(), rel=1e-9)
