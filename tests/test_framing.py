"""Ranks by range sort on tables that are larger than the sort's sample."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from loomscape.operators import splats as S


def test_the_rank_stays_over_all_parts(spark):
    n = 400_000
    points = spark.range(n, numPartitions=7).select(*(((F.col("id") * m) % n / 1000).alias(c) for c, m in zip("xyz", (7919, 104729, 1299709))))
    p = np.array([np.arange(n) * m % n / 1000 for m in (7919, 104729, 1299709)]).T
    want = np.sort(np.linalg.norm(p - p.mean(axis=0), axis=1))[int(0.9 * n)] * 1.2 / math.sin(0.5)
    for _ in range(3):
        got = S.framing(points, ["x", "y", "z"], 1.0).first()["distance"]
        assert abs(got - want) < 1e-9 * want
