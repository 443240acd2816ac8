"""Pictures of very many primitives cost what is seen of them."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from loomscape.operators import splats as S


def stack(spark, n):
    """Primitives behind each other, each over a whole picture of 48 x 40."""
    wide = {"u": 24.0, "v": 20.0, "ka": 1e-3, "kb": 0.0, "kc": 1e-3, "radius": 95.0, "opacity": 0.4}
    shades = {c: (F.col("id") % (k + 2) + 1) / (k + 3) for k, c in enumerate("rgb")}
    return spark.range(n).select(F.col("id").alias("splat_id"), (1 + F.floor(F.col("id") / 7)).cast("double").alias("depth"), *(F.lit(v).alias(c) for c, v in wide.items()), *(e.alias(c) for c, e in shades.items()))


def test_hidden_primitives_cost_no_pixels(spark):
    """100,000 primitives cover 192 million pixels, of which some twenty layers are seen."""
    ask = lambda n: {(r.x, r.y): (r.r, r.g, r.b, r.through) for r in S.render(stack(spark, n), 48, 40, ["r", "g", "b"], [0.1, 0.2, 0.3]).collect()}
    few, begin = ask(400), time.time()
    many = ask(100_000)
    assert time.time() - begin < 60 and len(many) == 48 * 40
    assert all(np.allclose(many[k], few[k], atol=1e-12) for k in many)


def test_gradients_look_no_farther_than_light(spark):
    goal = spark.range(48 * 40).select((F.col("id") % 48).alias("x"), F.floor(F.col("id") / 48).alias("y"), *(F.lit(0.5).alias(f"t_{c}") for c in "rgb"))
    ask = lambda n: {r.splat_id: tuple(r) for r in S.image_gradients(stack(spark, n), goal, 48 * 40, 48, 40, ["r", "g", "b"], [0.0] * 3).collect()}
    few, begin = ask(400), time.time()
    many = ask(100_000)
    assert time.time() - begin < 60 and many.keys() == few.keys() and len(many) < 100
    assert all(np.allclose(many[k], few[k], atol=1e-12) for k in many)
