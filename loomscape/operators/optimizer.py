"""Optimiser steps and density control on tables of primitives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

B1, B2, EPS = 0.9, 0.999, 1e-15


def adam(value: Column, grad: Column, m: Column, v: Column, step: int, rate: float) -> tuple[Column, Column, Column]:
    """New value and moments of one parameter, with bias correction."""
    m2 = B1 * m + (1 - B1) * grad
    v2 = B2 * v + (1 - B2) * grad * grad
    return value - rate * (m2 / (1 - B1**step)) / (F.sqrt(v2 / (1 - B2**step)) + EPS), m2, v2


def adam_step(splats: DataFrame, gradients: DataFrame, rates: dict[str, float], step: int, ident: str = "splat_id") -> DataFrame:
    """splats (with m_* and v_* columns) after one step on gradients (d_* columns); those
    without gradients take a step on zeros."""
    joined = splats.join(gradients.select(ident, *(f"d_{p}" for p in rates)), ident, "left")
    new = {}
    for p, rate in rates.items():
        x, m, v = adam(F.col(p), F.coalesce(f"d_{p}", F.lit(0.0)), F.coalesce(f"m_{p}", F.lit(0.0)), F.coalesce(f"v_{p}", F.lit(0.0)), step, rate)
        new |= {p: x, f"m_{p}": m, f"v_{p}": v}
    return joined.withColumns(new).drop(*(f"d_{p}" for p in rates))


def top_fraction(splats: DataFrame, score: str, fraction: float, ident: str = "splat_id") -> DataFrame:
    """The round(fraction n) rows of highest score, ties by id: a limit that each part
    applies before rows meet."""
    many = int(fraction * splats.count() + 0.5)
    return splats.orderBy(F.desc(score), ident).limit(many)


def clone(splats: DataFrame, chosen: DataFrame, ident: str, offset: Column) -> DataFrame:
    """splats and copies of those chosen, copies under new ids."""
    return splats.unionByName(splats.join(chosen.select(ident), ident, "left_semi").withColumn(ident, offset))


def prune(splats: DataFrame, opacity: Column, scale: Column, least: float, most: float | Column) -> DataFrame:
    """Without primitives that are too faint or too large; all stay where none would."""
    keep = (opacity >= least) & (scale <= most)
    flagged = splats.withColumn("_keep", keep)
    some = not flagged.where("_keep").isEmpty()
    return (flagged.where("_keep") if some else flagged).drop("_keep")


def keep_moments(splats: DataFrame, moments: DataFrame, names: Sequence[str], ident: str = "splat_id") -> DataFrame:
    """splats with their moments; new primitives get zeros."""
    out = splats.join(moments.select(ident, *names), ident, "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})


def reset_opacity(logit: Column, value: float = 0.01) -> Column:
    import math

    return F.least(logit, F.lit(math.log(value / (1 - value))))


def reset_opacities(splats: DataFrame, name: str = "logit", value: float = 0.01) -> DataFrame:
    """splats of an opacity of at most value, whose moments begin anew."""
    return splats.withColumns({name: reset_opacity(F.col(name), value), f"m_{name}": F.lit(0.0), f"v_{name}": F.lit(0.0)})
