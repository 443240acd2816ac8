"""Focal length from matches: pair sampling, calibration errors over a sweep of focal
lengths, and the sum of all pairs' curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscape.functions import geometry as G

#: Multiples of the longer image side that are tried.
MULTIPLIERS = (0.30, 0.34, 0.38, 0.42, 0.46, 0.50, 0.58, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 1.00, 1.10, 1.20, 1.35, 1.55, 1.90)

EPIPOLAR = [f"f{i}" for i in range(9)]


def sampled_pairs(frames: DataFrame, group: str, frame: str, order: Sequence[str], gaps: Sequence[int] = (1, 2, 3), most: int = 24) -> DataFrame:
    """group, gap, place, a and b: pairs of frames to try, for each gap at strides that spread
    about most of them over the group's frames; a gap as wide as the group has none."""
    by = Window.partitionBy(group)
    placed = frames.select(group, F.col(frame).alias("a"), (F.row_number().over(by.orderBy(*order)) - 1).alias("place"), F.count("*").over(by).alias("_n"))
    tried = placed.withColumn("gap", F.explode(F.array(*(F.lit(g) for g in gaps)))).where("gap < _n")
    step = F.greatest(F.floor((F.col("_n") - F.col("gap")) / most), F.lit(1))
    tried = tried.where((F.col("place") % step == 0) & (F.col("place") + F.col("gap") < F.col("_n"))).withColumn("_other", F.col("place") + F.col("gap"))
    other = placed.select(group, F.col("place").alias("_other"), F.col("a").alias("b"))
    return tried.join(other, [group, "_other"]).select(group, "gap", "place", "a", "b")


def accepted_pairs(pairs: DataFrame, counts: DataFrame, group: str, least: int = 16, most: int = 24) -> DataFrame:
    """The first most of a group's pairs, small gaps before wide ones, that have at least
    least matches, by counts (group, a, b, n)."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy("gap", "place"))
    enough = pairs.join(counts.where(F.col("n") >= least), [group, "a", "b"])
    return enough.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def _staged(df: DataFrame, prefix: str, values: Sequence[Column]) -> tuple[DataFrame, list[Column]]:
    """The values as columns of their own, so that no later one works them out again."""
    names = [f"_{prefix}{i}" for i in range(len(values))]
    return df.withColumns(dict(zip(names, values, strict=True))), [F.col(n) for n in names]


def calibrated(df: DataFrame, focal: Column, cx: Column, cy: Column) -> tuple[DataFrame, list[Column]]:
    """The essential matrix that the epipolar matrix f0..f8 of pixels has under a camera."""
    zero, one = F.lit(0.0), F.lit(1.0)
    k = [focal, zero, cx, zero, focal, cy, zero, zero, one]
    df, half = _staged(df, "h", G.mat_mul([F.col(n) for n in EPIPOLAR], k))
    return _staged(df, "e", G.mat_mul(G.transpose(k), half))


def _invariants(df: DataFrame, e: list[Column]) -> tuple[DataFrame, list[Column], Column, Column]:
    """e times its transpose, and of e's two large singular values the squares' sum and the
    product: no decomposition is needed."""
    df, a = _staged(df, "a", G.mat_mul(e, G.transpose(e)))
    trace = a[0] + a[4] + a[8]
    square = sum((x * x for x in a[1:]), a[0] * a[0])
    df = df.withColumns({"_t": trace, "_p": F.sqrt(F.greatest((trace * trace - square) / 2, F.lit(0.0)))})
    return df, a, F.col("_t"), F.col("_p")


def asymmetry(df: DataFrame, focal: Column, cx: Column, cy: Column) -> DataFrame:
    """Adds asymmetry, (s1 - s2) / (s1 + s2) of the singular values under a camera; 0 at the
    true focal length; null where there are none."""
    kept = [*df.columns, "asymmetry"]
    df, e = calibrated(df, focal, cx, cy)
    df, _, t, p = _invariants(df, e)
    total = F.sqrt(F.greatest(t + 2 * p, F.lit(0.0)))
    return df.withColumn("asymmetry", F.when(total > 0, F.sqrt(F.greatest(t - 2 * p, F.lit(0.0))) / total)).select(*kept)


def idealised(df: DataFrame, focal: Column, cx: Column, cy: Column) -> DataFrame:
    """df with f0..f8 replaced by the nearest epipolar matrix that a calibrated pair can have:
    both singular values become 1. On the plane that they span, the inverse root of e e'
    is a linear function of it."""
    kept = df.columns
    df, e = calibrated(df, focal, cx, cy)
    df, a, t, p = _invariants(df, e)
    total = F.sqrt(t + 2 * p)
    low = p * total
    df, ae = _staged(df, "b", G.mat_mul(a, e))
    df, one = _staged(df, "i", [F.when(low > 1e-18, ((t + p) * x - y) / low) for x, y in zip(e, ae, strict=True)])
    zero = F.lit(0.0)
    k = [1 / focal, zero, -cx / focal, zero, 1 / focal, -cy / focal, zero, zero, F.lit(1.0)]
    df, half = _staged(df, "g", G.mat_mul(one, k))
    df, f = _staged(df, "f", G.mat_mul(G.transpose(k), half))
    return df.withColumns(dict(zip(EPIPOLAR, f, strict=True))).select(*kept)


def _sampson() -> Column:
    return G.sampson([F.col(n) for n in EPIPOLAR], (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")))


def epipolar_inliers(matches: DataFrame, epipolar: DataFrame, pair: Sequence[str], bound: float = 2.0, least: int = 12) -> DataFrame:
    """Matches (pair, x1, y1, x2, y2) within bound pixels of their pair's epipolar matrix
    (pair, f0..f8), of pairs that have at least least of them."""
    near = matches.join(epipolar, list(pair)).where(_sampson() <= bound * bound).select(*matches.columns)
    enough = near.groupBy(*pair).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*pair)
    return near.join(enough, list(pair), "left_semi")


def focal_curves(matches: DataFrame, epipolar: DataFrame, pair: Sequence[str], long_side: float, cx: float, cy: float, multipliers: Sequence[float] = MULTIPLIERS) -> DataFrame:
    """pair, mult, cost and n: the upper median of the squared first-order epipolar distances
    in pixels under the matrix that a focal length of mult times the long side implies,
    over that focal length, and the number of matches. Each pair's matrices are worked out
    once for all multipliers; its median comes from ranks, so that no pair is gathered.
    Pairs with a distance that is undefined at some multiplier have no curve."""
    sweep = F.explode(F.array(*(F.lit(float(m)) for m in multipliers)))
    under = epipolar.select(*pair, *EPIPOLAR, sweep.alias("mult"))
    under = idealised(under, F.col("mult") * long_side, F.lit(float(cx)), F.lit(float(cy)))
    off = matches.join(under, list(pair)).select(*pair, "mult", _sampson().alias("off")).where("off IS NOT NULL AND NOT isnan(off) AND off < double('inf')")
    by = Window.partitionBy(*pair, "mult")
    ranked = off.withColumns({"_rank": F.row_number().over(by.orderBy("off")), "n": F.count("*").over(by)})
    curve = ranked.where(F.col("_rank") == F.floor(F.col("n") / 2) + 1).select(*pair, "mult", (F.col("off") / (F.col("mult") * long_side)).alias("cost"), "n")
    whole = curve.groupBy(*pair).agg(F.count("*").alias("_n")).where(F.col("_n") == len(multipliers)).select(*pair)
    return curve.join(whole, list(pair), "left_semi")


def summed_curves(curves: DataFrame, group: str, pair: Sequence[str]) -> DataFrame:
    """group, mult, total, pairs and support: curves over their own upper median, summed."""
    by = Window.partitionBy(*pair)
    ranked = curves.withColumns({"_rank": F.row_number().over(by.orderBy("cost", "mult")), "_many": F.count("*").over(by)})
    middle = F.max(F.when(F.col("_rank") == F.floor(F.col("_many") / 2) + 1, F.col("cost"))).over(by)
    usable = ranked.withColumn("_mid", middle).where("_mid > 1e-12")
    return usable.groupBy(group, "mult").agg(F.sum(F.col("cost") / F.col("_mid")).alias("total"), F.count("*").alias("pairs"), F.sum("n").alias("support"))


def chosen_focal(totals: DataFrame, group: str, long_side: float, multipliers: Sequence[float] = MULTIPLIERS) -> DataFrame:
    """One row for each group: the multiplier of the least total (the smallest of equal ones)
    and the focal length, both null where it stands at an end of the sweep, which is no
    measurement; the mean normalised error there, pairs and support."""
    best = totals.groupBy(group).agg(F.min_by(F.struct("mult", "total", "pairs", "support"), F.struct("total", "mult")).alias("_b"))
    inner = ~F.col("_b.mult").isin(float(multipliers[0]), float(multipliers[-1]))
    mult = F.when(inner, F.col("_b.mult"))
    return best.select(group, mult.alias("mult"), (mult * long_side).alias("focal"), (F.col("_b.total") / F.col("_b.pairs")).alias("error"), "_b.pairs", "_b.support")
