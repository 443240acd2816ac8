"""Damped least squares over cameras and points as block-sparse tables: a block is a row of
named columns, and the reduced camera system is solved by joins and sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscape.functions import geometry as G
from loomscape.sources.work import cut, cut_by, discard

SIX, THREE = range(6), range(3)
POINT_J = [f"p{r}{c}" for r in (0, 1) for c in THREE]
CAMERA_J = [f"c{r}{c}" for r in (0, 1) for c in SIX]
COUPLING = [f"w{r}{c}" for r in SIX for c in THREE]
FEW = 100_000  # cameras whose vectors are broadcast: some 10 MB
BUCKET = 50_000  # couplings to a bucket: some 15 MB


def jacobians(obs: DataFrame, focal: float, cx: float, cy: float) -> DataFrame:
    """Adds residuals ru and rv, and their derivatives by the point (p00..p12) and by a turn
    from the left and a shift of the camera (c00..c15); rows at or behind it go.

    obs holds the point in camera space (tx, ty, tz), the camera's rotation r0..r8 and the
    measured pixel (u, v).
    """
    seen = obs.where("tz > 1e-9")
    x, y, z = (F.col(c) for c in ("tx", "ty", "tz"))
    zero = F.lit(0.0)
    rows = [[focal / z, zero, -focal * x / (z * z)], [zero, focal / z, -focal * y / (z * z)]]
    turned = [[zero, z, -y], [-z, zero, x], [y, -x, zero]]
    rotation = [[F.col(f"r{3 * k + c}") for c in THREE] for k in THREE]
    out = {"ru": focal * x / z + cx - F.col("u"), "rv": focal * y / z + cy - F.col("v")}
    for r, d in enumerate(rows):
        out |= {f"p{r}{c}": G.dot(d, [rotation[k][c] for k in THREE]) for c in THREE}
        out |= {f"c{r}{c}": G.dot(d, [turned[k][c] for k in THREE]) for c in THREE}
        out |= {f"c{r}{c + 3}": d[c] for c in THREE}
    return seen.withColumns(out)


def _both(a: str, b: str) -> Column:
    """A product summed over an observation's two residuals; a and b name columns with the
    residual's number in place of #."""
    return F.col(a.replace("#", "0")) * F.col(b.replace("#", "0")) + F.col(a.replace("#", "1")) * F.col(b.replace("#", "1"))


def _gradient(name: str) -> Column:
    return F.col(name.replace("#", "0")) * F.col("ru") + F.col(name.replace("#", "1")) * F.col("rv")


def camera_blocks(j: DataFrame, camera: str) -> DataFrame:
    """The upper half of each camera's 6 x 6 block (u00..u55) and its gradient (g0..g5)."""
    sums = {f"u{r}{c}": _both(f"c#{r}", f"c#{c}") for r in SIX for c in range(r, 6)} | {f"g{r}": _gradient(f"c#{r}") for r in SIX}
    return j.groupBy(camera).agg(F.count("*").alias("n"), *(F.sum(e).alias(n) for n, e in sums.items()))


def point_blocks(j: DataFrame, point: str) -> DataFrame:
    """The upper half of each point's 3 x 3 block (v00..v22) and its gradient (h0..h2)."""
    sums = {f"v{r}{c}": _both(f"p#{r}", f"p#{c}") for r in THREE for c in range(r, 3)} | {f"h{r}": _gradient(f"p#{r}") for r in THREE}
    return j.groupBy(point).agg(F.count("*").alias("n"), *(F.sum(e).alias(n) for n, e in sums.items()))


def couplings(j: DataFrame, point: str, camera: str) -> DataFrame:
    """The 6 x 3 block (w00..w52) of each camera and point that meet."""
    return j.groupBy(point, camera).agg(*(F.sum(_both(f"c#{w[1]}", f"p#{w[2]}")).alias(w) for w in COUPLING))


def damped_inverses(points: DataFrame, point: str, damping: float) -> DataFrame:
    """point, i0..i8, the inverse of its block with a diagonal larger by damping, and y0..y2,
    that times its gradient; points whose block has no inverse go."""
    v = [F.col(f"v{min(r, c)}{max(r, c)}") * (1 + damping if r == c else 1) for r in THREE for c in THREE]
    out = points.withColumns({f"_v{k}": x for k, x in enumerate(v)})
    out = out.withColumns({f"i{k}": x for k, x in enumerate(G.inverse([F.col(f"_v{k}") for k in range(9)]))}).where("i0 IS NOT NULL")
    step = G.mat_vec([F.col(f"i{k}") for k in range(9)], [F.col(f"h{k}") for k in THREE])
    return out.select(point, *(f"i{k}" for k in range(9)), *(x.alias(f"y{k}") for k, x in enumerate(step)), *(f"h{k}" for k in THREE))


def _times_inverse(w: DataFrame) -> DataFrame:
    """Adds a00..a52, the coupling times the point's inverse."""
    inverse = [F.col(f"i{k}") for k in range(9)]
    return w.withColumns({f"a{r}{c}": G.dot([F.col(f"w{r}{k}") for k in THREE], [inverse[3 * k + c] for k in THREE]) for r in SIX for c in THREE})


def right_side(cameras: DataFrame, w: DataFrame, inverses: DataFrame, point: str, camera: str) -> DataFrame:
    """camera and b0..b5: the reduced system's right side, -g and what the points add to it."""
    add = w.join(inverses, point).groupBy(camera).agg(*(F.sum(G.dot([F.col(f"w{r}{k}") for k in THREE], [F.col(f"y{k}") for k in THREE])).alias(f"_b{r}") for r in SIX))
    return cameras.join(add, camera, "left").select(camera, *((F.coalesce(F.col(f"_b{r}"), F.lit(0.0)) - F.col(f"g{r}")).alias(f"b{r}") for r in SIX))


def reduced_blocks(cameras: DataFrame, w: DataFrame, inverses: DataFrame, point: str, camera: str, damping: float) -> DataFrame:
    """cam_i <= cam_j and s00..s55: the blocks of the reduced camera system that aren't empty.

    Cameras of one point meet by the point, so that rows follow the sum of squares of the
    points' numbers of cameras; camera_step() needs no such pairs.
    """
    left = _times_inverse(w.join(inverses, point)).select(point, F.col(camera).alias("cam_i"), *(f"a{r}{c}" for r in SIX for c in THREE))
    right = w.withColumnRenamed(camera, "cam_j")
    met = left.join(right, point).where("cam_i <= cam_j")
    sums = {f"s{r}{c}": G.dot([F.col(f"a{r}{k}") for k in THREE], [F.col(f"w{c}{k}") for k in THREE]) for r in SIX for c in SIX}
    less = met.groupBy("cam_i", "cam_j").agg(*(F.sum(-e).alias(n) for n, e in sums.items()))
    own = cameras.select(F.col(camera).alias("cam_i"), F.col(camera).alias("cam_j"), *(F.col(f"u{min(r, c)}{max(r, c)}").alias(f"s{r}{c}") for r in SIX for c in SIX))
    total = less.unionByName(own).groupBy("cam_i", "cam_j").agg(*(F.sum(n).alias(n) for n in sums))
    same = F.col("cam_i") == F.col("cam_j")
    return total.withColumns({f"s{r}{r}": F.when(same, F.col(f"s{r}{r}") * (1 + damping) + 1e-12).otherwise(F.col(f"s{r}{r}")) for r in SIX})


def camera_step(cameras: DataFrame, w: DataFrame, inverses: DataFrame, point: str, camera: str, damping: float, tolerance: float = 1e-9, most: int = 200) -> DataFrame:
    """camera and d0..d5: the step that solves the reduced camera system, by conjugate
    gradients with its diagonal as the preconditioner.

    The system is never formed: it meets a vector as U x - W (V^-1 (W' x)), two joins and
    sums over the couplings. Vectors are tables of a row for each camera, broadcast while
    they are at most FEW; the driver sees two numbers a round. Couplings are written in
    buckets of points once, so that rounds shuffle sums by camera only; of more than FEW
    cameras each round deals out the couplings by camera. Ends where the residual's
    norm, weighed by the preconditioner, has fallen by tolerance, or after most rounds.
    No cameras give an empty table.
    """
    buckets = w.count() // BUCKET + 1
    near = cut_by(_times_inverse(w.join(inverses, point)).select(point, camera, *(F.col(f"w{r}{c}") for r in SIX for c in THREE), *(f"a{r}{c}" for r in SIX for c in THREE)), point, buckets, "couplings")
    b = right_side(cameras, w, inverses, point, camera)
    full = 1 + damping
    less = near.groupBy(camera).agg(*(F.sum(G.dot([F.col(f"a{r}{k}") for k in THREE], [F.col(f"w{r}{k}") for k in THREE])).alias(f"_l{r}") for r in SIX))
    diagonal = {f"m{r}": (F.col(f"u{r}{r}") - F.coalesce(F.col(f"_l{r}"), F.lit(0.0))) * full + 1e-12 for r in SIX}
    state = cameras.join(b, camera).join(less, camera, "left").select(camera, *(f"u{r}{c}" for r in SIX for c in range(r, 6)), *(e.alias(n) for n, e in diagonal.items()), *(F.lit(0.0).alias(f"d{r}") for r in SIX), *(F.col(f"b{r}").alias(f"e{r}") for r in SIX))
    state = cut(state.withColumns({f"x{r}": F.col(f"e{r}") / F.col(f"m{r}") for r in SIX}), "step")
    few = state.limit(FEW + 1).count() <= FEW
    total = lambda f: sum((f(r) for r in range(1, 6)), f(0))
    rz = first = state.agg(F.sum(total(lambda r: F.col(f"e{r}") ** 2 / F.col(f"m{r}")))).first()[0] or 0.0
    for _ in range(most):
        if rz <= tolerance * tolerance * first:
            break
        x = state.select(camera, *(f"x{r}" for r in SIX))
        at = near.join(F.broadcast(x) if few else x, camera).groupBy(point).agg(*(F.sum(G.dot([F.col(f"a{r}{c}") for r in SIX], [F.col(f"x{r}") for r in SIX])).alias(f"q{c}") for c in THREE))
        back = near.join(at, point).groupBy(camera).agg(*(F.sum(G.dot([F.col(f"w{r}{c}") for c in THREE], [F.col(f"q{c}") for c in THREE])).alias(f"_q{r}") for r in SIX))
        met = state.join(back, camera, "left")
        row = lambda r: G.dot([F.col(f"u{min(r, c)}{max(r, c)}") for c in SIX], [F.col(f"x{c}") for c in SIX])
        # (1 + damping) * the diagonal of S, S itself elsewhere
        s = {f"s{r}": row(r) - F.coalesce(F.col(f"_q{r}"), F.lit(0.0)) + (F.col(f"m{r}") - (F.col(f"m{r}") - 1e-12) / full) * F.col(f"x{r}") for r in SIX}
        met = cut(met.select(*state.columns, *(e.alias(n) for n, e in s.items())), "step")
        curved = met.agg(F.sum(total(lambda r: F.col(f"x{r}") * F.col(f"s{r}")))).first()[0]
        if curved <= 0:
            break
        alpha = rz / curved
        # from the new residual itself: a difference of sums would lose it in rounding
        rz, before = met.agg(F.sum(total(lambda r: (F.col(f"e{r}") - alpha * F.col(f"s{r}")) ** 2 / F.col(f"m{r}")))).first()[0], rz  # noqa: B023
        beta = rz / before
        new = {f"d{r}": F.col(f"d{r}") + alpha * F.col(f"x{r}") for r in SIX} | {f"e{r}": F.col(f"e{r}") - alpha * F.col(f"s{r}") for r in SIX}
        old, state = state, met.withColumns(new)
        state = state.withColumns({f"x{r}": F.col(f"e{r}") / F.col(f"m{r}") + beta * F.col(f"x{r}") for r in SIX}).select(*old.columns)
        discard(old)
    out = cut(state.select(camera, *(f"d{r}" for r in SIX)), "step")
    discard(near)
    return out


def point_step(w: DataFrame, inverses: DataFrame, cameras: DataFrame, point: str, camera: str) -> DataFrame:
    """point and d0..d2: -V^-1 (h + W' d) for the cameras' step d."""
    pull = w.join(cameras, camera).groupBy(point).agg(*(F.sum(G.dot([F.col(f"w{r}{c}") for r in SIX], [F.col(f"d{r}") for r in SIX])).alias(f"_h{c}") for c in THREE))
    both = inverses.join(pull, point, "left")
    step = G.mat_vec([F.col(f"i{k}") for k in range(9)], [-(F.col(f"h{c}") + F.coalesce(F.col(f"_h{c}"), F.lit(0.0))) for c in THREE])
    return both.select(point, *(x.alias(f"d{c}") for c, x in enumerate(step)))


def gauge(j: DataFrame, camera: str, fixed: Sequence[int]) -> DataFrame:
    """Observations of the cameras that may move."""
    return j.where(~F.col(camera).isin(*fixed)) if fixed else j
