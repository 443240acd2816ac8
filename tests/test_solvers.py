"""Rendering, guided matching, focal estimates and block solvers against plain numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomscape.operators import adjustment as AD
from loomscape.operators import focal as FO
from loomscape.operators import guided as GM
from loomscape.operators import splats as S


def image(rows, width, height, background):
    """Pixels that something colours, one primitive after another."""
    colour, through, hit = np.zeros((height, width, 3)), np.ones((height, width)), np.zeros((height, width), bool)
    for r in sorted(rows, key=lambda r: (r["depth"], r["splat_id"])):
        for y in range(max(0, math.floor(r["v"] - r["radius"])), min(height - 1, math.ceil(r["v"] + r["radius"])) + 1):
            for x in range(max(0, math.floor(r["u"] - r["radius"])), min(width - 1, math.ceil(r["u"] + r["radius"])) + 1):
                dx, dy = x - r["u"], y - r["v"]
                power = -0.5 * (r["ka"] * dx * dx + r["kc"] * dy * dy) - r["kb"] * dx * dy
                alpha = min(0.99, r["opacity"] * math.exp(power))
                if power > 0 or alpha < 1 / 255:
                    continue
                hit[y, x] = True
                if through[y, x] <= 1 / 255:
                    continue
                colour[y, x] += np.array([r["r"], r["g"], r["b"]]) * alpha * through[y, x]
                through[y, x] *= 1 - alpha
    colour += through[..., None] * np.array(background)
    return {(x, y): [*colour[y, x], through[y, x]] for y in range(height) for x in range(width) if hit[y, x]}


def primitives(seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        a, c = rng.uniform(0.02, 1.5, 2).tolist()
        b = float(rng.uniform(-0.9, 0.9)) * math.sqrt(a * c)
        rows.append({"splat_id": k, "depth": float(rng.integers(1, 6)), "u": float(rng.uniform(-6, 36)), "v": float(rng.uniform(-6, 30)), "ka": a, "kb": b, "kc": c, "radius": float(rng.uniform(0.5, 14)), "opacity": float(rng.choice([0.001, 1 / 255, 0.3, 0.999])), "r": float(rng.random()), "g": float(rng.random()), "b": float(rng.random())})
    return rows


@pytest.mark.parametrize("slabs", [1, 5])
def test_render_brute_force(spark, slabs):
    rows = primitives(slabs, 150)
    got = {(r.x, r.y): [r.r, r.g, r.b, r.through] for r in S.render(spark.createDataFrame(rows), 30, 24, ["r", "g", "b"], [0.2, 0.4, 0.6], slabs=slabs).collect()}
    want = image(rows, 30, 24, [0.2, 0.4, 0.6])
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert np.allclose(got[k], v, atol=1e-9)


def test_coverage_has_only_pixels_that_pass(spark):
    rows = primitives(9, 60)
    df = spark.createDataFrame(rows)
    got = S.coverage(df, 30, 24).collect()
    assert got and min(r.alpha for r in got) >= 1 / 255 and max(r.alpha for r in got) <= 0.99
    assert all(0 <= r.x < 30 and 0 <= r.y < 24 for r in got) and len({(r.splat_id, r.x, r.y) for r in got}) == len(got)
    assert S.coverage(df.where("false"), 30, 24).count() == 0
    assert S.render(df.where("false"), 30, 24, ["r"], [0.0]).count() == 0


def claimed(rows, ratio, ceiling):
    out, taken = [], set()
    for pair, q in sorted({r[:2] for r in rows}):
        free = sorted((d, t) for p, a, t, d in rows if (p, a) == (pair, q) and (p, t) not in taken)
        if free and free[0][0] <= ceiling and (len(free) < 2 or free[0][0] < ratio * free[1][0]):
            taken.add((pair, free[0][1]))
            out.append((pair, q, free[0][1], free[0][0]))
    return sorted(out)


@pytest.mark.parametrize("ceiling", [float("inf"), 40.0])
def test_claims_as_one_after_another(spark, ceiling):
    rng = np.random.default_rng(4)
    rows = [(p, q, t, float(rng.integers(0, 100))) for p in range(3) for q in range(30) for t in range(25) if rng.random() < (0.1, 0.4, 0.02)[p]]
    df = spark.createDataFrame(rows, "pair int, query int, train int, distance double")
    got = GM.claim_in_order(df, "pair", "query", "train", "distance", 0.95, ceiling)
    assert sorted(tuple(r) for r in got.collect()) == claimed(rows, 0.95, ceiling)
    assert GM.claim_in_order(df.where("false"), "pair", "query", "train", "distance", 0.95).count() == 0


@pytest.mark.parametrize("cell", [0.03, 0.7])
def test_band_meets_all_that_is_near(spark, cell):
    rng = np.random.default_rng(6)
    lines = [(int(rng.integers(2)), k, *map(float, rng.normal(size=3))) for k in range(40)] + [(0, 40, 0.0, 0.0, 1.0), (0, 41, 1.0, 0.0, 0.2), (1, 42, 0.0, 2.0, 0.3), (7, 43, 1.0, 1.0, 0.0)]
    points = [(int(rng.integers(2)), k, *map(float, rng.uniform(-1, 1, 2))) for k in range(200)]
    got = GM.band_candidates(spark.createDataFrame(lines, "pair int, line int, la double, lb double, lc double"), spark.createDataFrame(points, "pair int, point int, x double, y double"), "pair", 0.05, cell)
    want = {(a, b) for p, a, la, lb, lc in lines for q, b, x, y in points if p == q and math.hypot(la, lb) > 1e-12 and abs(la * x + lb * y + lc) / math.hypot(la, lb) < 0.05}
    found = [(r.line, r.point) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def two_views(seed, focal, n=60, noise=0.0):
    rng = np.random.default_rng(seed)
    k = np.array([[focal, 0, 320], [0, focal, 240], [0, 0, 1.0]])
    a = rng.uniform(-0.3, 0.3)
    turn = np.array([[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]])
    shift = rng.uniform(-1, 1, 3)
    x = rng.uniform([-2, -2, 4], [2, 2, 9], (n, 3))
    one, two = x @ k.T, (x @ turn.T + shift) @ k.T
    cross = np.array([[0, -shift[2], shift[1]], [shift[2], 0, -shift[0]], [-shift[1], shift[0], 0]])
    f = np.linalg.inv(k).T @ cross @ turn @ np.linalg.inv(k)
    return one[:, :2] / one[:, 2:] + rng.normal(0, noise, (n, 2)), two[:, :2] / two[:, 2:] + rng.normal(0, noise, (n, 2)), f


def sweep(spark, focal, noise=0.3, pairs=6, multipliers=FO.MULTIPLIERS):
    matches, epipolar = [], []
    for p in range(pairs):
        one, two, f = two_views(p, focal, noise=noise)
        matches += [("c", p, *map(float, (*a, *b))) for a, b in zip(one, two, strict=True)]
        epipolar.append(("c", p, *map(float, f.ravel())))
    m = spark.createDataFrame(matches, "capture string, pair int, x1 double, y1 double, x2 double, y2 double")
    e = spark.createDataFrame(epipolar, "capture string, pair int, " + ", ".join(f"{n} double" for n in FO.EPIPOLAR))
    curves = FO.focal_curves(FO.epipolar_inliers(m, e, ["capture", "pair"]), e, ["capture", "pair"], 640.0, 320.0, 240.0, multipliers)
    return FO.chosen_focal(FO.summed_curves(curves, "capture", ["capture", "pair"]), "capture", 640.0, multipliers).first()


@pytest.mark.parametrize("mult", [0.5, 0.8, 1.2])
def test_known_focal_comes_out(spark, mult):
    got = sweep(spark, 640 * mult)
    assert got.mult == mult and got.focal == 640 * mult and got.pairs == 6


def test_focal_at_the_sweeps_end_is_none(spark):
    got = sweep(spark, 640 * 0.5, multipliers=(0.5, 0.8, 1.2))
    assert got.mult is None and got.focal is None and got.pairs == 6


def test_ideal_matrix_and_asymmetry_as_by_svd(spark):
    _, _, f = two_views(3, 500.0)
    df = spark.createDataFrame([tuple(map(float, f.ravel()))], ", ".join(f"{n} double" for n in FO.EPIPOLAR))
    args = (F.lit(400.0), F.lit(320.0), F.lit(240.0))
    k = np.array([[400.0, 0, 320], [0, 400, 240], [0, 0, 1]])
    u, s, vt = np.linalg.svd(k.T @ f @ k)
    want = np.linalg.inv(k).T @ u @ np.diag([1, 1, 0]) @ vt @ np.linalg.inv(k)
    assert np.allclose(list(FO.idealised(df, *args).first()), want.ravel(), atol=1e-9 * abs(want).max())
    assert abs(FO.asymmetry(df, *args).first().asymmetry - (s[0] - s[1]) / (s[0] + s[1])) < 1e-9


def test_pairs_are_sampled_by_gap_and_stride(spark):
    frames = spark.createDataFrame([("a", k) for k in range(60)] + [("b", 0), ("b", 1)], "capture string, frame int")
    got = sorted((r.capture, r.gap, r.place, r.a, r.b) for r in FO.sampled_pairs(frames, "capture", "frame", ["frame"], most=24).collect())
    want = [("a", g, k, k, k + g) for g in (1, 2, 3) for k in range(0, 60 - g, max(1, (60 - g) // 24))] + [("b", 1, 0, 0, 1)]
    assert got == want
    counts = spark.createDataFrame([(c, a, b, 15 + (a % 3 > 0)) for c, _, _, a, b in got], "capture string, a int, b int, n int")
    taken = sorted((r.capture, r.gap, r.place) for r in FO.accepted_pairs(FO.sampled_pairs(frames, "capture", "frame", ["frame"]), counts, "capture", 16, 24).collect())
    assert taken == sorted([(c, g, k) for c, g, k, a, _ in want if a % 3 and c == "a"][:24])


def test_steps_as_by_a_dense_solve(spark):
    rng = np.random.default_rng(8)
    turn = lambda a: np.array([[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]])
    points, rows, damping = rng.uniform([-2, -2, 5], [2, 2, 9], (25, 3)), [], 0.05
    cams = [(turn(0.1 * k - 0.2), np.array([0.3 * k, 0.1, 0.0])) for k in range(4)]
    h = np.zeros((3 * 6 + 75, 3 * 6 + 75))
    g = np.zeros(3 * 6 + 75)
    for i, x in enumerate(points):
        for k, (r, t) in enumerate(cams):
            if rng.random() < 0.2:
                continue
            q = r @ x + t
            u, v = 100 * q[0] / q[2] + 50 + rng.normal(), 100 * q[1] / q[2] + 40 + rng.normal()
            rows.append((i, k, *map(float, q), *map(float, r.ravel()), float(u), float(v)))
            d = np.array([[100 / q[2], 0, -100 * q[0] / q[2] ** 2], [0, 100 / q[2], -100 * q[1] / q[2] ** 2]])
            j = np.zeros((2, len(g)))
            j[:, 18 + 3 * i : 21 + 3 * i] = d @ r
            if k:
                j[:, 6 * k - 6 : 6 * k - 3] = d @ np.array([[0, q[2], -q[1]], [-q[2], 0, q[0]], [q[1], -q[0], 0]])
                j[:, 6 * k - 3 : 6 * k] = d
            h += j.T @ j
            g += j.T @ (np.array([100 * q[0] / q[2] + 50, 100 * q[1] / q[2] + 40]) - [u, v])
    v, w = h[18:, 18:] + damping * np.diag(np.diag(h[18:, 18:])), h[:18, 18:]
    s = h[:18, :18] - w @ np.linalg.inv(v) @ w.T
    s += damping * np.diag(np.diag(s)) + 1e-12 * np.eye(18)
    camera = np.linalg.solve(s, -g[:18] + w @ np.linalg.inv(v) @ g[18:])
    point = np.linalg.solve(v, -g[18:] - w.T @ camera)

    names = "pt int, cam int, tx double, ty double, tz double, " + ", ".join(f"r{k} double" for k in range(9)) + ", u double, v double"
    j = AD.jacobians(spark.createDataFrame(rows, names), 100.0, 50.0, 40.0)
    free = AD.gauge(j, "cam", [0])
    u, vt, wt = AD.camera_blocks(free, "cam"), AD.point_blocks(j, "pt"), AD.couplings(free, "pt", "cam")
    inverses = AD.damped_inverses(vt, "pt", damping)
    step = AD.camera_step(u, wt, inverses, "pt", "cam", damping)
    got = {r.cam: [r[f"d{k}"] for k in range(6)] for r in step.collect()}
    assert np.allclose([got[k] for k in (1, 2, 3)], camera.reshape(3, 6), atol=1e-6 * abs(camera).max())
    moved = {r.pt: [r.d0, r.d1, r.d2] for r in AD.point_step(wt, inverses, step, "pt", "cam").collect()}
    assert np.allclose([moved[k] for k in range(25)], point.reshape(25, 3), atol=1e-5 * abs(point).max())
    assert AD.camera_step(u.where("false"), wt, inverses, "pt", "cam", damping).count() == 0


def test_bucketed_tables_need_no_shuffle(spark):
    """Couplings in buckets of points meet sums by point where they lie."""
    from loomscape.sources.work import cut_by, discard

    rows = cut_by(spark.range(4000).selectExpr("id % 500 AS pt", "id % 7 AS cam", "id * 1.0 AS w"), "pt", 3)
    sums = rows.groupBy("pt").sum("w")
    met = rows.hint("merge").join(sums, "pt")
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 4000
    table = rows._cut_table
    discard(rows)
    assert not spark.catalog.tableExists(table)
