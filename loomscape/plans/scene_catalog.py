"""Registered queries of geometry, primitives, optimiser tables and capabilities."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomscape.functions import geometry as G
from loomscape.functions.geometry import tidy
from loomscape.operators import capabilities as C
from loomscape.operators import geometry as OG
from loomscape.operators import optimizer as O  # noqa: E741
from loomscape.operators import splats as S
from loomscape.plans.catalog import query
from loomscape.session import load

# Each base table is one SELECT that Spark and the SQL check both read.
_SPLATS = """SELECT p_partkey AS splat_id, (p_partkey % 40 - 20) / 4e0 AS px, (floor(p_partkey / 40e0) % 30 - 15) / 4e0 AS py, 2e0 + p_size / 10e0 AS pz,
-2e0 - (p_partkey % 5) / 4e0 AS sx, -2e0 - (p_partkey % 3) / 4e0 AS sy, -2e0 - (p_partkey % 7) / 4e0 AS sz,
(p_partkey % 7) / 7e0 AS qx, (p_partkey % 11) / 11e0 AS qy, (p_partkey % 13) / 13e0 AS qz, 1e0 AS qw,
(p_size % 11 - 5) / 2e0 AS logit, (p_partkey % 3) / 3e0 AS r, (p_partkey % 5) / 5e0 AS g, (p_partkey % 9) / 9e0 AS b FROM {part}"""
_POINTS = "SELECT p_partkey AS pt, (p_partkey % 37 - 18) / 6e0 AS x, (p_partkey % 29 - 14) / 5e0 AS y, 1e0 + p_size / 9e0 AS z FROM {part}"
_OBS = """SELECT l_partkey AS pt, l_suppkey % 20 AS cam, l_orderkey AS ord, l_linenumber AS ln, (l_partkey % 37 - 18) / 6e0 AS x, (l_partkey % 29 - 14) / 5e0 AS y, 3e0 + l_quantity / 9e0 AS z,
320e0 + (l_partkey % 37 - 18) * 20e0 + l_discount * 50e0 AS u, 240e0 + (l_partkey % 29 - 14) * 20e0 + l_tax * 50e0 AS v FROM {lineitem}"""
_PAIRS = """SELECT l_orderkey AS pair, l_linenumber AS ln, l_partkey AS k, (l_partkey % 101 - 50) / 60e0 AS ax, (l_suppkey % 37 - 18) / 40e0 AS ay,
(l_partkey % 101 - 50) / 60e0 + l_discount / 4e0 AS bx, (l_suppkey % 37 - 18) / 40e0 + l_tax / 40e0 AS byy FROM {lineitem}"""
TURN = (0.8, 0.0, 0.6, 0.0, 1.0, 0.0, -0.6, 0.0, 0.8)
SHIFT = (0.1, -0.2, 4.0)


def _sql(base: str) -> str:
    return base.format(part="part", lineitem="lineitem")


def _table(spark, sf, base: str) -> DataFrame:
    name = "part" if "{part}" in base else "lineitem"
    return spark.sql(base, **{name: load(spark, sf, name)})


_CAM = f"SELECT *, 0.8e0 * x + 0.6e0 * z + 0.1e0 AS tx, y - 0.2e0 AS ty, -0.6e0 * x + 0.8e0 * z + 4e0 AS tz FROM ({_sql(_OBS)})"


def _camera(spark, sf) -> DataFrame:
    t = G.to_camera(G.lit(*TURN), G.lit(*SHIFT), S.vector("x", "y", "z"))
    return _table(spark, sf, _OBS).withColumns({"tx": t[0], "ty": t[1], "tz": t[2]})


@query(f"SELECT pt, cam, ord, ln, round(CASE WHEN tz > 1e-9 THEN 460e0 * tx / tz + 320e0 END, 6) + 0.0 AS u, round(CASE WHEN tz > 1e-9 THEN 460e0 * ty / tz + 240e0 END, 6) + 0.0 AS v FROM ({_CAM})")
def pinhole_project(spark, sf):
    u, v = G.pinhole(S.vector("tx", "ty", "tz"), F.lit(460.0), F.lit(320.0), F.lit(240.0))
    return _camera(spark, sf).select("pt", "cam", "ord", "ln", tidy(u).alias("u"), tidy(v).alias("v"))


@query("SELECT c_custkey, w, h, round(0.72 * greatest(w, h), 6) + 0.0 AS focal, w / 2e0 AS cx, h / 2e0 AS cy FROM (SELECT c_custkey, 640e0 + c_nationkey * 16 AS w, 480e0 + c_custkey % 50 * 16 AS h FROM customer)")
def intrinsics_prior(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", (640.0 + F.col("c_nationkey") * 16).alias("w"), (480.0 + F.col("c_custkey") % 50 * 16).alias("h"))
    return c.select("c_custkey", "w", "h", tidy(G.focal_guess(F.col("w"), F.col("h"))).alias("focal"), (F.col("w") / 2).alias("cx"), (F.col("h") / 2).alias("cy"))


_SAMP = f"""SELECT *, off * off / (f0 * f0 + f1 * f1 + b0 * b0 + b1 * b1) AS d FROM (SELECT *, bx * f0 + byy * f1 + f2 AS off FROM (
SELECT *, 0.1 * ay - 0.2 AS f0, -0.1 * ax + 1.0 AS f1, 0.2 * ax - 1.0 * ay AS f2, -0.1 * byy + 0.2 AS b0, 0.1 * bx - 1.0 AS b1 FROM ({_sql(_PAIRS)})))"""


@query(f"SELECT pair, ln, k, round(d, 8) + 0.0 AS d FROM ({_SAMP}) WHERE d < 0.0004")
def sampson_inliers(spark, sf):
    e = G.lit(0.0, 0.1, -0.2, -0.1, 0.0, 1.0, 0.2, -1.0, 0.0)
    d = G.sampson(e, (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("byy")))
    return _table(spark, sf, _PAIRS).withColumn("d", d).where("d < 0.0004").select("pair", "ln", "k", tidy(F.col("d"), 8).alias("d"))


@query(f"""SELECT pt, round(degrees(acos(least(greatest((x * (x - 1) + y * y + z * z) / (sqrt(x * x + y * y + z * z) * sqrt((x - 1) * (x - 1) + y * y + z * z)), -1), 1))), 6) + 0.0 AS angle FROM ({_sql(_POINTS)})""")
def triangulation_angle(spark, sf):
    a = G.ray_angle(S.vector("x", "y", "z"), G.lit(0.0, 0.0, 0.0), G.lit(1.0, 0.0, 0.0))
    return _table(spark, sf, _POINTS).select("pt", tidy(a).alias("angle"))


@query(f"""WITH o AS ({_sql(_OBS)}), c AS (SELECT cam, avg(u) AS mu, avg(v) AS mv FROM o GROUP BY cam),
s AS (SELECT cam, avg(sqrt((u - mu) * (u - mu) + (v - mv) * (v - mv))) AS far FROM o JOIN c USING (cam) GROUP BY cam)
SELECT cam, round(mu, 6) + 0.0 AS mu, round(mv, 6) + 0.0 AS mv, round(sqrt(2) / far, 8) + 0.0 AS scale FROM c JOIN s USING (cam)""")
def hartley_normalise(spark, sf):
    out = OG.hartley(_table(spark, sf, _OBS), ["cam"], ["u", "v"])
    return out.select("cam", tidy(F.col("m_u")).alias("mu"), tidy(F.col("m_v")).alias("mv"), tidy(F.col("scale"), 8).alias("scale"))


@query(f"SELECT cam, " + ", ".join(f"round(sum({a} * {b}), 4) + 0.0 AS g_{a}{b}" for i, a in enumerate("xyz") for b in "xyz"[i:]) + f" FROM ({_sql(_OBS)}) GROUP BY cam")
def gram_matrix(spark, sf):
    g = OG.gram(_table(spark, sf, _OBS), ["cam"], ["x", "y", "z"])
    return g.select("cam", *(tidy(F.col(c), 4).alias(c) for c in g.columns if c != "cam"))


_RES = "SELECT *, 50e0 * x / z + 320e0 - u AS ru, 50e0 * y / z + 240e0 - v AS rv, 50e0 / z AS jux, -50e0 * x / (z * z) AS juz, 50e0 / z AS jvy, -50e0 * y / (z * z) AS jvz FROM (" + _sql(_OBS) + ")"


@query(f"""SELECT pt, count(*) AS n, round(sum(jux * jux), 4) + 0.0 AS h_xx, round(sum(jvy * jvy), 4) + 0.0 AS h_yy, round(sum(jux * juz), 4) + 0.0 AS h_xz, round(sum(jvy * jvz), 4) + 0.0 AS h_yz,
round(sum(juz * juz + jvz * jvz), 4) + 0.0 AS h_zz, round(sum(jux * ru), 3) + 0.0 AS g_x, round(sum(jvy * rv), 3) + 0.0 AS g_y, round(sum(juz * ru + jvz * rv), 3) + 0.0 AS g_z FROM ({_RES}) GROUP BY pt""")
def ba_normal_blocks(spark, sf):
    b = OG.point_blocks(_table(spark, sf, _OBS), "pt", 50.0, 320.0, 240.0)
    return b.select("pt", "n", *(tidy(F.col(f"h_{k}"), 4).alias(f"h_{k}") for k in ("xx", "yy", "xz", "yz", "zz")), *(tidy(F.col(f"g_{k}"), 3).alias(f"g_{k}") for k in "xyz"))


@query(f"""WITH w AS (SELECT pt, cam, sum(jux * ru) AS a, sum(jvy * rv) AS b FROM ({_RES}) GROUP BY pt, cam), p AS (SELECT pt, sum(jux * jux + jvy * jvy) AS h FROM ({_RES}) GROUP BY pt)
SELECT i.cam AS cam_i, j.cam AS cam_j, round(sum(i.a * j.a / h + i.b * j.b / h), 2) + 0.0 AS s FROM w i JOIN w j ON j.pt = i.pt AND j.cam >= i.cam JOIN p ON p.pt = i.pt GROUP BY ALL""")
def schur_complement(spark, sf):
    out = OG.schur(_table(spark, sf, _OBS), "pt", "cam", 50.0, 320.0, 240.0)
    return out.select("cam_i", "cam_j", tidy(F.col("s"), 2).alias("s"))


@query(f"SELECT o_orderpriority AS grp, round(sqrt(sum(ru * ru + rv * rv) / count(*)), 6) + 0.0 AS rmse, count(*) AS n FROM ({_RES}) JOIN orders ON o_orderkey = ord WHERE z > 1e-9 GROUP BY o_orderpriority")
def reprojection_rmse(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("grp"))
    out = OG.rmse(_table(spark, sf, _OBS).join(o, "ord"), ["grp"], 50.0, 320.0, 240.0)
    return out.select("grp", tidy(F.col("rmse")).alias("rmse"), "n")


@query(f"""WITH k AS (SELECT pt, cam, ord, ln FROM ({_RES}) WHERE sqrt(ru * ru + rv * rv) < 250) SELECT k.pt, count(*) AS n FROM k GROUP BY k.pt HAVING count(*) >= 2""")
def outlier_prune(spark, sf):
    return OG.drop_outliers(_table(spark, sf, _OBS), "pt", 250.0, 50.0, 320.0, 240.0).groupBy("pt").agg(F.count("*").alias("n"))


_MULT = [round(0.3 + 0.1 * k, 2) for k in range(17)]
_CURVE = f"""WITH m AS (SELECT unnest([{', '.join(f'{x}e0' for x in _MULT)}]) AS mult), c AS (SELECT pair, mult, cost FROM (SELECT l_suppkey AS pair, mult, avg(abs(l_quantity / 25e0 - mult) + l_discount) AS cost FROM lineitem, m GROUP BY ALL)),
d AS (SELECT pair, list_sort(list(cost))[9] AS mid FROM c GROUP BY pair)
SELECT mult, round(sum(cost / mid), 6) + 0.0 AS total, count(*) AS pairs FROM c JOIN d USING (pair) GROUP BY mult"""


@query(_CURVE)
def focal_sweep(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("pair"), (F.col("l_quantity") / 25).alias("q"), F.col("l_discount").alias("d"))
    curve = OG.sweep(rows, "pair", _MULT, lambda m: F.abs(F.col("q") - m) + F.col("d"))
    return OG.normalised_sum(curve, "pair").select("mult", tidy(F.col("total")).alias("total"), "pairs")


@query(f"WITH c AS ({_CURVE}) SELECT mult AS best, mult IN ({_MULT[0]}e0, {_MULT[-1]}e0) AS at_edge FROM c ORDER BY total, mult LIMIT 1")
def focal_choice(spark, sf):
    best = focal_sweep(spark, sf).orderBy("total", "mult").limit(1)
    return best.select(F.col("mult").alias("best"), F.col("mult").isin(_MULT[0], _MULT[-1]).alias("at_edge"))


# rotation of the quaternion, covariance and screen covariance, written out
_ROT = f"""SELECT s.*, qx / n AS x, qy / n AS y, qz / n AS z, qw / n AS w FROM (SELECT *, sqrt(qx * qx + qy * qy + qz * qz + qw * qw) AS n FROM ({_sql(_SPLATS)})) s"""
_MAT = f"""SELECT *, 1 - 2 * (y * y + z * z) AS m00, 2 * (x * y - w * z) AS m01, 2 * (x * z + w * y) AS m02, 2 * (x * y + w * z) AS m10, 1 - 2 * (x * x + z * z) AS m11, 2 * (y * z - w * x) AS m12,
2 * (x * z - w * y) AS m20, 2 * (y * z + w * x) AS m21, 1 - 2 * (x * x + y * y) AS m22, exp(2 * sx) AS e0, exp(2 * sy) AS e1, exp(2 * sz) AS e2 FROM ({_ROT})"""
_COV = "SELECT *, " + ", ".join(f"m{i}0 * m{j}0 * e0 + m{i}1 * m{j}1 * e1 + m{i}2 * m{j}2 * e2 AS c{i}{j}" for i in range(3) for j in range(3)) + f" FROM ({_MAT})"


@query("SELECT splat_id, " + ", ".join(f"round(c{i}{j}, 8) + 0.0 AS c{i}{j}" for i in range(3) for j in range(i, 3)) + f" FROM ({_COV})")
def splat_covariance3d(spark, sf):
    turn = G.quaternion_matrix(G.unit_quaternion(S.vector("qx", "qy", "qz", "qw")))
    cov = G.covariance(turn, [F.exp(c) for c in S.vector("sx", "sy", "sz")])
    names = [f"c{i}{j}" for i in range(3) for j in range(i, 3)]
    return _table(spark, sf, _SPLATS).select("splat_id", *(tidy(c, 8).alias(n) for n, c in zip(names, cov, strict=True)))


_T = f"SELECT *, px AS t0, py AS t1, pz + 1e0 AS t2 FROM ({_COV})"
_J = f"SELECT *, 200e0 / t2 AS ja, -200e0 * t0 / (t2 * t2) AS jb, -200e0 * t1 / (t2 * t2) AS jc FROM ({_T})"
_S2 = f"""SELECT *, ja * ja * c00 + 2 * ja * jb * c02 + jb * jb * c22 + 0.3 AS s0, ja * ja * c01 + ja * jc * c02 + jb * ja * c12 + jb * jc * c22 AS s1, ja * ja * c11 + 2 * ja * jc * c12 + jc * jc * c22 + 0.3 AS s2 FROM ({_J})"""
_PROJ = f"""SELECT *, t2 AS depth, 200e0 * t0 / t2 + 160e0 AS u, 200e0 * t1 / t2 + 120e0 AS v, s0 * s2 - s1 * s1 AS det, 1 / (1 + exp(-logit)) AS opacity,
3 * sqrt((s0 + s2) / 2 + sqrt(greatest((s0 + s2) * (s0 + s2) / 4 - (s0 * s2 - s1 * s1), 0))) AS radius FROM ({_S2})"""
_VIS = f"SELECT * FROM ({_PROJ}) WHERE depth > 0.2 AND radius BETWEEN 0.5 AND 512 AND det > 1e-12 AND u + radius >= 0 AND u - radius < 320 AND v + radius >= 0 AND v - radius < 240"


def _projected(spark, sf) -> DataFrame:
    one = G.lit(1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    return S.project(_table(spark, sf, _SPLATS), one, G.lit(0.0, 0.0, 1.0), F.lit(200.0), F.lit(160.0), F.lit(120.0))


def _visible(spark, sf) -> DataFrame:
    return S.visible(_projected(spark, sf), 320, 240)


@query(f"SELECT splat_id, round(depth, 6) + 0.0 AS depth, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v, round(s2 / det, 6) + 0.0 AS ka, round(-s1 / det, 6) + 0.0 AS kb, round(s0 / det, 6) + 0.0 AS kc, round(opacity, 6) + 0.0 AS opacity FROM ({_PROJ})")
def splat_project(spark, sf):
    return _projected(spark, sf).select("splat_id", *(tidy(F.col(c)).alias(c) for c in ("depth", "u", "v", "ka", "kb", "kc", "opacity")))


@query(f"SELECT splat_id, round(radius, 6) + 0.0 AS radius FROM ({_PROJ})")
def screen_radius(spark, sf):
    return _projected(spark, sf).select("splat_id", tidy(F.col("radius")).alias("radius"))


@query(f"SELECT splat_id FROM ({_VIS})")
def frustum_cull(spark, sf):
    return _visible(spark, sf).select("splat_id")


_TILES = f"""SELECT s.*, tx, ty FROM (SELECT *, greatest(floor((u - radius) / 16), 0)::BIGINT AS x0, least(floor((u + radius) / 16), 19)::BIGINT AS x1, greatest(floor((v - radius) / 16), 0)::BIGINT AS y0, least(floor((v + radius) / 16), 14)::BIGINT AS y1 FROM ({_VIS})) s,
(SELECT unnest(range(20)) AS tx) a, (SELECT unnest(range(15)) AS ty) b WHERE tx BETWEEN x0 AND x1 AND ty BETWEEN y0 AND y1"""


@query(f"SELECT splat_id, tx, ty FROM ({_TILES})")
def tile_binning(spark, sf):
    return S.tiles(_visible(spark, sf), 320, 240).select("splat_id", F.col("tx").cast("long").alias("tx"), F.col("ty").cast("long").alias("ty"))


@query(f"SELECT splat_id, tx, ty, row_number() OVER (PARTITION BY tx, ty ORDER BY round(depth, 6), splat_id) AS rank FROM ({_TILES})")
def tile_depth_rank(spark, sf):
    t = S.tiles(_visible(spark, sf).withColumn("depth", F.round("depth", 6)), 320, 240)
    return S.depth_rank(t, ["tx", "ty"]).select("splat_id", F.col("tx").cast("long").alias("tx"), F.col("ty").cast("long").alias("ty"), "rank")


_LIGHT = "SELECT l_orderkey AS k, l_linenumber AS o, l_partkey AS o2, l_suppkey AS o3, l_quantity AS o4, l_extendedprice AS o5, l_shipdate AS o6, 0.02e0 + l_discount * 6 AS alpha, (l_partkey % 11) / 11e0 AS c, (l_suppkey % 7) / 7e0 - 0.5e0 AS up FROM {lineitem}"
_ORD = ["o", "o2", "o3", "o4", "o5", "o6"]
_T_SQL = f"""SELECT *, coalesce(exp(sum(ln(1 - alpha)) OVER w), 1) AS t FROM ({_sql(_LIGHT)}) WINDOW w AS (PARTITION BY k ORDER BY {', '.join(_ORD)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query(f"SELECT k, round(sum(c * alpha * t), 6) + 0.0 AS c, round(min(t * (1 - alpha)), 6) + 0.0 AS through FROM ({_T_SQL}) WHERE t > 1 / 255e0 GROUP BY k")
def alpha_composite(spark, sf):
    out = S.composite(_table(spark, sf, _LIGHT), ["k"], _ORD, ["c"])
    return out.select("k", tidy(F.col("c")).alias("c"), tidy(F.col("through")).alias("through"))


@query(f"""WITH l AS (SELECT *, c * alpha * t AS mine FROM ({_T_SQL}) WHERE t > 1 / 255e0),
g AS (SELECT *, up * alpha * t AS dc, up * (c * t - (sum(mine) OVER (PARTITION BY k) - coalesce(sum(mine) OVER (PARTITION BY k ORDER BY {', '.join(_ORD)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - mine) / (1 - alpha)) AS da FROM l)
SELECT o2 AS splat_id, round(sum(dc), 5) + 0.0 AS d_colour, round(sum(da), 4) + 0.0 AS d_alpha, count(*) AS n FROM g GROUP BY o2""")
def grad_partial_final(spark, sf):
    g = S.blend_gradients(_table(spark, sf, _LIGHT), ["k"], _ORD, "c", "up")
    out = g.groupBy(F.col("o2").alias("splat_id")).agg(F.sum("d_colour").alias("d_colour"), F.sum("d_alpha").alias("d_alpha"), F.count("*").alias("n"))
    return out.select("splat_id", tidy(F.col("d_colour"), 5).alias("d_colour"), tidy(F.col("d_alpha"), 4).alias("d_alpha"), "n")


@query("SELECT l_suppkey AS view, round(avg(abs(l_discount - l_tax)), 8) + 0.0 AS loss, sum(sign(round((l_discount - l_tax) * 100)))::BIGINT AS signs FROM lineitem GROUP BY l_suppkey")
def l1_loss(spark, sf):
    off = F.col("l_discount") - F.col("l_tax")
    return load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("view")).agg(tidy(F.avg(F.abs(off)), 8).alias("loss"), F.sum(F.signum(F.round(off * 100))).cast("long").alias("signs"))


@query("SELECT l_partkey AS splat_id, round(sum(g), 4) + 0.0 AS grad, count(*) AS visible FROM (SELECT l_partkey, l_suppkey, sum(l_discount - 0.05) AS g FROM lineitem GROUP BY ALL) GROUP BY l_partkey")
def grad_sum_views(spark, sf):
    view = load(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum(F.col("l_discount") - 0.05).alias("g"))
    return view.groupBy(F.col("l_partkey").alias("splat_id")).agg(tidy(F.sum("g"), 4).alias("grad"), F.count("*").alias("visible"))


_ADAM = "SELECT p_partkey AS splat_id, p_retailprice AS x, p_size / 50e0 - 0.5e0 AS d_x, p_size / 100e0 AS m_x, p_size / 200e0 AS v_x FROM {part}"


@query(f"""SELECT splat_id, round(x - 0.01 * (m / (1 - pow(0.9, 3))) / (sqrt(v / (1 - pow(0.999, 3))) + 1e-15), 6) + 0.0 AS x, round(m, 8) + 0.0 AS m_x, round(v, 8) + 0.0 AS v_x
FROM (SELECT *, 0.9 * m_x + 0.1 * d_x AS m, 0.999 * v_x + 0.001 * d_x * d_x AS v FROM ({_sql(_ADAM)}))""")
def adam_step(spark, sf):
    t = _table(spark, sf, _ADAM)
    out = O.adam_step(t.drop("d_x"), t.select("splat_id", "d_x"), {"x": 0.01}, 3)
    return out.select("splat_id", tidy(F.col("x")).alias("x"), tidy(F.col("m_x"), 8).alias("m_x"), tidy(F.col("v_x"), 8).alias("v_x"))


@query(f"SELECT splat_id, round(least(logit, ln(0.01 / 0.99)), 6) + 0.0 AS logit FROM ({_sql(_SPLATS)})")
def opacity_reset(spark, sf):
    return _table(spark, sf, _SPLATS).select("splat_id", tidy(O.reset_opacity(F.col("logit"))).alias("logit"))


_SCORE = "SELECT splat_id, sx, logit, (splat_id * 7919) % 1009 AS score FROM ({s})"


@query(f"WITH s AS ({_SCORE.format(s=_sql(_SPLATS))}) SELECT splat_id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, splat_id) AS r FROM s) WHERE r <= (SELECT round(0.05 * count(*)) FROM s)")
def densify_topk(spark, sf):
    s = _table(spark, sf, _SPLATS).withColumn("score", F.col("splat_id") * 7919 % 1009)
    return O.top_fraction(s, "score", 0.05).select("splat_id", "score")


@query(f"WITH s AS ({_sql(_SPLATS)}), c AS (SELECT * FROM s WHERE sx < -2.5 AND logit > 1) SELECT splat_id, px, logit FROM s UNION ALL SELECT splat_id + 100000000, px, logit FROM c")
def clone_union(spark, sf):
    s = _table(spark, sf, _SPLATS)
    return O.clone(s, s.where("sx < -2.5 AND logit > 1"), "splat_id", F.col("splat_id") + 100_000_000).select("splat_id", "px", "logit")


@query(f"SELECT splat_id FROM ({_sql(_SPLATS)}) WHERE 1 / (1 + exp(-logit)) >= 0.1 AND greatest(exp(sx), exp(sy), exp(sz)) <= 0.13")
def prune_filter(spark, sf):
    size = F.greatest(*(F.exp(c) for c in S.vector("sx", "sy", "sz")))
    return O.prune(_table(spark, sf, _SPLATS), G.sigmoid(F.col("logit")), size, 0.1, 0.13).select("splat_id")


@query("SELECT p_partkey AS splat_id, coalesce(s_acctbal, 0) AS m_x FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def compact_moments(spark, sf):
    m = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("splat_id"), F.col("s_acctbal").alias("m_x"))
    return O.keep_moments(load(spark, sf, "part").select(F.col("p_partkey").alias("splat_id")), m, ["m_x"])


@query("""WITH p AS (SELECT s_suppkey AS id, s_nationkey * 1e0 AS x, s_acctbal / 500e0 AS y FROM supplier), d AS (SELECT a.id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, b.id AS o FROM p a JOIN p b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, o) AS k FROM d) SELECT id, round(ln(greatest(avg(d), 1e-4)), 6) + 0.0 AS log_scale FROM r WHERE k <= 3 GROUP BY id""")
def knn_init_radius(spark, sf):
    p = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("pt"), (F.col("s_nationkey") * 1.0).alias("x"), (F.col("s_acctbal") / 500).alias("y"))
    return S.nearest_radius(p, "pt", ["x", "y"], 8.0).select("id", tidy(F.log(F.greatest("radius", F.lit(1e-4)))).alias("log_scale"))


@query(f"WITH p AS ({_sql(_POINTS)}), c AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p) SELECT round(greatest(max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz))), 1e-6), 6) + 0.0 AS extent FROM p, c")
def scene_extent(spark, sf):
    return S.scene_extent(_table(spark, sf, _POINTS), ["x", "y", "z"]).select(tidy(F.col("extent")).alias("extent"))


@query(f"""WITH p AS ({_sql(_POINTS)}), c AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, count(*) AS n FROM p), d AS (SELECT sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) AS d, n FROM p, c)
SELECT round(list_sort(list(d))[least(any_value(n) - 1, floor(0.9 * any_value(n))::BIGINT) + 1] * 1.2 / sin(radians(25)), 6) + 0.0 AS distance FROM d""")
def framing_p90(spark, sf):
    return S.framing(_table(spark, sf, _POINTS), ["x", "y", "z"], math.radians(50)).select(tidy(F.col("distance")).alias("distance"))


@query("SELECT i AS step, round(5 * cos(radians(15)) * sin(2 * pi() * i / 24), 6) + 0.0 AS ex, round(-5 * sin(radians(15)), 6) + 0.0 AS ey, round(-5 * cos(radians(15)) * cos(2 * pi() * i / 24), 6) + 0.0 AS ez, round(240 / tan(radians(25)) / 1, 6) + 0.0 AS focal FROM (SELECT unnest(range(24)) AS i) t")
def orbit_turntable(spark, sf):
    return C.turntable(spark, 24, 5.0, 15.0, 480).select("step", *(tidy(F.col(c)).alias(c) for c in ("ex", "ey", "ez", "focal")))


_DEV = "SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'Apple M1' WHEN 1 THEN 'NVIDIA GeForce GT' WHEN 2 THEN 'AMD Radeon Pro' WHEN 3 THEN 'Intel Iris Pro' WHEN 4 THEN 'Intel UHD Graphics' ELSE 'Voodoo' END AS name, cast(floor(s_acctbal * 1000000) AS BIGINT) + 2000000000 AS working_set, s_suppkey % 4 = 0 AS low_power, s_nationkey AS host FROM {supplier}"
_VENDOR = """CASE WHEN lower(name) LIKE '%apple%' THEN 'apple' WHEN lower(name) LIKE '%nvidia%' OR lower(name) LIKE '%geforce%' OR lower(name) LIKE '%quadro%' THEN 'nvidia'
WHEN lower(name) LIKE '%amd%' OR lower(name) LIKE '%radeon%' OR lower(name) LIKE '%firepro%' OR lower(name) LIKE '%vega%' THEN 'amd'
WHEN lower(name) LIKE '%intel%' OR lower(name) LIKE '%iris%' OR lower(name) LIKE '%hd graphics%' THEN 'intel' ELSE 'unknown' END"""


def _devices(spark, sf) -> DataFrame:
    return spark.sql(_DEV, supplier=load(spark, sf, "supplier"))


@query(f"SELECT id, name, {_VENDOR} AS vendor FROM ({_DEV.format(supplier='supplier')})")
def vendor_parse(spark, sf):
    return _devices(spark, sf).select("id", "name", C.vendor(F.col("name")).alias("vendor"))


@query(f"SELECT host, id, name FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY low_power, working_set DESC, id) AS r FROM ({_DEV.format(supplier='supplier')})) WHERE r = 1")
def gpu_pick(spark, sf):
    return C.pick_device(_devices(spark, sf), "host").select("host", "id", "name")


@query(f"""SELECT id, vendor, floor(working_set * CASE vendor WHEN 'nvidia' THEN 0.6e0 WHEN 'amd' THEN 0.7e0 ELSE 0.5e0 END)::BIGINT AS budget,
CASE vendor WHEN 'nvidia' THEN 1000000 WHEN 'intel' THEN 750000 WHEN 'unknown' THEN 500000 WHEN 'amd' THEN least(4000000, greatest(250000, floor(working_set / 1073741824e0 * 1000000)::BIGINT)) ELSE least(6000000, greatest(250000, floor(working_set / 1073741824e0 * 750000)::BIGINT)) END::BIGINT AS ceiling,
CASE WHEN vendor IN ('amd', 'apple') THEN 32 ELSE 16 END AS tile, CASE vendor WHEN 'unknown' THEN 'fp32' ELSE 'fp16' END AS stored, CASE vendor WHEN 'apple' THEN 'fp16' ELSE 'fp32' END AS computed
FROM (SELECT *, {_VENDOR} AS vendor FROM ({_DEV.format(supplier='supplier')}))""")
def tier_decision(spark, sf):
    return C.decide(_devices(spark, sf)).select("id", "vendor", "budget", "ceiling", "tile", "stored", "computed")


@query("SELECT a.o_orderkey AS k, CASE WHEN (o_custkey % 3, o_orderkey % 5, o_orderkey % 7) < (1, 2, 3) THEN true ELSE false END AS older FROM orders a")
def version_compare(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), C.older(F.struct(F.col("o_custkey") % 3, F.col("o_orderkey") % 5, F.col("o_orderkey") % 7), (1, 2, 3)).alias("older"))


@query(f"""SELECT 0::BIGINT AS part, pt AS ord, printf('%.6f %.6f %.6f 200 200 200', x, y, z) AS line FROM ({_sql(_POINTS)})
UNION ALL SELECT 1, s_suppkey, printf('%.6f %.6f %.6f 255 40 40', s_nationkey * 1e0, s_acctbal / 500e0, 0e0) FROM supplier""")
def ply_lines(spark, sf):
    from loomscape.sources.ply import ply_rows

    cams = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("frame"), (F.col("s_nationkey") * 1.0).alias("x"), (F.col("s_acctbal") / 500).alias("y"), F.lit(0.0).alias("z"))
    return ply_rows(_table(spark, sf, _POINTS), cams, "pt", "frame")


@query("""SELECT vendor, count(*) AS n, '{"devices":' || count(*) || ',"vendor":"' || vendor || '"}' AS report FROM (SELECT """ + _VENDOR + f" AS vendor FROM ({_DEV.format(supplier='supplier')})) GROUP BY vendor")
def probe_report(spark, sf):
    d = _devices(spark, sf).groupBy(C.vendor(F.col("name")).alias("vendor")).agg(F.count("*").alias("n"))
    return d.select("vendor", "n", F.to_json(F.struct(F.col("n").alias("devices"), "vendor")).alias("report"))


@query("SELECT p_partkey AS k, format('frame_{:05d}.jpg', p_partkey) AS name, least(greatest(trunc(p_retailprice / 2000 * 255), 0), 255)::BIGINT AS level FROM part")
def frame_names_levels(spark, sf):
    level = F.least(F.greatest(F.col("p_retailprice") / 2000 * 255, F.lit(0.0)), F.lit(255.0)).cast("long")
    return load(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.format_string("frame_%05d.jpg", "p_partkey").alias("name"), level.alias("level"))


@query("SELECT o_orderkey AS frame FROM orders EXCEPT ALL SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def remaining_frames(spark, sf):
    done = load(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf, "orders").join(done, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("frame"))


@query("SELECT frame, support FROM (SELECT l_orderkey AS frame, count(DISTINCT l_partkey) AS support FROM lineitem GROUP BY 1) WHERE support >= 4 ORDER BY support DESC, frame LIMIT 40")
def registration_order(spark, sf):
    n = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(F.countDistinct("l_partkey").alias("support"))
    return n.where("support >= 4").orderBy(F.desc("support"), "frame").limit(40)



@query("WITH m AS (SELECT l_orderkey AS pair, l_partkey AS k, l_suppkey AS s, l_linenumber AS ln, l_linenumber % 3 = 0 AS fine FROM lineitem), c AS (SELECT pair, count(*) FILTER (fine) AS fine_n FROM m GROUP BY pair) SELECT pair, k, s, ln::BIGINT AS ln FROM m JOIN c USING (pair) WHERE fine OR fine_n < 2")
def fine_matches(spark, sf):
    m = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").cast("long").alias("ln"))
    fine = F.col("ln") % 3 == 0
    n = F.count(F.when(fine, 1)).over(Window.partitionBy("pair"))
    return m.withColumn("_n", n).where(fine | (F.col("_n") < 2)).drop("_n")
