"""Registered queries of rendering, block solvers, guided matching and focal estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomscape.functions import geometry as G
from loomscape.functions import vectors as V
from loomscape.functions.geometry import tidy
from loomscape.operators import adjustment as AD
from loomscape.operators import focal as FO
from loomscape.operators import frames as FR
from loomscape.operators import guided as GM
from loomscape.operators import optimizer as O  # noqa: E741
from loomscape.operators import pixels as P
from loomscape.operators import splats as S
from loomscape.plans.catalog import _BLUR, ORACLE_SQL, ORDER, QUERIES, _anchor_sql, _budget_sql, query
from loomscape.plans.scene_catalog import _SPLATS, _VIS, _sql, _table, _visible
from loomscape.session import load
from loomscape.sources.work import cut

_PIXELS = f"""SELECT * FROM (SELECT *, least(0.99, opacity * exp(power)) AS alpha FROM (
SELECT *, -0.5 * (s2 / det * (x - u) * (x - u) + s0 / det * (y - v) * (y - v)) + s1 / det * (x - u) * (y - v) AS power FROM (
SELECT *, unnest(range(greatest(floor(u - radius), 0)::BIGINT, least(ceil(u + radius), 319)::BIGINT + 1)) AS x FROM (
SELECT splat_id, r, g, b, u, v, s0, s1, s2, det, radius, opacity, round(depth, 6) AS depth, unnest(range(greatest(floor(v - radius), 0)::BIGINT, least(ceil(v + radius), 239)::BIGINT + 1)) AS y FROM ({_VIS})))) WHERE power <= 0) WHERE alpha >= 1 / 255e0"""


@query(f"SELECT splat_id, count(*) AS n, round(sum(alpha), 5) + 0.0 AS alpha, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ({_PIXELS}) GROUP BY splat_id")
def pixel_coverage(spark, sf):
    rows = S.coverage(_visible(spark, sf), 320, 240)
    ends = {f"{c}{i}": f(c).cast("long") for c in "xy" for i, f in enumerate((F.min, F.max))}
    return rows.groupBy("splat_id").agg(F.count("*").alias("n"), tidy(F.sum("alpha"), 5).alias("alpha"), *(e.alias(n) for n, e in ends.items()))


@query(f"""WITH t AS (SELECT *, coalesce(exp(sum(ln(1 - alpha)) OVER w), 1) AS t FROM ({_PIXELS}) WINDOW w AS (PARTITION BY x, y ORDER BY depth, splat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT x, y, sum(r * alpha * t) AS r, sum(g * alpha * t) AS g, sum(b * alpha * t) AS b, min(t * (1 - alpha)) AS through FROM t WHERE t > 1 / 255e0 GROUP BY x, y)
SELECT x, y, round(r + 0.1 * through, 5) + 0.0 AS r, round(g + 0.2 * through, 5) + 0.0 AS g, round(b + 0.3 * through, 5) + 0.0 AS b, round(through, 5) + 0.0 AS through FROM s""")
def render_pixels(spark, sf):
    seen = _visible(spark, sf).withColumn("depth", F.round("depth", 6))
    out = S.render(seen, 320, 240, ["r", "g", "b"], [0.1, 0.2, 0.3])
    return out.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *(tidy(F.col(c), 5).alias(c) for c in ("r", "g", "b", "through")))


_CLAIMS = """WITH RECURSIVE e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS c, list_transform(embedding, lambda x: floor(x::DOUBLE * 255)::BIGINT) AS v FROM embeddings),
p AS (SELECT b.label AS pair, a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))::DOUBLE AS distance
FROM e a JOIN e b ON b.label = a.label + 1 WHERE sqrt(a.x * a.x + a.y * a.y) > 1e-12 AND abs(a.x * b.x + a.y * b.y + a.c) / sqrt(a.x * a.x + a.y * a.y) < 0.02),
q AS (SELECT pair, a, row_number() OVER (PARTITION BY pair ORDER BY a) AS k, list({'d': distance, 'b': b} ORDER BY distance, b) AS own FROM p GROUP BY pair, a),
r AS (SELECT DISTINCT pair, 0::BIGINT AS k, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS distance, []::BIGINT[] AS taken FROM q
UNION ALL SELECT pair, k, a, CASE WHEN ok THEN free[1].b END, CASE WHEN ok THEN free[1].d END, CASE WHEN ok THEN list_append(taken, free[1].b) ELSE taken END FROM (
  SELECT *, len(free) > 0 AND free[1].d <= 130000 AND (len(free) < 2 OR free[1].d < 0.9025 * free[2].d) AS ok FROM (
    SELECT r.pair, q.k, q.a, r.taken, list_filter(q.own, lambda z: NOT list_contains(r.taken, z.b)) AS free FROM r JOIN q ON q.pair = r.pair AND q.k = r.k + 1)))
SELECT pair, a, b, distance FROM r WHERE b IS NOT NULL"""


@query(_CLAIMS)
def guided_greedy_match(spark, sf):
    v = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.floor(F.get("embedding", i).cast("double") * 255).cast("long"))
    e = load(spark, sf, "embeddings").select("vec_id", "label", *(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate("xyc")), v.alias("v"))
    lines = e.select((F.col("label") + 1).alias("pair"), F.col("vec_id").alias("query"), F.col("x").alias("la"), F.col("y").alias("lb"), F.col("c").alias("lc"), "v")
    points = e.select(F.col("label").alias("pair"), F.col("vec_id").alias("train"), "x", "y", "v")
    out = GM.guided_matches(lines, points, "pair", 0.02, 0.9025, 130000.0)
    return out.select("pair", F.col("query").alias("a"), F.col("train").alias("b"), "distance")


# Two captures of suppliers as frames, parts as points: what both frames of a pair supplied is
# seen in both, at a focal length of 0.8 times the long side of 640.
_FRAMES = """SELECT s_suppkey AS frame, s_suppkey % 2 AS capture, a / 40e0 AS ta, (s_suppkey % 7 - 3) / 3e0 AS tx, (s_suppkey % 5 - 2) / 4e0 AS ty, (s_suppkey % 3) / 5e0 AS tz, (1 - a * a / 6400e0) / (1 + a * a / 6400e0) AS c, a / 40e0 / (1 + a * a / 6400e0) AS s
FROM (SELECT s_suppkey, s_suppkey * 7 % 13 - 6 AS a FROM {supplier})"""
_SEEN = """SELECT l_suppkey AS frame, l_partkey AS point, (l_partkey % 37 - 18) / 8e0 AS wx, (l_partkey % 29 - 14) / 8e0 AS wy, 4e0 + (l_partkey % 23) / 5e0 AS wz, avg(l_discount) - 0.05 AS du, avg(l_tax) - 0.04 AS dv FROM {lineitem} GROUP BY l_suppkey, l_partkey"""
_PIX = """SELECT k.frame, capture, point, 512e0 * (c * wx + s * wz + tx) / (c * wz - s * wx + tz) + 320e0 + 8 * du AS px, 512e0 * (wy + ty) / (c * wz - s * wx + tz) + 240e0 + 8 * dv AS py
FROM ({seen}) k JOIN ({frames}) f ON f.frame = k.frame WHERE c * wz - s * wx + tz > 0.5"""
_TRY = """WITH p AS (SELECT capture, frame, row_number() OVER (PARTITION BY capture ORDER BY frame) - 1 AS place, count(*) OVER (PARTITION BY capture) AS n FROM ({frames}))
SELECT x.capture, gap, x.place, x.frame AS a, y.frame AS b FROM p x, (SELECT unnest([1, 2, 3]) AS gap) g, p y
WHERE gap < x.n AND x.place % greatest((x.n - gap) // 24, 1) = 0 AND y.capture = x.capture AND y.place = x.place + gap"""
_MET = "SELECT t.capture, t.gap, t.place, t.a, t.b, p.point, p.px AS x1, p.py AS y1, q.px AS x2, q.py AS y2 FROM ({tries}) t JOIN ({pix}) p ON p.frame = t.a JOIN ({pix}) q ON q.frame = t.b AND q.point = p.point"
_BASE = {"frames": _FRAMES.format(supplier="supplier"), "seen": _SEEN.format(lineitem="lineitem")}
_PIX_SQL = _PIX.format(**_BASE)
_MET_SQL = _MET.format(tries=_TRY.format(**_BASE), pix=_PIX_SQL)
_TAKEN = f"""SELECT capture, gap, place, a, b, n FROM (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY gap, place) AS r
FROM (SELECT capture, gap, place, a, b, count(*) AS n FROM ({_MET_SQL}) GROUP BY ALL) WHERE n >= 16) WHERE r <= 24"""


def _tables(spark, sf):
    frames = spark.sql(_FRAMES, supplier=load(spark, sf, "supplier"))
    seen = spark.sql(_SEEN, lineitem=load(spark, sf, "lineitem"))
    # {seen} and {frames} stand in parentheses, which a table's name must not
    pixels = spark.sql(_PIX.replace("({seen})", "{seen}").replace("({frames})", "{frames}"), seen=seen, frames=frames)
    pairs = FO.sampled_pairs(frames, "capture", "frame", ["frame"])
    one = pixels.select("capture", F.col("frame").alias("a"), "point", F.col("px").alias("x1"), F.col("py").alias("y1"))
    two = pixels.select("capture", F.col("frame").alias("b"), "point", F.col("px").alias("x2"), F.col("py").alias("y2"))
    matches = pairs.join(one, ["capture", "a"]).join(two, ["capture", "b", "point"])
    counts = matches.groupBy("capture", "a", "b").agg(F.count("*").alias("n"))
    return frames, matches, FO.accepted_pairs(pairs, counts, "capture")


@query(_TAKEN)
def focal_pair_sample(spark, sf):
    return _tables(spark, sf)[2].select("capture", F.col("gap").cast("long").alias("gap"), F.col("place").cast("long").alias("place"), "a", "b", "n")


def _times(a: list[str], b: list[str]) -> list[str]:
    """A product of matrices of SQL terms."""
    return [" + ".join(f"({a[3 * i + k]}) * ({b[3 * k + j]})" for k in range(3) if "0" not in (a[3 * i + k], b[3 * k + j])) or "0" for i in range(3) for j in range(3)]


def _turned(a: list[str]) -> list[str]:
    return [a[3 * j + i] for i in range(3) for j in range(3)]


def _as(values: list[str], prefix: str) -> str:
    return ", ".join(f"{v} AS {prefix}{i}" for i, v in enumerate(values))


def _named(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(9)]


def _camera_terms(focal: str) -> tuple[list[str], list[str]]:
    return [focal, "0", "320e0", "0", focal, "240e0", "0", "0", "1e0"], [f"1 / {focal}", "0", f"-320e0 / {focal}", "0", f"1 / {focal}", f"-240e0 / {focal}", "0", "0", "1e0"]


_MATRIX = f"SELECT t.*, {_as(_times(['g.c', '0', 'g.s', '0', '1e0', '0', '-g.s', '0', 'g.c'], _turned(['f.c', '0', 'f.s', '0', '1e0', '0', '-f.s', '0', 'f.c'])), 'r')}, f.tx AS fx, f.ty AS fy, f.tz AS fz, g.tx AS gx, g.ty AS gy, g.tz AS gz FROM ({_TAKEN}) t JOIN ({_BASE['frames']}) f ON f.frame = t.a JOIN ({_BASE['frames']}) g ON g.frame = t.b"
_SHIFT = "SELECT *, " + ", ".join(f"g{c} - (r{3 * i} * fx + r{3 * i + 1} * fy + r{3 * i + 2} * fz) AS t{i}" for i, c in enumerate("xyz")) + f" FROM ({_MATRIX})"
_ESS = f"SELECT *, {_as(_times(['0', '-t2', 't1', 't2', '0', '-t0', '-t1', 't0', '0'], _named('r')), 'e')} FROM ({_SHIFT})"
_INV = _camera_terms("512e0")[1]
_FUND = f"SELECT capture, gap, place, a, b, {_as(_times(_turned(_INV), _times(_named('e'), _INV)), 'f')} FROM ({_ESS})"
_OFF = "pow(x2 * ({p0}) + y2 * ({p1}) + ({p2}), 2) / (pow({p0}, 2) + pow({p1}, 2) + pow({b0}, 2) + pow({b1}, 2))".format(**{f"p{i}": f"f{3 * i} * x1 + f{3 * i + 1} * y1 + f{3 * i + 2}" for i in range(3)}, **{f"b{i}": f"f{i} * x2 + f{i + 3} * y2 + f{i + 6}" for i in range(2)})
_IN = f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY capture, a, b) AS m FROM (SELECT m.capture, m.a, m.b, x1, y1, x2, y2 FROM ({_MET_SQL}) m JOIN ({_FUND}) f ON f.a = m.a AND f.b = m.b WHERE {_OFF} <= 4)) WHERE m >= 12"
_K = _camera_terms("(mult * 640)")
_SWEEP = f"SELECT * EXCLUDE (f0, f1, f2, f3, f4, f5, f6, f7, f8), {_as(_times(_turned(_K[0]), _times(_named('f'), _K[0])), 'e')} FROM ({_FUND}), (SELECT unnest([{', '.join(f'{m}e0' for m in FO.MULTIPLIERS)}]) AS mult)"
_TWO = f"SELECT *, a0 + a4 + a8 AS t, sqrt(greatest((pow(a0 + a4 + a8, 2) - ({' + '.join(f'a{i} * a{i}' for i in range(9))})) / 2, 0)) AS p FROM (SELECT *, {_as(_times(_named('e'), _turned(_named('e'))), 'a')} FROM ({_SWEEP}))"
_ONE = f"SELECT *, {_as([f'((t + p) * e{i} - ({x})) / (p * sqrt(t + 2 * p))' for i, x in enumerate(_times(_named('a'), _named('e')))], 'i')} FROM ({_TWO})"
_UNDER = f"SELECT capture, a, b, mult, t, p, {_as(_times(_turned(_K[1]), _times(_named('i'), _K[1])), 'f')} FROM ({_ONE})"
_COSTS = f"""SELECT capture, a, b, mult, off / (mult * 640) AS cost, n FROM (SELECT *, row_number() OVER (PARTITION BY capture, a, b, mult ORDER BY off) AS r, count(*) OVER (PARTITION BY capture, a, b, mult) AS n
FROM (SELECT m.capture, m.a, m.b, mult, {_OFF} AS off FROM ({_IN}) m JOIN ({_UNDER}) u ON u.a = m.a AND u.b = m.b)) WHERE r = n // 2 + 1"""
_TOTALS = f"""SELECT capture, mult, sum(cost / mid) AS total, count(*) AS pairs, sum(n)::BIGINT AS support FROM (SELECT *, list_sort(list(cost) OVER (PARTITION BY capture, a, b))[11] AS mid FROM ({_COSTS})) WHERE mid > 1e-12 GROUP BY capture, mult"""


def _epipolar(spark, sf):
    frames, matches, pairs = _tables(spark, sf)
    pose = lambda x: frames.select(F.col("frame").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("c", "s", "tx", "ty", "tz")))
    both = pairs.join(pose("a"), "a").join(pose("b"), "b")
    zero, one = F.lit(0.0), F.lit(1.0)
    turn = lambda x: [F.col(f"{x}_c"), zero, F.col(f"{x}_s"), zero, one, zero, -F.col(f"{x}_s"), zero, F.col(f"{x}_c")]
    at = lambda x: [F.col(f"{x}_t{i}") for i in "xyz"]
    both = both.withColumns({f"r{i}": c for i, c in enumerate(G.mat_mul(turn("b"), G.transpose(turn("a"))))})
    r = [F.col(f"r{i}") for i in range(9)]
    both = both.withColumns({f"t{i}": g - m for i, (g, m) in enumerate(zip(at("b"), G.mat_vec(r, at("a")), strict=True))})
    t = [F.col(f"t{i}") for i in range(3)]
    both = both.withColumns({f"e{i}": c for i, c in enumerate(G.mat_mul([zero, -t[2], t[1], t[2], zero, -t[0], -t[1], t[0], zero], r))})
    k = [F.lit(1 / 512), zero, F.lit(-320 / 512), zero, F.lit(1 / 512), F.lit(-240 / 512), zero, zero, one]
    f = G.mat_mul(G.transpose(k), G.mat_mul([F.col(f"e{i}") for i in range(9)], k))
    epipolar = both.select("capture", "a", "b", *(c.alias(n) for n, c in zip(FO.EPIPOLAR, f, strict=True)))
    return matches.select("capture", "a", "b", "x1", "y1", "x2", "y2"), epipolar


_PAIR = ["capture", "a", "b"]


def _totals(spark, sf):
    matches, epipolar = _epipolar(spark, sf)
    near = FO.epipolar_inliers(matches, epipolar, _PAIR)
    return FO.summed_curves(FO.focal_curves(near, epipolar, _PAIR, 640.0, 320.0, 240.0), "capture", _PAIR)


@query(f"SELECT capture, a, b, mult, round(CASE WHEN t + 2 * p > 0 THEN sqrt(greatest(t - 2 * p, 0)) / sqrt(t + 2 * p) END, 6) + 0.0 AS asymmetry FROM ({_UNDER})")
def focal_asymmetry(spark, sf):
    swept = _epipolar(spark, sf)[1].withColumn("mult", F.explode(F.array(*(F.lit(m) for m in FO.MULTIPLIERS))))
    out = FO.asymmetry(swept, F.col("mult") * 640.0, F.lit(320.0), F.lit(240.0))
    return out.select(*_PAIR, "mult", tidy(F.col("asymmetry")).alias("asymmetry"))


@query(f"SELECT capture, mult, round(total, 5) + 0.0 AS total, pairs, support FROM ({_TOTALS})")
def focal_curve(spark, sf):
    return _totals(spark, sf).select("capture", "mult", tidy(F.col("total"), 5).alias("total"), "pairs", "support")


@query(f"""SELECT capture, CASE WHEN within THEN mult END AS mult, CASE WHEN within THEN mult * 640 END AS focal, round(total / pairs, 5) + 0.0 AS error, pairs, support
FROM (SELECT *, mult NOT IN ({FO.MULTIPLIERS[0]}e0, {FO.MULTIPLIERS[-1]}e0) AS within, row_number() OVER (PARTITION BY capture ORDER BY total, mult) AS r FROM ({_TOTALS})) WHERE r = 1""")
def focal_estimate(spark, sf):
    out = FO.chosen_focal(_totals(spark, sf), "capture", 640.0)
    return out.withColumn("error", tidy(F.col("error"), 5))


# Parts seen by four cameras, which turn about the vertical; the first one stays.
_BA = """SELECT pt, cam, c * wx + s * wz + a AS tx, wy - a / 2 AS ty, c * wz - s * wx + 0.5 AS tz, c AS r0, 0e0 AS r1, s AS r2, 0e0 AS r3, 1e0 AS r4, 0e0 AS r5, -s AS r6, 0e0 AS r7, c AS r8,
50 * (c * wx + s * wz + a) / (c * wz - s * wx + 0.5) + 320e0 + du AS u, 50 * (wy - a / 2) / (c * wz - s * wx + 0.5) + 240e0 + dv AS v
FROM (SELECT *, (1 - a * a) / (1 + a * a) AS c, 2 * a / (1 + a * a) AS s FROM (SELECT l_partkey AS pt, l_suppkey % 4 AS cam, (l_suppkey % 4 - 2) / 16e0 AS a, (l_partkey % 37 - 18) / 6e0 AS wx, (l_partkey % 29 - 14) / 5e0 AS wy,
6e0 + (l_partkey % 23) / 5e0 AS wz, (l_discount - 0.05) * 40 AS du, (l_tax - 0.04) * 40 AS dv FROM {lineitem}))"""
DAMP = 0.1
_JAC = f"""SELECT *, 50 / tz * r0 - 50 * tx / (tz * tz) * r6 AS p00, 50 / tz * r1 - 50 * tx / (tz * tz) * r7 AS p01, 50 / tz * r2 - 50 * tx / (tz * tz) * r8 AS p02,
50 / tz * r3 - 50 * ty / (tz * tz) * r6 AS p10, 50 / tz * r4 - 50 * ty / (tz * tz) * r7 AS p11, 50 / tz * r5 - 50 * ty / (tz * tz) * r8 AS p12,
-50 * tx * ty / (tz * tz) AS c00, 50 + 50 * tx * tx / (tz * tz) AS c01, -50 * ty / tz AS c02, 50 / tz AS c03, 0e0 AS c04, -50 * tx / (tz * tz) AS c05,
-50 - 50 * ty * ty / (tz * tz) AS c10, 50 * tx * ty / (tz * tz) AS c11, 50 * tx / tz AS c12, 0e0 AS c13, 50 / tz AS c14, -50 * ty / (tz * tz) AS c15,
50 * tx / tz + 320 - u AS ru, 50 * ty / tz + 240 - v AS rv FROM ({_BA.format(lineitem="lineitem")}) WHERE tz > 1e-9"""
_U = [f"sum(c0{r} * c0{c} + c1{r} * c1{c}) AS u{r}{c}" for r in range(6) for c in range(r, 6)] + [f"sum(c0{r} * ru + c1{r} * rv) AS g{r}" for r in range(6)]
_V = [f"sum(p0{r} * p0{c} + p1{r} * p1{c}) AS v{r}{c}" for r in range(3) for c in range(r, 3)] + [f"sum(p0{r} * ru + p1{r} * rv) AS h{r}" for r in range(3)]
_W = [f"sum(c0{r} * p0{c} + c1{r} * p1{c}) AS w{r}{c}" for r in range(6) for c in range(3)]
_UT = f"SELECT cam, count(*) AS n, {', '.join(_U)} FROM ({_JAC}) WHERE cam <> 0 GROUP BY cam"
_VT = f"SELECT pt, count(*) AS n, {', '.join(_V)} FROM ({_JAC}) GROUP BY pt"
_WT = f"SELECT pt, cam, {', '.join(_W)} FROM ({_JAC}) WHERE cam <> 0 GROUP BY pt, cam"
_D = [f"{'1.1e0 * ' if r == c else ''}v{min(r, c)}{max(r, c)}" for r in range(3) for c in range(3)]
_COF = [f"{_D[(j + 1) % 3 * 3 + (i + 1) % 3]} * {_D[(j + 2) % 3 * 3 + (i + 2) % 3]} - {_D[(j + 1) % 3 * 3 + (i + 2) % 3]} * {_D[(j + 2) % 3 * 3 + (i + 1) % 3]}" for i in range(3) for j in range(3)]
_VI = f"SELECT pt, h0, h1, h2, {', '.join(f'k{k} / d AS i{k}' for k in range(9))} FROM (SELECT *, {_D[0]} * k0 + {_D[1]} * k3 + {_D[2]} * k6 AS d FROM (SELECT *, {_as(_COF, 'k')} FROM ({_VT}))) WHERE abs(d) > 1e-18"
_A = f"SELECT w.*, h0, h1, h2, {', '.join(f'w{r}0 * i{c} + w{r}1 * i{3 + c} + w{r}2 * i{6 + c} AS a{r}{c}' for r in range(6) for c in range(3))} FROM w JOIN i ON i.pt = w.pt"
_WITH = f"WITH u AS ({_UT}), w AS ({_WT}), i AS ({_VI}), a AS ({_A})"
_DIGITS = 3


def _blocks(spark, sf):
    obs = spark.sql(_BA, lineitem=load(spark, sf, "lineitem"))
    j = AD.jacobians(obs, 50.0, 320.0, 240.0)
    free = AD.gauge(j, "cam", [0])
    return AD.camera_blocks(free, "cam"), AD.point_blocks(j, "pt"), AD.couplings(free, "pt", "cam")


def _round(names: list[str], digits: int = _DIGITS) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def _cols(names: list[str], digits: int = _DIGITS):
    return [tidy(F.col(n), digits).alias(n) for n in names]


_U_NAMES = [x.split()[-1] for x in _U]
_V_NAMES = [x.split()[-1] for x in _V]


@query(f"SELECT cam, n, {_round(_U_NAMES)} FROM ({_UT})")
def ba_camera_blocks(spark, sf):
    return _blocks(spark, sf)[0].select("cam", "n", *_cols(_U_NAMES))


@query(f"SELECT pt, n, {_round(_V_NAMES)} FROM ({_VT})")
def ba_point_blocks(spark, sf):
    return _blocks(spark, sf)[1].select("pt", "n", *_cols(_V_NAMES))


@query(f"SELECT pt, cam, {_round(AD.COUPLING)} FROM ({_WT})")
def ba_couplings(spark, sf):
    return _blocks(spark, sf)[2].select("pt", "cam", *_cols(AD.COUPLING))


_S_NAMES = [f"s{r}{c}" for r in range(6) for c in range(6)]
_REDUCED = f"""{_WITH}, p AS (SELECT a.cam AS cam_i, w.cam AS cam_j, {', '.join(f'sum(a{r}0 * w.w{c}0 + a{r}1 * w.w{c}1 + a{r}2 * w.w{c}2) AS s{r}{c}' for r in range(6) for c in range(6))} FROM a JOIN w ON w.pt = a.pt AND a.cam <= w.cam GROUP BY ALL)
SELECT cam_i, cam_j, {', '.join(f"round(CASE WHEN cam_i = cam_j THEN (coalesce(u{min(r, c)}{max(r, c)}, 0) - s{r}{c}){' * 1.1e0 + 1e-12' if r == c else ''} ELSE -s{r}{c} END, 2) + 0.0 AS s{r}{c}" for r in range(6) for c in range(6))}
FROM p LEFT JOIN u ON u.cam = cam_i AND cam_i = cam_j"""


@query(_REDUCED)
def ba_reduced_system(spark, sf):
    u, v, w = _blocks(spark, sf)
    return AD.reduced_blocks(u, w, AD.damped_inverses(v, "pt", DAMP), "pt", "cam", DAMP).select("cam_i", "cam_j", *_cols(_S_NAMES, 2))


_RIGHT = f"{_WITH} SELECT u.cam, row, round(b, 3) + 0.0 AS b, true AS solved FROM (SELECT cam, unnest([{', '.join(f'b{r}' for r in range(6))}]) AS b, unnest(range(6)) AS row FROM (SELECT u.cam, {', '.join(f'coalesce(x{r}, 0) - g{r} AS b{r}' for r in range(6))} FROM u LEFT JOIN (SELECT cam, {', '.join(f'sum(a{r}0 * h0 + a{r}1 * h1 + a{r}2 * h2) AS x{r}' for r in range(6))} FROM a GROUP BY cam) x ON x.cam = u.cam)) u"


@query(_RIGHT)
def ba_camera_step(spark, sf):
    """The right side, and whether the blocks of the reduced system times the step are that."""
    u, v, w = (cut(x, "blocks") for x in _blocks(spark, sf))
    inverses = AD.damped_inverses(v, "pt", DAMP)
    step = AD.camera_step(u, w, inverses, "pt", "cam", DAMP)
    half = AD.reduced_blocks(u, w, inverses, "pt", "cam", DAMP)
    turned = half.where("cam_i < cam_j").select(F.col("cam_j").alias("cam_i"), F.col("cam_i").alias("cam_j"), *(F.col(f"s{c}{r}").alias(f"s{r}{c}") for r in range(6) for c in range(6)))
    met = half.unionByName(turned).join(step.withColumnRenamed("cam", "cam_j"), "cam_j").groupBy(F.col("cam_i").alias("cam"))
    reached = met.agg(*(F.sum(G.dot([F.col(f"s{r}{c}") for c in range(6)], [F.col(f"d{c}") for c in range(6)])).alias(f"z{r}") for r in range(6)))
    both = reached.join(AD.right_side(u, w, inverses, "pt", "cam"), "cam")
    rows = both.select("cam", F.posexplode(F.array(*(F.struct(F.col(f"b{r}").alias("b"), F.col(f"z{r}").alias("z")) for r in range(6)))).alias("row", "x"))
    return rows.select("cam", F.col("row").cast("long").alias("row"), tidy(F.col("x.b"), 3).alias("b"), (F.abs(F.col("x.z") - F.col("x.b")) <= 1e-6 * (1 + F.abs(F.col("x.b")))).alias("solved"))


_TARGET = f"SELECT x, y, g AS t_r, b AS t_g, r AS t_b FROM ({ORACLE_SQL['render_pixels']})"
_BEHIND = " + ".join(f"sign(t{c} - t_{c}) / 230400e0 * ({c} * t - (t{c} - f{c} - m{c}) / (1 - alpha))" for c in "rgb")
_GRADIENT = f"""WITH p AS (SELECT *, coalesce(exp(sum(ln(1 - alpha)) OVER w), 1) AS t FROM ({_PIXELS}) WINDOW w AS (PARTITION BY x, y ORDER BY depth, splat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, {', '.join(f'{c} * alpha * t AS m{c}' for c in 'rgb')}, min(t * (1 - alpha)) OVER (PARTITION BY x, y) AS last, row_number() OVER (PARTITION BY x, y ORDER BY depth, splat_id) AS k FROM p WHERE t > 1 / 255e0),
a AS (SELECT *, {', '.join(f'coalesce(sum(m{c}) OVER w, 0) AS f{c}, sum(m{c}) OVER (PARTITION BY x, y) + {b} * last AS t{c}' for c, b in zip('rgb', ('0.1', '0.2', '0.3'), strict=True))} FROM m WINDOW w AS (PARTITION BY x, y ORDER BY depth, splat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT splat_id, {', '.join(f'round(sum(sign(t{c} - t_{c}) / 230400e0 * alpha * t) * 1000, 5) + 0.0 AS d_{c}' for c in 'rgb')}, round(sum(CASE WHEN alpha < 0.99 THEN ({_BEHIND}) * alpha * (1 - opacity) ELSE 0 END) * 1000, 5) + 0.0 AS d_logit,
round(sum(CASE WHEN k = 1 THEN (abs(tr - t_r) + abs(tg - t_g) + abs(tb - t_b)) / 230400e0 ELSE 0 END) * 1000, 5) + 0.0 AS loss, count(*) AS seen FROM a JOIN ({_TARGET}) q USING (x, y) GROUP BY splat_id"""


@query(_GRADIENT)
def image_gradients(spark, sf):
    """Of the picture from the same one with its channels exchanged, in thousandths."""
    seen = _visible(spark, sf).withColumn("depth", F.round("depth", 6))
    target = render_pixels(spark, sf).select("x", "y", F.col("g").alias("t_r"), F.col("b").alias("t_g"), F.col("r").alias("t_b"))
    out = S.image_gradients(seen, target, 320 * 240, 320, 240, ["r", "g", "b"], [0.1, 0.2, 0.3])
    return out.select("splat_id", *(tidy(F.col(c) * 1000, 5).alias(c) for c in ("d_r", "d_g", "d_b", "d_logit", "loss")), "seen")


@query(f"SELECT splat_id, round(least(logit, ln(0.01 / 0.99)), 6) + 0.0 AS logit, 0e0 AS m_logit, 0e0 AS v_logit FROM ({_sql(_SPLATS)})")
def opacity_reset_moments(spark, sf):
    state = _table(spark, sf, _SPLATS).join(load(spark, sf, "part").select(F.col("p_partkey").alias("splat_id"), (F.col("p_size") / 50 - 0.5).alias("m_logit"), (F.col("p_size") / 900).alias("v_logit")), "splat_id")
    return O.reset_opacities(state).select("splat_id", tidy(F.col("logit")).alias("logit"), "m_logit", "v_logit")


_RUNS = _anchor_sql(_BLUR, 15)


@query(f"""SELECT e.user_id, count(*) AS total, count(s.event_id) AS selected, count(*) - count(b.event_id) AS rejected_blurry, count(b.event_id) - count(d.event_id) AS rejected_duplicate, count(d.event_id) - count(s.event_id) AS rejected_over_budget
FROM events e LEFT JOIN (SELECT event_id FROM ({_BLUR})) b ON b.event_id = e.event_id LEFT JOIN (SELECT event_id FROM ({_RUNS})) d ON d.event_id = e.event_id
LEFT JOIN (SELECT event_id FROM ({_budget_sql(_RUNS, 10)})) s ON s.event_id = e.event_id GROUP BY e.user_id""")
def selection_rejects(spark, sf):
    frames = load(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    verdicts = FR.selection_verdicts(frames, "user_id", "event_id", ORDER, "value", "value", F.lit(True), 0.4, 15, 10)
    return FR.reject_counters(verdicts, "user_id")


@query(f"""WITH k AS ({ORACLE_SQL['nms_keypoints']}), c AS (SELECT DISTINCT image FROM k WHERE image % 40 = 0 ORDER BY image LIMIT 6), s AS (SELECT *, CASE WHEN max(response) OVER (PARTITION BY image) > 0 THEN response / max(response) OVER (PARTITION BY image) ELSE 0 END AS s FROM k JOIN c USING (image))
SELECT image, x, y, 1600 / 260e0 AS radius, 1600 / 700e0 AS line, round(0.2 + 0.8 * s, 6) + 0.0 AS red, round(0.9 - 0.7 * s, 6) + 0.0 AS green, round(1.0 - 0.9 * s, 6) + 0.0 AS blue FROM s""")
def feature_overlay(spark, sf):
    out = P.overlay(QUERIES["nms_keypoints"](spark, sf), "image", 1600)
    return out.select("image", "x", "y", "radius", "line", *(tidy(F.col(c)).alias(c) for c in ("red", "green", "blue")))
