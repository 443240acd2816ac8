"""Registered queries of frames, pixels, matching and graphs, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomscape.functions import vectors as V
from loomscape.functions.geometry import tidy
from loomscape.operators import frames as FR
from loomscape.operators import matching as M
from loomscape.operators import pixels as P
from loomscape.session import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that says the same."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


ORDER = ["ts", "event_id"]

_PLACED = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events"


@query(f"SELECT event_id, user_id, place FROM (SELECT *, greatest(ceil(n / 20.0)::BIGINT, 1) AS stride FROM ({_PLACED})) WHERE place % stride = 0 AND place // stride < 20")
def frame_stride_sample(spark, sf):
    return FR.stride_sample(load(spark, sf, "events"), "user_id", ORDER, 20).select("event_id", "user_id", "place")


_BLUR = """SELECT e.* FROM events e JOIN (
  SELECT user_id, list_sort(list(value))[count(*) // 2 + 1] AS middle FROM events GROUP BY user_id) m USING (user_id)
WHERE value >= 0.4 * middle"""


@query(f"SELECT event_id, user_id, value FROM ({_BLUR})")
def blur_relative_filter(spark, sf):
    return FR.reject_blurry(load(spark, sf, "events"), "user_id", "value").select("event_id", "user_id", "value")


def _anchor_sql(source: str, least: float) -> str:
    return f"""
WITH RECURSIVE f AS (SELECT event_id, user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM ({source})),
walk AS (
  SELECT user_id, k, value AS anchor, 1 AS run FROM f WHERE k = 1
  UNION ALL
  SELECT f.user_id, f.k, CASE WHEN abs(f.value - w.anchor) >= {least} THEN f.value ELSE w.anchor END,
         w.run + CASE WHEN abs(f.value - w.anchor) >= {least} THEN 1 ELSE 0 END
  FROM walk w JOIN f ON f.user_id = w.user_id AND f.k = w.k + 1),
best AS (
  SELECT f.*, row_number() OVER (PARTITION BY f.user_id, w.run ORDER BY f.value DESC, f.k) AS b FROM f JOIN walk w ON f.user_id = w.user_id AND f.k = w.k)
SELECT event_id, user_id, ts, value FROM best WHERE b = 1"""


def _dedup(frames: DataFrame, least: float) -> DataFrame:
    return FR.collapse_duplicates(frames.select("event_id", "user_id", "ts", "value"), "user_id", ORDER, "value", F.lit(True), "value", least)


@query(f"SELECT event_id, user_id, value FROM ({_anchor_sql('SELECT * FROM events', 15)})")
def anchor_dedup(spark, sf):
    return _dedup(load(spark, sf, "events"), 15).select("event_id", "user_id", "value")


def _budget_sql(source: str, target: int) -> str:
    return f"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM ({source})),
b AS (SELECT d.*, t.bucket, t.bucket * n // {target} AS lo, (t.bucket + 1) * n // {target} AS hi
      FROM d, (SELECT unnest(range({target})) AS bucket) t WHERE n > {target}),
i AS (SELECT *, CASE WHEN hi - lo >= 5 THEN (hi - lo) // 5 ELSE 0 END AS inset FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY value DESC, place) AS best FROM i
      WHERE place >= lo + inset AND place < greatest(lo + inset + 1, hi - inset))
SELECT event_id, user_id, value FROM r WHERE best = 1
UNION ALL SELECT event_id, user_id, value FROM d WHERE n <= {target}"""


@query(_budget_sql("SELECT * FROM events", 12))
def bucket_budget(spark, sf):
    return FR.budget(load(spark, sf, "events"), "user_id", ORDER, "value", 12).select("event_id", "user_id", "value")


@query(_budget_sql(_anchor_sql(_BLUR, 15).replace("WITH RECURSIVE", "WITH RECURSIVE"), 10))
def frame_select(spark, sf):
    return FR.select_frames(load(spark, sf, "events").select("event_id", "user_id", "ts", "value"), "user_id", ORDER, "value", "value", F.lit(True), 0.4, 15, 10).select("event_id", "user_id", "value")


@query(f"""WITH s AS ({_budget_sql(_anchor_sql(_BLUR, 15), 10)}) SELECT user_id, count(*) AS kept, (SELECT count(*) FROM events e WHERE e.user_id = s.user_id) AS total FROM s GROUP BY user_id""")
def selection_counters(spark, sf):
    kept = frame_select(spark, sf).groupBy("user_id").agg(F.count("*").alias("kept"))
    return kept.join(load(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("total")), "user_id")


@query(f"SELECT e.event_id, e.event_type, e.value FROM events e WHERE e.event_id IN (SELECT event_id FROM ({_budget_sql(_anchor_sql(_BLUR, 15), 10)}))")
def selected_rescan(spark, sf):
    return load(spark, sf, "events").join(frame_select(spark, sf).select("event_id"), "event_id", "left_semi").select("event_id", "event_type", "value")


_NAME = "regexp_extract(url, '://[^/]*/?([^?#]*)', 1)"
_KEY = "array_to_string(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(regexp_replace(p, '^0+(.)', '\\1'), 20, '0') ELSE p END), '')"


@query(f"SELECT page_id, name, {_KEY} AS sort_key FROM (SELECT page_id, {_NAME} AS name FROM pages)")
def natural_name_sort(spark, sf):
    pages = load(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://[^/]*/?([^?#]*)", 1).alias("name"))
    return pages.withColumn("sort_key", FR.natural_key(F.col("name")))


_FILES = "SELECT doc_id, 'Shot_' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.JPG' WHEN 1 THEN '.heic' WHEN 2 THEN '.MOV' WHEN 3 THEN '.webp' WHEN 4 THEN '.mp4' ELSE '' END AS name FROM {documents}"


@query(
    """SELECT doc_id, name, CASE WHEN lower(regexp_extract(name, '\\.([^./]+)$', 1)) IN ('bmp','dng','heic','heif','jpeg','jpg','png','tif','tiff') THEN 'photo'
WHEN lower(regexp_extract(name, '\\.([^./]+)$', 1)) IN ('avi','m2ts','m4v','mov','mp4','mts') THEN 'video' ELSE 'unsupported' END AS kind FROM ("""
    + _FILES.format(documents="documents")
    + ")"
)
def source_ext_filter(spark, sf):
    files = spark.sql(_FILES, documents=load(spark, sf, "documents"))
    return files.withColumn("kind", FR.source_kind(F.col("name")))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) / 64, 6) + 0.0 AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def signature_l1_adjacent(spark, sf):
    e = load(spark, sf, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea")), e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    return a.join(b, "a").select("a", "b", tidy(V.l1_distance(F.col("ea"), F.col("eb"))).alias("distance"))


_RGB = "SELECT l_orderkey AS image, l_linenumber AS ln, l_partkey % 256 AS r, l_suppkey % 256 AS g, cast(l_quantity AS BIGINT) % 256 AS b, l_partkey % 48 AS y, l_suppkey % 64 AS x FROM {lineitem}"


@query(f"SELECT image, ln, r, g, b, round((0.2126 * r + 0.7152 * g + 0.0722 * b) / 255.0, 6) + 0.0 AS luma FROM ({_RGB.format(lineitem='lineitem')})")
def luma_projection(spark, sf):
    p = spark.sql(_RGB, lineitem=load(spark, sf, "lineitem"))
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    return p.select("image", "ln", "r", "g", "b", tidy(V.luma(r, g, b)).alias("luma"))


@query(f"""SELECT image, ((y + 1) * 6 - 1) // 48 AS ny, ((x + 1) * 8 - 1) // 64 AS nx, round(avg(r), 6) + 0.0 AS r, round(avg(g), 6) + 0.0 AS g, round(avg(b), 6) + 0.0 AS b
FROM (SELECT * REPLACE (image % 50 AS image) FROM ({_RGB.format(lineitem='lineitem')})) GROUP BY ALL""")
def rgb_area_downsample(spark, sf):
    p = spark.sql(_RGB, lineitem=load(spark, sf, "lineitem")).withColumn("image", F.col("image") % 50)
    out = P.area_downsample(p, ["r", "g", "b"], 48, 64, 6, 8)
    return out.select("image", F.col("ny").cast("long").alias("ny"), F.col("nx").cast("long").alias("nx"), *(tidy(F.col(c)).alias(c) for c in "rgb"))


_PIX = "SELECT vec_id AS image, (i // 8)::BIGINT AS y, (i % 8)::BIGINT AS x, embedding[i + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS i) t"


def _pixels(spark, sf):
    return P.unpack(load(spark, sf, "embeddings"), "vec_id", "embedding", 8)


@query(f"""WITH p AS ({_PIX}), l AS (SELECT c.image, coalesce(n.v + s.v + w.v + e.v - 4 * c.v, 0) AS l FROM p c
LEFT JOIN p n ON n.image = c.image AND n.x = c.x AND n.y = c.y - 1 LEFT JOIN p s ON s.image = c.image AND s.x = c.x AND s.y = c.y + 1
LEFT JOIN p w ON w.image = c.image AND w.y = c.y AND w.x = c.x - 1 LEFT JOIN p e ON e.image = c.image AND e.y = c.y AND e.x = c.x + 1)
SELECT image, round(greatest(avg(l * l) - avg(l) * avg(l), 0), 6) + 0.0 AS blur FROM l GROUP BY image""")
def laplacian_variance(spark, sf):
    return P.laplacian_variance(_pixels(spark, sf)).select("image", tidy(F.col("blur")).alias("blur"))


@query(f"SELECT image, ((y + 1) * 3 - 1) // 8 AS cy, ((x + 1) * 3 - 1) // 8 AS cx, round(avg(v), 6) + 0.0 AS mean FROM ({_PIX}) GROUP BY ALL")
def cell_means(spark, sf):
    return P.cell_means(_pixels(spark, sf), 3, 8, 8).select("image", F.col("cy").cast("long").alias("cy"), F.col("cx").cast("long").alias("cx"), tidy(F.col("mean")).alias("mean"))


@query(f"SELECT image, y // 2 AS y, x // 2 AS x, round(avg(v), 6) + 0.0 AS v FROM ({_PIX}) GROUP BY image, y // 2, x // 2")
def box_downsample(spark, sf):
    return P.box_downsample(_pixels(spark, sf), 8, 8).select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), tidy(F.col("v")).alias("v"))


_GRAD = f"""WITH p AS ({_PIX}),
g AS (SELECT c.image, c.y, c.x,
  sum(k.gx * q.v) AS gx, sum(k.gy * q.v) AS gy FROM p c JOIN p q ON q.image = c.image AND abs(q.y - c.y) <= 1 AND abs(q.x - c.x) <= 1
  JOIN (VALUES (-1,-1,-1,-1),(-1,0,0,-2),(-1,1,1,-1),(0,-1,-2,0),(0,0,0,0),(0,1,2,0),(1,-1,-1,1),(1,0,0,2),(1,1,1,1)) k(dy, dx, gx, gy) ON k.dy = q.y - c.y AND k.dx = q.x - c.x
  WHERE c.y BETWEEN 1 AND 6 AND c.x BETWEEN 1 AND 6 GROUP BY ALL),
h AS (SELECT c.image, c.y, c.x, sum(q.gx * q.gx) AS xx, sum(q.gx * q.gy) AS xy, sum(q.gy * q.gy) AS yy FROM g c
  JOIN g q ON q.image = c.image AND abs(q.y - c.y) <= 2 AND abs(q.x - c.x) <= 2 GROUP BY ALL HAVING count(*) = 25),
r AS (SELECT image, y, x, xx * yy - xy * xy - 0.04 * (xx + yy) * (xx + yy) AS response FROM h)"""


@query(f"{_GRAD} SELECT image, y, x, round(response, 5) + 0.0 AS response FROM r")
def harris_response(spark, sf):
    return P.harris(_pixels(spark, sf)).select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), tidy(F.col("response"), 5).alias("response"))


@query(f"SELECT image, round(atan2(sum((y - 3.5) * v), sum((x - 3.5) * v)), 6) + 0.0 AS angle FROM ({_PIX}) WHERE (y - 3.5) * (y - 3.5) + (x - 3.5) * (x - 3.5) <= 9 GROUP BY image")
def orientation_centroid(spark, sf):
    return P.orientation(_pixels(spark, sf), 3.5, 3.5, 3.0).select("image", tidy(F.col("angle")).alias("angle"))


# pixels as responses: integers, so that ties occur and no rounding differs
_RESP = "SELECT vec_id AS image, (i // 8)::BIGINT AS y, (i % 8)::BIGINT AS x, floor(embedding[i + 1]::DOUBLE * 40) AS response FROM embeddings, (SELECT unnest(range(64)) AS i) t"


def _responses(spark, sf):
    return _pixels(spark, sf).select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.floor(F.col("v") * 40).cast("double").alias("response"))


@query(f"""SELECT image, y, x, response::DOUBLE AS response FROM (SELECT *, max(response) OVER (PARTITION BY image) AS top, max(response) OVER (PARTITION BY image, y // 4, x // 4) AS cell FROM ({_RESP}))
WHERE response >= greatest(0.5 * cell, 0.25 * top)""")
def cell_threshold(spark, sf):
    return P.cell_threshold(_responses(spark, sf), [F.floor(F.col("y") / 4), F.floor(F.col("x") / 4)], 0.5, 0.25).select("image", "y", "x", "response")


@query(f"""WITH r AS ({_RESP}) SELECT image, y, x, response::DOUBLE AS response FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.image = a.image AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1
AND (b.response > a.response OR (b.response = a.response AND (b.y < a.y OR (b.y = a.y AND b.x < a.x)))))""")
def nms_keypoints(spark, sf):
    return P.suppress(_responses(spark, sf), 1).select("image", "y", "x", "response")


@query(f"""SELECT image, y, x, rank FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY grid DESC, y, x) AS rank FROM
(SELECT *, round(response * 1048576 / nullif(max(response) OVER (PARTITION BY image), 0)) AS grid FROM ({_RESP}))) WHERE rank <= 10""")
def quantised_topk(spark, sf):
    return P.strongest(_responses(spark, sf), 10).select("image", "y", "x", "rank")


@query(f"""SELECT image, y, x, cell, turn, taken FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY turn, cell) AS taken FROM
(SELECT *, row_number() OVER (PARTITION BY image, cell ORDER BY response DESC, y, x) AS turn FROM (SELECT *, (y // 4) * 2 + x // 4 AS cell FROM ({_RESP})))) WHERE taken <= 14""")
def cell_round_robin(spark, sf):
    cell = (F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4)).cast("long")
    return P.round_robin(_responses(spark, sf), cell, 14).select("image", "y", "x", "cell", "turn", "taken")


@query("""WITH l AS (SELECT c_custkey AS image, level, (640 >> level) * (480 >> level) AS area FROM customer, (SELECT unnest(range(4)) AS level) t)
SELECT image, level::BIGINT AS level, greatest(16, round(1500.0 * area / sum(area) OVER (PARTITION BY image)))::BIGINT AS quota, greatest(2, 8 >> level)::BIGINT AS radius FROM l""")
def level_quota(spark, sf):
    levels = load(spark, sf, "customer").select(F.col("c_custkey").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("level"))
    area = F.expr("shiftright(640, level) * shiftright(480, level)")
    share = F.round(1500.0 * area / F.sum(area).over(Window.partitionBy("image")))
    return levels.select("image", F.col("level").cast("long").alias("level"), F.greatest(F.lit(16), share).cast("long").alias("quota"), F.greatest(F.lit(2), F.expr("shiftright(8, level)")).cast("long").alias("radius"))


# four lanes of 16 bits: sign bits of the embedding
_LANES = "SELECT vec_id, label, " + ", ".join(f"list_sum(list_transform(range(16), lambda i: CASE WHEN embedding[{16 * k} + i + 1] > 0 THEN 1 << i ELSE 0 END))::BIGINT AS d{k}" for k in range(4)) + " FROM embeddings"


@query(f"""WITH d AS ({_LANES}), p AS (SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.d0, b.d0)) + bit_count(xor(a.d1, b.d1)) + bit_count(xor(a.d2, b.d2)) + bit_count(xor(a.d3, b.d3)) AS distance
FROM d a JOIN d b ON b.label = a.label + 1),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rn, lead(distance) OVER (PARTITION BY a ORDER BY distance, b) AS second FROM p)
SELECT a, b, distance::BIGINT AS distance FROM r WHERE rn = 1 AND (second IS NULL OR distance < 0.95 * second)""")
def hamming_match(spark, sf):
    # squared distances of sign bits are the numbers of bits that differ
    d = load(spark, sf, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 64), lambda x: F.when(x > 0, 1).otherwise(0).cast("long")).alias("v"))
    out = M.match_descriptors(d.withColumn("pair", F.col("label") + 1), d.withColumn("pair", F.col("label")), "pair", "vec_id", "v", 0.95, cross_check=False)
    return out.select(F.col("query_id").alias("a"), F.col("train_id").alias("b"), F.col("distance").cast("long").alias("distance"))


_L2 = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 255)::BIGINT) AS v FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))::DOUBLE AS distance FROM e a JOIN e b ON b.label = a.label + 1),
f AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rn, lead(distance) OVER (PARTITION BY a ORDER BY distance, b) AS second,
  row_number() OVER (PARTITION BY b ORDER BY distance, a) AS back FROM p)"""


def _descriptors(spark, sf):
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 255).cast("long"))
    d = load(spark, sf, "embeddings").select("vec_id", "label", v.alias("v"))
    return d.withColumn("pair", F.col("label") + 1), d.withColumn("pair", F.col("label"))


@query(f"{_L2} SELECT a, b, distance FROM f WHERE rn = 1 AND (second IS NULL OR distance < 0.81 * second) AND distance <= 120000")
def l2_ratio_match(spark, sf):
    q, t = _descriptors(spark, sf)
    return M.match_descriptors(q, t, "pair", "vec_id", "v", 0.81, 120000, cross_check=False).select(F.col("query_id").alias("a"), F.col("train_id").alias("b"), "distance")


@query(f"{_L2} SELECT a, b, distance FROM f WHERE rn = 1 AND back = 1 AND (second IS NULL OR distance < 0.98 * second)")
def cross_check_match(spark, sf):
    q, t = _descriptors(spark, sf)
    return M.match_descriptors(q, t, "pair", "vec_id", "v", 0.98).select(F.col("query_id").alias("a"), F.col("train_id").alias("b"), "distance")


_BAND = """WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS c FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(abs(a.x * b.x + a.y * b.y + a.c) / sqrt(a.x * a.x + a.y * a.y), 6) + 0.0 AS off FROM e a JOIN e b ON b.label = a.label + 1
WHERE abs(a.x * b.x + a.y * b.y + a.c) / sqrt(a.x * a.x + a.y * a.y) < 0.05"""


@query(_BAND)
def epipolar_candidates(spark, sf):
    e = load(spark, sf, "embeddings").select("vec_id", "label", *(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate("xyc")))
    a = e.select(F.col("vec_id").alias("a"), (F.col("label") + 1).alias("pair"), F.col("x").alias("la"), F.col("y").alias("lb"), F.col("c").alias("lc"))
    b = e.select(F.col("vec_id").alias("b"), F.col("label").alias("pair"), "x", "y")
    off = F.abs(F.col("la") * F.col("x") + F.col("lb") * F.col("y") + F.col("lc")) / F.sqrt(F.col("la") * F.col("la") + F.col("lb") * F.col("lb"))
    return a.join(b, "pair").withColumn("off", off).where("off < 0.05").select("a", "b", tidy(F.col("off")).alias("off"))


_NEAR = """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders)
SELECT x.o_custkey AS cust, x.o_orderkey AS a, y.o_orderkey AS b FROM o x JOIN o y ON y.o_custkey = x.o_custkey AND y.place BETWEEN x.place + 1 AND x.place + 6"""


def _near(spark, sf):
    return M.window_pairs(load(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey", 6)


@query(_NEAR)
def window_pairs(spark, sf):
    return _near(spark, sf).select(F.col("o_custkey").alias("cust"), "a", "b")


_WIDE = """WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders)
SELECT x.o_orderkey AS a, y.o_orderkey AS b, y.place - x.place AS gap, floor(abs(x.o_totalprice - y.o_totalprice) / 1000)::BIGINT AS score FROM o x JOIN o y ON y.o_custkey = x.o_custkey AND y.place > x.place"""


def _wide(spark, sf):
    o = load(spark, sf, "orders").withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    x = o.select("o_custkey", F.col("o_orderkey").alias("a"), F.col("o_totalprice").alias("pa"), F.col("place").alias("ia"))
    y = o.select("o_custkey", F.col("o_orderkey").alias("b"), F.col("o_totalprice").alias("pb"), F.col("place").alias("ib"))
    return x.join(y, "o_custkey").where("ib > ia").select("a", "b", (F.col("ib") - F.col("ia")).cast("long").alias("gap"), F.floor(F.abs(F.col("pa") - F.col("pb")) / 1000).alias("score"))


@query(f"SELECT a, b, score FROM ({_WIDE}) WHERE gap > 6 ORDER BY score DESC, a, b LIMIT 60")
def loop_candidates(spark, sf):
    return M.loop_candidates(_wide(spark, sf).select("a", "b", "score"), _near(spark, sf), "score", 60)


@query(f"SELECT a, b, gap, score FROM (SELECT *, row_number() OVER (PARTITION BY gap ORDER BY score DESC, a, b) AS r FROM ({_WIDE})) WHERE r <= 3 AND score >= 30 ORDER BY gap DESC, score DESC, a, b LIMIT 25")
def seed_pool(spark, sf):
    return M.seed_pool(_wide(spark, sf), "gap", "score", 30)


# every line of lineitem is a keypoint: linked with the first and with the last one before it of
# its part and supplier, and with the last one before it of its order and quantity
_EDGES = """SELECT id AS a, unnest([hub, before, beside]) AS b FROM (SELECT id, first(id) OVER w AS hub, lag(id) OVER w AS before, lag(id) OVER (PARTITION BY l_orderkey, l_quantity ORDER BY id) AS beside
FROM (SELECT *, l_orderkey * 8 + l_linenumber AS id FROM lineitem) WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY id))"""
_TRACK = f"""WITH RECURSIVE e AS (SELECT a, b FROM ({_EDGES}) WHERE a <> b), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(id, other) AS (SELECT a, a FROM s UNION SELECT r.id, s.b FROM reach r JOIN s ON s.a = r.other)
SELECT id, min(other) AS track FROM reach GROUP BY id"""


def _tracks(spark, sf):
    lines = load(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    own, order = Window.partitionBy("l_partkey", "l_suppkey").orderBy("id"), Window.partitionBy("l_orderkey", "l_quantity").orderBy("id")
    links = lines.select(F.col("id").alias("a"), F.first("id").over(own).alias("hub"), F.lag("id").over(own).alias("before"), F.lag("id").over(order).alias("beside"))
    return M.tracks(links.select("a", F.explode(F.array("hub", "before", "beside")).alias("b")))


@query(_TRACK)
def track_components(spark, sf):
    return _tracks(spark, sf)


@query(f"SELECT track, id % 16 AS frame, min(id) AS keypoint FROM ({_TRACK}) GROUP BY track, id % 16")
def track_dedupe(spark, sf):
    t = _tracks(spark, sf).withColumn("frame", F.col("id") % 16)
    return M.first_of(t, ["track", "frame"], ["id"]).select("track", "frame", F.col("id").alias("keypoint"))


@query("""SELECT l_partkey AS keypoint, l_orderkey AS frame, l_linenumber::BIGINT AS match FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS r
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F') WHERE r = 1""")
def first_correspondence(spark, sf):
    done = load(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = load(spark, sf, "lineitem").join(done, "l_orderkey")
    first = M.first_of(rows, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"])
    return first.select(F.col("l_partkey").alias("keypoint"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("long").alias("match"))
