"""Gaussian primitives: projection, tiles, compositing and their gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscape.functions import geometry as G
from loomscape.functions.tiles_np import SHAPE, blender, differentiator
from loomscape.sources.work import cut, discard

TILE = 16
ALPHA_LEAST = 1 / 255


def vector(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def project(splats: DataFrame, rotation: list[Column], shift: list[Column], focal: Column, cx: Column, cy: Column) -> DataFrame:
    """Adds depth, u, v, the inverse screen covariance (ka, kb, kc), radius, det and opacity."""
    turn = G.quaternion_matrix(G.unit_quaternion(vector("qx", "qy", "qz", "qw")))
    scale = [F.exp(c) for c in vector("sx", "sy", "sz")]
    point = G.to_camera(rotation, shift, vector("px", "py", "pz"))
    cov = G.covariance(turn, scale)
    # one projection a step, so that no expression is worked out many times over
    out = splats.withColumns({f"c{i}": c for i, c in enumerate(cov)} | {f"t{i}": c for i, c in enumerate(point)})
    at = vector("t0", "t1", "t2")
    flat = G.screen_covariance(vector("c0", "c1", "c2", "c3", "c4", "c5"), rotation, at, focal)
    out = out.withColumns({"s0": flat[0], "s1": flat[1], "s2": flat[2]})
    s = vector("s0", "s1", "s2")
    d = s[0] * s[2] - s[1] * s[1]
    u, v = G.pinhole(at, focal, cx, cy)
    out = out.withColumns({"depth": at[2], "u": u, "v": v, "det": d, "radius": G.screen_radius(s), "opacity": G.sigmoid(F.col("logit"))})
    safe = F.when(F.col("det") > 1e-12, F.col("det"))
    out = out.withColumns({"ka": s[2] / safe, "kb": -s[1] / safe, "kc": s[0] / safe})
    return out.drop(*(f"c{i}" for i in range(6)), *(f"t{i}" for i in range(3)), "s0", "s1", "s2")


def visible(projected: DataFrame, width: int, height: int, nearest: float = 0.2, least: float = 0.5, most: float = 512.0) -> DataFrame:
    """Primitives before the camera, of a size worth drawing, whose box meets the image."""
    # predicates on computed columns would be rewritten in terms of the inputs, many times
    # over; a row number keeps them above the projection
    projected = projected.withColumn("_row", F.monotonically_increasing_id())
    r = F.col("radius")
    box = (F.col("u") + r >= 0) & (F.col("u") - r < width) & (F.col("v") + r >= 0) & (F.col("v") - r < height)
    return projected.where((F.col("depth") > nearest) & (r >= least) & (r <= most) & (F.col("det") > 1e-12) & box & (F.col("_row") >= 0)).drop("_row")


def tiles(projected: DataFrame, width: int, height: int, size: int = TILE) -> DataFrame:
    """A row for each tile that a primitive's box meets."""
    def span(centre: str, cells: int) -> Column:
        low = F.greatest(F.floor((F.col(centre) - F.col("radius")) / size), F.lit(0))
        high = F.least(F.floor((F.col(centre) + F.col("radius")) / size), F.lit(cells - 1))
        return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int")))

    out = projected.withColumn("tx", F.explode(span("u", -(-width // size))))
    return out.withColumn("ty", F.explode(span("v", -(-height // size))))


def depth_rank(tiled: DataFrame, keys: list[str], ident: str = "splat_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("depth", ident))
    return tiled.withColumn("rank", rank.cast("long"))


def coverage(projected: DataFrame, width: int, height: int) -> DataFrame:
    """A row for each pixel (x, y) that a primitive colours, with its alpha.

    Pixels lie within the radius, rounded outwards and cut to the image, where the power of
    the falloff is at most 0 and alpha, at most 0.99, at least 1/255. Along a row of pixels
    the alphas that count make one span, whose ends solve a quadratic; only that span is
    generated, and the gates are asked of each of its pixels.
    """
    span = lambda low, high: F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))))
    r, u, v = F.col("radius"), F.col("u"), F.col("v")
    rows = projected.withColumn("y", span(F.greatest(F.floor(v - r), F.lit(0)), F.least(F.ceil(v + r), F.lit(height - 1))))
    dy = F.col("y") - v
    # -power <= ln(255 * opacity), as a bound on dx
    room = (F.col("kb") * dy) ** 2 - F.col("ka") * (F.col("kc") * dy * dy - 2 * F.ln(F.col("opacity") / ALPHA_LEAST))
    half, middle = F.sqrt(F.greatest(room, F.lit(0.0))) / F.col("ka"), u - F.col("kb") * dy / F.col("ka")
    rows = rows.withColumns({"_room": room, "_low": middle - half - 1e-6, "_high": middle + half + 1e-6}).where("_room >= -1e-9")
    out = rows.withColumn("x", span(F.greatest(F.floor(u - r), F.ceil("_low"), F.lit(0)), F.least(F.ceil(u + r), F.floor("_high"), F.lit(width - 1))))
    dx = F.col("x") - u
    power = -0.5 * (F.col("ka") * dx * dx + F.col("kc") * dy * dy) - F.col("kb") * dx * dy
    out = out.withColumn("_power", power).where("_power <= 0")
    out = out.withColumn("alpha", F.least(F.lit(0.99), F.col("opacity") * F.exp("_power"))).where(F.col("alpha") >= ALPHA_LEAST)
    return out.drop("_power", "_room", "_low", "_high")


def _queues(projected: DataFrame, width: int, height: int, columns: list[str], ident: str, size: int = TILE) -> DataFrame:
    """A row for each tile with a pixel that a primitive may colour: within its radius,
    rounded outwards, and where alpha may reach 1/255."""
    room, det = 2 * F.ln(F.col("opacity") / ALPHA_LEAST), F.col("ka") * F.col("kc") - F.col("kb") * F.col("kb")

    def reach(other: str) -> Column:
        whole = F.col("radius") + 1
        return F.when(det > 0, F.least(whole, F.sqrt(F.greatest(room, F.lit(0.0)) * F.col(other) / det) * (1 + 1e-6) + 1e-3)).otherwise(whole)

    def span(centre: str, far: str, cells: int) -> Column:
        low = F.greatest(F.floor((F.col(centre) - F.col(far)) / size), F.lit(0))
        high = F.least(F.floor((F.col(centre) + F.col(far)) / size), F.lit(cells - 1))
        return F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))))

    rows = projected.select(ident, "depth", *SHAPE, *columns).withColumns({"_rx": reach("kc"), "_ry": reach("ka"), "_room": room}).where("_room >= -1e-9")
    out = rows.withColumn("ty", span("v", "_ry", -(-height // size))).withColumn("tx", span("u", "_rx", -(-width // size)))
    return out.select("tx", "ty", F.lit(1).alias("kind"), "depth", ident, *SHAPE, *columns)


def _by_tile(queues: DataFrame, own: DataFrame | None, ident: str) -> DataFrame:
    """Each tile's own row and then its queue from front to back, in one partition."""
    rows = queues if own is None else queues.unionByName(own.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    # a number, so that tiles of little data are still dealt out
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "tx", "ty").sortWithinPartitions("tx", "ty", "kind", "depth", ident)


def _picture(projected: DataFrame, width: int, height: int, colours: list[str], ident: str, slabs: int) -> tuple[DataFrame, DataFrame]:
    """All primitives' queues, and tx, ty, light, last and the colours' sums of each tile."""
    queues = _queues(projected, width, height, colours, ident)
    blend = blender(TILE, width, height, colours)
    schema = "tx int, ty int, light array<double>, last double, " + ", ".join(f"`{c}` array<double>" for c in colours)
    begun = ["tx", "ty", "light", "last", *(F.col(c).alias(f"s_{c}") for c in colours)]
    none = queues.sparkSession.createDataFrame([], schema).select(*begun)
    first = projected.approxQuantile("depth", [1 / slabs], 0.01) if slabs > 1 else []
    if not first:
        return queues, cut(_by_tile(queues, none, ident).mapInArrow(blend, schema), "tiles")
    front = cut(_by_tile(queues.where(F.col("depth") <= first[0]), none, ident).mapInArrow(blend, schema), "tiles")
    seen = F.exists("light", lambda x: x > ALPHA_LEAST)
    shut = front.where(~seen)
    # tiles that the front closes look at nothing behind it
    rest = queues.where(F.col("depth") > first[0]).join(F.broadcast(shut.select("tx", "ty")), ["tx", "ty"], "left_anti")
    whole = cut(_by_tile(rest, front.where(seen).select(*begun), ident).mapInArrow(blend, schema).unionByName(shut), "tiles")
    discard(front)
    return queues, whole


def render(projected: DataFrame, width: int, height: int, colours: list[str], background: list[float], ident: str = "splat_id", slabs: int = 16) -> DataFrame:
    """x, y, colours and what is let through, for each pixel that a primitive colours;
    the others show the background.

    Front to back by (depth, ident), until 1/255 or less is let through. Primitives queue
    at the tiles that they may colour, and a tile's queue is held against its open pixels
    until there are none: memory is one tile's, and work follows what is seen, not the
    pixels that primitives cover. The nearest of slabs parts of the primitives goes
    first; the rest queues at tiles that are still open then.
    """
    _, tiles = _picture(projected, width, height, colours, ident, slabs)
    pixels = tiles.select("tx", "ty", F.posexplode(F.arrays_zip("light", *colours)).alias("_at", "_p"))
    x, y = F.col("tx") * TILE + F.col("_at") % TILE, F.col("ty") * TILE + F.floor(F.col("_at") / TILE).cast("int")
    out = pixels.where("_p.light < 1").select(x.alias("x"), y.alias("y"), *(F.col(f"_p.{c}").alias(c) for c in colours), F.col("_p.light").alias("through"))
    return out.withColumns({c: F.col(c) + b * F.col("through") for c, b in zip(colours, background, strict=True)})


def composite(rows: DataFrame, keys: list[str], order: list[str], colours: list[str], alpha: str = "alpha", background: float = 0.0) -> DataFrame:
    """Front-to-back blend of each key's rows: sums of colour * alpha * what is let through
    by the rows before, until that is 1/255 or less; then the background.

    What is let through never grows, so that stopping is a filter on the running product.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    through = F.coalesce(F.product(1 - F.col(alpha)).over(w), F.lit(1.0))
    lit = rows.withColumn("_t", through).where(F.col("_t") > 1 / 255)
    sums = lit.groupBy(*keys).agg(*(F.sum(F.col(c) * F.col(alpha) * F.col("_t")).alias(c) for c in colours), F.min(F.col("_t") * (1 - F.col(alpha))).alias("through"))
    return sums.withColumns({c: F.col(c) + background * F.col("through") for c in colours}) if background else sums


def blend_gradients(rows: DataFrame, keys: list[str], order: list[str], colour: str, upstream: str, alpha: str = "alpha") -> DataFrame:
    """Adds d_colour and d_alpha of each row for one channel of composite().

    What stands behind a row is the key's total less what stands before it and itself;
    both come from running sums.
    """
    base = Window.partitionBy(*keys).orderBy(*order)
    before = base.rowsBetween(Window.unboundedPreceding, -1)
    t = F.coalesce(F.product(1 - F.col(alpha)).over(before), F.lit(1.0))
    lit = rows.withColumn("t", t).where(F.col("t") > 1 / 255).withColumn("mine", F.col(colour) * F.col(alpha) * F.col("t"))
    front = F.coalesce(F.sum("mine").over(before), F.lit(0.0))
    total = F.sum("mine").over(Window.partitionBy(*keys))
    out = lit.withColumns({"front": front, "total": total})
    behind = F.col("total") - F.col("front") - F.col("mine")
    d_alpha = F.col(upstream) * (F.col(colour) * F.col("t") - behind / (1 - F.col(alpha)))
    return out.withColumns({"d_colour": F.col(upstream) * F.col(alpha) * F.col("t"), "d_alpha": d_alpha}).drop("front", "total", "mine")


def image_gradients(projected: DataFrame, target: DataFrame, pixels: int, width: int, height: int, colours: list[str], background: list[float], ident: str = "splat_id", slabs: int = 16) -> DataFrame:
    """ident, d_ of each colour and of logit, loss and seen: how the mean absolute difference
    from the target (x, y and colours t_*, a row for each pixel) over pixels times channels
    changes.

    The picture is made first, tile by tile: see render(). Queues then go by once more, as
    far as anything is seen: what stands behind a primitive is the pixel's total less what
    stands before it and itself, the background among it. Gradients are summed by tile
    before the shuffle. loss is a primitive's part of the summed difference of the pixels
    that it is the first to colour, so that the parts of all primitives add up to that of
    the pixels that any colours.
    """
    queues, tiles = _picture(projected, width, height, colours, ident, slabs)
    total = lambda c, b: F.zip_with(c, "light", lambda s, t: s + b * t).alias(f"s_{c}")
    picture = tiles.where(F.col("last").isNotNull()).select("tx", "ty", "last", *(total(c, b) for c, b in zip(colours, background, strict=True)))
    place = (F.col("y") % TILE * TILE + F.col("x") % TILE).cast("int")
    dealt = target.select(F.floor(F.col("x") / TILE).cast("int").alias("tx"), F.floor(F.col("y") / TILE).cast("int").alias("ty"), place.alias("_at"), *(f"t_{c}" for c in colours))
    # a tile has no more pixels than this
    goals = dealt.groupBy("tx", "ty").agg(*(F.map_from_entries(F.collect_list(F.struct("_at", F.col(f"t_{c}").cast("double")))).alias(f"t_{c}") for c in colours))
    every = F.sequence(F.lit(0), F.lit(TILE * TILE - 1))
    filled = {f"t_{c}": F.transform(every, lambda i: F.coalesce(F.col(f"t_{c}")[i], F.lit(float("nan")))) for c in colours}  # noqa: B023
    own = picture.join(goals.withColumns(filled), ["tx", "ty"])
    near = queues.join(F.broadcast(own.select("tx", "ty", "last")), ["tx", "ty"]).where("depth <= last").drop("last")
    kinds = dict(projected.dtypes)
    schema = f"`{ident}` {kinds[ident]}, " + ", ".join(f"`d_{c}` double" for c in [*colours, "logit"]) + ", loss double, seen long"
    parts = _by_tile(near, own.drop("last"), ident).mapInArrow(differentiator(TILE, width, height, colours, ident, 1.0 / (pixels * len(colours))), schema)
    return parts.groupBy(ident).agg(*(F.sum(c).alias(c) for c in parts.columns[1:]))


def _cells(names: list[str], cell: float) -> dict[str, Column]:
    return {f"_c{i}": F.floor(F.col(n) / cell) for i, n in enumerate(names)}


def _nearest(pairs: DataFrame, names: list[str], need: int) -> DataFrame:
    """id, radius, far and n of the nearest others among pairs of points."""
    d2 = sum(((F.col(n) - F.col(f"o_{n}")) ** 2 for n in names[1:]), (F.col(names[0]) - F.col(f"o_{names[0]}")) ** 2)
    ranked = pairs.where(~F.col("id").eqNullSafe(F.col("other"))).withColumn("d", F.sqrt(d2)).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("d", "other")))
    return ranked.where(F.col("r") <= need).groupBy("id").agg(F.avg("d").alias("radius"), F.max("d").alias("far"), F.count("*").alias("n"))


def _descend(todo: DataFrame, every: DataFrame, names: list[str], cell: float, need: int) -> DataFrame:
    """The nearest others of points whose neighbours stand cells away, through grids each
    eight times as coarse as the next.

    A cell has its number of points and their box. On each grid a point keeps the cells
    that may hold a neighbour: those no farther than the distance within which cells that
    are wholly nearer hold enough points. Only their cells on the next grid are looked at.
    """
    keys = [f"_c{i}" for i in range(len(names))]
    box = [f"{e}{i}" for i in range(len(names)) for e in ("lo", "hi")]
    ends = [f(f"{e}{i}").alias(f"{e}{i}") for i in range(len(names)) for e, f in (("lo", F.min), ("hi", F.max))]
    first = every.withColumns({f"{e}{i}": F.col(f"o_{n}") for i, n in enumerate(names) for e in ("lo", "hi")}).groupBy(*keys)
    grids = [cut(first.agg(F.count("*").alias("n"), *ends), "grid")]
    while grids[-1].limit(65).count() > 64:  # ends: at last a cell or two are left along each axis
        grids.append(cut(grids[-1].groupBy(*(F.shiftright(k, 3).alias(k) for k in keys)).agg(F.sum("n").alias("n"), *ends), "grid"))
    top = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in [*keys, "n", *box])) for r in grids[-1].collect()))
    own = todo.withColumns({f"_own{i}": c for i, c in enumerate(_cells(names, cell).values())})
    at = own.withColumn("_cell", F.explode(top)).select(*own.columns, "_cell.*")
    for level in range(len(grids) - 1, -1, -1):
        if level < len(grids) - 1:
            parts = grids[level].withColumns({f"_up{i}": F.shiftright(k, 3) for i, k in enumerate(keys)})
            up = at.select(*own.columns, *(F.col(k).alias(f"_up{i}") for i, k in enumerate(keys)))
            at = up.join(parts, [f"_up{i}" for i in range(len(keys))]).select(*own.columns, *keys, "n", *box)
        zero = F.lit(0.0)
        off = [(F.greatest(F.col(f"lo{i}") - F.col(n), F.col(n) - F.col(f"hi{i}"), zero), F.greatest(F.abs(F.col(f"lo{i}") - F.col(n)), F.abs(F.col(f"hi{i}") - F.col(n)))) for i, n in enumerate(names)]
        mine = F.lit(True)
        for i, k in enumerate(keys):
            mine = mine & (F.shiftright(f"_own{i}", 3 * level) == F.col(k))
        at = at.withColumns({"_near": sum((x * x for x, _ in off), zero), "_far": sum((x * x for _, x in off), zero), "_others": F.col("n") - mine.cast("long")})
        at = at.withColumn("_sum", F.sum("_others").over(Window.partitionBy("id").orderBy("_far")))
        at = at.withColumn("_bound", F.min(F.when(F.col("_sum") >= need, F.col("_far"))).over(Window.partitionBy("id")))
        at = at.where(F.col("_near") <= F.col("_bound") * (1 + 1e-9)).drop("_near", "_far", "_others", "_sum", "_bound")
    out = cut(_nearest(at.select("id", *names, *keys).join(every, keys), names, need).select("id", "radius"), "nearest")
    discard(*grids)
    return out


def nearest_radius(points: DataFrame, ident: str, names: list[str], cell: float, count: int = 3) -> DataFrame:
    """Mean distance to the nearest `count` other points (fewer where there are fewer).

    Points meet within blocks of cells, of the given size or, where cells hold many points,
    a part of it: the neighbours found in the cells around are right as soon as the last
    is nearer than a cell. Points where that fails, as they stand apart, search a pyramid
    of grids from its top: see _descend. More than `count` points in one place have
    radius 0, and stand for `count` neighbours of others. Points without all coordinates
    have no row and are nobody's neighbours.
    """
    todo = points.select(F.col(ident).alias("id"), *names)
    for n in names:
        todo = todo.where(F.col(n).isNotNull() & ~F.isnan(n))
    total = todo.count()
    need = min(count, max(0, total - 1))
    if not need:
        return todo.select("id", F.lit(0.0).alias("radius"))
    heaps = cut(todo.groupBy(*names).agg(F.count("*").alias("_n")).where(F.col("_n") > need).select(*names), "heaps")
    heaped = todo.join(heaps, names, "left_semi").select("id", F.lit(0.0).alias("radius"))
    todo = cut(todo.join(heaps, names, "left_anti").select("id", *names), "points")
    if todo.isEmpty():
        return heaped
    some = heaps.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(need)))).select(F.lit(None).cast(dict(todo.dtypes)["id"]).alias("id"), *names)
    every = todo.unionByName(some).select(F.col("id").alias("other"), *(F.col(n).alias(f"o_{n}") for n in names))
    met = lambda size: every.groupBy(*_cells([f"o_{n}" for n in names], size).values()).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
    for _ in range(16):  # a quarter of the size each time, while points have more than some 64 others in their cell
        if met(cell) <= 64 * total:
            break
        cell /= 4
    every = every.withColumns({k: F.floor(F.col(f"o_{n}") / cell) for k, n in zip(_cells(names, cell), names, strict=True)})
    around = todo.withColumns(_cells(names, cell))
    for k in _cells(names, cell):
        around = around.withColumn(k, F.explode(F.array(*(F.col(k) + d for d in (-1, 0, 1)))))
    near = _nearest(around.join(every, list(_cells(names, cell))), names, need)
    sure = cut(near.where((F.col("n") == need) & (F.col("far") <= cell)).select("id", "radius"), "nearest")
    left = todo.join(sure, "id", "left_anti")
    out = heaped.unionByName(sure)
    return out if left.isEmpty() else out.unionByName(_descend(left, every, names, cell, need))


def scene_extent(points: DataFrame, names: list[str]) -> DataFrame:
    """One row: the largest distance from the centroid, at least 1e-6; 1 without points."""
    centre = points.agg(*(F.avg(n).alias(f"m_{n}") for n in names))
    off = sum(((F.col(n) - F.col(f"m_{n}")) ** 2 for n in names[1:]), (F.col(names[0]) - F.col(f"m_{names[0]}")) ** 2)
    far = points.join(F.broadcast(centre)).agg(F.max(F.sqrt(off)).alias("far"))  # one row against all
    return far.select(F.when(F.col("far").isNull(), 1.0).otherwise(F.greatest("far", F.lit(1e-6))).alias("extent"))


def framing(points: DataFrame, names: list[str], fov: float) -> DataFrame:
    """One row: centroid, and the distance from which nine tenths of the points are seen.

    The distance at the place min(n - 1, floor(0.9 n)) of all sorted ones, found by rank
    within range-sorted parts, so that no part holds more than its share.
    """
    import math

    centre = points.agg(*(F.avg(n).alias(f"m_{n}") for n in names), F.count("*").alias("n")).first()
    if not centre["n"]:
        return points.sparkSession.createDataFrame([], ", ".join(f"m_{n} double" for n in names) + ", distance double")
    off = sum(((F.col(n) - F.lit(centre[f"m_{n}"])) ** 2 for n in names[1:]), (F.col(names[0]) - F.lit(centre[f"m_{names[0]}"])) ** 2)
    place = min(centre["n"] - 1, int(0.9 * centre["n"]))
    ordered = points.select(F.sqrt(off).alias("d")).repartitionByRange("d").sortWithinPartitions("d").withColumn("_at", F.monotonically_increasing_id())
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # written, as another run of the range sort would sample other bounds
    ordered = cut(ordered.select("d", part.alias("part"), at.alias("at")), "ranked")
    for r in sorted(ordered.groupBy("part").agg(F.count("*").alias("n")).collect()):
        if place < r["n"]:
            break
        place -= r["n"]
    d = ordered.where((F.col("part") == r["part"]) & (F.col("at") == place)).select((F.greatest("d", F.lit(1e-6)) * 1.2 / math.sin(fov / 2)).alias("distance"))
    return d.select(*(F.lit(centre[f"m_{n}"]).alias(f"m_{n}") for n in names), "distance")
