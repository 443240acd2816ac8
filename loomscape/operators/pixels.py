"""Images as tables of pixels (image, y, x, v): stencils, grids and keypoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unpack(images: DataFrame, image: str, values: str, width: int) -> DataFrame:
    """One row for each value of a row-major array."""
    out = images.select(F.col(image).alias("image"), F.posexplode(values).alias("i", "v"))
    return out.select("image", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).alias("x"), F.col("v").cast("double").alias("v"))


def _neighbours(pixels: DataFrame) -> DataFrame:
    """v at the eight neighbours, null beyond the edge: windows along rows, then columns."""
    row, column = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    out = pixels.withColumns({"w": F.lag("v").over(row), "e": F.lead("v").over(row)})
    return out.withColumns({n + s: f(c).over(column) for n, f in (("n", F.lag), ("s", F.lead)) for s, c in (("", "v"), ("w", "w"), ("e", "e"))})


def laplacian_variance(pixels: DataFrame) -> DataFrame:
    """Variance of the five-point Laplacian over all pixels, those of the edge counting 0."""
    response = F.coalesce(F.col("n") + F.col("s") + F.col("w") + F.col("e") - 4 * F.col("v"), F.lit(0.0))
    mean, square = F.avg("l"), F.avg(F.col("l") * F.col("l"))
    return _neighbours(pixels).withColumn("l", response).groupBy("image").agg(F.greatest(square - mean * mean, F.lit(0.0)).alias("blur"))


def cell_means(pixels: DataFrame, cells: int, height: int, width: int) -> DataFrame:
    """Mean of each cell of a cells x cells grid with whole-number bounds."""
    cy = F.floor(((F.col("y") + 1) * cells - 1) / height).cast("int")
    cx = F.floor(((F.col("x") + 1) * cells - 1) / width).cast("int")
    return pixels.groupBy("image", cy.alias("cy"), cx.alias("cx")).agg(F.avg("v").alias("mean"))


def box_downsample(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Half the size by means of 2 x 2; an odd last row or column goes."""
    inside = (F.col("y") < height // 2 * 2) & (F.col("x") < width // 2 * 2)
    return pixels.where(inside).groupBy("image", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(F.avg("v").alias("v"))


def harris(pixels: DataFrame, k: float = 0.04) -> DataFrame:
    """Corner response det - k trace^2 of gradient products summed over 5 x 5; only where
    all of that window's gradients exist."""
    gx = (F.col("ne") - F.col("nw")) + 2 * (F.col("e") - F.col("w")) + (F.col("se") - F.col("sw"))
    gy = (F.col("sw") - F.col("nw")) + 2 * (F.col("s") - F.col("n")) + (F.col("se") - F.col("ne"))
    g = _neighbours(pixels).select("image", "y", "x", gx.alias("gx"), gy.alias("gy")).where("gx IS NOT NULL AND gy IS NOT NULL")
    g = g.select("image", "y", "x", (F.col("gx") * F.col("gx")).alias("xx"), (F.col("gx") * F.col("gy")).alias("xy"), (F.col("gy") * F.col("gy")).alias("yy"))
    row = Window.partitionBy("image", "y").orderBy("x").rangeBetween(-2, 2)
    column = Window.partitionBy("image", "x").orderBy("y").rangeBetween(-2, 2)
    s = g.withColumns({n: F.sum(n).over(row) for n in ("xx", "xy", "yy")} | {"c": F.count("*").over(row)})
    s = s.withColumns({n: F.sum(n).over(column) for n in ("xx", "xy", "yy", "c")}).where("c = 25")
    trace = F.col("xx") + F.col("yy")
    return s.select("image", "y", "x", (F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy") - k * trace * trace).alias("response"))


def orientation(pixels: DataFrame, cy: float, cx: float, radius: float) -> DataFrame:
    """Direction of the centre of mass within a disc."""
    dy, dx = F.col("y") - F.lit(cy), F.col("x") - F.lit(cx)
    inside = dx * dx + dy * dy <= radius * radius
    return pixels.where(inside).groupBy("image").agg(F.atan2(F.sum(dy * F.col("v")), F.sum(dx * F.col("v"))).alias("angle"))


def cell_threshold(points: DataFrame, cell: list[Column], relative: float = 0.01, floor: float = 0.0005) -> DataFrame:
    """Points whose response reaches the larger of relative times their cell's highest and
    floor times their image's highest."""
    p = points.withColumns({f"_c{i}": c for i, c in enumerate(cell)})
    keys = [f"_c{i}" for i in range(len(cell))]
    top, cell_top = F.max("response").over(Window.partitionBy("image")), F.max("response").over(Window.partitionBy("image", *keys))
    p = p.withColumns({"_top": top, "_cell": cell_top})
    return p.where(F.col("response") >= F.greatest(relative * F.col("_cell"), floor * F.col("_top"))).drop("_top", "_cell", *keys)


def suppress(points: DataFrame, radius: int) -> DataFrame:
    """Points that no stronger point, nor an equal one earlier in row order, has within
    radius in both directions. Neighbours meet in blocks of radius + 1."""
    size = radius + 1
    block = lambda c: F.floor(F.col(c) / size)
    own = points.withColumns({"_by": block("y"), "_bx": block("x")})
    near = F.sequence(F.lit(-1), F.lit(1))
    other = points.select("image", F.col("y").alias("oy"), F.col("x").alias("ox"), F.col("response").alias("other"))
    other = other.withColumns({"_by": F.floor(F.col("oy") / size), "_bx": F.floor(F.col("ox") / size)})
    spread = other.withColumn("_dy", F.explode(near)).withColumn("_dx", F.explode(near))
    spread = spread.withColumns({"_by": F.col("_by") + F.col("_dy"), "_bx": F.col("_bx") + F.col("_dx")}).drop("_dy", "_dx")
    close = (F.abs(F.col("oy") - F.col("y")) <= radius) & (F.abs(F.col("ox") - F.col("x")) <= radius)
    earlier = (F.col("oy") < F.col("y")) | ((F.col("oy") == F.col("y")) & (F.col("ox") < F.col("x")))
    beats = (F.col("other") > F.col("response")) | ((F.col("other") == F.col("response")) & earlier)
    a, b = own.alias("a"), spread.alias("b")
    same = (F.col("a.image") == F.col("b.image")) & (F.col("a._by") == F.col("b._by")) & (F.col("a._bx") == F.col("b._bx"))
    return a.join(b, same & close & beats, "left_anti").drop("_by", "_bx")


def strongest(points: DataFrame, most: int, steps: int = 1 << 20) -> DataFrame:
    """At most `most` points of each image by response in steps of its highest, then row order."""
    top = F.max("response").over(Window.partitionBy("image"))
    grid = F.round(F.col("response") * steps / F.nullif("_top", F.lit(0.0)))
    p = points.withColumn("_top", top).withColumn("_grid", grid)
    rank = F.row_number().over(Window.partitionBy("image").orderBy(F.desc("_grid"), "y", "x"))
    return p.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).drop("_top", "_grid")


def round_robin(points: DataFrame, cell: Column, most: int) -> DataFrame:
    """At most `most` points of each image, taken from its cells in turn, best first."""
    turn = F.row_number().over(Window.partitionBy("image", "cell").orderBy(F.desc("response"), "y", "x"))
    p = points.withColumn("cell", cell).withColumn("turn", turn.cast("long"))
    taken = F.row_number().over(Window.partitionBy("image").orderBy("turn", "cell"))
    return p.withColumn("taken", taken.cast("long")).where(F.col("taken") <= most)


def area_downsample(pixels: DataFrame, values: list[str], height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Means over the source area of each new pixel (at least one pixel of the source)."""
    ny = F.floor(((F.col("y") + 1) * new_height - 1) / height).cast("int")
    nx = F.floor(((F.col("x") + 1) * new_width - 1) / width).cast("int")
    return pixels.groupBy("image", ny.alias("ny"), nx.alias("nx")).agg(*(F.avg(v).alias(v) for v in values))


def overlay(keypoints: DataFrame, image: str, width: int, every: int = 40, most: int = 6) -> DataFrame:
    """Circles to draw over the first most images whose number every divides: place, radius,
    line width, and a colour from blue (weak) to red, by the response over the image's
    strongest; 0 where that is not above 0."""
    chosen = keypoints.where(F.col(image) % every == 0).select(image).distinct().orderBy(image).limit(most)
    rows = keypoints.join(F.broadcast(chosen), image)  # most rows at the most
    top = F.max("response").over(Window.partitionBy(image))
    s = F.when(top > 0, F.col("response") / top).otherwise(0.0)
    rows = rows.withColumn("_s", s)
    return rows.select(image, "x", "y", F.lit(max(4.0, width / 260)).alias("radius"), F.lit(max(2.0, width / 700)).alias("line"), (0.2 + 0.8 * F.col("_s")).alias("red"), (0.9 - 0.7 * F.col("_s")).alias("green"), (1.0 - 0.9 * F.col("_s")).alias("blue"))
