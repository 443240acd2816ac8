"""Frame scoring and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscape.operators.runs import anchors, numbered

# Extensions of photos and videos that are read.
IMAGE_EXTENSIONS = ["bmp", "dng", "heic", "heif", "jpeg", "jpg", "png", "tif", "tiff"]
VIDEO_EXTENSIONS = ["avi", "m2ts", "m4v", "mov", "mp4", "mts"]


def with_place(frames: DataFrame, session: str, order: Sequence[str], name: str = "place") -> DataFrame:
    """Adds each frame's number from 0 in its session."""
    return frames.withColumn(name, (F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1).cast("long"))


def stride_sample(frames: DataFrame, session: str, order: Sequence[str], most: int) -> DataFrame:
    """Every so manieth frame of each session, at most `most`, evenly spread: the stride is
    the least that keeps the session within it."""
    placed = with_place(frames, session, order)
    stride = F.ceil(F.count("*").over(Window.partitionBy(session)) / F.lit(float(most)))
    return placed.withColumn("stride", F.greatest(stride, F.lit(1)).cast("long")).where("place % stride = 0 AND place div stride < " + str(most))


def reject_blurry(frames: DataFrame, session: str, blur: str, factor: float = 0.4) -> DataFrame:
    """Frames at least factor as sharp as the upper median of their session.

    The median is that of counts by value: two windows over one ordering, no list of a
    session's values.
    """
    w = Window.partitionBy(session)
    n = F.count("*").over(w)
    ranked = frames.withColumn("_rank", F.row_number().over(w.orderBy(blur)) - 1).withColumn("_n", n)
    middle = F.max(F.when(F.col("_rank") == F.floor(F.col("_n") / 2), F.col(blur))).over(w)
    return ranked.withColumn("_middle", middle).where(F.col(blur) >= factor * F.col("_middle")).drop("_rank", "_n", "_middle")


def collapse_duplicates(frames: DataFrame, session: str, order: Sequence[str], blur: str, distance: Column | None, signature: str, least: float, bits: int = 16) -> DataFrame:
    """The sharpest frame of each run of near-equal ones.

    A run goes on while frames differ by less than least from its first frame, so that
    drift adds up; the first of equally sharp frames stays. Frames differ by the mean
    absolute difference of their signatures (by 1 where lengths differ or one is null);
    where distance is given, signatures are numbers, and a null or NaN differs from none.
    No session is gathered: runs are found in blocks of 2 ** bits frames, and the best
    of each run is combined before the shuffle. Null sessions are one session.
    """
    sig_type = "double" if distance is not None else "array<double>"
    rows = frames.select(F.struct(*frames.columns).alias("_f"), F.xxhash64(session).alias("_s"), F.col(session).alias("_k"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.col(signature).cast(sig_type).alias("_sig"), F.col(blur).alias("_blur"))
    keys = ["_k", *(f"_o{i}" for i in range(len(order)))]
    ordered = numbered(rows, keys).drop(*keys)
    runs = anchors(ordered, least, bits)
    best = ordered.join(runs, "_row").groupBy("_anchor").agg(F.max_by("_f", F.struct("_blur", -F.col("_row"))).alias("_f"))
    return best.select("_f.*")


def budget(frames: DataFrame, session: str, order: Sequence[str], blur: str, target: int) -> DataFrame:
    """At most target frames of each session: the sharpest of each of target even buckets.

    In buckets of five frames or more a fifth is left out at either end, so that picks
    keep apart. The earliest of equally sharp frames is picked.
    """
    target = max(1, target)
    placed = with_place(frames, session, order, "_place").withColumn("_n", F.count("*").over(Window.partitionBy(session)))
    t = F.lit(target)
    # the bucket whose share [b n / t, (b + 1) n / t) of places holds this one
    bucket = F.floor(((F.col("_place") + 1) * t - 1) / F.col("_n"))
    placed = placed.withColumn("_bucket", F.when(F.col("_n") <= t, F.col("_place")).otherwise(bucket))
    begin, end = F.floor(F.col("_bucket") * F.col("_n") / t), F.floor((F.col("_bucket") + 1) * F.col("_n") / t)
    inset = F.when(end - begin >= 5, F.floor((end - begin) / 5)).otherwise(0)
    inside = (F.col("_n") <= t) | ((F.col("_place") >= begin + inset) & (F.col("_place") < F.greatest(begin + inset + 1, end - inset)))
    best = F.row_number().over(Window.partitionBy(session, "_bucket").orderBy(F.desc(blur), "_place"))
    return placed.where(inside).withColumn("_best", best).where("_best = 1").drop("_place", "_n", "_bucket", "_best")


def select_frames(frames: DataFrame, session: str, order: Sequence[str], blur: str, signature: str, distance: Column | None = None, factor: float = 0.4, least: float = 0.01, target: int = 150) -> DataFrame:
    """Blur rejection, then runs of duplicates, then the budget."""
    sharp = reject_blurry(frames, session, blur, factor)
    return budget(collapse_duplicates(sharp, session, order, blur, distance, signature, least), session, order, blur, target)


def selection_verdicts(frames: DataFrame, session: str, ident: str, order: Sequence[str], blur: str, signature: str, distance: Column | None = None, factor: float = 0.4, least: float = 0.01, target: int = 150) -> DataFrame:
    """session, ident and verdict of every frame: blurry, duplicate, over budget or selected.

    Each stage tells what it lets through; the last stage that did so is the verdict, by
    one aggregation over the stages' ids.
    """
    sharp = reject_blurry(frames, session, blur, factor)
    runs = collapse_duplicates(sharp, session, order, blur, distance, signature, least)
    stages = [frames, sharp, runs, budget(runs, session, order, blur, target)]
    passed = [df.select(session, ident, F.lit(k).alias("_stage")) for k, df in enumerate(stages)]
    every = passed[0].unionByName(passed[1]).unionByName(passed[2]).unionByName(passed[3])
    last = every.groupBy(session, ident).agg(F.max("_stage").alias("_stage"))
    names = F.array(*(F.lit(x) for x in ("blurry", "duplicate", "over budget", "selected")))
    return last.select(session, ident, F.get(names, F.col("_stage")).alias("verdict"))


def reject_counters(verdicts: DataFrame, session: str) -> DataFrame:
    """Each session's frames, those selected, and those rejected by reason."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    return verdicts.groupBy(session).agg(F.count("*").alias("total"), count("selected").alias("selected"), count("blurry").alias("rejected_blurry"), count("duplicate").alias("rejected_duplicate"), count("over budget").alias("rejected_over_budget"))


def natural_key(name: Column) -> Column:
    """Sorts digits in names as numbers: img_2 before img_10. Runs of digits are padded."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0")).otherwise(p)), "")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def source_kind(name: Column) -> Column:
    """photo, video or unsupported, by the name's extension."""
    return F.when(extension(name).isin(IMAGE_EXTENSIONS), "photo").when(extension(name).isin(VIDEO_EXTENSIONS), "video").otherwise("unsupported")
