"""Shared plumbing of the training-data operators: links that connect what shares keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscape.operators.graph import components
from loomscape.session import load
from loomscape.sources.work import cut as materialize
from loomscape.sources.work import discard, work_path

__all__ = ["components", "connect", "discard", "materialize", "prefix_pairs", "shared_keys", "small", "table", "work_path"]


NARROW = 1_000_000  # rows of one long that are broadcast: 8 MB


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df to be broadcast where it has at most this many (narrow) rows; beyond them the
    join deals out both sides by its keys. df is best a table of materialize(), whose
    rows are counted from its files."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, sf_dir, name)


def shared_keys(member: DataFrame) -> DataFrame:
    """Of (key, id) those rows whose key several ids have."""
    shared = member.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    shared = materialize(shared, "keys")
    out = materialize(member.join(small(shared, NARROW), "key"), "members")
    discard(shared)
    return out


def _centres(rows: DataFrame) -> DataFrame:
    """For each key of (key, id) the id that meets most others under all its keys: of
    copies that are each like one original rather than like each other, the original."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    weight = rows.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("w"))
    return rows.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("w", -F.col("id"))).alias("centre"))


def _apart(rows: DataFrame, links: DataFrame) -> DataFrame:
    """key, id and part (the id's component under links) of rows whose key's members are
    in several parts."""
    found = materialize(components(links), "found")
    now = rows.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    mixed = now.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    out = materialize(now.join(mixed, "key"), "apart")
    discard(found)
    return out


def connect(members: DataFrame, verified: Callable[[DataFrame], DataFrame], settle: Callable[[DataFrame], DataFrame] | None = None, centres: int = 2, known: DataFrame | None = None) -> DataFrame:
    """Verified links (a, b) that connect all ids that verified links between any two
    ids of one key connect; members are those of shared_keys(). Links that are known
    already are among those returned.

    No pairs are made at first: every member is held against its key's centre only, the
    id that meets most others. Where members of a key stay in different components
    afterwards, further centres follow, until the pairs between components that are left
    over are at most a few for each member; those are then all checked. Or settle gets
    those members (key, id, part) after so many centres, and returns the links that are
    still needed; rounds are bounded then.
    Members of one component need no pair, so that nothing is lost, and no key's members
    are gathered in one task.
    """
    left = materialize(members.join(_centres(members), "key").where("id <> centre"), "left")
    links = verified(left.select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct())
    links = links if known is None else links.unionByName(known)
    left = left.drop("centre")
    rounds = 1
    while True:
        now = _apart(left, links)
        if settle and rounds == centres:
            return links.unionByName(settle(now))
        parts = now.groupBy("key", "part").agg(F.count("*").alias("n"))
        stat = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("part", F.struct("n", "part")).alias("main"))
        rest = materialize(now.join(stat, "key"), "left")
        todo = rest.agg(F.count("*").alias("rows"), F.sum(F.when(F.col("part") != F.col("main"), F.col("n"))).alias("pairs")).first()
        if not todo["rows"]:
            return links
        last = not settle and todo["pairs"] <= 8 * todo["rows"] + 10_000
        if last:
            one = rest.where("part <> main").select("key", F.col("id").alias("a"), F.col("part").alias("part_a"))
            other = rest.select("key", F.col("id").alias("b"), F.col("part").alias("part_b"), "main")
            pairs = one.join(other, "key").where("part_a <> part_b AND (part_b = main OR a < b)")
        else:
            rest = materialize(rest.join(_centres(rest.select("key", "id")), "key"), "left")
            own = F.max(F.when(F.col("id") == F.col("centre"), F.col("part"))).alias("own")
            pairs = rest.join(rest.groupBy("key").agg(own), "key").where("part <> own").select(F.col("id").alias("a"), F.col("centre").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = links.unionByName(verified(pairs))
        if last:
            return links
        left, rounds = rest.where("id <> centre").select("key", "id"), rounds + 1


def prefix_pairs(prefixes: DataFrame, near: Callable[[str, str], Column] | None = None, more: Sequence[Column] = ()) -> DataFrame:
    """Pairs (a, b) of ids of different parts that may be alike: the last step of a
    positional prefix join.

    prefixes has the first few entries of each id's set in an order that all sets share,
    as many as an alike set must share one of: key, id, part, n (the set's size) and most
    (the largest set that can be alike if this is the first entry shared). The smaller set
    of a pair must leave room for one of its own size there, so that sets that have but a
    common passage in common make no pair at all. near, if given, tells of the entries'
    column sketch, as sa and sb, and of na and nb whether a pair is worth a comparison; more
    are columns of those that are the same either way round, and are returned too.
    """
    rows = materialize(prefixes, "prefixes")
    mixed = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.max(F.col("most") >= F.col("n")).alias("room")).where("low < high AND room").select("key")
    held = rows.join(small(materialize(mixed, "mixed")), "key")
    of_part = held.groupBy("key", "part").agg(F.count("*").alias("c"))
    main = of_part.groupBy("key").agg(F.max_by("part", F.struct("c", "part")).alias("main"))
    held = materialize(held.join(main, "key"), "prefixes")
    discard(rows)
    held_too = [("sketch", "s")] if near else []
    side = lambda x: [F.col(c).alias(to + x) for c, to in (("id", ""), ("part", "p"), ("n", "n"), ("most", "m"), *held_too)]
    low = held.where("most >= n").select("key", *side("a"), "main")
    high = held.select("key", *side("b"), F.col("main").alias("main_b"))
    fits = F.expr("pa <> pb AND na <= nb AND nb <= ma AND na <= mb")
    fits = fits & near("a", "b") if near else fits
    one = low.where("pa <> main").join(high, "key").where(fits)
    two = low.where("pa = main").join(high.where("pb <> main_b"), "key").where(fits)
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *more]
    return one.select(*ends).unionByName(two.select(*ends)).where("a < b").distinct()
