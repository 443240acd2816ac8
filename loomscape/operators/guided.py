"""Matching along known epipolar lines, and one-to-one claims in a fixed order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscape.functions import kernels
from loomscape.sources.work import cut, discard


def _cells(low: Column, high: Column, cell: float) -> Column:
    first, last = F.floor(low / cell).cast("int"), F.floor(high / cell).cast("int")
    return F.explode(F.when(first <= last, F.sequence(first, last)))


def band_candidates(lines: DataFrame, points: DataFrame, pair: str, reach: float, cell: float) -> DataFrame:
    """Each line with the points of its pair nearer than reach, and off, their distance.

    lines hold pair, la, lb and lc (la x + lb y + lc = 0) and any other columns, points pair,
    x, y and others. A point lies in one cell of a grid, a line asks for the cells that its
    band crosses, column by column where it is flat and row by row where it is steep, so
    that they meet in an equi-join on (pair, cell) and no line is held against all points.
    Lines without direction meet nothing, as do those of pairs without points.
    """
    extent = points.groupBy(pair).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    norm = F.sqrt(F.col("la") * F.col("la") + F.col("lb") * F.col("lb"))
    steep = F.abs(F.col("la")) > F.abs(F.col("lb"))
    own = lines.withColumns({"_norm": norm, "_steep": steep}).where("_norm > 1e-12").join(extent, pair)
    # along the axis that the line runs with: from p0 to p1; across it: q0 to q1
    pick = lambda a, b: F.when(F.col("_steep"), F.col(a)).otherwise(F.col(b))
    own = own.withColumns({"_p0": pick("y0", "x0"), "_p1": pick("y1", "x1"), "_q0": pick("x0", "y0"), "_q1": pick("x1", "y1"), "_along": pick("lb", "la"), "_across": pick("la", "lb")})
    own = own.withColumn("_p", _cells(F.col("_p0"), F.col("_p1"), cell))
    at = lambda t: -(F.col("_along") * t + F.col("lc")) / F.col("_across")
    ends = at(F.col("_p") * cell), at((F.col("_p") + 1) * cell)
    wide = F.col("_norm") / F.abs(F.col("_across")) * reach + 1e-9 * cell
    own = own.withColumns({"_low": F.greatest(F.least(*ends) - wide, F.col("_q0")), "_high": F.least(F.greatest(*ends) + wide, F.col("_q1"))})
    own = own.where("_low <= _high").withColumn("_q", _cells(F.col("_low"), F.col("_high"), cell))
    own = own.select(*lines.columns, "_norm", F.when(F.col("_steep"), F.col("_q")).otherwise(F.col("_p")).alias("_cx"), F.when(F.col("_steep"), F.col("_p")).otherwise(F.col("_q")).alias("_cy"))
    placed = points.withColumns({"_cx": F.floor(F.col("x") / cell).cast("int"), "_cy": F.floor(F.col("y") / cell).cast("int")})
    off = F.abs(F.col("la") * F.col("x") + F.col("lb") * F.col("y") + F.col("lc")) / F.col("_norm")
    return own.join(placed, [pair, "_cx", "_cy"]).withColumn("off", off).where(F.col("off") < reach).drop("_cx", "_cy", "_norm")


def _walker(pair: str, query: str, train: str, distance: str, ratio: float, ceiling: float):
    """The claims of candidates in order of pair, query, distance and train."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, free, taken = None, [], set()  # the query that goes on, and its two nearest free ones

        def claims() -> bool:
            return bool(free) and free[0][1] <= ceiling and (len(free) < 2 or free[0][1] < ratio * free[1][1])

        for rows in batches:
            out = []
            for at in zip(*(rows[c].tolist() for c in (pair, query, train, distance)), strict=True):
                if at[:2] != own:
                    if own and claims():
                        out.append((*own, *free[0]))
                        taken.add(free[0][0])
                    if not own or at[0] != own[0]:
                        taken = set()
                    own, free = at[:2], []
                if len(free) < 2 and at[2] not in taken:
                    free.append(at[2:])
            yield pd.DataFrame(out, columns=[pair, query, train, distance])
        if own and claims():
            yield pd.DataFrame([(*own, *free[0])], columns=[pair, query, train, distance])

    return walk


def claim_in_order(candidates: DataFrame, pair: str, query: str, train: str, distance: str, ratio: float, ceiling: float = float("inf")) -> DataFrame:
    """One-to-one matches (pair, query, train, distance) of candidates of those columns.

    As if the queries of each pair came one after another, ascending: each looks at the
    train rows that none has claimed, and claims the nearest (the smaller of equal ones) if
    that is within the ceiling and nearer than ratio times the next, should there be one.

    Queries without a candidate within the ceiling claim nothing and go. Then rounds over
    all pairs at once: a query's outcome is settled as soon as no earlier unsettled one has
    either of its two nearest free train rows among its candidates, as nobody else can
    change them. All such queries leave in one round with what they claimed. As soon as a
    round settles less than half of the candidates left, which chains of queries that
    wait for each other bring about, the rest of each pair is walked in order, in a task
    that keeps the claimed train rows and one query. An empty table has no matches.
    """
    key = [pair, query]
    near = Window.partitionBy(*key)
    left = candidates.select(*key, train, distance).where(F.col(distance) <= ceiling / ratio)
    left = cut(left.withColumn("_least", F.min(distance).over(near)).where(F.col("_least") <= ceiling).drop("_least"), "claims")
    done: list[DataFrame] = []
    count, shrinks = left.count(), True
    while count and shrinks:
        head = left.groupBy(pair, train).agg(F.min(query).alias("_head"))
        near = Window.partitionBy(*key).orderBy(distance, train)
        two = left.withColumn("_rank", F.row_number().over(near)).where("_rank <= 2").join(head, [pair, train])
        # both of the two nearest wait for this query only
        free = F.col("_head") == F.col(query)
        settled = two.groupBy(*key).agg(F.min(free).alias("_free"), F.min_by(F.struct(train, distance), "_rank").alias("_best"), F.max(F.when(F.col("_rank") == 2, F.col(distance))).alias("_second")).where("_free")
        settled = settled.select(*key, f"_best.{train}", f"_best.{distance}", (F.col("_second").isNull() | (F.col(f"_best.{distance}") < ratio * F.col("_second"))).alias("_clear"))
        settled = cut(settled.withColumn("_claims", F.col("_clear") & (F.col(distance) <= ceiling)).drop("_clear"), "claims")
        done.append(settled)
        rest = left.join(settled.select(*key), key, "left_anti").join(settled.where("_claims").select(pair, train), [pair, train], "left_anti")
        before, left = left, cut(rest, "claims")
        discard(before)
        had, count = count, left.count()
        shrinks = 2 * count <= had
    ordered = left.repartition(pair).sortWithinPartitions(*key, distance, train)
    out = ordered.mapInPandas(_walker(pair, query, train, distance, ratio, ceiling), left.schema)
    out = cut(out, "claims") if count else left
    for more in done:
        out = out.unionByName(more.where("_claims").drop("_claims"))
    return out.select(*key, train, distance)


def _nearest_of_blocks(reach: float, limit: float, keep: int, chunk: int = 256):
    """For each query of a block its nearest train rows of another block, and how many
    there are within the limit."""

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(t):
            t = t.sort_values("id")
            points, theirs, train, lines = t[["a", "b"]].to_numpy(float), _matrix(t["v"]), t["id"].to_numpy(), q[["a", "b", "c"]].to_numpy(float)
            for k in range(0, len(q), chunk):
                near = kernels.near_lines(lines[k : k + chunk], points, reach)
                d = kernels.present_distances(_matrix(q["v"].iloc[k : k + chunk]), theirs)
                at, least, many = kernels.least_by_row(d, near, limit, keep)
                ids, ends = q["id"].to_numpy()[k : k + chunk], np.cumsum(np.minimum(many, keep)).tolist()
                out += [(q["pair"].iloc[0], ids[i], train[at[e - min(n, keep) : e]], least[e - min(n, keep) : e], n) for i, (n, e) in enumerate(zip(many.tolist(), ends, strict=True)) if n]
        return pd.DataFrame(out, columns=["pair", "query", "train", "distance", "n"])

    return run


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column])


def _list_walker(reach: float, ratio: float, ceiling: float):
    """The claims of queries in order of pair and query, each from its list of nearest train
    rows. Where claims have used up a list that isn't whole, the query is held against the
    pair's train rows that are free; these come first in a pair, and are kept."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, taken, lines, lines_of = None, set(), [], None
        parts, held, free = [], None, None  # train rows as they came, as arrays, and which are free

        def free_now() -> list[tuple[float, int]]:
            nonlocal parts, held, free
            if held is None:
                rows = pd.concat(parts)
                held, parts = (rows["id"].to_numpy(), rows[["a", "b"]].to_numpy(float), _matrix(rows["v"])), []
                free = ~np.isin(held[0], np.fromiter(taken, np.int64, len(taken)))
            found = []
            for line, v in lines:
                at = np.flatnonzero(kernels.near_lines(line[None], held[1], reach)[0] & free)
                if len(at):
                    d = kernels.present_distances(v[None], held[2][at])
                    near, least, _ = kernels.least_by_row(d, np.ones(d.shape, bool), np.inf, 2)
                    found += zip(least.tolist(), held[0][at[near]].tolist(), strict=True)
            return sorted(found)[:2]

        for rows in batches:
            out = []
            for pair, some in rows.groupby("pair", sort=False):
                if pair != own:
                    own, taken, lines, lines_of, parts, held = pair, set(), [], None, [], None
                points = some[some["kind"] == 0]
                if len(points):
                    parts.append(points)
                some = some[some["kind"] > 0]
                for kind, query, a, b, c, v, trains, distances, more in zip(*(some[x] for x in ("kind", "id", "a", "b", "c", "v", "train", "distance", "more")), strict=True):
                    if kind == 1:
                        lines, lines_of = lines if query == lines_of else [], query
                        lines.append((np.array([a, b, c], float), np.asarray(v, dtype=float)))
                        continue
                    two = [x for x in zip(distances.tolist(), trains.tolist(), strict=True) if x[1] not in taken][:2]
                    # what a list leaves out is no nearer than its last
                    if more and len(two) < 2 and not (two[0][0] < ratio * distances[-1] if two else distances[-1] > ceiling):
                        two = free_now()
                    if two and two[0][0] <= ceiling and (len(two) < 2 or two[0][0] < ratio * two[1][0]):
                        taken.add(two[0][1])
                        out.append((pair, query, two[0][1], two[0][0]))
                        if held is not None:
                            free[np.searchsorted(held[0], two[0][1]) : np.searchsorted(held[0], two[0][1], "right")] = False
            yield pd.DataFrame(out, columns=["pair", "query", "train", "distance"])

    return walk


def guided_matches(lines: DataFrame, points: DataFrame, pair: str, reach: float, ratio: float = 0.95, ceiling: float = float("inf"), block: int = 8192, keep: int = 8) -> DataFrame:
    """The matches claim_in_order() has of all lines (pair, query, la, lb, lc, v) and points
    (pair, train, x, y, v) of a pair that are nearer than reach, by the squared distance of v.

    v are whole numbers, equally many in all rows; what is null on a side counts nothing.
    Ids are whole numbers too; rows without one have no match.

    Both sides of a pair are dealt into blocks of about block rows, and each block of lines
    meets each of points in a task of its own, which returns the keep nearest of each query;
    their pairs are all looked at, but never rows of a table. The lists of a pair are then walked in order in one task. Claims rarely
    use a list up; where they do, that task holds the query against the pair's free points,
    so it keeps those of one pair in memory and is quadratic if all queries come to that.
    """
    kinds = dict(lines.dtypes) | {"train": dict(points.dtypes)["train"]}
    q = lines.where("query IS NOT NULL").select(F.col(pair).alias("pair"), F.col("query").cast("long").alias("id"), F.col("la").alias("a"), F.col("lb").alias("b"), F.col("lc").alias("c"), F.col("v").alias("v"))
    t = points.where("train IS NOT NULL").select(F.col(pair).alias("pair"), F.col("train").cast("long").alias("id"), F.col("x").alias("a"), F.col("y").alias("b"), F.lit(None).cast("double").alias("c"), F.col("v").alias("v"))
    parts = lambda df, name: df.groupBy("pair").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = cut(parts(q, "_mine").join(parts(t, "_theirs"), "pair"), "sizes")
    groups, pairs = sizes.agg(F.coalesce(F.sum(F.col("_mine") * F.col("_theirs")), F.lit(0)), F.count("*")).first()
    tasks = lambda n: min(960, max(1, 3 * n))

    def dealt(df: DataFrame, own: str, others: str, at: list[str]) -> DataFrame:
        rows = df.join(sizes, "pair").withColumn(at[0], F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        rows = rows.withColumn(at[1], F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("_mine", "_theirs")
        return rows.repartition(tasks(groups), "pair", "_q", "_t").groupBy("pair", "_q", "_t")

    met = dealt(q, "_mine", "_theirs", ["_q", "_t"]).cogroup(dealt(t, "_theirs", "_mine", ["_t", "_q"]))
    met = met.applyInPandas(_nearest_of_blocks(reach, ceiling / ratio, keep), f"pair {kinds[pair]}, query long, train array<long>, distance array<double>, n long")
    near = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("distance", "train")))), 1, keep)
    listed = met.groupBy("pair", "query").agg(near.alias("near"), F.sum("n").alias("n")).where(F.get("near", F.lit(0))["distance"] <= ceiling)
    listed = cut(listed.select("pair", F.col("query").alias("id"), "near.train", "near.distance", (F.col("n") > F.size("near")).alias("more")), "nearest")
    more = listed.where("more")
    rows = listed.withColumn("kind", F.lit(2))
    rows = rows.unionByName(q.join(more, ["pair", "id"], "left_semi").withColumn("kind", F.lit(1)), True)
    rows = rows.unionByName(t.join(more.select("pair").distinct(), "pair", "left_semi").withColumn("kind", F.lit(0)), True)
    ordered = rows.repartition(tasks(pairs), "pair").sortWithinPartitions("pair", F.col("kind") > 0, "id", "kind")
    ordered = ordered.select("pair", "kind", "id", "a", "b", "c", "v", "train", "distance", "more")
    out = cut(ordered.mapInPandas(_list_walker(reach, ratio, ceiling), f"pair {kinds[pair]}, query long, train long, distance double"), "claims")
    discard(sizes, listed)
    return out.select(F.col("pair").alias(pair), *(F.col(c).cast(kinds[c]).alias(c) for c in ("query", "train")), "distance")
