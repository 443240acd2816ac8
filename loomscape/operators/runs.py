"""Runs of near-equal frames, found in blocks of each session at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomscape.sources.work import cut, discard

NONE = -1


def numbered(frames: DataFrame, keys: Sequence[str], name: str = "_row") -> DataFrame:
    """frames with their numbers from 0 in the order of keys, over all partitions.

    A range sort, whose parts are numbered apart and then moved by the sizes of those
    before: no partition holds more than its range. Written, so that numbers stay.
    """
    placed = cut(frames.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))  # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begin = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_begin"))
    return placed.withColumn("_part", part).join(F.broadcast(begin), "_part").withColumn(name, F.col("_begin") + at).drop("_part", "_at", "_begin")


def _signatures(column: pd.Series, scalar: bool) -> tuple[np.ndarray, np.ndarray]:
    """Values as rows of a matrix, and how many of each are given."""
    if scalar:
        return column.to_numpy(dtype=float, na_value=np.nan)[:, None], np.ones(len(column), dtype=int)
    sizes = np.array([0 if v is None else len(v) for v in column], dtype=int)
    if len(sizes) and (sizes == sizes[0]).all() and sizes[0]:
        return np.stack(column.to_numpy()).astype(float), sizes
    out = np.zeros((len(sizes), max(sizes, default=0)))
    for i, v in enumerate(column):
        out[i, : sizes[i]] = v if sizes[i] else 0
    return out, sizes


def _apart(values: np.ndarray, sizes: np.ndarray, anchor: np.ndarray, least: float, scalar: bool) -> np.ndarray:
    if scalar:
        return np.abs(values[:, 0] - anchor[0]) >= least
    n = len(anchor)
    same = (sizes == n) & (n > 0)
    if not n or n > values.shape[1]:
        return np.full(len(values), 1.0 >= least)
    off = np.abs(values[:, :n] - anchor).cumsum(axis=1)[:, -1] / n
    return np.where(same, np.isnan(off) | (off >= least), 1.0 >= least)


def _walker(least: float, scalar: bool):
    """Walks blocks of frames in order; what goes on from batch to batch is one anchor."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = session = None
        at, sig, used = NONE, np.zeros(0), NONE
        for frames in batches:
            if not len(frames):
                continue
            rows, blocks, sessions = (frames[c].to_numpy() for c in ("_row", "_block", "_s"))
            values, sizes = _signatures(frames["_sig"], scalar)
            anchors, uses = np.empty(len(rows), dtype=np.int64), np.empty(len(rows), dtype=np.int64)
            turns = np.flatnonzero((blocks[1:] != blocks[:-1]) | (sessions[1:] != sessions[:-1])) + 1
            for begin, end in zip([0, *turns], [*turns, len(rows)], strict=True):
                if blocks[begin] != block:
                    block, at, used = blocks[begin], NONE, NONE
                    entry = frames["_entry"].iloc[begin]
                    if not pd.isna(entry):
                        came, count = _signatures(frames["_entry_sig"].iloc[begin : begin + 1], scalar)
                        at, sig, used = int(entry), came[0, : count[0]], int(entry)
                elif sessions[begin] != session:
                    at = NONE
                session = sessions[begin]
                place, width = begin, 16
                if at == NONE:
                    at, sig = int(rows[place]), values[place, : sizes[place]].copy()
                while place < end:
                    stop = min(end, place + width)
                    hit = np.flatnonzero(_apart(values[place:stop], sizes[place:stop], sig, least, scalar))
                    if not len(hit):
                        anchors[place:stop] = at
                        place, width = stop, width * 2
                        continue
                    anchors[place : place + hit[0]] = at
                    place, width = place + int(hit[0]), 16
                    at, sig = int(rows[place]), values[place, : sizes[place]].copy()
                    anchors[place] = at
                    place += 1
                uses[begin:end] = used
            yield pd.DataFrame({"_row": rows, "_s": sessions, "_anchor": anchors, "_used": uses})

    return walk


def anchors(ordered: DataFrame, least: float, bits: int = 16) -> DataFrame:
    """_row and _anchor: the number of the first frame of each frame's run.

    ordered has numbers without gaps (_row), a session's hash (_s: only neighbours are
    told apart by it) and signatures (_sig: a number or an array of them). A run goes on
    while frames are less than least from its first one.

    Blocks of 2 ** bits rows are walked apart, each as if a run began with it. Where the
    block before ends in another run than was assumed, the block is walked again from that
    run's first frame, in one piece with its neighbour: blocks grow twofold a round. Chains
    mostly meet after a few runs, so that two rounds do; at worst a round is done for
    each doubling. A walk keeps one anchor, however long its block is.
    """
    scalar = not dict(ordered.dtypes)["_sig"].startswith("array")
    walk, shape = _walker(least, scalar), "_row long, _s long, _anchor long, _used long"

    def walked(rows: DataFrame) -> DataFrame:
        return rows.repartition("_block").sortWithinPartitions("_block", "_row").mapInPandas(walk, shape)

    sig_type = dict(ordered.dtypes)["_sig"]
    frames = ordered.select("_row", "_s", "_sig")
    first = frames.select("*", F.shiftright("_row", bits).alias("_block"), F.lit(None).cast("long").alias("_entry"), F.lit(None).cast(sig_type).alias("_entry_sig"))
    runs = cut(walked(first), "runs")
    while True:
        by = F.shiftright("_row", bits).alias("_block")
        ends = runs.groupBy(by).agg(F.min_by("_used", "_row").alias("used"), F.min_by("_s", "_row").alias("s"), F.max_by("_s", "_row").alias("last"), F.max_by("_anchor", "_row").alias("exit"))
        w = Window.orderBy("_block")  # a row a block
        right = F.when(F.lag("last").over(w) == F.col("s"), F.lag("exit").over(w)).otherwise(NONE)
        # pairs of blocks of which one went wrong, and where the first of the two is entered
        pairs = ends.select("_block", "used", right.alias("right")).groupBy(F.shiftright("_block", 1).alias("_block")).agg(F.bool_or(F.col("used") != F.col("right")).alias("wrong"), F.min_by("right", "_block").alias("_entry"))
        entries = cut(pairs.where("wrong").select("_block", "_entry"), "entries")
        if entries.isEmpty():
            discard(entries)
            return runs.select("_row", "_anchor")
        bits += 1
        known = frames.select(F.col("_row").alias("_entry"), F.col("_sig").alias("_entry_sig"))
        met = entries.join(known, "_entry", "left").withColumn("_entry", F.when(F.col("_entry") >= 0, F.col("_entry")))
        by = F.shiftright("_row", bits)
        # broadcast, a row a block: after a join by _block the repartition in walked() would be
        # taken for done, and a join that turns into a broadcast one reads by mapper then,
        # which splits a block over tasks
        again = walked(frames.withColumn("_block", by).join(F.broadcast(met), "_block"))
        kept = runs.withColumn("_block", by).join(entries.select("_block"), "_block", "left_anti").drop("_block")
        before, runs = runs, cut(kept.unionByName(again), "runs")
        discard(before, entries)
