"""Runs of frames in blocks against one walk over each session."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from loomscape.functions.vectors import l1_distance
from loomscape.operators import frames as FR


def by_hand(rows, least, apart):
    """One frame after another: rows of (session, place, blur, signature)."""
    out, best, anchor, session = [], None, None, object()
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if r[0] != session or apart(anchor, r[3]) >= least:
            if best is not None:
                out.append(best)
            session, anchor, best = r[0], r[3], r
        elif r[2] > best[2]:
            best = r
    return sorted(map(repr, [*out, best] if best is not None else out))


def signals(kind, n, rng):
    value = 0.0
    for i in range(n):
        value = {"still": value, "drift": i * 0.25, "noise": rng.random() * 4, "walk": value + rng.choice([-0.5, 0, 0.5]), "steps": float(i // 37)}[kind]
        yield value


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_numbers_in_blocks(spark, bits):
    rng = random.Random(bits)
    kinds = ["still", "drift", "noise", "walk", "steps"]
    rows = [(k, i, float(rng.randrange(5)), v) for k in kinds for i, v in enumerate(signals(k, 211, rng))]
    rows += [(None, i, 1.0, 0.0) for i in range(3)] + [(f"one{i}", 0, 2.0, 9.0) for i in range(20)]
    df = spark.createDataFrame(rows, "s string, i int, b double, v double").repartition(5)
    got = FR.collapse_duplicates(df, "s", ["i"], "b", F.lit(True), "v", 1.7, bits)
    assert got.columns == df.columns
    assert sorted(repr(tuple(r)) for r in got.collect()) == by_hand(rows, 1.7, lambda a, b: abs(a - b))


def test_signatures_in_blocks(spark):
    """Signatures of another length, empty or null differ by 1; distances are l1_distance's."""
    rng = random.Random(5)
    rows = [("a", i, float(i % 7), [v, v / 3, rng.random() / 50]) for i, v in enumerate(signals("walk", 150, rng))]
    rows += [("b", i, 0.5, s) for i, s in enumerate([None, [], [1.0], [1.0, 2.0], [1.05, 2.0], None, None, [float("nan"), 1.0], [0.0, 1.0]])]
    df = spark.createDataFrame(rows, "s string, i int, b double, v array<double>")

    def apart(a, b):
        if not a or not b or len(a) != len(b):
            return 1.0
        d = sum(abs(x - y) for x, y in zip(a, b)) / len(a)
        return d if d == d else 9.0

    pair = spark.createDataFrame([([1.0, 2.0], [1.5, 2.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "x array<double>, y array<double>")
    assert [r[0] for r in pair.select(l1_distance(F.col("x"), F.col("y"))).collect()] == [0.25, 1.0, 1.0]
    for bits in (2, 16):
        got = FR.collapse_duplicates(df, "s", ["i"], "b", None, "v", 0.3, bits)
        assert sorted(repr(tuple(r)) for r in got.collect()) == by_hand(rows, 0.3, apart)


def test_repeated_rows_nulls_and_clashing_names(spark):
    """Repeated rows are frames of their own; null signatures differ from none as numbers;
    null sharpness is the least; columns may be named like the operator's own."""
    rows = [("a", 1, None, 0.0, 7), ("a", 1, None, 0.0, 7), ("a", 2, 1.0, None, 8), ("a", 3, 1.0, 5.0, 9), ("a", 3, 1.0, 5.0, 9)]
    df = spark.createDataFrame(rows, "s string, i int, b double, v double, _row int").withColumn("_anchor", F.lit(1)).withColumn("_f", F.lit("x"))
    got = FR.collapse_duplicates(df, "s", ["i"], "b", F.lit(True), "v", 1.0)
    assert got.columns == df.columns and sorted(r.i for r in got.collect()) == [2, 3]
    assert FR.collapse_duplicates(df.limit(0), "s", ["i"], "b", F.lit(True), "v", 1.0).count() == 0


def test_a_session_of_a_million_frames_ends(spark):
    """Half drifts steadily, so that chains of blocks never meet; half stands still."""
    n = 1_000_000
    value = F.when(F.col("id") < n // 2, F.col("id") * 0.125).otherwise(n / 16)
    df = spark.range(n).select(F.lit("a").alias("s"), F.col("id").alias("i"), (F.col("id") % 3).cast("double").alias("b"), value.alias("v"))
    begin = time.time()
    got = FR.collapse_duplicates(df, "s", ["i"], "b", F.lit(True), "v", 12.45).agg(F.count("*"), F.min("i"), F.max("i")).first()
    # the first of a run is 100 frames after that of the one before: drift over 12.45
    assert got[0] == n // 2 // 100 + 1 and time.time() - begin < 120


def test_a_block_is_walked_in_one_piece_by_whatever_join(spark):
    """Values that come in long plateaus, in sessions that begin and end within blocks."""
    rng = random.Random(7)
    rows = [(f"s{i // 4100}", i, float(rng.randrange(50)), v) for i, v in enumerate(v for _ in range(12_000) for v in [rng.expovariate(0.1)] * 10)]
    df = spark.createDataFrame(rows, "s string, i int, b double, v double").repartition(16)
    late = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10485760"}  # joins turn when they run
    for k, v in late.items():
        spark.conf.set(k, v)
    try:
        got = FR.collapse_duplicates(df, "s", ["i"], "b", F.lit(True), "v", 15.0, 14).collect()
    finally:
        for k in late:
            spark.conf.unset(k)
    assert sorted(repr(tuple(r)) for r in got) == by_hand(rows, 15.0, lambda a, b: abs(a - b))
