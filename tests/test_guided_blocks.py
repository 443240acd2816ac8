"""Guided matches of blocks and lists against one query after another."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest

from loomscape.functions import kernels
from loomscape.operators import guided as GM

SCHEMA = "pair long, {} long, {}, v array<long>"


def one_by_one(lines, points, reach, ratio, ceiling):
    out = []
    for pair in sorted({x[0] for x in lines}):
        taken = set()
        for query in sorted({x[1] for x in lines if x[0] == pair}):
            found = []
            for _, _, a, b, c, v in (x for x in lines if x[:2] == (pair, query)):
                norm = math.sqrt(a * a + b * b)
                for p, train, x, y, w in points:
                    if p == pair and train not in taken and norm > 1e-12 and abs(a * x + b * y + c) / norm < reach:
                        found.append((float(sum((i - j) ** 2 for i, j in zip(v, w, strict=True) if i is not None and j is not None)), train))
            found.sort()
            if found and found[0][0] <= ceiling and (len(found) < 2 or found[0][0] < ratio * found[1][0]):
                taken.add(found[0][1])
                out.append((pair, query, found[0][1], found[0][0]))
    return out


def matched(spark, lines, points, *args, **kw):
    q = spark.createDataFrame(lines, SCHEMA.format("query", "la double, lb double, lc double"))
    t = spark.createDataFrame(points, SCHEMA.format("train", "x double, y double"))
    return sorted(map(tuple, GM.guided_matches(q, t, "pair", *args, **kw).collect()))


@pytest.mark.parametrize("keep,high,ceiling", [(1, 4, 60.0), (2, 4, float("inf")), (3, 400, 5e4), (8, 3, 8.0)])
def test_same_as_one_by_one(spark, keep, high, ceiling):
    """Short lists and few values: claims use lists up, distances are equal; some ids stand
    twice, some lines have no direction, some components are null."""
    rng = np.random.default_rng(keep)
    v = lambda: [int(x) if rng.random() < 0.97 else None for x in rng.integers(-high, high, 5)]
    lines = [(p, int(rng.integers(120)) - 9, *((0.0, 0.0) if i % 29 == 0 else rng.normal(size=2).tolist()), float(rng.normal() / 5), v()) for p in (1, 2, 4) for i in range(100)]
    points = [(p, int(rng.integers(90)) + (1 << 60), *rng.normal(size=2).tolist(), v()) for p in (1, 2, 3) for _ in range(80)]
    want = one_by_one(lines, points, 0.5, 0.9, ceiling)
    assert len(want) > 20 and matched(spark, lines, points, 0.5, 0.9, ceiling, block=16, keep=keep) == want
    assert matched(spark, lines, points, 0.5, 0.9, ceiling, keep=keep) == want


def test_a_chain_uses_lists_up(spark):
    """All queries want the same train rows, and each takes the nearest that is left."""
    lines = [(1, i, 1.0, 0.0, 0.0, [0]) for i in range(300)]
    points = [(1, i, 0.0, 0.0, [2**i if i < 40 else 2**40 + i]) for i in range(60)]
    want = one_by_one(lines, points, 0.1, 0.9, float("inf"))
    assert len(want) > 39 and matched(spark, lines, points, 0.1, 0.9, keep=4) == want


def test_all_pairs_in_the_band(spark):
    """25 million pairs in one band, which were rows of a table before."""
    n = 5000
    rng = np.random.default_rng(1)
    v = rng.integers(-255, 256, (n, 16))
    w = v + rng.integers(-9, 10, v.shape)
    lines = [(1, i, 1.0, 0.0, 0.0, x) for i, x in enumerate(v.tolist())]
    points = [(1, i, 0.0, 0.0, x) for i, x in enumerate(w.tolist())]
    began = time.time()
    got = matched(spark, lines, points, 0.1, 0.9, 1e6, block=1024)
    assert [x[:3] for x in got] == [(1, i, i) for i in range(n)] and time.time() - began < 90


def test_no_rows(spark):
    some = [(1, 1, 1.0, 0.0, 0.0, [1])], [(2, 1, 0.0, 0.0, [1])]
    assert matched(spark, *some, 0.1) == matched(spark, [], some[1], 0.1) == matched(spark, some[0], [], 0.1) == []


def test_vectors_with_gaps_as_sql(spark, tmp_path):
    """Short vectors and null elements, which had no match before."""
    import duckdb

    from loomscape.plans import solver_catalog as S

    table = f"(SELECT * REPLACE (CASE WHEN vec_id % 5 = 0 THEN embedding[1:40] WHEN vec_id % 7 = 0 THEN list_concat(embedding[1:9], [NULL], embedding[11:64]) ELSE embedding END::FLOAT[] AS embedding) FROM '/root/testdata/sf0.01/embeddings.parquet')"
    duckdb.sql(f"COPY {table} TO '{tmp_path}/embeddings.parquet'")
    sql = S._CLAIMS.replace("FROM embeddings)", f"FROM '{tmp_path}/embeddings.parquet')")
    con = duckdb.connect()
    want = sorted(con.sql(sql).fetchall())
    assert sorted(map(tuple, S.guided_greedy_match(spark, str(tmp_path)).collect())) == want and want


@pytest.mark.parametrize("share", [0.05, 0.9])
def test_least_entries_by_row(share):
    rng = np.random.default_rng(2)
    for top in (3, 1 << 52):
        d, near, limit = rng.integers(0, top, (50, 300)).astype(float), rng.random((50, 300)) < share, top * 0.8
        at, least, many = kernels.least_by_row(d, near, limit, 4)
        held = np.where(near & (d <= limit), d, np.inf)
        want = np.argsort(held, axis=1, kind="stable")[:, :4]
        there = np.isfinite(np.take_along_axis(held, want, 1))
        assert at.tolist() == want[there].tolist() and least.tolist() == np.take_along_axis(held, want, 1)[there].tolist()
        assert many.tolist() == np.isfinite(held).sum(axis=1).tolist()
