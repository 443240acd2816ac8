"""Claims of queries that wait for each other in one long chain."""

from __future__ import annotations

import time

from loomscape.operators import guided as GM


def test_a_chain_of_queries_is_no_chain_of_rounds(spark):
    """Query i wants train row i, which query i - 1 has as its second: 400 rounds of one each."""
    rows = [(p, i, i + k, 1.0 + k) for p in (1, 2) for i in range(400) for k in (0, 1)] + [(1, 900, 0, 5.0), (2, 901, 5000, 99.0)]
    df = spark.createDataFrame(rows, "pair long, query long, train long, distance double")
    began = time.time()
    got = sorted(map(tuple, GM.claim_in_order(df, "pair", "query", "train", "distance", 0.9, 50.0).collect()))
    assert got == [(p, i, i, 1.0) for p in (1, 2) for i in range(400)] and time.time() - began < 60
