"""Registered queries against their SQL."""

from __future__ import annotations

import pytest
from oracle import compare

import loomscape.plans.solver_catalog  # noqa: F401
from loomscape.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert compare(spark, SMALL, name) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["event_id", "user_id", "value"] and df.count() > 0


def test_greedy_claims_are_one_to_one(spark):
    rows = catalog.QUERIES["guided_greedy_match"](spark, SMALL).collect()
    assert rows and len({r.a for r in rows}) == len(rows) == len({r.b for r in rows})


def test_order_of_rows_does_not_matter(spark):
    from pyspark.sql import functions as F

    from loomscape.operators import frames as FR

    events = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "user_id", "ts", "value")
    args = ("user_id", catalog.ORDER, "value", "value", F.lit(True), 0.4, 15, 10)
    one = sorted(FR.select_frames(events, *args).collect())
    assert one == sorted(FR.select_frames(events.repartition(7).orderBy(F.rand(3)), *args).collect())


def test_empty_frames(spark):
    from pyspark.sql import functions as F

    from loomscape.operators import frames as FR

    events = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "user_id", "ts", "value").where("false")
    assert FR.select_frames(events, "user_id", catalog.ORDER, "value", "value", F.lit(True)).count() == 0
