"""Streams that are stopped and go on; jobs that are cancelled by tag."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from loomscape.streaming.control import Progress, cancel, paced_files, tagged


def test_stop_and_restart_lose_nothing(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.range(60).repartition(6).write.parquet(source)
    seen = Progress()
    spark.streams.addListener(seen)
    try:

        def start(**trigger):
            stream = paced_files(spark, source, "id long").writeStream.format("parquet")
            return stream.option("path", out).option("checkpointLocation", state).trigger(**trigger).start()

        query = start(processingTime="1 second")
        until = time.time() + 60
        while time.time() < until and not (query.lastProgress and query.lastProgress["batchId"] >= 1):
            time.sleep(0.1)
        query.stop()
        early = spark.read.schema("id long").parquet(out).count()
        assert 0 < early < 60  # paced: not all at once
        again = start(availableNow=True)
        assert again.awaitTermination(90)
        assert again.id == query.id
        assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(60))
        until = time.time() + 30
        while time.time() < until and seen.ended.get(str(query.id)) is None:
            time.sleep(0.1)
        assert seen.batches[str(query.id)] >= 2
        assert seen.ended[str(query.id)] == ""
    finally:
        spark.streams.removeListener(seen)


def test_cancel_by_tag(spark):
    sc, errors = spark.sparkContext, []

    def run():
        with tagged(sc, "to-go"):
            try:
                spark.range(0, 1 << 44, 1, 8).select(F.sum(F.xxhash64("id").cast("double"))).collect()
            except Exception as e:  # noqa: BLE001
                errors.append(str(e))

    job = threading.Thread(target=run, daemon=True)
    job.start()
    until = time.time() + 60
    while job.is_alive() and time.time() < until:
        time.sleep(1)
        cancel(sc, "to-go")
    job.join(10)
    assert len(errors) == 1 and "cancel" in errors[0].lower()
    assert spark.range(5).count() == 5  # what isn't tagged goes on


def test_tags_are_checked(spark):
    with pytest.raises(Exception), tagged(spark.sparkContext, "a,b"):
        pass


def test_idle_sessions_give_their_last_run(spark, tmp_path):
    from loomscape.streaming.keyframes import keyframes

    schema = "session long, frame_id long, blur double, signature array<double>"
    rows = [(1, 0, 0.2, [0.0]), (1, 1, 0.9, [0.0]), (1, 2, 0.5, [0.5]), (2, 0, 0.4, [0.1]), (3, None, None, None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    frames = keyframes(paced_files(spark, str(tmp_path / "in"), schema), idle=2.0)
    query = frames.writeStream.format("memory").queryName("idle_runs").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("idle_runs").count() < 3:
            assert query.exception() is None
            time.sleep(0.5)
        found = sorted(tuple(r) for r in spark.table("idle_runs").collect())
    finally:
        query.stop()
    assert found == [(1, 1, 0.9), (1, 2, 0.5), (2, 0, 0.4)]
