"""Training on tables: gradients, durable states, resets; selection verdicts and overlays."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomscape.functions import geometry as G
from loomscape.operators import optimizer as O  # noqa: E741
from loomscape.operators import splats as S
from loomscape.plans import table_training as T
from loomscape.sources.generations import commit, generations, latest

def camera():
    return G.lit(1, 0, 0, 0, 1, 0, 0, 0, 1), G.lit(0, 0, 0), 20.0, 8.0, 6.0, 16, 12


NAMES = "splat_id long, px double, py double, pz double, sx double, sy double, sz double, qx double, qy double, qz double, qw double, logit double, r double, g double, b double"


def cloud(spark, seed=1, n=8):
    rng = np.random.default_rng(seed)
    rows = [(k, *rng.uniform(-0.8, 0.8, 2).tolist(), float(rng.uniform(2, 5)), *rng.uniform(-2.2, -1.2, 3).tolist(), *rng.normal(size=4).tolist(), float(rng.uniform(-1, 1.5)), *rng.uniform(0.1, 0.9, 3).tolist()) for k in range(n)]
    return spark.createDataFrame(rows, NAMES)


def seen(splats):
    return S.visible(S.project(splats, *camera()[:2], F.lit(20.0), F.lit(8.0), F.lit(6.0)), 16, 12)


def picture(splats, background=(0.0, 0.0, 0.0)):
    return {(r.x, r.y): (r.r, r.g, r.b) for r in S.render(seen(splats), 16, 12, ["r", "g", "b"], list(background)).collect()}


def target(spark):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(x, y, *rng.random(3).tolist()) for x in range(16) for y in range(12)], "x int, y int, t_r double, t_g double, t_b double")


def test_gradients_agree_with_differences(spark):
    goal, background = target(spark), (0.1, 0.2, 0.3)
    want = {(r.x, r.y): (r.t_r, r.t_g, r.t_b) for r in goal.collect()}
    loss = lambda splats: sum(abs(a - b) for at, p in picture(splats, background).items() for a, b in zip(p, want[at], strict=True)) / (192 * 3)
    splats = cloud(spark)
    got = {r.splat_id: r for r in S.image_gradients(seen(splats), goal, 192, 16, 12, ["r", "g", "b"], list(background)).collect()}
    assert abs(sum(r.loss for r in got.values()) - loss(splats)) < 1e-9
    for splat, name in ((0, "r"), (3, "b"), (1, "logit"), (5, "logit")):
        moved = [splats.withColumn(name, F.col(name) + F.when(F.col("splat_id") == splat, d).otherwise(0.0)) for d in (1e-5, -1e-5)]
        slope = (loss(moved[0]) - loss(moved[1])) / 2e-5
        assert abs(got[splat][f"d_{name}"] - slope) <= 0.02 * abs(slope) + 1e-6


class Killed(Exception):
    pass


def test_killed_training_goes_on_as_if_it_had_not_been(spark, tmp_path):
    goal = spark.createDataFrame([(x, y, *c) for (x, y), c in picture(cloud(spark)).items()], "x int, y int, t_r double, t_g double, t_b double")
    start = cloud(spark).withColumns({c: F.lit(0.5) for c in "rgb"})
    rates = {"r": 0.05, "g": 0.05, "b": 0.05, "logit": 0.02}
    view = T.view_gradients(goal, 192, *camera())
    order = lambda df: sorted(tuple(r) for r in df.select("splat_id", *rates, *(f"{k}_{p}" for p in rates for k in "mv")).collect())
    options = {"every": 2, "reset_every": 2, "reset_end": 2}

    steps, whole = T.train_tables(start, view, rates, 4, str(tmp_path / "one"), **options)

    def dies(splats, step):
        if step == 4 and dies.alive:
            dies.alive = False
            raise Killed
        return view(splats, step)

    dies.alive = True
    with pytest.raises(Killed):
        T.train_tables(start, dies, rates, 4, str(tmp_path / "two"), **options)
    assert latest(spark, str(tmp_path / "two"))[0] == 2
    again, resumed = T.train_tables(start, dies, rates, 4, str(tmp_path / "two"), **options)
    assert steps == again == 4
    for a, b in zip(order(whole), order(resumed), strict=True):
        assert np.allclose(a, b, atol=1e-12)
    before = S.image_gradients(seen(start), goal, 192, 16, 12, ["r", "g", "b"], [0.0] * 3).agg(F.sum("loss")).first()[0]
    _, learned = T.train_tables(start, view, rates, 3, str(tmp_path / "three"))
    after = S.image_gradients(seen(learned), goal, 192, 16, 12, ["r", "g", "b"], [0.0] * 3).agg(F.sum("loss")).first()[0]
    assert after < before and T.train_tables(start, dies, rates, 4, str(tmp_path / "two"), **options)[0] == 4


def test_half_a_version_is_none(spark, tmp_path):
    folder = str(tmp_path / "v")
    assert latest(spark, folder) is None
    for k in (1, 2, 3):
        commit(spark.range(k), folder, k)
    assert [s for s, _ in generations(spark, folder)] == [3, 2]
    (tmp_path / "v" / "step-000000000009-0123456789ab").mkdir()  # a writer that died
    step, df = latest(spark, folder)
    assert step == 3 and df.count() == 3


def test_reset_clears_the_moments(spark):
    df = spark.createDataFrame([(1, 3.0, 0.5, 0.2, 7.0), (2, -9.0, 0.1, 0.1, 8.0)], "splat_id long, logit double, m_logit double, v_logit double, m_r double")
    got = {r.splat_id: r for r in O.reset_opacities(df).collect()}
    assert abs(got[1].logit - np.log(0.01 / 0.99)) < 1e-12 and got[2].logit == -9.0
    assert all(r.m_logit == r.v_logit == 0 and r.m_r >= 7 for r in got.values())


def test_verdicts_cover_every_frame_once(spark):
    from loomscape.operators import frames as FR

    rng = np.random.default_rng(2)
    rows = [(k, k % 3, k, float(rng.uniform(0, 100))) for k in range(200)]
    df = spark.createDataFrame(rows, "event_id int, user_id int, ts int, value double")
    args = ("user_id", "event_id", ["ts"], "value", "value", F.lit(True), 0.4, 15, 10)
    got = FR.selection_verdicts(df, *args).collect()
    assert sorted(r.event_id for r in got) == list(range(200))
    chosen = FR.select_frames(df, "user_id", ["ts"], "value", "value", F.lit(True), 0.4, 15, 10).collect()
    assert {r.event_id for r in got if r.verdict == "selected"} == {r.event_id for r in chosen}
    for r in FR.reject_counters(FR.selection_verdicts(df, *args), "user_id").collect():
        assert r.total == r.selected + r.rejected_blurry + r.rejected_duplicate + r.rejected_over_budget
    assert FR.reject_counters(FR.selection_verdicts(df.where("false"), *args), "user_id").count() == 0


def test_overlay_takes_the_first_images(spark):
    from loomscape.operators import pixels as P

    rows = [(i, x, 0, float(x if i % 80 else 0)) for i in range(0, 400, 20) for x in range(3)]
    got = P.overlay(spark.createDataFrame(rows, "image int, x int, y int, response double"), "image", 520).collect()
    assert {r.image for r in got} == {0, 40, 80, 120, 160, 200} and all(r.radius == 4.0 and r.line == 2.0 for r in got)
    colour = {(r.image, r.x): (r.red, r.blue) for r in got}
    assert np.allclose(colour[40, 2], (1.0, 0.1)) and np.allclose(colour[80, 2], (0.2, 1.0))
