"""Images, primitives, reconstruction, checkpoints and streams end to end."""

from __future__ import annotations

import numpy as np
import pytest

from loomscape.functions import features_np as N
from loomscape.functions import geometry_np as G
from loomscape.functions import splat_np as S
from loomscape.sources import photos, splt


def corners(seed=5, shift=0):
    rng = np.random.default_rng(seed)
    v = np.full((120, 160), 0.5)
    for _ in range(25):
        y, x, s = rng.integers(8, 100), rng.integers(8, 120), rng.integers(5, 14)
        v[y : y + s, x + shift : x + shift + s] = rng.uniform()
    return v


def test_scores():
    flat, checker = np.full((96, 96), 0.5), np.kron(np.indices((48, 48)).sum(0) % 2, np.ones((2, 2)))
    assert N.blur_score(checker) > 100 * max(N.blur_score(flat), 1e-9)
    for shape in ((64, 1), (1, 64), (1, 1), (2, 2)):
        assert N.blur_score(np.full(shape, 0.5)) == 0 and len(N.signature(np.full(shape, 0.5))) == 64


@pytest.mark.parametrize("kind", ["brief", "sift"])
def test_shifted_images_match(kind):
    from loomscape.functions.kernels import match

    a, b = N.extract(corners(), 200, kind), N.extract(corners(shift=12), 200, kind)
    assert len(a) > 20
    da, db = (np.stack([r["descriptor"] for r in x]).astype(np.int64) for x in (a, b))
    q, t, _ = match(da, db, 0.8 if kind == "brief" else 0.64, 80 if kind == "brief" else 120_000, True, kind == "brief")
    moved = [abs(b[j]["x"] - a[i]["x"] - 12) < 1.5 and abs(b[j]["y"] - a[i]["y"]) < 1.5 for i, j in zip(q, t, strict=True)]
    assert len(moved) > 15 and np.mean(moved) > 0.85


def test_brief_pattern_is_inside():
    p = N.brief_pattern()
    assert p.shape == (256, 4) and np.abs(p).max() <= 15 and not (p[:, :2] == p[:, 2:]).all(axis=1).any()


CAM, POSE = (60.0, 32.0, 24.0), (np.eye(3), np.zeros(3))


def cloud(*rows):
    return np.array([[x, y, z, s, s, s, 0, 0, 0, 1, o, *c] for x, y, z, s, o, c in rows], float)


def test_render_occludes_whatever_the_order():
    two = cloud((0, 0, 3, -1.5, 6, (1, 0, 0)), (0, 0, 5, -1, 6, (0, 1, 0)))
    a, b = S.render(two, POSE, CAM, 64, 48), S.render(two[::-1], POSE, CAM, 64, 48)
    assert np.allclose(a, b) and a[24, 32, 0] > 0.9 and a[24, 32, 1] < 0.1
    assert np.allclose(S.render(two[:0], POSE, CAM, 64, 48, 0.3), 0.3)


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(3)
    c = cloud((0.1, 0, 3, -1.2, 0.3, (0.8, 0.2, 0.1)), (-0.4, 0.2, 4, -1, 0.1, (0.1, 0.7, 0.3)), (0, 0, -3, -1, 1, (1, 1, 1)))
    image = rng.uniform(0, 1, (48, 64, 3))
    _, g, _ = S.loss_and_gradients(c, POSE, CAM, image)
    assert not g[2].any()
    for i, f in ((0, 0), (0, 2), (0, 3), (1, 10), (1, 12), (0, 11)):
        d = np.zeros_like(c)
        d[i, f] = 1e-4
        want = (S.loss(c + d, POSE, CAM, image) - S.loss(c - d, POSE, CAM, image)) / 2e-4
        assert abs(g[i, f] - want) <= 0.06 * abs(want) + 2e-6


def test_training_learns(spark):
    from loomscape.plans import training as T

    truth = cloud((0.2, 0, 3, -1.2, 2, (0.9, 0.2, 0.1)), (-0.5, 0.2, 4, -1, 2, (0.1, 0.8, 0.3)))
    poses = [(G.rotate(np.array([0, a, 0])), np.array([-3.5 * a, 0, 0])) for a in (-0.15, 0, 0.15)]
    views = T.view_table(spark, [T.View(*p, CAM, S.render(truth, p, CAM, 64, 48)) for p in poses])
    start = truth + np.array([0.05, -0.05, 0, 0.1, 0.1, 0.1, 0, 0, 0, 0, -1, 0, 0, 0])
    start[:, 11:] = 0.5
    rates = np.array([5e-3] * 3 + [1e-2] * 3 + [0] * 4 + [5e-2] + [3e-2] * 3)
    state, losses = T.train(spark, start, views, 25, rates)
    assert losses[-1] < 0.6 * losses[0]
    again, _ = T.train(spark, state.cloud, views, 2, rates, state=state)
    assert again.step == 27


def test_density_control():
    from loomscape.plans import training as T

    c = cloud((0, 0, 3, -6, 1, (1, 0, 0)), (1, 0, 3, -1.5, 1, (0, 1, 0)), (0, 1, 3, -3, -9, (0, 0, 1)), (0.5, 0.5, 3, -3, 1, (1, 1, 1)))
    state = T.State.begin(c)
    state.m += 1
    got = T.densify(state, np.array([3.0, 2.0, 0, 0]), T.extent(c), 0.5)
    assert got == {"cloned": 1, "split": 1, "pruned": 1} and len(state.cloud) == 5 and state.m.sum() == 2 * 14
    lone = T.State.begin(c[2:3])
    assert T.densify(lone, np.zeros(1), 1.0)["pruned"] == 0 and len(lone.cloud) == 1


def test_checkpoint(spark, tmp_path):
    rng = np.random.default_rng(0)
    c = rng.normal(size=(7, 14)).astype(np.float32)
    splt.write(c, 42, str(tmp_path / "x.splt"))
    back, iteration = splt.read(str(tmp_path / "x.splt"))
    assert (back == c).all() and iteration == 42
    data = splt.encode(c, 1)
    for bad in (b"abc", b"\0" * 16 + data[16:], data[:-8], data[:4] + b"\2\0\0\0" + data[8:]):
        with pytest.raises(splt.CheckpointError):
            splt.decode(bad)
    splt.register(spark)
    assert spark.read.format("splt").load(str(tmp_path / "x.splt")).count() == 7


def test_photo_folder(spark, tmp_path):
    rng = np.random.default_rng(1)
    for name in ("img_10", "img_1", "img_3", "img_2"):
        (tmp_path / f"{name}.png").write_bytes(photos.encode_png(rng.uniform(size=(40, 48, 3))))
    (tmp_path / "notes.txt").write_text("x")
    rows = photos.scan(spark, str(tmp_path))
    assert [r.name for r in rows.orderBy("frame_id").collect()] == ["img_1.png", "img_2.png", "img_3.png", "img_10.png"]
    assert sorted(r.frame_id for r in photos.score(rows).collect()) == [0, 1, 2, 3]
    for bad in (str(tmp_path / "none"), str(tmp_path / "notes.txt")):
        with pytest.raises(photos.SourceError):
            photos.scan(spark, bad)


def test_reconstruction(spark):
    from loomscape.plans.reconstruction import pair_matches, reconstruct

    rng = np.random.default_rng(8080)
    camera, n = (1000.0, 640.0, 360.0), 150
    p = np.stack([rng.uniform(-2, 2, n), rng.uniform(-1.2, 1.2, n), rng.uniform(5, 8, n)], axis=1)
    names = rng.integers(0, 256, (n, 32))
    rows, truth = [], []
    for f in range(5):
        pose = (G.rotate(np.array([0, 0.06 * f, 0])), np.array([-0.45 * f, 0.02 * f, 0]))
        truth.append(pose)
        q = p @ pose[0].T + pose[1]
        for k, (u, v) in enumerate(q[:, :2] / q[:, 2:] * 1000 + np.array([640, 360])):
            rows.append((f, k, float(u), float(v), names[k].tolist()))
    t = spark.createDataFrame(rows, "frame_id long, kp_id long, x double, y double, descriptor array<smallint>")
    m = pair_matches(t, 3)
    got = reconstruct(t.repartition(5), m, camera)
    assert len(got.poses) == 5 and len(got.points) > 100 and got.rmse < 0.5
    turn = got.poses[4][0] @ got.poses[0][0].T
    want = truth[4][0] @ truth[0][0].T
    assert np.degrees(np.arccos(np.clip((np.trace(turn.T @ want) - 1) / 2, -1, 1))) < 0.1


def test_keyframe_stream(spark, tmp_path):
    from loomscape.streaming.keyframes import keyframes

    frames = [(0.006 * i, float(i % 4)) for i in range(20)]
    schema = "session long, frame_id long, blur double, signature array<double>"
    batches = [[(1, i, b, [s, s, s, s]) for i, (s, b) in enumerate(frames)][:11], [(1, i, b, [s, s, s, s]) for i, (s, b) in enumerate(frames)][11:] + [(1, None, None, None)], [(1, 100, 1.0, [5.0] * 4)]]
    got = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = keyframes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        got = sorted(r.frame_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want, anchor, run = [], None, []
    for i, (s, b) in enumerate(frames):  # the runs by hand
        if anchor is None or s - anchor >= 0.01:
            want += [max(run, key=lambda x: (x[1], -x[0]))[0]] if run else []
            anchor, run = s, []
        run.append((i, b))
    want.append(max(run, key=lambda x: (x[1], -x[0]))[0])  # the session was ended; the next one has not
    assert got == want and len(want) == 10

