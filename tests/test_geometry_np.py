"""Numeric kernels on scenes of known truth."""

from __future__ import annotations

import numpy as np

from loomscape.functions import geometry_np as N

CAM = (1200.0, 960.0, 540.0)


def scene(n, degrees, shift, seed):
    rng = np.random.default_rng(seed)
    p = np.stack([rng.uniform(-2, 2, n), rng.uniform(-1.5, 1.5, n), rng.uniform(4, 9, n)], axis=1)
    return p, (N.rotate(np.array([0, np.radians(degrees), 0])), np.array(shift, float))


def view(p, pose):
    q = p @ pose[0].T + pose[1]
    return q[:, :2] / q[:, 2:] * CAM[0] + np.array(CAM[1:])


def degrees_between(a, b):
    return np.degrees(np.arccos(np.clip((np.trace(a.T @ b) - 1) / 2, -1, 1)))


HOME = (np.eye(3), np.zeros(3))


def test_splitmix_reference_values():
    s = N.SplitMix(1234567)
    assert [s.next() for _ in range(3)] == [6457827717110365317, 3203168211198807973, 9817491932198370423]


def test_small_algebra():
    assert np.allclose(np.linalg.eigh(np.array([[2, 1, 0], [1, 2, 0], [0, 0, 3.0]]))[0], [1, 3, 3])
    u, s, vt = N.svd3(np.diag([3.0, 2.0, 1e-12]))
    assert s[2] == 0 and np.allclose(u @ np.diag(s) @ vt, np.diag([3.0, 2.0, 0]), atol=1e-9)
    r = N.rotate(np.array([0.1, -0.4, 0.3]))
    assert np.allclose(N.nearest_rotation(2.5 * r), r)
    assert N.solve_spd(np.array([[1.0, 2], [2, 1]]), np.ones(2)) is None
    assert np.allclose(N.solve_spd(np.array([[4.0, 1], [1, 3]]), np.array([1.0, 2])), np.linalg.solve([[4, 1], [1, 3]], [1, 2]))


def test_two_views_and_outliers():
    p, pose = scene(140, 8, (0.6, 0.05, 0), 42)
    a, b = view(p, HOME), view(p, pose)
    got = N.two_view(a, b, CAM, CAM)
    assert degrees_between(got.rotation, pose[0]) < 0.5 and len(got.inliers) > 100
    assert got.shift @ pose[1] / np.linalg.norm(pose[1]) > np.cos(np.radians(1))
    rng = np.random.default_rng(1)
    b[::4] = rng.uniform(0, 1000, b[::4].shape)
    got = N.two_view(a, b, CAM, CAM)
    assert degrees_between(got.rotation, pose[0]) < 1 and len(got.inliers) > 70
    assert N.two_view(a[:5], b[:5], CAM, CAM) is None


def test_focal_asymmetry_is_least_at_the_truth():
    p, pose = scene(160, 10, (0.8, 0.1, 0.2), 7)
    f, inside = N.fundamental(view(p, HOME), view(p, pose))
    assert inside.sum() > 120
    f = N.eight_points(view(p, HOME), view(p, pose), None)
    scores = {m: N.asymmetry(f, (CAM[0] * m, *CAM[1:])) for m in (0.6, 0.8, 1.0, 1.25, 1.6)}
    assert min(scores, key=scores.get) == 1.0


def test_pose_from_points():
    p, pose = scene(60, 20, (0.3, -0.2, 0.5), 31)
    uv = view(p, pose)
    r, t, _ = N.pnp(p, uv, CAM)
    assert degrees_between(r, pose[0]) < 0.01 and np.allclose(t, pose[1], atol=1e-3)
    rng = np.random.default_rng(2)
    uv[:18] = rng.uniform(0, 1000, (18, 2))
    r, _, inside = N.pnp(p, uv, CAM)
    assert degrees_between(r, pose[0]) < 0.5 and len(inside) >= 40
    assert N.pnp(p[:3], uv[:3], CAM) is None


def test_bundle_adjustment():
    p, pose = scene(100, 8, (0.6, 0.05, 0), 2024)
    third = (N.rotate(np.array([0, np.radians(15), 0])), np.array([1.1, 0.0, 0.1]))
    poses = [HOME, pose, third]
    cam, pt = np.repeat(np.arange(3), 100), np.tile(np.arange(100), 3)
    uv = np.concatenate([view(p, x) for x in poses])
    rng = np.random.default_rng(555)
    start = [HOME] + [(N.rotate(np.array([0.01, -0.015, 0.008])) @ r, t + 0.02) for r, t in poses[1:]]
    got, _, rmse = N.bundle_adjust(start, p + rng.normal(0, 0.05, p.shape), cam, pt, uv, [CAM] * 3)
    assert rmse < 0.05 and np.allclose(got[0][0], np.eye(3)) and np.allclose(got[0][1], 0)
