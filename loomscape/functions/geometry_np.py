"""Multi-view geometry in numpy: robust fits, triangulation, bundle adjustment.

Poses take world to camera: x = r @ p + t; +y is down and +z ahead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class SplitMix:
    """The published SplitMix64 generator."""

    def __init__(self, seed: int):
        self.state = seed & (2**64 - 1)

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) % 2**64
        z = self.state
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
        return z ^ (z >> 31)

    def uniform(self) -> float:
        return (self.next() >> 40) / (1 << 24)

    def normal(self) -> float:
        u = max(self.uniform(), 1e-7)
        return float(np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * self.uniform()))

    def sample(self, n: int, k: int) -> np.ndarray:
        """k different numbers below n, ascending."""
        got: set[int] = set()
        while len(got) < k:
            got.add(self.next() % n)
        return np.array(sorted(got))


def null_vector(rows: np.ndarray) -> np.ndarray:
    return np.linalg.eigh(rows.T @ rows)[1][:, 0]


def svd3(a: np.ndarray, relative: float = 1e-7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, s, vt of a 3 x 3 matrix; singular values that are nothing beside the first are 0."""
    u, s, vt = np.linalg.svd(a)
    return u, np.where(s > relative * max(s[0], 1e-300), s, 0.0), vt


def nearest_rotation(a: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(a)
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt


def solve_spd(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    try:
        low = np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        return None
    return np.linalg.solve(low.T, np.linalg.solve(low, b))


def rotate(omega: np.ndarray) -> np.ndarray:
    """The rotation by an axis-angle vector."""
    angle = np.linalg.norm(omega)
    if angle < 1e-12:
        return np.eye(3)
    x, y, z = omega / angle
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def hartley(points: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Points about their centroid at a mean distance of the root of their dimension, and the map."""
    d = points.shape[1]
    mid = points.mean(axis=0)
    far = np.linalg.norm(points - mid, axis=1).mean()
    if far < 1e-12:
        return None
    s = np.sqrt(d) / far
    m = np.eye(d + 1) * s
    m[:d, d], m[d, d] = -s * mid, 1
    return (points - mid) * s, m


def homogeneous(p: np.ndarray) -> np.ndarray:
    return np.concatenate([p, np.ones((len(p), 1))], axis=1)


def eight_points(a: np.ndarray, b: np.ndarray, singular: tuple[float, ...] | None = (1.0, 1.0, 0.0)) -> np.ndarray | None:
    """The epipolar matrix of eight pairs or more; with the given singular values, or of rank 2."""
    na, nb = hartley(a), hartley(b)
    if na is None or nb is None or len(a) < 8:
        return None
    (x, ma), (y, mb) = na, nb
    rows = (homogeneous(y)[:, :, None] * homogeneous(x)[:, None, :]).reshape(len(x), 9)
    e = mb.T @ null_vector(rows).reshape(3, 3) @ ma
    u, s, vt = np.linalg.svd(e)
    return u @ np.diag(singular if singular else (s[0], s[1], 0.0)) @ vt


def sampson(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = homogeneous(a), homogeneous(b)
    forth, back = x @ e.T, y @ e
    norm = forth[:, 0] ** 2 + forth[:, 1] ** 2 + back[:, 0] ** 2 + back[:, 1] ** 2
    off = (y * forth).sum(axis=1)
    return np.where(norm > 1e-18, off * off / np.maximum(norm, 1e-18), np.inf)


def ransac(n: int, k: int, fit, cost, bound: float, rounds: int, seed: int, sure: float | None = 0.9999) -> tuple[object, np.ndarray] | None:
    """The model of most inliers over samples of k, and its inliers. sure ends the rounds
    early, once a clean sample has been met with that chance (20 rounds at least)."""
    if n < k:
        return None
    draw, best, most, need, done = SplitMix(seed), None, k - 1, rounds, 0
    while done < need:
        done += 1
        model = fit(draw.sample(n, k))
        if model is None:
            continue
        inside = cost(model) < bound
        if inside.sum() > most:
            best, most = (model, inside), int(inside.sum())
            if sure:
                clean = (most / n) ** k
                need = min(rounds, max(20, int(np.ceil(np.log(1 - sure) / np.log(1 - clean)))) if clean < 1 else 20)
    return best


def triangulate(a: np.ndarray, b: np.ndarray, first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Points from normalised pairs; NaN where they meet nowhere."""
    p, q = (np.concatenate([r, t[:, None]], axis=1) for r, t in (first, second))
    rows = np.stack([a[:, :1] * p[2] - p[0], a[:, 1:] * p[2] - p[1], b[:, :1] * q[2] - q[0], b[:, 1:] * q[2] - q[1]], axis=1)
    h = np.linalg.svd(rows)[2][:, 3]
    w = h[:, 3:]
    return np.where(np.abs(w) > 1e-12, h[:, :3] / np.where(np.abs(w) > 1e-12, w, 1.0), np.nan)


def ray_angles(points: np.ndarray, first, second) -> np.ndarray:
    ca, cb = -first[0].T @ first[1], -second[0].T @ second[1]
    a, b = points - ca, points - cb
    n = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    return np.where(n > 1e-24, np.degrees(np.arccos(np.clip((a * b).sum(axis=1) / np.maximum(n, 1e-24), -1, 1))), 0.0)


@dataclass
class TwoView:
    rotation: np.ndarray
    shift: np.ndarray
    points: np.ndarray
    inliers: np.ndarray


def pose_of(e: np.ndarray, a: np.ndarray, b: np.ndarray, least_angle: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Of the four poses that an essential matrix allows the one with most points before
    both views at a fair angle."""
    u, _, vt = np.linalg.svd(e)
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    best, most, home = None, 0, (np.eye(3), np.zeros(3))
    for r in (u @ w @ vt, u @ w.T @ vt):
        r = r * np.sign(np.linalg.det(r))
        for t in (u[:, 2], -u[:, 2]):
            p = triangulate(a, b, home, (r, t))
            ok = (p[:, 2] > 0) & ((p @ r.T + t)[:, 2] > 0) & (ray_angles(p, home, (r, t)) >= least_angle)
            if ok.sum() > most:
                best, most = (r, t, p, ok), int(ok.sum())
    return best


def two_view(pixels_a: np.ndarray, pixels_b: np.ndarray, camera_a, camera_b, bound: float = 2.0, rounds: int = 2000, seed: int = 0x9E3779B97F4A7C15) -> TwoView | None:
    """Relative pose from matched pixels; cameras are (focal, cx, cy)."""
    a, b = ((np.asarray(p, float) - c[1:]) / c[0] for p, c in ((pixels_a, np.array(camera_a)), (pixels_b, np.array(camera_b))))
    limit = (bound / ((camera_a[0] + camera_b[0]) / 2)) ** 2
    got = ransac(len(a), 8, lambda s: eight_points(a[s], b[s]), lambda e: sampson(e, a, b), limit, rounds, seed)
    if got is None:
        return None
    e, inside = got
    again = eight_points(a[inside], b[inside])
    if again is not None and (sampson(again, a, b) < limit).sum() >= inside.sum():
        e, inside = again, sampson(again, a, b) < limit
    at = np.flatnonzero(inside)
    pose = pose_of(e, a[at], b[at])
    if pose is None:
        return None
    r, t, p, ok = pose
    return TwoView(r, t, p[ok], at[ok])


def fundamental(pixels_a: np.ndarray, pixels_b: np.ndarray, bound: float = 2.0, rounds: int = 800, seed: int = 0x2545F4914F6CDD1D):
    """Rank-2 epipolar matrix of pixels and its inliers."""
    a, b = np.asarray(pixels_a, float), np.asarray(pixels_b, float)
    return ransac(len(a), 8, lambda s: eight_points(a[s], b[s], None), lambda f: sampson(f, a, b), bound * bound, rounds, seed, None)


def asymmetry(f: np.ndarray, camera) -> float:
    """How far a calibrated epipolar matrix is from having two equal singular values."""
    k = np.array([[camera[0], 0, camera[1]], [0, camera[0], camera[2]], [0, 0, 1.0]])
    s = np.linalg.svd(k.T @ f @ k)[1]
    return float((s[0] - s[1]) / (s[0] + s[1]))


def pose_from_points(world: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Linear pose from six points or more in normalised coordinates."""
    nw, ns = hartley(world), hartley(seen)
    if nw is None or ns is None or len(world) < 6:
        return None
    (x, mw), (y, ms) = nw, ns
    h = homogeneous(x)
    zero = np.zeros_like(h)
    rows = np.concatenate([np.concatenate([h, zero, -y[:, :1] * h], 1), np.concatenate([zero, h, -y[:, 1:] * h], 1)])
    p = np.linalg.inv(ms) @ null_vector(rows).reshape(3, 4) @ mw
    if np.median((homogeneous(world) @ p[2])) < 0:
        p = -p
    scale = np.linalg.svd(p[:, :3])[1].mean()
    if scale < 1e-12:
        return None
    return nearest_rotation(p[:, :3]), p[:, 3] / scale


def pnp(world: np.ndarray, pixels: np.ndarray, camera, bound: float = 8.0, rounds: int = 2000, least: int = 8, seed: int = 0x51ED270B) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Pose of a camera from points and pixels, with its inliers."""
    world, pixels, c = np.asarray(world, float), np.asarray(pixels, float), np.array(camera)
    seen = (pixels - c[1:]) / c[0]

    def off(pose):
        q = world @ pose[0].T + pose[1]
        ok = q[:, 2] > 1e-9
        d = np.linalg.norm(q[:, :2] / np.where(ok, q[:, 2], 1.0)[:, None] * c[0] + c[1:] - pixels, axis=1)
        return np.where(ok, d, np.inf)

    got = ransac(len(world), 6, lambda s: pose_from_points(world[s], seen[s]), off, bound, rounds, seed)
    if got is None or got[1].sum() < least:
        return None
    pose, inside = got
    again = pose_from_points(world[inside], seen[inside])
    if again is not None and (off(again) < bound).sum() >= inside.sum():
        pose, inside = again, off(again) < bound
    return pose[0], pose[1], np.flatnonzero(inside)


def bundle_adjust(poses: list[tuple[np.ndarray, np.ndarray]], points: np.ndarray, cam: np.ndarray, pt: np.ndarray, pixels: np.ndarray, cameras: list, rounds: int = 60) -> tuple[list, np.ndarray, float]:
    """Damped least squares over poses and points; the first pose stays. Points are
    eliminated block by block, so that only a system of cameras is solved."""
    focal = np.array([c[0] for c in cameras])
    mid = np.array([c[1:] for c in cameras])
    points, damp, n_cam, n_pt = points.copy(), 1e-4, len(poses), len(points)

    def error(ps, xs):
        r, t = np.stack([p[0] for p in ps])[cam], np.stack([p[1] for p in ps])[cam]
        q = np.einsum("nij,nj->ni", r, xs[pt]) + t
        z = np.where(np.abs(q[:, 2]) > 1e-9, q[:, 2], 1e-9)
        return q, q[:, :2] / z[:, None] * focal[cam][:, None] + mid[cam] - pixels

    q, e = error(poses, points)
    cost = (e * e).sum()
    for _ in range(rounds):
        z = q[:, 2]
        f = focal[cam] / z
        d = np.zeros((len(cam), 2, 3))
        d[:, 0, 0] = d[:, 1, 1] = f
        d[:, 0, 2], d[:, 1, 2] = -f * q[:, 0] / z, -f * q[:, 1] / z
        r = np.stack([p[0] for p in poses])[cam]
        moved = q - np.stack([p[1] for p in poses])[cam]
        skew = np.zeros((len(cam), 3, 3))
        skew[:, 0, 1], skew[:, 0, 2], skew[:, 1, 2] = moved[:, 2], -moved[:, 1], moved[:, 0]
        skew[:, 1, 0], skew[:, 2, 0], skew[:, 2, 1] = -moved[:, 2], moved[:, 1], -moved[:, 0]
        jc = np.concatenate([d @ skew, d], axis=2)
        jp = d @ r
        u, v = np.zeros((n_cam, 6, 6)), np.zeros((n_pt, 3, 3))
        gc, gp = np.zeros((n_cam, 6)), np.zeros((n_pt, 3))
        np.add.at(u, cam, np.einsum("nki,nkj->nij", jc, jc))
        np.add.at(v, pt, np.einsum("nki,nkj->nij", jp, jp))
        np.add.at(gc, cam, np.einsum("nki,nk->ni", jc, e))
        np.add.at(gp, pt, np.einsum("nki,nk->ni", jp, e))
        w = np.zeros((n_pt, n_cam, 6, 3))
        np.add.at(w, (pt, cam), np.einsum("nki,nkj->nij", jc, jp))
        better = False
        for _ in range(8):
            vi = np.linalg.inv(v * (1 + damp * np.eye(3)) + 1e-12 * np.eye(3))
            wv = np.einsum("pcij,pjk->pcik", w, vi)
            s = -np.einsum("pcij,pdkj->cidk", wv, w)
            for c in range(n_cam):
                s[c, :, c] += u[c] * (1 + damp * np.eye(6))
            b = gc - np.einsum("pcij,pj->ci", wv, gp)
            step = solve_spd(s[1:, :, 1:].reshape(6 * (n_cam - 1), -1) + 1e-9 * np.eye(6 * (n_cam - 1)), -b[1:].ravel())
            if step is not None:
                move = np.concatenate([np.zeros(6), step]).reshape(n_cam, 6)
                shift = -np.einsum("pij,pj->pi", vi, gp + np.einsum("pcij,ci->pj", w, move))
                new = [(nearest_rotation(rotate(m[:3]) @ p[0]), p[1] + m[3:]) for p, m in zip(poses, move, strict=True)]
                q2, e2 = error(new, points + shift)
                if (e2 * e2).sum() < cost:
                    gain = cost - (e2 * e2).sum()
                    poses, points, q, e, cost, better = new, points + shift, q2, e2, (e2 * e2).sum(), True
                    damp = max(damp * 0.3, 1e-12)
                    break
            damp *= 10
        if not better or gain < 1e-10 * (cost + 1e-12):
            break
    return poses, points, float(np.sqrt(cost / max(1, len(cam))))
