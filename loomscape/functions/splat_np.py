"""Gaussian primitives in numpy: projection, rendering and gradients of one view.

A cloud is an (n, 14) array: px py pz, log scales, quaternion xyzw, opacity logit, r g b.
"""

from __future__ import annotations

import numpy as np

FIELDS = ["px", "py", "pz", "sx", "sy", "sz", "qx", "qy", "qz", "qw", "logit", "r", "g", "b"]


def _project(cloud: np.ndarray, pose, camera) -> dict[str, np.ndarray]:
    r, t = pose
    f, cx, cy = camera
    q = cloud[:, 6:10] / np.maximum(np.linalg.norm(cloud[:, 6:10], axis=1, keepdims=True), 1e-12)
    x, y, z, w = q.T
    turn = np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], axis=1).reshape(-1, 3, 3)
    half = turn * np.exp(cloud[:, None, 3:6])
    p = cloud[:, :3] @ r.T + t
    d = np.maximum(p[:, 2], 1e-6)
    j = np.zeros((len(cloud), 2, 3))
    j[:, 0, 0] = j[:, 1, 1] = f / d
    j[:, 0, 2], j[:, 1, 2] = -f * p[:, 0] / d**2, -f * p[:, 1] / d**2
    m = j @ r @ half
    s = m @ m.transpose(0, 2, 1) + 0.3 * np.eye(2)
    det = s[:, 0, 0] * s[:, 1, 1] - s[:, 0, 1] ** 2
    mid = (s[:, 0, 0] + s[:, 1, 1]) / 2
    radius = 3 * np.sqrt(mid + np.sqrt(np.maximum(mid**2 - det, 0)))
    inv = np.stack([s[:, 1, 1], -s[:, 0, 1], s[:, 0, 0]], axis=1) / np.where(det > 1e-12, det, 1)[:, None]
    return {"u": f * p[:, 0] / d + cx, "v": f * p[:, 1] / d + cy, "depth": p[:, 2], "det": det, "radius": radius, "inv": inv, "opacity": 1 / (1 + np.exp(-cloud[:, 10]))}


def _layers(cloud: np.ndarray, pose, camera, width: int, height: int):
    """Visible primitives from front to back with their boxes and alphas."""
    g = _project(cloud, pose, camera)
    ok = (g["depth"] > 0.2) & (g["radius"] >= 0.5) & (g["radius"] <= 512) & (g["det"] > 1e-12)
    ok &= (g["u"] + g["radius"] >= 0) & (g["u"] - g["radius"] < width) & (g["v"] + g["radius"] >= 0) & (g["v"] - g["radius"] < height)
    at = np.flatnonzero(ok)
    for i in at[np.lexsort((at, g["depth"][at]))].tolist():
        u, v, rad = g["u"][i], g["v"][i], g["radius"][i]
        x0, x1 = max(0, int(np.ceil(u - rad))), min(width, int(np.floor(u + rad)) + 1)
        y0, y1 = max(0, int(np.ceil(v - rad))), min(height, int(np.floor(v + rad)) + 1)
        if x0 >= x1 or y0 >= y1:
            continue
        dx, dy = np.arange(x0, x1)[None, :] - u, np.arange(y0, y1)[:, None] - v
        a, b, c = g["inv"][i]
        fall = np.exp(np.minimum(-0.5 * (a * dx * dx + c * dy * dy) - b * dx * dy, 0))
        alpha = np.minimum(0.99, g["opacity"][i] * fall)
        yield i, (slice(y0, y1), slice(x0, x1)), np.where(alpha >= 1 / 255, alpha, 0.0)


def render(cloud: np.ndarray, pose, camera, width: int, height: int, background: float = 0.0) -> np.ndarray:
    """(height, width, 3): front-to-back blending until 1/255 of the light is left."""
    out, through = np.zeros((height, width, 3)), np.ones((height, width))
    for i, box, alpha in _layers(cloud, pose, camera, width, height):
        alpha = np.where(through[box] > 1 / 255, alpha, 0.0)
        out[box] += (alpha * through[box])[..., None] * cloud[i, 11:14]
        through[box] *= 1 - alpha
    return out + background * through[..., None]


def loss(cloud: np.ndarray, pose, camera, image: np.ndarray) -> float:
    return float(np.abs(render(cloud, pose, camera, image.shape[1], image.shape[0]) - image).mean())


def loss_and_gradients(cloud: np.ndarray, pose, camera, image: np.ndarray, step: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean absolute error, its gradients by the cloud's fields, and by screen place (u, v).

    Blending is differentiated exactly, to alpha and colour of every pixel; from there a
    primitive's own alphas are differentiated by central differences of its projection.
    """
    h, w = image.shape[:2]
    layers = list(_layers(cloud, pose, camera, w, h))
    through, out, before = np.ones((h, w)), np.zeros((h, w, 3)), []
    for k, (i, box, alpha) in enumerate(layers):
        alpha = np.where(through[box] > 1 / 255, alpha, 0.0)
        layers[k] = (i, box, alpha)
        before.append(through[box].copy())
        out[box] += (alpha * through[box])[..., None] * cloud[i, 11:14]
        through[box] *= 1 - alpha
    off = out - image
    up = np.sign(off) / off.size
    grads, screen = np.zeros_like(cloud), np.zeros((len(cloud), 2))
    behind = out.copy()
    d_alpha: dict[int, tuple] = {}
    for (i, box, alpha), t in zip(layers, before, strict=True):
        mine = (alpha * t)[..., None] * cloud[i, 11:14]
        behind[box] -= mine
        d_alpha[i] = (box, (up[box] * (cloud[i, 11:14] * t[..., None] - behind[box] / (1 - alpha)[..., None])).sum(axis=2) * (alpha > 0))
        grads[i, 11:14] = (up[box] * (alpha * t)[..., None]).sum(axis=(0, 1))
    rows = sorted(d_alpha)
    if not rows:
        return float(np.abs(off).mean()), grads, screen

    def alphas(moved: np.ndarray, shift=(0.0, 0.0)) -> np.ndarray:
        g = _project(moved, pose, camera)
        total = np.zeros(len(rows))
        for k, i in enumerate(rows):
            box, d = d_alpha[i]
            dx, dy = np.arange(box[1].start, box[1].stop)[None, :] - g["u"][k] - shift[0], np.arange(box[0].start, box[0].stop)[:, None] - g["v"][k] - shift[1]
            a, b, c = g["inv"][k]
            total[k] = (np.minimum(0.99, g["opacity"][k] * np.exp(np.minimum(-0.5 * (a * dx * dx + c * dy * dy) - b * dx * dy, 0))) * d).sum()
        return total

    own = cloud[rows]
    for f in range(11):
        high, low = own.copy(), own.copy()
        high[:, f] += step
        low[:, f] -= step
        grads[rows, f] = (alphas(high) - alphas(low)) / (2 * step)
    for k, shift in enumerate(((step, 0.0), (0.0, step))):
        screen[rows, k] = (alphas(own, shift) - alphas(own, (-shift[0], -shift[1]))) / (2 * step)
    return float(np.abs(off).mean()), grads, screen
