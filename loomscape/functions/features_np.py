"""Image features in numpy: luma, scores, corners, pyramids and descriptors."""

from __future__ import annotations

import numpy as np

from loomscape.functions.geometry_np import SplitMix

BRIEF_SEED = 0x5F3A9C217E44B0D9
RADIUS = 15


def luma(rgb: np.ndarray) -> np.ndarray:
    return (rgb[..., :3].astype(np.float64) @ np.array([0.2126, 0.7152, 0.0722])) / 255


def blur_score(v: np.ndarray) -> float:
    """Variance of the five-point Laplacian over all pixels, the edge counting 0."""
    out = np.zeros_like(v)
    if min(v.shape) > 2:
        out[1:-1, 1:-1] = v[:-2, 1:-1] + v[2:, 1:-1] + v[1:-1, :-2] + v[1:-1, 2:] - 4 * v[1:-1, 1:-1]
    return float(max(0.0, (out * out).mean() - out.mean() ** 2))


def signature(v: np.ndarray, cells: int = 8) -> np.ndarray:
    """Mean luma of a grid of cells; empty cells are 0."""
    h, w = v.shape
    out = np.zeros((cells, cells))
    for i in range(cells):
        for j in range(cells):
            part = v[i * h // cells : (i + 1) * h // cells, j * w // cells : (j + 1) * w // cells]
            out[i, j] = part.mean() if part.size else 0.0
    return out.ravel()


def harris(v: np.ndarray, k: float = 0.04) -> np.ndarray:
    h, w = v.shape
    out = np.zeros((h, w))
    if min(h, w) < 7:
        return out
    dx = v[:, 2:] - v[:, :-2]
    gx = dx[:-2] + 2 * dx[1:-1] + dx[2:]
    dy = v[2:] - v[:-2]
    gy = dy[:, :-2] + 2 * dy[:, 1:-1] + dy[:, 2:]

    def box(a):
        c = np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return c[5:, 5:] - c[:-5, 5:] - c[5:, :-5] + c[:-5, :-5]

    xx, xy, yy = box(gx * gx), box(gx * gy), box(gy * gy)
    out[3:-3, 3:-3] = xx * yy - xy * xy - k * (xx + yy) ** 2
    return out


def half(v: np.ndarray) -> np.ndarray:
    h, w = v.shape[0] // 2 * 2, v.shape[1] // 2 * 2
    return v[:h, :w].reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3))


def keypoints(response: np.ndarray, most: int, radius: int = 4, relative: float = 0.01, floor: float = 0.0005, cells: int = 8) -> np.ndarray:
    """(y, x) of local maxima, spread over a grid of cells, strongest first.

    Earlier pixels win ties; responses compare in steps of 2**-20 of the highest.
    """
    h, w = response.shape
    top = response.max(initial=0)
    if top <= 0:
        return np.zeros((0, 2), np.int64)
    padded = np.pad(response, radius, constant_values=-np.inf)
    keep = response > 0
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            other = padded[radius + dy : radius + dy + h, radius + dx : radius + dx + w]
            keep &= response > other if (dy, dx) < (0, 0) else response >= other
    keep[:radius] = keep[h - radius :] = False
    keep[:, :radius] = keep[:, w - radius :] = False
    y, x = np.nonzero(keep)
    cell = (y * cells // h) * cells + x * cells // w
    best = np.zeros(cells * cells)
    np.maximum.at(best, (np.arange(h)[:, None] * cells // h * cells + np.arange(w) * cells // w).ravel(), response.ravel())
    ok = response[y, x] >= np.maximum(best[cell] * relative, top * floor)
    y, x, cell = y[ok], x[ok], cell[ok]
    step = np.round(response[y, x] / top * (1 << 20))
    order = np.lexsort((x, y, -step))
    turn = np.zeros(len(order), np.int64)
    seen: dict[int, int] = {}
    for i in order.tolist():
        turn[i] = seen.get(int(cell[i]), 0)
        seen[int(cell[i])] = turn[i] + 1
    taken = np.lexsort((cell, turn))[:most]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    taken = taken[np.argsort(rank[taken])]
    return np.stack([y[taken], x[taken]], axis=1)


_dy, _dx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = _dy**2 + _dx**2 <= RADIUS**2


def _patch(v: np.ndarray, y: int, x: int, r: int) -> np.ndarray:
    ys, xs = np.clip(np.arange(y - r, y + r + 1), 0, v.shape[0] - 1), np.clip(np.arange(x - r, x + r + 1), 0, v.shape[1] - 1)
    return v[np.ix_(ys, xs)]


def orientation(v: np.ndarray, y: int, x: int) -> float:
    p = _patch(v, y, x, RADIUS) * _DISC
    return float(np.arctan2((p * _dy).sum(), (p * _dx).sum()))


def brief_pattern(seed: int = BRIEF_SEED, pairs: int = 256) -> np.ndarray:
    """Pairs of offsets (dx1, dy1, dx2, dy2) of a rounded normal spread within the disc's box."""
    draw, out = SplitMix(seed), []
    while len(out) < pairs:
        p = [int(np.clip(round(draw.normal() * 6), -RADIUS, RADIUS)) for _ in range(4)]
        if p[:2] != p[2:]:
            out.append(p)
    return np.array(out)


_PATTERN = brief_pattern()


def brief(v: np.ndarray, y: int, x: int, angle: float) -> np.ndarray:
    """32 bytes: which of two turned places is brighter, for each pair."""
    c, s = np.cos(angle), np.sin(angle)

    def at(dx, dy):
        px = np.clip(np.rint(x + c * dx - s * dy).astype(int), 0, v.shape[1] - 1)
        py = np.clip(np.rint(y + s * dx + c * dy).astype(int), 0, v.shape[0] - 1)
        return v[py, px]

    return np.packbits(at(_PATTERN[:, 0], _PATTERN[:, 1]) < at(_PATTERN[:, 2], _PATTERN[:, 3]))


def sift(v: np.ndarray, y: int, x: int, angle: float, radius: int = 12) -> np.ndarray:
    """128 bytes: weighted histograms of 8 gradient directions in 4 x 4 cells about the
    keypoint's direction, spread to neighbouring bins; unit length, clipped at 0.2."""
    p = _patch(v, y, x, radius + 1)
    gy, gx = (p[2:, 1:-1] - p[:-2, 1:-1]) / 2, (p[1:-1, 2:] - p[1:-1, :-2]) / 2
    dy, dx = np.mgrid[-radius : radius + 1, -radius : radius + 1].astype(float)
    c, s = np.cos(angle), np.sin(angle)
    u, w = (c * dx + s * dy) / radius * 2 + 1.5, (-s * dx + c * dy) / radius * 2 + 1.5
    turn = (np.arctan2(gy, gx) - angle) / (2 * np.pi) * 8 % 8
    weight = np.hypot(gx, gy) * np.exp(-((u - 1.5) ** 2 + (w - 1.5) ** 2) / 8)
    out = np.zeros((4, 4, 8))
    for bu in (0, 1):
        for bw in (0, 1):
            for bt in (0, 1):
                iu, iw, it = np.floor(u).astype(int) + bu, np.floor(w).astype(int) + bw, np.floor(turn).astype(int) + bt
                share = weight * (1 - np.abs(u - iu)) * (1 - np.abs(w - iw)) * (1 - np.abs(turn - it))
                ok = (iu >= 0) & (iu < 4) & (iw >= 0) & (iw < 4)
                np.add.at(out, (iw[ok], iu[ok], it[ok] % 8), share[ok])
    d = out.ravel()
    for _ in range(2):
        n = np.linalg.norm(d)
        d = np.minimum(d / n, 0.2) if n > 1e-12 else d
    n = np.linalg.norm(d)
    return np.clip(np.rint(d / n * 512 if n > 1e-12 else d), 0, 255).astype(np.uint8)


def extract(v: np.ndarray, most: int = 1500, kind: str = "brief", levels: int = 4, radius: int = 8) -> list[dict]:
    """Keypoints of a pyramid in pixels of the whole image, with direction and descriptor."""
    pyramid = [v]
    while len(pyramid) < levels and min(pyramid[-1].shape) >= 128:
        pyramid.append(half(pyramid[-1]))
    area = sum(p.size for p in pyramid)
    rows = []
    for octave, p in enumerate(pyramid):
        response = harris(p)
        quota = max(16, round(most * p.size / area))
        for y, x in keypoints(response, quota, max(2, radius >> octave)).tolist():
            angle = orientation(p, y, x)
            d = brief(p, y, x, angle) if kind == "brief" else sift(p, y, x, angle)
            scale = 1 << octave
            rows.append({"x": (x + 0.5) * scale - 0.5, "y": (y + 0.5) * scale - 0.5, "response": float(response[y, x]), "angle": angle, "octave": octave, "descriptor": d})
    rows.sort(key=lambda r: (-r["response"], r["octave"], r["y"], r["x"]))
    return rows[:most]
