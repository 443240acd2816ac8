"""Light through the primitives of one tile after another, in numpy over Arrow batches.

Batches hold rows by tile (tx, ty), the tile's own row (kind 0) first and then its primitives
(kind 1) from front to back. What goes on from batch to batch is one tile's pixels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

LEAST = 1 / 255
BLOCK = 64  # primitives that are held against a tile's open pixels at once
SHAPE = ("u", "v", "ka", "kb", "kc", "radius", "opacity")


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple[int, int]]]:
    tx, ty = _numbers(batch, "tx"), _numbers(batch, "ty")
    turns = np.flatnonzero((tx[1:] != tx[:-1]) | (ty[1:] != ty[:-1])) + 1
    for begin, end in zip([0, *turns], [*turns, len(tx)], strict=True):
        yield int(begin), int(end), (int(tx[begin]), int(ty[begin]))


def _own(batch: pa.RecordBatch, name: str, row: int, size: int, default: float) -> np.ndarray:
    found = batch.column(name)[row]
    return np.array(found.values.to_numpy(zero_copy_only=False), dtype=float) if found.is_valid else np.full(size, default)


def _alphas(x: np.ndarray, y: np.ndarray, shape: list[np.ndarray]) -> np.ndarray:
    """Primitives by pixels; 0 where a primitive doesn't colour the pixel."""
    u, v, ka, kb, kc, radius, opacity = (s[:, None] for s in shape)
    dx, dy = x - u, y - v
    power = -0.5 * (ka * dx * dx + kc * dy * dy) - kb * dx * dy
    alpha = np.minimum(0.99, opacity * np.exp(np.minimum(power, 0)))
    inside = (x >= np.floor(u - radius)) & (x <= np.ceil(u + radius)) & (y >= np.floor(v - radius)) & (y <= np.ceil(v + radius))
    return np.where((power <= 0) & inside & (alpha >= LEAST), alpha, 0.0)


def _through(light: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """What reaches each primitive, and, as the last row, what is left behind all of them."""
    return np.vstack([light, 1 - alpha]).cumprod(axis=0)


class _Tile:
    def __init__(self, at: tuple[int, int], size: int, width: int, height: int, light: np.ndarray) -> None:
        place = np.arange(size * size)
        self.at, self.x, self.y = at, at[0] * size + place % size, at[1] * size + place // size
        self.inside = (self.x < width) & (self.y < height)
        self.light = light

    def blocks(self, batch: pa.RecordBatch, begin: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For blocks of primitives: the first one's row, open pixels, alphas, the light that
        reaches each, and where it is seen. Ends where no pixel is open."""
        columns = [_numbers(batch, c)[begin:end] for c in SHAPE]
        for k in range(0, end - begin, BLOCK):
            open_ = np.flatnonzero(self.inside & (self.light > LEAST))
            if not len(open_):
                return
            alpha = _alphas(self.x[open_], self.y[open_], [c[k : k + BLOCK] for c in columns])
            t = _through(self.light[open_], alpha)
            lit = (alpha > 0) & (t[:-1] > LEAST)
            yield begin + k, open_, alpha, t[:-1], lit
            # the light stays as it is behind the last one that is seen
            self.light[open_] = np.minimum(self.light[open_], np.where(lit, t[1:], 1.0).min(axis=0))


def blender(size: int, width: int, height: int, colours: Sequence[str]):
    """tx, ty, light and each colour's sums, arrays of a tile's pixels, and last, the depth
    of the last primitive that is seen; a tile's own row holds what it begins with."""
    names = ["tx", "ty", "light", "last", *colours]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), *(pa.list_(pa.float64()) for _ in colours)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = sums = last = None

        def ended() -> pa.RecordBatch:
            values = [[tile.at[0]], [tile.at[1]], [tile.light], [last], *([s] for s in sums)]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = _numbers(batch, "kind")
            for begin, end, at in _segments(batch):
                if tile is None or at != tile.at:
                    if tile is not None:
                        yield ended()
                    own = kind[begin] == 0
                    begun = lambda name, default: _own(batch, name, begin, size * size, default) if own else np.full(size * size, default)  # noqa: B023, E731
                    tile, last = _Tile(at, size, width, height, begun("light", 1.0)), batch.column("last")[begin].as_py() if own else None
                    sums = [begun(f"s_{c}", 0.0) for c in colours]
                    begin += int(own)
                values, depth = [_numbers(batch, c) for c in colours], _numbers(batch, "depth")
                for k, open_, alpha, t, lit in tile.blocks(batch, begin, end):
                    part = np.where(lit, alpha * t, 0.0)
                    for s, c in zip(sums, values, strict=True):
                        s[open_] += c[k : k + len(part)] @ part
                    seen = np.flatnonzero(lit.any(axis=1))
                    if len(seen):
                        last = float(depth[k + seen[-1]])
        if tile is not None:
            yield ended()

    return run


def differentiator(size: int, width: int, height: int, colours: Sequence[str], ident: str, part: float):
    """ident, d_ of each colour and of logit, loss and seen of each primitive in each tile. A
    tile's own row holds each colour of the picture (s_) and of the target (t_, NaN where
    there is none)."""
    sums = [*(f"d_{c}" for c in colours), "d_logit", "loss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for batch in batches:
            if not batch.num_rows:
                continue
            for begin, end, at in _segments(batch):
                if tile is None or at != tile.at:
                    tile = _Tile(at, size, width, height, np.full(size * size, 1.0))
                    behind, goal = ([_own(batch, f"{p}_{c}", begin, size * size, np.nan) for c in colours] for p in "st")
                    tile.inside &= ~np.isnan(goal).any(axis=0)  # pixels without a target count for nothing
                    off = [np.nan_to_num(a - g) for a, g in zip(behind, goal, strict=True)]
                    up, loss = [np.sign(o) * part for o in off], sum(np.abs(o) for o in off) * part
                    begin += 1
                values, opacity = [_numbers(batch, c) for c in colours], _numbers(batch, "opacity")
                for k, open_, alpha, t, lit in tile.blocks(batch, begin, end):
                    mine, d_alpha, out = np.where(lit, alpha * t, 0.0), 0.0, []
                    for i, c in enumerate(values):
                        own = c[k : k + len(mine), None]
                        rest = behind[i][open_] - (own * mine).cumsum(axis=0)
                        d_alpha = d_alpha + up[i][open_] * (own * t - rest / (1 - alpha))
                        behind[i][open_] = rest[-1]
                        out.append((mine * up[i][open_]).sum(axis=1))
                    free = lit & (alpha < 0.99)
                    out.append(np.where(free, d_alpha * alpha, 0.0).sum(axis=1) * (1 - opacity[k : k + len(mine)]))
                    out.append(np.where(lit & (t == 1), loss[open_], 0.0).sum(axis=1))
                    seen = lit.sum(axis=1)
                    at_ = np.flatnonzero(seen)
                    if len(at_):
                        arrays = [batch.column(ident).take(pa.array(at_ + k)), *(pa.array(o[at_]) for o in out), pa.array(seen[at_], pa.int64())]
                        yield pa.RecordBatch.from_arrays(arrays, [ident, *sums, "seen"])

    return run
