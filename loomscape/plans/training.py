"""Training of Gaussian primitives on views: gradients by view in tasks, steps on tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from loomscape.functions import splat_np
from loomscape.functions.splat_np import FIELDS
from loomscape.operators.optimizer import B1, B2, EPS

RATES = np.array([1.6e-4] * 3 + [5e-3] * 3 + [1e-3] * 4 + [5e-2] + [2.5e-3] * 3)


@dataclass
class View:
    rotation: np.ndarray
    shift: np.ndarray
    camera: tuple[float, float, float]
    image: np.ndarray


@dataclass
class State:
    cloud: np.ndarray
    m: np.ndarray
    v: np.ndarray
    step: int = 0

    @classmethod
    def begin(cls, cloud: np.ndarray) -> State:
        return cls(cloud.copy(), np.zeros_like(cloud), np.zeros_like(cloud))


def extent(cloud: np.ndarray) -> float:
    p = cloud[:, :3]
    return max(1e-6, float(np.linalg.norm(p - p.mean(axis=0), axis=1).max())) if len(p) else 1.0


def gradients(spark: SparkSession, cloud: np.ndarray, views: DataFrame) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean loss, summed gradients, mean screen gradient and number of views of each primitive.

    views holds one row for each view (view, pose array of 12, camera array of 3, height,
    width, pixels array); each task adds up its own views before anything is shuffled.
    """
    shared = spark.sparkContext.broadcast(cloud)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cloud = shared.value
        total, screen, seen, loss, n = np.zeros_like(cloud), np.zeros(len(cloud)), np.zeros(len(cloud)), 0.0, 0
        for part in parts:
            for row in part.itertuples():
                pose = np.asarray(row.pose, float)
                image = np.asarray(row.pixels, float).reshape(row.height, row.width, 3)
                one, g, s = splat_np.loss_and_gradients(cloud, (pose[:9].reshape(3, 3), pose[9:]), tuple(row.camera), image)
                size = np.linalg.norm(s, axis=1)
                total, screen, seen, loss, n = total + g, screen + size, seen + (size > 0), loss + one, n + 1
        if n:
            yield pd.DataFrame({"loss": [loss], "n": [n], "grad": [total.ravel()], "screen": [screen], "seen": [seen]})

    rows = views.mapInPandas(run, "loss double, n long, grad array<double>, screen array<double>, seen array<double>").collect()
    grad = sum(np.array(r["grad"]) for r in rows).reshape(cloud.shape)
    seen = sum(np.array(r["seen"]) for r in rows)
    return sum(r["loss"] for r in rows) / sum(r["n"] for r in rows), grad, sum(np.array(r["screen"]) for r in rows) / np.maximum(seen, 1), seen


def adam(state: State, grad: np.ndarray, rates: np.ndarray = RATES) -> None:
    state.step += 1
    state.m = B1 * state.m + (1 - B1) * grad
    state.v = B2 * state.v + (1 - B2) * grad * grad
    state.cloud -= rates * (state.m / (1 - B1**state.step)) / (np.sqrt(state.v / (1 - B2**state.step)) + EPS)
    state.cloud[:, 6:10] /= np.maximum(np.linalg.norm(state.cloud[:, 6:10], axis=1, keepdims=True), 1e-12)
    state.cloud[:, 11:14] = np.clip(state.cloud[:, 11:14], 0, 1)


def densify(state: State, screen: np.ndarray, size: float, fraction: float = 0.05, clone_below: float = 0.01, faint: float = 0.005, largest: float = 0.5, seed: int = 1) -> dict[str, int]:
    """Clones small and splits large primitives of the highest screen gradients, then
    prunes faint and huge ones (never all). Moments follow; new primitives begin at zero."""
    n = len(state.cloud)
    chosen = np.lexsort((np.arange(n), -screen))[: int(fraction * n + 0.5)]
    chosen = chosen[screen[chosen] > 0]
    scale = np.exp(state.cloud[:, 3:6]).max(axis=1)
    small, large = chosen[scale[chosen] <= clone_below * size], chosen[scale[chosen] > clone_below * size]
    rng, children = np.random.default_rng(seed), []
    for i in large.tolist():
        for _ in range(2):
            c = state.cloud[i].copy()
            x, y, z, w = c[6:10]
            turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
            c[:3] += turn @ (rng.normal(size=3) * np.exp(c[3:6]))
            c[3:6] -= np.log(1.6)
            children.append(c)
    new = np.concatenate([state.cloud[small], np.array(children).reshape(-1, 14)])
    keep = np.ones(n, dtype=bool)
    keep[large] = False
    cloud = np.concatenate([state.cloud[keep], new])
    m, v = (np.concatenate([a[keep], np.zeros_like(new)]) for a in (state.m, state.v))
    ok = (1 / (1 + np.exp(-cloud[:, 10])) >= faint) & (np.exp(cloud[:, 3:6]).max(axis=1) <= largest * size)
    if not ok.any():
        ok[:] = True
    state.cloud, state.m, state.v = cloud[ok], m[ok], v[ok]
    return {"cloned": len(small), "split": len(large), "pruned": int((~ok).sum())}


def view_table(spark: SparkSession, views: list[View]) -> DataFrame:
    rows = [(k, [*v.rotation.ravel().tolist(), *v.shift.tolist()], list(map(float, v.camera)), v.image.shape[0], v.image.shape[1], v.image.ravel().tolist()) for k, v in enumerate(views)]
    return spark.createDataFrame(rows, "view int, pose array<double>, camera array<double>, height int, width int, pixels array<double>").repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism)))


def train(spark: SparkSession, cloud: np.ndarray, views: DataFrame, rounds: int, rates: np.ndarray = RATES, densify_every: int = 50, densify_end: int = 0, state: State | None = None) -> tuple[State, list[float]]:
    """rounds steps; the state, moments included, goes on where it is given again."""
    state, losses = state or State.begin(cloud), []
    views.cache()
    for k in range(1, rounds + 1):
        loss, grad, screen, _ = gradients(spark, state.cloud, views)
        losses.append(loss)
        adam(state, grad, rates)
        if k % densify_every == 0 and k <= densify_end:
            densify(state, screen, extent(state.cloud))
    views.unpersist()
    return state, losses


def splat_frame(spark: SparkSession, cloud: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(cloud, columns=FIELDS).assign(splat_id=np.arange(len(cloud))))
