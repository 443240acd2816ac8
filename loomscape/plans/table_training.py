"""Training on tables: primitives with their moments are a table, every step a plan, and the
state a version in a folder that a later run goes on from."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscape.operators import optimizer as O  # noqa: E741
from loomscape.operators import splats as S
from loomscape.sources.generations import commit, latest
from loomscape.sources.work import cut, discard

Gradients = Callable[[DataFrame, int], DataFrame]


def with_moments(splats: DataFrame, names: Sequence[str]) -> DataFrame:
    """splats with moments of zero where they have none."""
    new = [f"{k}_{n}" for n in names for k in "mv" if f"{k}_{n}" not in splats.columns]
    return splats.withColumns({n: F.lit(0.0) for n in new}) if new else splats


def view_gradients(target: DataFrame, pixels: int, rotation: list[Column], shift: list[Column], focal: float, cx: float, cy: float, width: int, height: int, background: Sequence[float] = (0.0, 0.0, 0.0)) -> Gradients:
    """Gradients of colours and opacities for one view of the target image (x, y, t_r, t_g, t_b)."""

    def run(splats: DataFrame, step: int) -> DataFrame:
        seen = S.visible(S.project(splats, rotation, shift, F.lit(focal), F.lit(cx), F.lit(cy)), width, height)
        return S.image_gradients(seen, target, pixels, width, height, ["r", "g", "b"], list(background))

    return run


def train_tables(splats: DataFrame, gradients: Gradients, rates: dict[str, float], steps: int, folder: str, every: int = 10, reset_every: int = 0, reset_end: int = 0, faint: float = 0.005, largest: float = float("inf"), prune_every: int = 0) -> tuple[int, DataFrame]:
    """The state after steps steps, and their number: splats (splat_id, their parameters and
    moments m_* and v_*), begun from the newest version in folder, should there be one.

    Each step is one plan of a view's or all views' gradients and of adam_step(), joined by
    splat_id; no primitive passes through the driver. Every so many steps the state,
    moments included, is committed whole, so that a run that was killed goes on from its
    last version and ends with the same table as one that was not; between these the
    lineage is cut in the shared folder. Opacities are reset, moments too, every
    reset_every steps up to reset_end; faint and large primitives go every prune_every.
    """
    spark = splats.sparkSession
    found = latest(spark, folder)
    done, state = found if found else (0, with_moments(splats, list(rates)))
    size = F.greatest(*(F.exp(c) for c in ("sx", "sy", "sz")))
    for step in range(done + 1, steps + 1):
        found = gradients(state, step)
        new = O.adam_step(state, found.select("splat_id", *(f"d_{p}" for p in rates)), rates, step)
        for c in {"r", "g", "b"} & rates.keys():
            new = new.withColumn(c, F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)))
        if reset_every and step % reset_every == 0 and step <= reset_end:
            new = O.reset_opacities(with_moments(new, ["logit"]))
        if prune_every and step % prune_every == 0:
            new = O.prune(new, 1 / (1 + F.exp(-F.col("logit"))), size, faint, largest)
        old = state
        state = commit(new, folder, step) if step % every == 0 or step == steps else cut(new, "state")
        discard(old)
    return max(done, steps), state
