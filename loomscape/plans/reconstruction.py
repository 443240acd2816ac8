"""Incremental structure from motion over matched features.

Matching and two-view fits of frame pairs run in tasks; the growing reconstruction, a
few cameras and points, is held by the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscape.functions import geometry_np as N
from loomscape.operators.matching import match_descriptors, window_pairs

NEAR, FAR = 2.5, 4.0  # pixels for adding to a point, and for a new one
SEED_INLIERS, LEAST_SUPPORT = 30, 6


@dataclass
class Reconstruction:
    poses: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    points: list[np.ndarray] = field(default_factory=list)
    seen: list[dict[int, int]] = field(default_factory=list)  # of each point: frame, keypoint
    rmse: float = 0.0


def pair_matches(features: DataFrame, reach: int = 6, ratio: float = 0.8, ceiling: float = 80, bits: bool = True, least: int = 8) -> DataFrame:
    """(a, b, ka, kb) of mutual matches of frames at most reach places apart, of pairs with
    at least `least` of them; features hold (frame_id, kp_id, descriptor)."""
    frames = features.select("frame_id").distinct().withColumn("all", F.lit(0))
    pairs = window_pairs(frames, "all", ["frame_id"], "frame_id", reach).withColumn("pair", F.to_json(F.array("a", "b")))
    f = features.select("frame_id", "kp_id", "descriptor")
    query = pairs.join(f, pairs.a == f.frame_id).select("pair", "kp_id", "descriptor")
    train = pairs.join(f, pairs.b == f.frame_id).select("pair", "kp_id", "descriptor")
    m = match_descriptors(query, train, "pair", "kp_id", "descriptor", ratio, ceiling, bits=bits)
    enough = m.groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("pair")
    got = m.join(enough, "pair").withColumn("ends", F.from_json("pair", "array<bigint>"))
    return got.select(F.get("ends", F.lit(0)).alias("a"), F.get("ends", F.lit(1)).alias("b"), F.col("query_id").alias("ka"), F.col("train_id").alias("kb"))


def fit_pairs(matches: DataFrame, keypoints: DataFrame, camera: tuple[float, float, float]) -> DataFrame:
    """Inliers and median ray angle of each pair's two-view fit, by pair in tasks."""
    k = keypoints.select("frame_id", "kp_id", "x", "y")
    m = matches.join(k.toDF("a", "ka", "xa", "ya"), ["a", "ka"]).join(k.toDF("b", "kb", "xb", "yb"), ["b", "kb"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ka", "kb"])
        got = N.two_view(rows[["xa", "ya"]].to_numpy(), rows[["xb", "yb"]].to_numpy(), camera, camera)
        n = 0 if got is None else len(got.points)
        angles = np.sort(N.ray_angles(got.points, (np.eye(3), np.zeros(3)), (got.rotation, got.shift))) if n else np.zeros(1)
        return pd.DataFrame({"a": [rows["a"].iloc[0]], "b": [rows["b"].iloc[0]], "inliers": [n], "angle": [float(angles[len(angles) // 2])]})

    return m.groupBy("a", "b").applyInPandas(fit, "a long, b long, inliers long, angle double")


def reconstruct(keypoints: DataFrame, matches: DataFrame, camera: tuple[float, float, float], adjust_every: int = 3) -> Reconstruction | None:
    """Cameras and points, or none without a pair to start from.

    Starts from the pair of most points times angle; then the frame that most points are
    seen in is fitted next, the smaller number first, until none fits.
    """
    fits = fit_pairs(matches, keypoints, camera).where(F.col("inliers") >= SEED_INLIERS)
    seed = fits.orderBy(F.desc(F.col("inliers") * F.col("angle")), "a", "b").first()
    if seed is None:
        return None
    # one row for each keypoint and match of a scene's selected frames
    at = {(r.frame_id, r.kp_id): np.array([r.x, r.y]) for r in keypoints.select("frame_id", "kp_id", "x", "y").collect()}
    pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in matches.orderBy("a", "b", "ka", "kb").collect():
        pairs.setdefault((r.a, r.b), []).append((r.ka, r.kb))
    frames = sorted({f for p in pairs for f in p})
    out, c = Reconstruction(), np.array(camera)
    own: dict[tuple[int, int], int] = {}

    def add(point: np.ndarray, seen: dict[int, int]) -> None:
        own.update({(f, k): len(out.points) for f, k in seen.items()})
        out.points.append(point)
        out.seen.append(dict(seen))

    def off(i: int, f: int, k: int) -> float:
        q = out.poses[f][0] @ out.points[i] + out.poses[f][1]
        return float(np.linalg.norm(q[:2] / q[2] * c[0] + c[1:] - at[f, k])) if q[2] > 1e-9 else np.inf

    def grow() -> None:
        for (a, b), rows in sorted(pairs.items()):
            if a not in out.poses or b not in out.poses:
                continue
            new = []
            for ka, kb in rows:
                i, j = own.get((a, ka)), own.get((b, kb))
                if i is None and j is None:
                    new.append((ka, kb))
                elif (i is None) != (j is None):
                    p, f, k = (i, b, kb) if j is None else (j, a, ka)
                    if f not in out.seen[p] and off(p, f, k) < NEAR:
                        out.seen[p][f] = k
                        own[f, k] = p
            if not new:
                continue
            na, nb = (np.array([(at[f, k] - c[1:]) / c[0] for k in ks]) for f, ks in ((a, [x for x, _ in new]), (b, [x for _, x in new])))
            points = N.triangulate(na, nb, out.poses[a], out.poses[b])
            angles = N.ray_angles(points, out.poses[a], out.poses[b])
            for (ka, kb), p, angle in zip(new, points, angles, strict=True):
                if (a, ka) in own or (b, kb) in own or not np.isfinite(p).all() or angle < 1:
                    continue
                add(p, {a: ka, b: kb})
                if max(off(len(out.points) - 1, a, ka), off(len(out.points) - 1, b, kb)) >= FAR:
                    own.pop((a, ka)), own.pop((b, kb)), out.points.pop(), out.seen.pop()

    def adjust() -> None:
        order = sorted(out.poses)
        rows = [(order.index(f), i, *at[f, k]) for i, s in enumerate(out.seen) for f, k in sorted(s.items())]
        if len(order) < 2 or not rows:
            return
        r = np.array(rows)
        poses, points, out.rmse = N.bundle_adjust([out.poses[f] for f in order], np.array(out.points), r[:, 0].astype(int), r[:, 1].astype(int), r[:, 2:], [camera] * len(order))
        out.poses.update(zip(order, poses, strict=True))
        out.points[:] = list(points)
        bad = [(i, f, k) for i, s in enumerate(out.seen) for f, k in s.items() if off(i, f, k) > FAR]
        for i, f, k in bad:
            del out.seen[i][f], own[f, k]
        keep = [i for i, s in enumerate(out.seen) if len(s) >= 2]
        out.points[:], out.seen[:] = [out.points[i] for i in keep], [out.seen[i] for i in keep]
        own.clear()
        own.update({(f, k): i for i, s in enumerate(out.seen) for f, k in s.items()})

    a, b = seed["a"], seed["b"]
    first = N.two_view(np.array([at[a, k] for k, _ in pairs[a, b]]), np.array([at[b, k] for _, k in pairs[a, b]]), camera, camera)
    out.poses = {a: (np.eye(3), np.zeros(3)), b: (first.rotation, first.shift)}
    for i, p in zip(first.inliers.tolist(), first.points, strict=True):
        add(p, {a: pairs[a, b][i][0], b: pairs[a, b][i][1]})
    grow()
    while True:
        support: dict[int, dict[int, int]] = {f: {} for f in frames if f not in out.poses}
        for (x, y), rows in sorted(pairs.items()):
            for kx, ky in rows:
                if x in out.poses and y in support and (x, kx) in own:
                    support[y].setdefault(ky, own[x, kx])
                elif y in out.poses and x in support and (y, ky) in own:
                    support[x].setdefault(kx, own[y, ky])
        for f in sorted(support, key=lambda f: (-len(support[f]), f)):
            if len(support[f]) < LEAST_SUPPORT:
                continue
            seen = sorted(support[f].items())
            got = N.pnp(np.array([out.points[i] for _, i in seen]), np.array([at[f, k] for k, _ in seen]), camera)
            if got is None:
                continue
            out.poses[f] = got[:2]
            for i in got[2].tolist():
                k, p = seen[i]
                if f not in out.seen[p] and (f, k) not in own:
                    out.seen[p][f] = k
                    own[f, k] = p
            grow()
            if len(out.poses) % adjust_every == 0:
                adjust()
            break
        else:
            break
    adjust()
    return out
