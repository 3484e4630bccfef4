"""Floor plans: point-in-polygon, wall bands and segments, polygon rings, wall refinement, heights."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import local_maxima
from ..functions.linalg import axial_gap

#: Edges that are unrolled into one expression; a polygon of more must be thinned first.
MAX_EDGES = 2000


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a ray to the right crosses the ring an odd number of times; a box test comes first."""
    if len(ring) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges")
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    edges = F.array(*[F.struct(F.lit(float(a)).alias("ax"), F.lit(float(b)).alias("ay"), F.lit(float(c)).alias("bx"), F.lit(float(d)).alias("by")) for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1])])
    cross = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (F.size(F.filter(edges, cross)) % 2 == 1)


def crop(points: DataFrame, ring, z_lo: float, z_hi: float, margin: float = 0.10) -> DataFrame:
    return points.where(F.col("z").between(z_lo - margin, z_hi + margin)).where(in_polygon(F.col("x"), F.col("y"), ring))


def buffer_width(short_side: Column) -> Column:
    return F.least(F.greatest(short_side * 0.015, F.lit(0.08)), F.lit(0.15))


def nearest_segment(points: DataFrame, segments: list[tuple[float, float, float, float]]) -> DataFrame:
    """points with wall and d2 of the nearest segment (the first on a tie); degenerate segments are skipped."""
    if len(segments) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} segments")
    x, y, best = F.col("x"), F.col("y"), []
    for k, (ax, ay, bx, by) in enumerate(segments):
        dx, dy = bx - ax, by - ay
        if (l2 := dx * dx + dy * dy) < 1e-12:
            continue
        t = F.least(F.greatest(((x - ax) * dx + (y - ay) * dy) / l2, F.lit(0.0)), F.lit(1.0))
        best.append(F.struct(((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2).alias("d2"), F.lit(k).alias("wall")))
    if not best:
        return points.withColumns({"wall": F.lit(None).cast("int"), "d2": F.lit(None).cast("double")})
    return points.withColumn("_m", F.array_min(F.array(*best))).withColumns({"wall": F.col("_m.wall"), "d2": F.col("_m.d2")}).drop("_m")


def wall_band(points: DataFrame, walls: list[tuple[float, float, float, float]], band: float, slack: float = 0.5) -> DataFrame:
    """A row per point and wall with the point within band across and half the length plus slack along."""
    if len(walls) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} walls")
    x, y, hits = F.col("x"), F.col("y"), []
    for k, (ax, ay, bx, by) in enumerate(walls):
        size = math.hypot(bx - ax, by - ay)
        ux, uy, mx, my = (bx - ax) / size, (by - ay) / size, (ax + bx) / 2, (ay + by) / 2
        along, perp = (x - mx) * ux + (y - my) * uy, (y - my) * ux - (x - mx) * uy
        ok = (F.abs(perp) < band) & (F.abs(along) < size / 2 + slack)
        hits.append(F.when(ok, F.struct(F.lit(k).alias("wall"), along.alias("along"), perp.alias("perp"))))
    return points.select("*", F.inline(F.array_compact(F.array(*hits))))


def ring_walls(ring: DataFrame, least: float = 0.15) -> DataFrame:
    """ring(poly, i, x, y) -> walls longer than least: poly, wall, x1, y1, x2, y2, angle in [0, 180), length."""
    w = Window.partitionBy("poly").orderBy("i")
    first = Window.partitionBy("poly").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = ring.select("poly", F.col("i").alias("wall"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.coalesce(F.lead("x").over(w), F.first("x").over(first)).alias("x2"), F.coalesce(F.lead("y").over(w), F.first("y").over(first)).alias("y2"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return e.withColumns({"angle": F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0)), "length": F.sqrt(dx * dx + dy * dy)}).where(F.col("length") > least)


def polygon_area(ring: DataFrame) -> DataFrame:
    w = ring_walls(ring, -1.0)
    return w.groupBy("poly").agg((F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2).alias("area"), F.sum("length").alias("perimeter"))


def snap_angles(walls: DataFrame, step: float = 45.0) -> DataFrame:
    """walls with the nearest multiple of step, the lower on a tie."""
    k = int(180 / step)
    best = F.array_min(F.array(*[F.struct(axial_gap("angle", F.lit(i * step), 180.0).alias("d"), F.lit(i * step).alias("a")) for i in range(k)]))
    return walls.withColumn("snapped", best["a"])


def tiered_snap(walls: DataFrame, dominant: list[float], tolerances=(7.0, 7.0, 4.0, 3.0)) -> DataFrame:
    """walls with the direction they snap to: dominant ones first, then right angles, diagonals, hexagon angles, by
    their tolerances; null if none is near."""
    prior = [(0.0, 1), (90.0, 1), (45.0, 2), (135.0, 2), (30.0, 3), (60.0, 3), (120.0, 3), (150.0, 3)]
    away = lambda a: all(min((a - d) % 180, (d - a) % 180) >= 1e-3 for d in dominant)
    targets = [(d, 0) for d in dominant] + [(a, t) for a, t in prior if away(a)]
    hits = [F.when((d := axial_gap("angle", F.lit(float(a)), 180.0)) <= tolerances[t], F.struct(F.lit(int(t > 0)).alias("later"), d.alias("d"), F.lit(k).alias("k"), F.lit(float(a)).alias("a"))) for k, (a, t) in enumerate(targets)]
    return walls.withColumn("snapped", F.array_min(F.array_compact(F.array(*hits)))["a"])


def angle_mode(walls: DataFrame) -> DataFrame:
    """One row: the middle of the fullest 1-degree bin of wall angles modulo 90, weighted by length, the lowest on a
    tie, and the shortest turn that takes it to an axis."""
    h = walls.groupBy(F.floor(F.pmod("angle", F.lit(90.0))).cast("int").alias("bin")).agg(F.sum("length").alias("w"))
    m = h.agg(F.max_by("bin", F.struct(F.round("w", 6), -F.col("bin"))).alias("bin")).select((F.col("bin") + F.lit(0.5)).alias("mode"))
    return m.withColumn("turn", F.when(F.col("mode") > 45, 90 - F.col("mode")).otherwise(-F.col("mode")))


def dominant_directions(walls: DataFrame, k: int = 3, apart: float = 12.0, share: float = 0.10, sigma: float = 2.0, prior: float = 0.10) -> list[float]:
    """Directions of a length-weighted histogram of 180 bins with prior weight on right angles and diagonals,
    smoothed around the circle; the highest first, none nearer than apart to one taken. Walls marked fallback don't vote."""
    if "fallback" in walls.columns:
        walls = walls.where("NOT fallback")
    rows = walls.where("length >= 0.3").groupBy(F.pmod(F.floor("angle").cast("int"), F.lit(180)).alias("bin")).agg(F.sum("length").alias("w")).collect()  # 180 rows at most
    h = np.zeros(180)
    for r in rows:
        h[r.bin] = r.w
    total = h.sum()
    for a, w in ((0, 1.0), (90, 1.0), (45, 0.3), (135, 0.3)):
        h[a] += w * prior * total
    at = np.arange(-10, 11)
    kernel = np.exp(-0.5 * (at / sigma) ** 2)
    kernel /= kernel.sum()
    h = sum(kernel[i] * np.roll(h, at[i]) for i in range(len(at)))
    out: list[float] = []
    for b in np.argsort(-h, kind="stable"):
        if len(out) == k or h[b] < share * h.max() or h.max() == 0:
            break
        if all(min((b - o) % 180, (o - b) % 180) >= apart for o in out):
            out.append(float(b))
    return out


def line_corners(lines: DataFrame) -> DataFrame:
    """lines(poly, i, px, py, dx, dy) -> corner i: where line i meets line i + 1 around the ring; the middle of their
    points if they are near parallel."""
    w = Window.partitionBy("poly").orderBy("i")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = lines.select("*", *[F.coalesce(F.lead(c).over(w), F.first(c).over(full)).alias(f"n_{c}") for c in ("px", "py", "dx", "dy")])
    den = F.col("dx") * F.col("n_dy") - F.col("dy") * F.col("n_dx")
    t = ((F.col("n_px") - F.col("px")) * F.col("n_dy") - (F.col("n_py") - F.col("py")) * F.col("n_dx")) / den
    ok = F.abs(den) >= 1e-6
    return n.select("poly", "i", F.when(ok, F.col("px") + t * F.col("dx")).otherwise((F.col("px") + F.col("n_px")) / 2).alias("x"), F.when(ok, F.col("py") + t * F.col("dy")).otherwise((F.col("py") + F.col("n_py")) / 2).alias("y"))


def fit_walls(candidates: DataFrame, lengths: dict[int, float] | None = None, least: int = 20, rounds: int = 3) -> DataFrame:
    """candidates(wall, x, y) -> wall, px, py, dx, dy, inliers, rmse, residual, x1, y1, x2, y2, vxx, vxy, vyy, confidence,
    fallback: a robust line per wall, its band tightened with the spread of its inliers; the inliers' ends and moments
    about (px, py) stand for them later on. confidence compares extent and number with a wall's expected length."""

    def fit(p, w=None):
        w = np.ones(len(p)) if w is None else w
        for _ in range(10):
            c = (w[:, None] * p).sum(0) / w.sum()
            q = (p - c) * np.sqrt(w)[:, None]
            d = np.linalg.eigh(q.T @ q)[1][:, 1]
            r = np.abs((p - c) @ np.array([-d[1], d[0]]))
            s = max(1.4826 * np.median(r), 1e-9) * 1.345
            w = np.where(r <= s, 1.0, s / np.maximum(r, 1e-12))
        return c, d, r, q.T @ q

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, wall = pdf[["x", "y"]].to_numpy(), pdf.wall.iloc[0]
        if len(p) < least:
            return pd.DataFrame([[wall, *[None] * 4, len(p), *[None] * 9, 0.0, True]], columns=cols)
        c, d, r, v = fit(p)
        for _ in range(rounds):
            spread = 1.4826 * np.median(np.abs(r - np.median(r)))
            keep = r < np.clip(2.5 * spread, 0.02, 0.06)
            if keep.sum() < least or keep.all():
                break
            p = p[keep]
            c, d, r, v = fit(p)
        t = (p - c) @ d
        expected = (lengths or {}).get(int(wall), float(np.ptp(t)))
        sure = min(1.0, np.ptp(t) / max(0.6 * expected, 0.1)) * min(1.0, len(p) / max(expected / 0.03, 20))
        return pd.DataFrame([[wall, *c, *d, len(p), float(np.sqrt((r * r).mean())), float(r.mean()), *(c + t.min() * d), *(c + t.max() * d), v[0, 0], v[0, 1], v[1, 1], float(sure), False]], columns=cols)

    doubles = ["px", "py", "dx", "dy", "rmse", "residual", "x1", "y1", "x2", "y2", "vxx", "vxy", "vyy", "confidence"]
    cols = ["wall", *doubles[:4], "inliers", *doubles[4:], "fallback"]
    kinds = {"wall": "int", "inliers": "long", "fallback": "boolean"}
    return candidates.groupBy("wall").applyInPandas(run, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in cols))


def convex_hull(p: np.ndarray) -> np.ndarray:
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(points):
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1] - out[-2])[0] * (q - out[-1])[1] - (out[-1] - out[-2])[1] * (q - out[-1])[0] <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(list(p)) + half(list(p[::-1])))


def oriented_boxes(points: DataFrame, least: int = 10) -> DataFrame:
    """points(det_id, x, y, z) -> the upright box of least footprint: centre, yaw, sizes, grade. Under 3 points none;
    under `least` the axis-parallel box."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y", "z"]].to_numpy()
        if len(p) < 3:
            return pd.DataFrame(columns=cols)
        lo, hi = p.min(0), p.max(0)
        if len(p) < least:
            c, s, yaw, grade = (lo + hi) / 2, hi - lo, 0.0, "low"
        else:
            hull, best = convex_hull(p[:, :2]), None
            for a, b in zip(hull, np.roll(hull, -1, axis=0)):
                t = math.atan2(b[1] - a[1], b[0] - a[0])
                rot = np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
                q = hull @ rot.T
                e = np.ptp(q, axis=0)
                if best is None or e[0] * e[1] < best[0] - 1e-12:
                    best = (e[0] * e[1], t, e, rot.T @ ((q.min(0) + q.max(0)) / 2))
            _, yaw, e, mid = best
            if e[1] > e[0]:
                e, yaw = e[::-1], yaw + math.pi / 2
            c, s, grade = np.array([*mid, (lo[2] + hi[2]) / 2]), np.array([*e, hi[2] - lo[2]]), "high" if len(p) >= 30 else "medium"
        return pd.DataFrame([[pdf.det_id.iloc[0], *c, yaw, *np.maximum(s, 0.02), grade]], columns=cols)

    cols = ["det_id", "x", "y", "z", "yaw", "sx", "sy", "sz", "grade"]
    return points.groupBy("det_id").applyInPandas(run, "det_id long, " + ", ".join(f"{c} double" for c in cols[1:8]) + ", grade string")


def ceiling_slice(points: DataFrame, least_z: float = 1.5, width: float = 0.05, below: float = 0.30) -> DataFrame:
    """Points at or above the first height peak over least_z, less `below`; the fullest bin if there is no peak."""
    high = points.where(F.col("z") >= least_z)
    b = high.agg(F.min("z").alias("lo"), F.max("z").alias("hi")).withColumn("k", F.greatest(F.lit(8), F.ceil((F.col("hi") - F.col("lo")) / width)).cast("int"))
    at = F.least(F.floor((F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("k")), F.col("k") - 1).cast("int")
    n = high.join(F.broadcast(b)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row
    bins = b.select("lo", "hi", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin")).join(n, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bins = bins.withColumn("most", F.max("n").over(Window.partitionBy("lo")))
    peaks = local_maxima(bins, F.greatest(F.lit(3.0), 0.15 * F.col("most")), "lo")
    mid = lambda c: F.col("lo") + (F.col(c) + 0.5) * (F.col("hi") - F.col("lo")) / F.col("k")
    first = peaks.agg(F.min(mid("bin")).alias("z0"))
    best = bins.agg(F.max_by(mid("bin"), F.struct("n", -F.col("bin"))).alias("z1"))
    cut = first.join(best).select((F.coalesce("z0", "z1") - below).alias("cut"))
    return points.join(F.broadcast(cut)).where("z >= cut").drop("cut")  # one row


def simplify_ring(ring: np.ndarray, eps: float) -> np.ndarray:
    """Points of a closed ring that lie farther than eps from the chords between those kept."""

    def keep(p):
        if len(p) < 3:
            return [p[0]]
        a, d = p[0], p[-1] - p[0]
        size = np.linalg.norm(d)
        far = np.abs(d[0] * (p - a)[:, 1] - d[1] * (p - a)[:, 0]) / size if size > 1e-12 else np.linalg.norm(p - a, axis=1)
        i = int(far.argmax())
        return keep(p[: i + 1]) + keep(p[i:]) if far[i] > eps else [a]

    i = int(np.linalg.norm(ring - ring[0], axis=1).argmax())
    return np.array(keep(ring[: i + 1]) + keep(np.vstack([ring[i:], ring[:1]])))
