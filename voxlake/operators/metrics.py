"""Quality measures of clouds and trajectories as one-row frames, joined to one flat row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import voxel_coherence
from ..storage import stored
from .planes import detect_plane, plane_distance, plane_rmse
from .quantile import percentiles


def extent(points: DataFrame) -> DataFrame:
    return points.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))], F.count(F.lit(1)).alias("n"))


def color_share(points: DataFrame) -> DataFrame:
    return points.agg(F.count(F.lit(1)).alias("n_points"), F.avg(F.col("has_color").cast("int")).alias("colorized_fraction"))


def coherence(points: DataFrame, v: float = 0.03) -> DataFrame:
    gaps = stored(voxel_coherence(points, v))
    p95 = (percentiles(gaps, "gap", [0.95]) or [None])[0]
    return gaps.agg(F.avg("gap").alias("coherence_mean"), F.lit(p95).cast("double").alias("coherence_p95"), F.count(F.lit(1)).alias("mixed_voxels"))


def wall_rmse(points: DataFrame, band: float = 0.05, walls: int = 3, attempts: int = 15, least: int = 2000) -> list[float]:
    """RMSE of up to `walls` upright planes, peeled off one after the other."""
    out, rest = [], points
    for k in range(attempts):
        found = detect_plane(rest, band, seed=k)
        if found is None or len(out) == walls:
            break
        n, d = found[0], found[1]
        if abs(n[2]) <= 0.5 and found[3] >= least:
            dist = plane_distance(n, d)
            out.append(rest.where(F.abs(dist) < band).agg(F.sqrt(F.avg(dist * dist)).alias("e")).first().e)
        rest = rest.where(F.abs(plane_distance(n, d)) >= band)
    return out


def floor_measure(points: DataFrame, band: float = 0.05, least: int = 1000) -> tuple[float | None, int]:
    """RMSE and inliers of the largest plane if it lies within 30 degrees of level; (None, 0) for a cloud of under
    `least` points or another plane."""
    if points.limit(least).count() < least:
        return None, 0
    found = detect_plane(points, band)
    if found is None or abs(found[0][2]) < 3**0.5 / 2:
        return None, 0
    r = plane_rmse(points, found[0], found[1], band).first()
    return r.rmse, r.inliers


def floor_flatness(points: DataFrame, band: float = 0.05) -> float | None:
    """RMSE of the largest plane if it lies within 30 degrees of level."""
    return floor_measure(points, band, 3)[0]


def as_json(row: DataFrame) -> DataFrame:
    return row.select(F.to_json(F.struct(*row.columns)).alias("json"))
