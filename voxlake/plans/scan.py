"""A whole scan: poses by the first estimator that holds, the map, the trajectory and what happened."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grid, metrics, motion
from ..operators.camera import Camera
from ..storage import stored
from .backends import get_backend
from .build_map import build_map


def run(points: DataFrame, imu: DataFrame, images: DataFrame | None = None, pixels: DataFrame | None = None, calibration: Camera | None = None, estimators: tuple[str, ...] = ("deskewed_scan_to_map", "scan_to_map"), voxel: float = 0.005, per_frame=None, **options) -> tuple[DataFrame, DataFrame, dict]:
    """points(bag_id, scan_id, point_idx, stamp, t_off, x, y, z) of one bag -> (map, poses, stats). An estimator that
    fails, diverges or leaves out a scan gives way to the next. per_frame is called with (scan_id, stamp, pose) in order."""
    began, scans = time.time(), points.select("scan_id").distinct().count()
    poses, used, tried = None, None, {}
    for name in estimators:
        try:
            found = stored(get_backend(name)(points, imu))
            if (n := found.count()) != scans:
                raise ValueError(f"{n} poses for {scans} scans")
            if motion.diverged(found).first().diverged:
                raise ValueError("the trajectory diverged")
            poses, used = found, name
            break
        except Exception as e:  # whatever an estimator fails with, the next one is tried and the cause kept
            tried[name] = str(e).splitlines()[0][:200] if str(e) else type(e).__name__
    if poses is None:
        raise RuntimeError(f"no estimator held: {tried}")
    posed = time.time()
    if per_frame:
        stamps = points.groupBy("scan_id").agg(F.first("stamp").alias("stamp"))
        for r in poses.join(stamps, "scan_id").orderBy("scan_id").toLocalIterator():
            per_frame(r.scan_id, r.stamp, r)
    cloud = stored(build_map(points, imu, poses.drop("bag_id"), images, pixels, calibration, voxel=voxel, **options))
    share = cloud.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("has_color").cast("int")).alias("c")).first()
    stats = {"backend": used, "gave_way": tried, "scans": scans, "points": share.n, "colorized_fraction": share.c, "pose_seconds": round(posed - began, 3), "seconds": round(time.time() - began, 3)}
    return cloud, poses, stats


def all_metrics(cloud: DataFrame, poses: DataFrame) -> dict:
    """Every measure of a map and its trajectory in one flat row."""
    found = metrics.wall_rmse(cloud)
    one = {"wall_rmse_m": sum(found) / len(found) if found else None, "n_walls": len(found)}
    one |= dict(zip(("floor_rmse_m", "floor_inliers"), metrics.floor_measure(cloud)))
    one |= metrics.coherence(cloud.where(grid.is_colorized()).withColumn("has_color", F.lit(True)).unionByName(cloud.where(~grid.is_colorized()).withColumn("has_color", F.lit(False)))).first().asDict()
    from ..operators.ordered import jerk

    path = jerk(poses.withColumn("one", F.lit(1)), "one", "scan_id", "tx", "ty", "tz").first()
    one |= {"mean_jerk": path.mean_jerk, "p95_jerk": path.p95_jerk, "trajectory_length_m": path.length} if path else {"mean_jerk": None, "p95_jerk": None, "trajectory_length_m": None}
    return one
