"""The map plan: colour from raw positions, then deskew, then pose, then voxels, outliers, levelling; one lazy plan but
for the widening search of outliers and the two scalars of levelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import camera as cam
from ..operators import grid, motion, planes
from ..operators.ordered import asof_nearest


def build_map(points: DataFrame, imu: DataFrame, poses: DataFrame, images: DataFrame | None = None, pixels: DataFrame | None = None, calibration: cam.Camera | None = None, voxel: float = 0.01, tolerance: float = 0.15, neighbours: int = 20, ratio: float = 2.0, level: bool = True) -> DataFrame:
    by = [c for c in ("bag_id",) if all(c in df.columns for df in (points, imu))]  # each bag has its own times
    if calibration is not None:
        key = "bag_id" if "bag_id" in points.columns and "bag_id" in images.columns else "one"
        timed = points.withColumns({"t": F.col("stamp") + F.col("t_off"), "one": F.lit(1)})
        match = asof_nearest(timed.select(key, "t").distinct(), images.withColumn("one", F.lit(1)).select(key, "t", "image_id"), key, "t", "image_id", tolerance)
        timed = timed.join(match.select(key, "t", F.col("match_id").alias("image_id")), [key, "t"], "left")
        points = cam.sample_colors(cam.project(timed, calibration), pixels, calibration).drop("t", "u", "v", "depth", "image_id", "one")
    else:
        points = points.withColumns({"has_color": F.lit(False), **{c: F.lit(grid.GRAY) for c in "rgb"}})
    world = motion.apply_poses(motion.deskew(points, imu, by=tuple(by)), poses)
    cloud = grid.voxel_color_mean(world, voxel).withColumn("point_id", grid.packed(F.col("vx"), F.col("vy"), F.col("vz"))).drop("vx", "vy", "vz", "n")
    cloud = cloud.join(grid.statistical_outliers(cloud.select("point_id", "x", "y", "z"), 3 * voxel, neighbours, ratio).select("point_id"), "point_id", "left_semi")
    if level and (floor := planes.detect_floor(cloud)) is not None:
        cloud = planes.level(cloud, floor[0])
    return cloud
