"""Streaming forms: voxel means kept up to date, images matched to scans, a call per micro-batch of frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import voxel_color_mean


def live_voxels(points: DataFrame, v: float) -> DataFrame:
    """voxel_color_mean of a stream; write it in update mode."""
    return voxel_color_mean(points, v)


def live_matches(scans: DataFrame, images: DataFrame, tolerance: float = 0.15, late: str = "1 second") -> DataFrame:
    """Pairs of scan(scan_id, ts) and image(image_id, its) rows at most tolerance seconds apart, as a stream join."""
    s, i = scans.withWatermark("ts", late), images.withWatermark("its", late)
    gap = F.expr(f"its BETWEEN ts - INTERVAL {tolerance} SECONDS AND ts + INTERVAL {tolerance} SECONDS")
    return s.join(i, gap)


def each_frame(frames: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands every micro-batch to call(batch, batch_id)."""
    return frames.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).start()
