"""Levelling of stored clouds, once: a comment in the file's header tells that it was done."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from ..operators.planes import detect_floor, histogram_floor, level
from ..sources.ply import comments_of, decode, read_ply, write_ply
from ..storage import load_file, save_file, stored

MARK = "floor_leveled"


def level_points(points: DataFrame, band: float = 0.03, seed: int = 0) -> tuple[DataFrame, float, float]:
    """The cloud turned and shifted to its floor, the turn in degrees and the shift. Fails without a level plane."""
    found = detect_floor(points, band, seed=seed)
    if found is None:
        raise ValueError("no level plane")
    normal = found[0]
    turned = stored(level(points, normal))
    return turned, math.degrees(math.acos(max(-1.0, min(1.0, normal[2])))), -(histogram_floor(turned).first().floor_z or 0.0)


def level_ply(spark: SparkSession, source: str, target: str, band: float = 0.03) -> bool:
    """Write the levelled cloud of a file with all its properties and comments, or a copy if the file is marked; returns
    whether it was levelled now."""
    comments = comments_of(spark, source)
    if any(c.startswith(MARK) for c in comments):
        if source != target:
            save_file(spark, target, load_file(spark, source))
        return False
    names = list(decode(load_file(spark, source))[0].dtype.names)
    points = stored(read_ply(spark, source, names))
    turned, degrees, shift = level_points(points, band)
    write_ply(turned, target, names, [*comments, f"{MARK} rotation_deg={degrees:.2f} z_shift={shift:.4f}"])
    return True
