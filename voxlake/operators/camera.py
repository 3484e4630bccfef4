"""Pinhole camera with radial and tangential distortion, colour sampling and detection frustums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import apply_matrix
from .grid import GRAY


@dataclass(frozen=True)
class Camera:
    fx: float
    fy: float
    cx: float
    cy: float
    width: int
    height: int
    dist: tuple = (0.0, 0.0, 0.0, 0.0, 0.0)  # k1, k2, p1, p2, k3
    rotation: tuple = ((1, 0, 0), (0, 1, 0), (0, 0, 1))
    translation: tuple = (0, 0, 0)


def _step(points: DataFrame, *columns) -> DataFrame:
    """Columns computed once a row: a generator of one row, through which later filters and steps are not inlined."""
    return points.select("*", F.inline(F.array(F.struct(*columns))))


def project(points: DataFrame, cam: Camera) -> DataFrame:
    """points with u, v (null behind the camera) and depth."""
    xc, yc, zc = apply_matrix(cam.rotation, ("x", "y", "z"), cam.translation)
    p = _step(points, xc.alias("_xc"), yc.alias("_yc"), zc.alias("depth"))
    ok = F.col("depth") > 0
    p = _step(p, F.when(ok, F.col("_xc") / F.col("depth")).alias("_a"), F.when(ok, F.col("_yc") / F.col("depth")).alias("_b"))
    k1, k2, p1, p2, k3 = cam.dist
    a, b, r = F.col("_a"), F.col("_b"), F.col("_r")
    p = _step(p, (a * a + b * b).alias("_r"))
    radial = 1 + r * (k1 + r * (k2 + r * k3))
    u = cam.fx * (a * radial + 2 * p1 * a * b + p2 * (r + 2 * a * a)) + cam.cx
    v = cam.fy * (b * radial + p1 * (r + 2 * b * b) + 2 * p2 * a * b) + cam.cy
    return _step(p, u.alias("u"), v.alias("v")).drop("_xc", "_yc", "_a", "_b", "_r")


def in_image(cam: Camera):
    return (F.col("u") >= 0) & (F.col("u") < cam.width) & (F.col("v") >= 0) & (F.col("v") < cam.height)


def sample_colors(projected: DataFrame, pixels: DataFrame, cam: Camera) -> DataFrame:
    """projected(image_id, u, v, ...) with r, g, b in [0, 1] and has_color, from pixels(image_id, u, v, r, g, b of
    0 to 255) by an equi-join on the truncated pixel; unmatched points are gray."""
    at = projected.withColumns({"_u": F.when(in_image(cam), F.col("u").try_cast("int")), "_v": F.when(in_image(cam), F.col("v").try_cast("int"))})
    px = pixels.select(F.col("image_id").alias("_i"), F.col("u").alias("_pu"), F.col("v").alias("_pv"), *[(F.col(c) / 255.0).alias(f"_{c}") for c in "rgb"])
    out = at.join(px, (F.col("image_id") == F.col("_i")) & (F.col("_u") == F.col("_pu")) & (F.col("_v") == F.col("_pv")), "left")
    return out.withColumns({"has_color": F.col("_r").isNotNull(), **{c: F.coalesce(F.col(f"_{c}"), F.lit(GRAY)) for c in "rgb"}}).drop("_u", "_v", "_i", "_pu", "_pv", "_r", "_g", "_b")


def frustum_points(projected: DataFrame, boxes: DataFrame, cam: Camera, padding: float = 15.0, cell: int = 64) -> DataFrame:
    """Pairs of points and detections(det_id, x1, y1, x2, y2) whose padded box holds the pixel: boxes are exploded
    over the image tiles they touch, points join their tile."""
    tiles = lambda a, b, most: F.sequence(F.floor(F.greatest(a - padding, F.lit(0.0)) / cell), F.floor(F.least(b + padding, F.lit(float(most))) / cell))
    b = boxes.where((F.col("x2") + padding >= 0) & (F.col("y2") + padding >= 0) & (F.col("x1") - padding <= cam.width) & (F.col("y1") - padding <= cam.height))
    b = b.withColumn("_tx", F.explode(tiles(F.col("x1"), F.col("x2"), cam.width))).withColumn("_ty", F.explode(tiles(F.col("y1"), F.col("y2"), cam.height)))
    p = projected.where(in_image(cam)).withColumns({"_tx": F.floor(F.col("u") / cell), "_ty": F.floor(F.col("v") / cell)})
    inside = F.col("u").between(F.col("x1") - padding, F.col("x2") + padding) & F.col("v").between(F.col("y1") - padding, F.col("y2") + padding)
    return p.join(b, ["_tx", "_ty"]).where(inside).drop("_tx", "_ty", "x1", "y1", "x2", "y2")


def mask_points(projected: DataFrame, masks: DataFrame, cam: Camera, width: int, height: int) -> DataFrame:
    """Pairs of points and detections whose mask holds the point's pixel: masks(det_id, mx, my) are the cells that are on,
    of rasters of width by height over the whole image; an equi-join on the scaled, clipped cell."""
    cell = lambda c, size, full: F.least(F.greatest(F.floor(F.col(c) * (size / full)), F.lit(0)), F.lit(size - 1)).cast("int")
    p = projected.where(in_image(cam)).withColumns({"mx": cell("u", width, cam.width), "my": cell("v", height, cam.height)})
    return p.join(masks.select("det_id", F.col("mx").cast("int").alias("mx"), F.col("my").cast("int").alias("my")).distinct(), ["mx", "my"]).drop("mx", "my")


def depth_mad(points: DataFrame, key: str, value: str, scale: float = 3.0) -> DataFrame:
    """Rows within scale robust deviations of their key's median; keys of under 3 rows or without spread pass."""
    med = points.groupBy(key).agg(F.median(value).alias("med"), F.count(F.lit(1)).alias("cnt"))
    dev = points.join(med, key).withColumn("dev", F.abs(F.col(value) - F.col("med")))
    mad = dev.groupBy(key).agg(F.median("dev").alias("mad"))
    return dev.join(mad, key).where((F.col("cnt") < 3) | (F.col("mad") < 1e-6) | (F.col("dev") < scale * 1.4826 * F.col("mad"))).drop("med", "cnt", "dev", "mad")


def gravity(imu: DataFrame, n: int = 50) -> DataFrame:
    """Unit mean of the first n accelerations; +z where its size is no gravity's."""
    m = imu.orderBy("t").limit(n).agg(*[F.avg(c).alias(c) for c in ("ax", "ay", "az")])
    size = F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2)
    ok = F.coalesce(size.between(5, 15), F.lit(False))
    return m.select(*[F.when(ok, F.col(c) / size).otherwise(float(c == "az")).alias(g) for c, g in (("ax", "gx"), ("ay", "gy"), ("az", "gz"))])
