"""Planes: bands, inlier votes of hypotheses, least-squares refits, detection of floors and rooms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import arc_to_z
from ..functions.polygon import signed_area
from ..storage import stored
from .floorplan import convex_hull
from .grid import packed, point_normals, voxel_downsample
from .quantile import percentiles


def plane_distance(n, d: float) -> Column:
    return F.col("x") * n[0] + F.col("y") * n[1] + F.col("z") * n[2] + d


def plane_rmse(points: DataFrame, n, d: float, band: float) -> DataFrame:
    dist = plane_distance(n, d)
    return points.where(F.abs(dist) < band).agg(F.sqrt(F.avg(dist * dist)).alias("rmse"), F.count(F.lit(1)).alias("inliers"))


def hypothesis_votes(points: DataFrame, planes: list[tuple[float, float, float, float]], band: float) -> DataFrame:
    """Inliers of each plane (a, b, c, d): one pass, one conditional count a plane, combined before the shuffle."""
    votes = points.agg(*[F.count_if(F.abs(plane_distance(p[:3], p[3])) < band).alias(str(k)) for k, p in enumerate(planes)])
    return votes.select(F.inline(F.array(*[F.struct(F.lit(k).alias("plane"), F.col(str(k)).alias("votes")) for k in range(len(planes))])))


def many_votes(points: DataFrame, planes: list[tuple[float, float, float, float]], band: float) -> DataFrame:
    """Inliers of each plane as hypothesis_votes, for any number of planes: a matrix product a block of points."""
    normal, offset = np.array([p[:3] for p in planes], float).T, np.array([p[3] for p in planes], float)

    def run(batches):
        import pyarrow as pa

        votes = np.zeros(len(offset), np.int64)
        for b in batches:
            p = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)], 1).astype(float)
            for i in range(0, len(p), 1024):
                votes += (np.abs(p[i : i + 1024] @ normal + offset) < band).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(votes), dtype=np.int32)), pa.array(votes)], names=["plane", "votes"])

    return points.select("x", "y", "z").mapInArrow(run, "plane int, votes long").groupBy("plane").agg(F.sum("votes").alias("votes"))


def detect_plane(points: DataFrame, band: float, hypotheses: int = 1000, seed: int = 0, sample: int = 2000):
    """The plane with most inliers among seeded three-point hypotheses from a bounded sample, refitted on its
    inliers by their moments: (unit normal, d, centroid, inliers), or None for under 3 points."""
    total = points.count()
    if total < 3:
        return None
    draw = points.select("x", "y", "z").orderBy(F.xxhash64("x", "y", "z", F.lit(seed))).limit(sample).collect()
    p = np.array(draw, float)
    rng = np.random.default_rng(seed)
    planes = []
    for _ in range(hypotheses):
        a, b, c = p[rng.choice(len(p), 3, replace=False)]
        n = np.cross(b - a, c - a)
        if (size := np.linalg.norm(n)) > 1e-9:
            n = n / size
            planes.append((*map(float, n), float(-n @ a)))
    if not planes:
        return None
    best = many_votes(points, planes, band).orderBy(F.col("votes").desc(), "plane").first()
    n, d = planes[best.plane][:3], planes[best.plane][3]
    inner = points.where(F.abs(plane_distance(n, d)) < band)
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    m = inner.agg(F.count(F.lit(1)).alias("k"), *[F.avg(c).alias(c) for c in "xyz"], *[F.covar_pop(a, b).alias(a + b) for a, b in pairs]).first()
    cov = np.array([[m[min(a, b) + max(a, b)] for b in "xyz"] for a in "xyz"])
    normal = np.linalg.eigh(cov)[1][:, 0]
    centre = np.array([m.x, m.y, m.z])
    return tuple(map(float, normal)), float(-normal @ centre), tuple(map(float, centre)), m.k


def detect_floor(points: DataFrame, band: float = 0.03, peels: int = 3, least: int = 100, seed: int = 0):
    """The first of up to `peels` planes within 45 degrees of the cloud's thinnest axis, its normal upwards."""
    e = points.agg(*[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).first()
    axis = min(range(3), key=lambda k: (e[k], k)) if e[0] is not None else 2
    rest = points
    for _ in range(peels):
        found = detect_plane(rest, band, seed=seed)
        if found is None or found[3] < least:
            return None
        n, d = found[0], found[1]
        if abs(n[axis]) > 0.5**0.5:
            if n[axis] < 0:
                n, d = tuple(-x for x in n), -d
            return n, d, found[2], found[3]
        rest = rest.where(F.abs(plane_distance(n, d)) >= band)
    return None


def level(points: DataFrame, normal, bins: int = 100) -> DataFrame:
    """Points turned so that normal points up, with the floor at z = 0: the fullest of equal bins in the lowest 30
    percent, the first on a tie."""
    r = arc_to_z(normal)
    turned = points.withColumns({c: sum((F.col(k) * v for k, v in zip("yz", row[1:])), F.col("x") * row[0]) for c, row in zip("xyz", r)})
    return turned.join(F.broadcast(histogram_floor(turned, bins))).withColumn("z", F.col("z") - F.col("floor_z")).drop("floor_z")  # one row


def histogram_floor(points: DataFrame, bins: int = 100) -> DataFrame:
    """floor_z: the middle of the fullest of equal z bins below the 1st percentile plus 30 % of the range, the first on
    a tie; the 1st percentile where 10 points or fewer lie there; null for an empty cloud."""
    spark, height = points.sparkSession, points.select("z")
    one = percentiles(height, "z", [0.0, 0.01, 1.0])
    floor = None
    if one:
        lo, p1, top = one
        low = height.where(F.col("z") < p1 + 0.3 * (top - lo))
        hi, n = low.agg(F.max("z"), F.count(F.lit(1))).first()
        floor = p1
        if n > 10:
            place = F.least(F.floor((F.col("z") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int") if hi > lo else F.lit(0)
            best = low.groupBy(place.alias("bin")).count().agg(F.max_by("bin", F.struct(F.col("count"), -F.col("bin"))).alias("bin")).first().bin
            floor = lo + (best + 0.5) * (hi - lo) / bins
    return spark.createDataFrame([(floor,)], "floor_z double")


def peel(points: DataFrame, band: float, most: int, least: int, seed: int = 0):
    """Yield up to `most` planes, each found among the points that those before left."""
    rest = points
    for k in range(most):
        found = detect_plane(rest, band, seed=seed + k)
        if found is None or found[3] < least:
            return
        yield found
        rest = rest.where(F.abs(plane_distance(found[0], found[1])) >= band)


def detect_room(points: DataFrame, voxel: float = 0.03, walls: int = 8, seed: int = 0) -> dict:
    """Floor (lowest level plane), ceiling (highest one over 1 m above it) and walls of a levelled cloud. Points of the
    downsampled cloud are parted by their normals; level and upright ones are peeled by themselves."""
    cloud = voxel_downsample(points, voxel).select(packed(F.col("vx"), F.col("vy"), F.col("vz")).alias("point_id"), "x", "y", "z")
    cloud = stored(cloud)
    out: dict = {"floor": None, "ceiling": None, "walls": []}
    if cloud.count() < 100:
        return out
    graded = stored(cloud.join(point_normals(cloud, 2 * voxel), "point_id").select("x", "y", "z", F.abs("nz").alias("tilt")))
    level_, upright = graded.where("tilt > 0.8"), graded.where("tilt < 0.3")
    if level_.count() > 100:
        flat = sorted(peel(level_, voxel, 5, 100, seed), key=lambda p: p[2][2])
        if flat:
            out["floor"] = flat[0]
            out["ceiling"] = max((p for p in flat[1:] if p[2][2] > flat[0][2][2] + 1.0), key=lambda p: p[2][2], default=None)
    if (n := upright.count()) > 100:
        out["walls"] = [p for p in peel(upright, 1.5 * voxel, walls, max(n // 100, 50), seed + 100) if abs(p[0][2]) <= 0.3]
    return out


def hull_area(points: DataFrame) -> float:
    """Area of the convex hull of x and y: each task keeps its own hull, whose corners meet at the end."""

    def run(batches):
        import pyarrow as pa

        held = np.zeros((0, 2))
        for b in batches:
            xy = np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)], 1)
            held = convex_hull(np.concatenate([held, xy[np.isfinite(xy).all(1)]]))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(held[:, k])) for k in range(2)], names=["x", "y"])

    corners = points.select(F.col("x").cast("double"), F.col("y").cast("double")).where("x IS NOT NULL AND y IS NOT NULL").mapInArrow(run, "x double, y double").collect()
    hull = convex_hull(np.array([tuple(r) for r in corners]).reshape(-1, 2))
    return abs(signed_area(hull)) if len(hull) > 2 else 0.0


def pick_ceiling(points: DataFrame, room: dict, band: float = 0.15, ratio: float = 1.25) -> tuple:
    """(ceiling, floor, whether they were swapped): the plane called floor is the ceiling if the hull of the points near
    it is larger by more than ratio, as furniture hides parts of a floor but not of a ceiling."""
    ceiling, floor = room["ceiling"], room["floor"]
    if ceiling is None or floor is None:
        return ceiling, floor, False
    above, below = (hull_area(points.where(F.abs(plane_distance(p[0], p[1])) < band)) for p in (ceiling, floor))
    return (floor, ceiling, True) if below > ratio * above else (ceiling, floor, False)
