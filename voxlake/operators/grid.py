"""Voxel grids and neighbourhoods: equi-joins on packed cell keys instead of range joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

GRAY = 128 / 255


def cells(v: float, names=("vx", "vy", "vz"), of=("x", "y", "z"), origin=(0.0, 0.0, 0.0)) -> list[Column]:
    return [F.floor((F.col(c) - F.lit(float(o))) / v).cast("long").alias(n) for n, c, o in zip(names, of, origin)]


def packed(ix: Column, iy: Column, iz: Column) -> Column:
    """One long of three cell indices of 21 bits each."""
    off = 1 << 20
    return F.shiftleft(ix + off, 42) + F.shiftleft(iy + off, 21) + (iz + off)


def voxel_color_mean(points: DataFrame, v: float, gray: float = GRAY) -> DataFrame:
    """Mean position of all, mean colour of coloured points of a voxel; gray where there are none."""
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("has_color"), F.col(c))), F.lit(gray)).alias(c)
    return points.groupBy(*cells(v)).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), mean("r"), mean("g"), mean("b"), F.count(F.lit(1)).alias("n"), F.bool_or("has_color").alias("has_color"))


def voxel_color_priority(points: DataFrame, v: float) -> DataFrame:
    """Voxel means of the coloured points where there are any, else of the gray ones: the anti-join of gray cells
    against coloured ones in one aggregation."""
    some = F.bool_or("has_color")
    pick = lambda c: F.when(some, F.avg(F.when(F.col("has_color"), F.col(c)))).otherwise(F.avg(c)).alias(c)
    return points.groupBy(*cells(v)).agg(*[pick(c) for c in "xyz"], *[pick(c) for c in "rgb"], some.alias("has_color"))


def voxel_downsample(points: DataFrame, v: float) -> DataFrame:
    """Voxel means on a grid anchored half a voxel below the least coordinates."""
    lo = points.agg(*[F.min(c).alias(f"_{c}") for c in "xyz"])
    p = points.join(F.broadcast(lo))  # one row
    keys = [F.floor((F.col(c) - (F.col(f"_{c}") - v / 2)) / v).cast("long").alias(k) for c, k in zip("xyz", ("vx", "vy", "vz"))]
    return p.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("n"))


def voxel_coherence(points: DataFrame, v: float) -> DataFrame:
    """Distance of the gray and the coloured centroid of each voxel that has both."""
    on = F.col("has_color")
    parts = [F.avg(F.when(k, F.col(c))).alias(f"{c}{s}") for s, k in (("1", on), ("0", ~on)) for c in "xyz"]
    m = points.groupBy(*cells(v)).agg(*parts).where("x1 IS NOT NULL AND x0 IS NOT NULL")
    return m.select("vx", "vy", "vz", F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2 + (F.col("z1") - F.col("z0")) ** 2).alias("gap"))


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str) -> DataFrame:
    """Pairs of left and right points within radius: cells as wide as the radius, the left side exploded to its 27
    neighbour cells, an equi-join on the cell. Columns: left_id, right_id, d2 and right's columns as r_*."""
    near = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    around = F.array(*[F.struct(*[(k + d).cast("long").alias(n) for k, d, n in zip(cells(radius), o, ("vx", "vy", "vz"))]) for o in near])
    l = left.select(F.col(left_id), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"), F.inline(around))  # noqa: E741
    r = right.select(*cells(radius), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != right_id], F.col(right_id))
    d2 = (F.col("_x") - F.col("r_x")) ** 2 + (F.col("_y") - F.col("r_y")) ** 2 + (F.col("_z") - F.col("r_z")) ** 2
    return l.join(r, ["vx", "vy", "vz"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).drop("vx", "vy", "vz", "_x", "_y", "_z")


def knn(pairs: DataFrame, left_id: str, right_id: str, k: int) -> DataFrame:
    w = Window.partitionBy(left_id).orderBy("d2", right_id)
    return pairs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def idw_colors(gray: DataFrame, colored: DataFrame, radius: float, k: int = 8, least: int = 2) -> DataFrame:
    """Colours of gray points blended from their k nearest coloured ones within radius by inverse distance."""
    near = knn(radius_pairs(gray, colored, radius, "gray_id", "point_id"), "gray_id", "point_id", k).withColumn("w", 1 / (F.sqrt("d2") + 1e-3))
    blend = lambda c: (F.sum(F.col("w") * F.col(f"r_{c}")) / F.sum("w")).alias(c)
    return near.groupBy("gray_id").agg(blend("r"), blend("g"), blend("b"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


#: Points whose nearest ones are looked for in one pass over the cloud.
FEW = 1000


def _means_by_scan(points: DataFrame, few: list, k: int) -> DataFrame:
    """point_id, mean_d of up to FEW points: each task keeps the k least distances of each, which meet at the end."""
    at = [(r.x, r.y, r.z) for r in few]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        q, best = np.array(at), np.full((len(at), 0), np.inf)
        for b in batches:
            p = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1)
            for i in range(0, len(p), 2048):
                d = ((q[:, None, :] - p[None, i : i + 2048]) ** 2).sum(2)
                best = np.concatenate([best, d], 1)
                if best.shape[1] > k:
                    best = np.partition(best, k - 1, 1)[:, :k]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(at)), best.shape[1])), pa.array(best.ravel())], names=["i", "d2"])

    found = points.select("x", "y", "z").mapInArrow(run, "i long, d2 double")
    least = found.withColumn("_k", F.row_number().over(Window.partitionBy("i").orderBy("d2"))).where(F.col("_k") <= k).groupBy("i").agg(F.avg(F.sqrt("d2")).alias("mean_d"))
    names = points.sparkSession.createDataFrame([(k, r.point_id) for k, r in enumerate(few)], f"i long, point_id {points.schema['point_id'].dataType.simpleString()}")
    return least.join(F.broadcast(names), "i").select("point_id", "mean_d")  # FEW rows


def nearest_means(points: DataFrame, start: float, k: int) -> DataFrame:
    """point_id, mean_d: the mean distance of each point to its k nearest (itself counted; all where there are fewer).
    Points with fewer than k within the radius are searched again within twice the radius, from start on, until the k
    are proven; the last FEW of them, which may stand far from all others, by one pass over the cloud. Points without
    finite coordinates are left out."""
    points = stored(points.where(" AND ".join(f"abs({c}) < double('infinity')" for c in "xyz")).select("point_id", "x", "y", "z"))
    other = points.withColumnRenamed("point_id", "other_id")
    done, rest, radius = [], points, start
    while True:
        near = knn(radius_pairs(rest, other, radius, "point_id", "other_id"), "point_id", "other_id", k)
        near = stored(near.groupBy("point_id").agg(F.avg(F.sqrt("d2")).alias("mean_d"), F.count(F.lit(1)).alias("n")))
        done.append(near.where(F.col("n") >= k))
        rest = points.join(near.where(F.col("n") < k).select("point_id"), "point_id", "left_semi")
        few = rest.limit(FEW + 1).collect()
        if len(few) <= FEW:
            break
        radius *= 2
    if few:
        done.append(_means_by_scan(points, few, k))
    return reduce(DataFrame.unionByName, [d.select("point_id", "mean_d") for d in done])


def statistical_outliers(points: DataFrame, start: float, k: int, ratio: float) -> DataFrame:
    """Points whose mean distance to their k nearest (themselves counted) is at most the mean of all such means plus
    ratio standard deviations. The search for the k nearest starts within start and widens."""
    mean = nearest_means(points, start, k)
    all_ = mean.agg((F.avg("mean_d") + ratio * F.stddev_samp("mean_d")).alias("most"))
    return mean.join(F.broadcast(all_)).where("mean_d <= most").select("point_id", "mean_d")  # one row


def point_normals(points: DataFrame, radius: float, k: int = 30, least: int = 3) -> DataFrame:
    """point_id, nx, ny, nz: the direction in which the k nearest points within radius spread least; points with fewer
    than `least` neighbours (themselves counted) are left out. Moments are aggregates; only their matrices are solved."""
    other = points.select(F.col("point_id").alias("other_id"), "x", "y", "z")
    near = knn(radius_pairs(points, other, radius, "point_id", "other_id"), "point_id", "other_id", k)
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    moments = near.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(f"r_{a}", f"r_{b}").alias(a + b) for a, b in pairs]).where(F.col("n") >= least)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            m = {p + q: b.column(2 + i).to_numpy(zero_copy_only=False) for i, (p, q) in enumerate(pairs)}
            matrices = np.stack([np.stack([m[min(p, q) + max(p, q)] for q in "xyz"], 1) for p in "xyz"], 1)
            normal = np.linalg.eigh(matrices)[1][:, :, 0] if len(matrices) else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(normal[:, i])) for i in range(3)]], names=["point_id", "nx", "ny", "nz"])

    kind = points.schema["point_id"].dataType.simpleString()
    return moments.mapInArrow(run, f"point_id {kind}, nx double, ny double, nz double")


def is_colorized(tolerance: float = 1e-6, names=("r", "g", "b"), gray: float = GRAY) -> Column:
    """Whether a channel differs from gray by more than tolerance."""
    return reduce(lambda a, b: a | b, [F.abs(F.col(c) - gray) > tolerance for c in names])
