"""Motion correction, poses and map building over scans in long form: points(scan_id, point_idx, stamp, t_off, x, y, z)."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linalg import apply_matrix, quaternion, rotate_by_vector


def rotation_angles(points: DataFrame, imu: DataFrame, reference: str = "end", bucket: float = 1e-3, by: tuple[str, ...] = ()) -> DataFrame:
    """by, scan_id, bucket, wx, wy, wz: the integral of the angular rate from the bucket's time to the scan's reference.

    The rate between samples is linear, and none beyond them; from a bucket to a reference that both lie on one side of
    all samples, or with one sample alone, the nearest one's rate holds. A scan that no sample meets is left out. by names
    columns of both tables, such as the bag, whose samples belong together. Distinct buckets, not points, meet the samples:
    one union and a running sum per axis."""
    if reference not in ("start", "end"):
        raise ValueError("reference is start or end")
    by, axes = list(by), ("gx", "gy", "gz")
    scans = [*by, "scan_id"]
    buckets = points.select(*scans, "stamp", F.rint(F.col("t_off") / bucket).cast("long").alias("bucket"), "t_off")
    scan = buckets.groupBy(*scans, "stamp").agg(F.min("t_off").alias("lo"), F.max("t_off").alias("hi")).where("hi > lo")
    ref = (F.col("stamp") + F.col("hi" if reference == "end" else "lo")).alias("ref")
    ask = buckets.select(*scans, "bucket").distinct().join(scan, scans)
    times = ask.select(*scans, "bucket", (F.col("stamp") + F.col("bucket") * bucket).alias("t")).unionByName(scan.select(*scans, F.lit(None).cast("long").alias("bucket"), ref.alias("t")))
    own = by or [F.lit(1)]
    s = imu.select(*by, "t", *axes).groupBy(*by, "t").agg(*[F.avg(c).alias(c) for c in axes])
    w = Window.partitionBy(*own).orderBy("t")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({f"{c}2": F.lead(c).over(w) for c in ("t", *axes)})
    s = s.withColumns({f"i{c}": F.coalesce(F.sum((F.col(c) + F.col(f"{c}2")) / 2 * (F.col("t2") - F.col("t"))).over(before), F.lit(0.0)) for c in axes})
    state = F.struct("t", "t2", *[x for c in axes for x in (c, f"{c}2", f"i{c}")])
    none = F.lit(None).cast(s.select(state.alias("s")).schema["s"].dataType)
    null = F.lit(None).cast("long")
    kind = points.schema["scan_id"].dataType
    both = times.select(*scans, "t", F.lit(1).alias("kind"), "bucket", none.alias("s")).unionByName(s.select(*by, F.lit(None).cast(kind).alias("scan_id"), "t", F.lit(0).alias("kind"), null.alias("bucket"), state.alias("s")))
    at = both.withColumn("s", F.last("s", True).over(Window.partitionBy(*own).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))).where("kind = 1")
    ahead = F.when(F.col("s.t2").isNotNull(), F.least(F.col("t"), F.col("s.t2")) - F.col("s.t")).otherwise(F.when(F.col("s").isNotNull(), F.lit(0.0)))
    theta = []
    for k, c in enumerate(axes):
        slope = F.coalesce((F.col(f"s.{c}2") - F.col(f"s.{c}")) / (F.col("s.t2") - F.col("s.t")), F.lit(0.0))
        theta.append(F.coalesce(F.col(f"s.i{c}") + ahead * F.col(f"s.{c}") + slope * ahead * ahead / 2, F.lit(0.0)).alias(f"th{k}"))
    at = at.select(*scans, "bucket", "t", *theta)
    end = at.where("bucket IS NULL").select(*scans, F.col("t").alias("ref"), *[F.col(f"th{k}").alias(f"end{k}") for k in range(3)])
    rates = [f(F.struct(*axes), F.col("t")).alias(n) for f, n in ((F.min_by, "first"), (F.max_by, "last"))]
    span = imu.groupBy(*by).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), *rates).where("t0 IS NOT NULL")  # a row a bag
    met = (scan.join(span, by) if by else scan.join(F.broadcast(span))).where((F.col("stamp") + F.col("lo") <= F.col("t1")) & (F.col("stamp") + F.col("hi") >= F.col("t0"))).select(*scans, "t0", "t1", "first", "last")
    rows = at.where("bucket IS NOT NULL").join(end, scans).join(met, scans)
    early, late = F.greatest("t", "ref") <= F.col("t0"), F.least("t", "ref") >= F.col("t1")
    turn = lambda k, c: F.when(early, F.col("first")[c] * (F.col("ref") - F.col("t"))).when(late | (F.col("t0") == F.col("t1")), F.col("last")[c] * (F.col("ref") - F.col("t"))).otherwise(F.col(f"end{k}") - F.col(f"th{k}"))
    return rows.select(*scans, "bucket", *[turn(k, c).alias(n) for k, (c, n) in enumerate(zip(axes, ("wx", "wy", "wz")))])


def deskew(points: DataFrame, imu: DataFrame, reference: str = "end", bucket: float = 1e-3, by: tuple[str, ...] = ()) -> DataFrame:
    """Points as if all were measured at the scan's reference time. Scans that no sample meets, and scans whose
    points share one time, stay as they are; unmet_scans tells the former."""
    turn = rotation_angles(points, imu, reference, bucket, by)
    p = points.withColumn("bucket", F.rint(F.col("t_off") / bucket).cast("long")).join(turn, [*by, "scan_id", "bucket"], "left")
    x, y, z = rotate_by_vector(("x", "y", "z"), tuple(-F.coalesce(F.col(c), F.lit(0.0)) for c in ("wx", "wy", "wz")))
    return p.withColumns({"_x": x, "_y": y, "_z": z}).select(*[F.col(f"_{c}").alias(c) if c in "xyz" else F.col(c) for c in points.columns])


def unmet_scans(points: DataFrame, imu: DataFrame, by: tuple[str, ...] = ()) -> int:
    """Scans that no sample meets, which deskew leaves raw; warns if there are any."""
    by = list(by)
    scan = points.groupBy(*by, "scan_id", "stamp").agg(F.min("t_off").alias("lo"), F.max("t_off").alias("hi"))
    span = imu.groupBy(*by).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    both = scan.join(span, by, "left") if by else scan.join(F.broadcast(span))  # one row
    n = both.where(~F.coalesce((F.col("stamp") + F.col("lo") <= F.col("t1")) & (F.col("stamp") + F.col("hi") >= F.col("t0")), F.lit(False))).count()
    if n:
        warnings.warn(f"imu samples missing for deskew of {n} scans, which stay raw", stacklevel=2)
    return n


def deskew_kernel(t_off: np.ndarray, xyz: np.ndarray, stamp: float, imu_t: np.ndarray, gyro: np.ndarray, reference: str = "end", bucket: float = 1e-3) -> np.ndarray:
    """One scan in memory, the same definition: for grouped kernels and for measuring the arithmetic alone."""
    if reference not in ("start", "end"):
        raise ValueError("reference is start or end")
    if not len(t_off):
        return xyz
    if not len(imu_t) or stamp + t_off.min() > imu_t[-1] or stamp + t_off.max() < imu_t[0]:
        warnings.warn("imu samples missing for deskew, the scan stays raw", stacklevel=2)
        return xyz
    if np.ptp(t_off) == 0:
        return xyz
    area = np.concatenate([np.zeros((1, 3)), np.cumsum((gyro[1:] + gyro[:-1]) / 2 * np.diff(imu_t)[:, None], 0)])
    k, inv = np.unique(np.rint(t_off / bucket), return_inverse=True)

    def theta(t):
        t = np.clip(t, imu_t[0], imu_t[-1])
        i = np.clip(np.searchsorted(imu_t, t, side="right") - 1, 0, max(len(imu_t) - 2, 0))
        h = t - imu_t[i]
        if len(imu_t) == 1:
            return np.zeros((len(t), 3))
        slope = (gyro[i + 1] - gyro[i]) / (imu_t[i + 1] - imu_t[i])[:, None]
        return area[i] + gyro[i] * h[:, None] + slope * (h * h / 2)[:, None]

    end = stamp + (t_off.max() if reference == "end" else t_off.min())
    t = stamp + k * bucket
    w = theta(np.array([end])) - theta(t)
    early, late = np.maximum(t, end) <= imu_t[0], np.minimum(t, end) >= imu_t[-1]
    if len(imu_t) == 1:
        early = np.ones(len(t), bool)
    w = -np.where(early[:, None], gyro[:1] * (end - t)[:, None], np.where(late[:, None], gyro[-1:] * (end - t)[:, None], w))
    a = np.linalg.norm(w, axis=1, keepdims=True)
    u = (w / np.where(a > 0, a, 1))[inv]
    a = a[inv]
    return xyz * np.cos(a) + np.cross(u, xyz) * np.sin(a) + u * (u * xyz).sum(1, keepdims=True) * (1 - np.cos(a))


def apply_poses(points: DataFrame, poses: DataFrame) -> DataFrame:
    """points in the frame of poses(scan_id, r00..r22, tx, ty, tz); every scan must have its pose."""
    p = points.join(poses, "scan_id", "left")
    r = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    x, y, z = apply_matrix(r, ("x", "y", "z"), (F.col("tx"), F.col("ty"), F.col("tz")))
    x = F.when(F.col("r00").isNull(), F.raise_error(F.lit("a scan has no pose")).cast("double")).otherwise(x)
    return p.withColumns({"_x": x, "_y": y, "_z": z}).select(*[F.col(f"_{c}").alias(c) if c in "xyz" else F.col(c) for c in points.columns])


def trajectory(poses: DataFrame, scans: DataFrame) -> DataFrame:
    """timestamp, x, y, z, qw, qx, qy, qz as text with six places, in scan order."""
    q = quaternion([f"r{i}{j}" for i in range(3) for j in range(3)])
    p = poses.join(scans.select("scan_id", "stamp"), "scan_id").withColumns(dict(zip(("qw", "qx", "qy", "qz"), q)))
    return p.orderBy("scan_id").select(*[F.format_string("%.6f", c).alias(n) for c, n in (("stamp", "timestamp"), ("tx", "x"), ("ty", "y"), ("tz", "z"), ("qw", "qw"), ("qx", "qx"), ("qy", "qy"), ("qz", "qz"))])


def write_trajectory(poses: DataFrame, scans: DataFrame, path: str) -> None:
    """The trajectory as one CSV file with a header, in a folder at path; a row a scan."""
    trajectory(poses, scans).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def diverged(poses: DataFrame, most: float = 100.0) -> DataFrame:
    """One row: whether a pose is not finite or the extent passes most."""
    bad = F.lit(False)
    for c in ("tx", "ty", "tz"):
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    e = [F.max(c) - F.min(c) > most for c in ("tx", "ty", "tz")]
    return poses.agg(F.coalesce(F.bool_or(bad) | e[0] | e[1] | e[2], F.lit(False)).alias("diverged"))


_AROUND = np.array([(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])


class NearGrid:
    """Points in cells of the search radius, sorted by cell: neighbours of many points at once."""

    def __init__(self, target: np.ndarray, reach: float):
        self.target, self.reach = target, reach
        self.low = np.floor(target.min(0) / reach).astype(np.int64) - 2
        self.span = np.floor(target.max(0) / reach).astype(np.int64) - self.low + 3
        self.order = np.argsort(self._key(np.floor(target / reach).astype(np.int64)), kind="stable")
        self.keys = self._key(np.floor(target[self.order] / reach).astype(np.int64))

    def _key(self, cell: np.ndarray) -> np.ndarray:
        c = cell - self.low
        key = (c[..., 0] * self.span[1] + c[..., 1]) * self.span[2] + c[..., 2]
        return np.where(((c >= 0) & (c < self.span)).all(-1), key, -1)

    def pairs(self, source: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index in source, index in target) of the k nearest within reach, by source and then distance."""
        out = []
        for at in range(0, len(source), 4096):
            p = source[at : at + 4096]
            key = self._key(np.floor(p / self.reach).astype(np.int64)[:, None, :] + _AROUND[None])
            lo, hi = np.searchsorted(self.keys, key, side="left"), np.searchsorted(self.keys, key, side="right")
            n = np.where(key >= 0, hi - lo, 0).ravel()
            i = np.repeat(np.repeat(np.arange(len(p)), len(_AROUND)), n)
            j = self.order[np.repeat(lo.ravel() - np.cumsum(n) + n, n) + np.arange(n.sum())]
            d = ((p[i] - self.target[j]) ** 2).sum(1)
            near = d <= self.reach * self.reach
            i, j, d = i[near], j[near], d[near]
            by = np.lexsort((j, d, i))
            i, j = i[by], j[by]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((i[first] + at, j[first]))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def normals_of(points: np.ndarray, reach: float, k: int = 12) -> np.ndarray:
    """Unit directions of least spread of each point's k nearest, zero for under 3."""
    i, j = NearGrid(points, reach).pairs(points, k)
    n = np.bincount(i, minlength=len(points))
    at = np.cumsum(n) - n
    mean = np.add.reduceat(points[j], at) / n[:, None]  # every point is its own neighbour
    q = points[j] - mean[i]
    spread = np.add.reduceat(q[:, :, None] * q[:, None, :], at)
    out = np.linalg.eigh(spread)[1][:, :, 0]
    out[n < 3] = 0
    return out


def align_scan(source: np.ndarray, target: np.ndarray, guess: np.ndarray, voxel: float = 0.1, rounds: int = 30):
    """Point-to-plane alignment of a scan to a map: pose, fitness, success. Correspondences within 3 voxels through
    a grid; under 10 points give the guess."""
    if len(source) < 10 or len(target) < 10:
        return guess, 0.0, False
    grid, normals = NearGrid(target, 3 * voxel), normals_of(target, 3 * voxel)
    pose, fitness = guess.copy(), 0.0
    for _ in range(rounds):
        moved = source @ pose[:3, :3].T + pose[:3, 3]
        i, j = grid.pairs(moved, 1)
        fitness = len(i) / len(source)
        if len(i) < 6:
            break
        a = np.hstack([np.cross(moved[i], normals[j]), normals[j]])
        b = ((target[j] - moved[i]) * normals[j]).sum(1)
        step = np.linalg.lstsq(a, b, rcond=None)[0]
        t = np.linalg.norm(step[:3])
        k = step[:3] / t if t > 0 else np.array([0, 0, 1.0])
        s = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        r = np.eye(3) + np.sin(t) * s + (1 - np.cos(t)) * s @ s
        pose = np.vstack([np.hstack([r @ pose[:3, :3], (r @ pose[:3, 3] + step[3:])[:, None]]), [0, 0, 0, 1]])
        if np.abs(step).max() < 1e-6:
            break
    return pose, fitness, fitness > 0.1


POSE_SCHEMA = "bag_id long, scan_id long, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)) + ", tx double, ty double, tz double"


def estimate_poses(points: DataFrame, voxel: float = 0.1) -> DataFrame:
    """Scan-to-map odometry of points(bag_id, scan_id, x, y, z): state runs along a bag, bags run in parallel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pose, rows = np.eye(4), []
        seen = None
        for scan_id, g in pdf.sort_values("scan_id").groupby("scan_id"):
            xyz = g[["x", "y", "z"]].to_numpy()
            key = np.unique(np.floor(xyz / voxel).astype(int), axis=0, return_index=True)[1]
            xyz = xyz[np.sort(key)]
            if seen is not None:
                pose = align_scan(xyz, seen, pose, voxel)[0]
            world = xyz @ pose[:3, :3].T + pose[:3, 3]
            seen = world if seen is None else np.vstack([seen, world])
            seen = seen[np.sort(np.unique(np.floor(seen / voxel).astype(int), axis=0, return_index=True)[1])]
            rows.append([pdf.bag_id.iloc[0], scan_id, *pose[:3, :3].ravel(), *pose[:3, 3]])
        return pd.DataFrame(rows, columns=[c.split()[0] for c in POSE_SCHEMA.split(", ")])

    return points.groupBy("bag_id").applyInPandas(run, POSE_SCHEMA)
