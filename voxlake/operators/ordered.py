"""Operators on time-ordered rows: nearest matches, interval means, integrals, differences, gaps, fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_nearest(left: DataFrame, right: DataFrame, key: str, t: str, right_id: str, tolerance: float) -> DataFrame:
    """left rows with the id and time of the nearest right row of the same key within tolerance; the earlier on a
    tie, null if none. One union and two fills over a window; no range join."""
    cols = left.columns
    both = left.select(*cols, F.lit(None).cast(right.schema[right_id].dataType).alias("_id"), F.lit(1).alias("_o")).unionByName(right.select(key, t, F.col(right_id).alias("_id"), F.lit(0).alias("_o")), allowMissingColumns=True)
    r = F.when(F.col("_o") == 0, F.struct(F.col(t).alias("t"), F.col("_id").alias("id")))
    back = Window.partitionBy(key).orderBy(t, "_o").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(t, "_o").rowsBetween(0, Window.unboundedFollowing)
    m = both.withColumn("_b", F.last(r, True).over(back)).withColumn("_a", F.first(r, True).over(ahead)).where("_o = 1")
    db, da = F.col(t) - F.col("_b.t"), F.col("_a.t") - F.col(t)
    earlier = da.isNull() | (db <= da)
    near = F.when(earlier, F.col("_b")).otherwise(F.col("_a"))
    dt = F.when(earlier, db).otherwise(da)
    return m.select(*cols, F.when(dt <= tolerance, near["id"]).alias("match_id"), F.when(dt <= tolerance, near["t"]).alias("match_t"))


def interval_mean(frames: DataFrame, samples: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Mean of samples in [previous frame, frame), per frame with any."""
    both = frames.select(key, t, F.lit(None).cast("double").alias(value), F.lit(0).alias("_o")).unionByName(samples.select(key, t, F.col(value).cast("double").alias(value), F.lit(1).alias("_o")))
    # walking backwards, the last frame met strictly after a sample is the one whose interval holds it
    ahead = Window.partitionBy(key).orderBy(F.col(t).desc(), F.col("_o").desc()).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(key).orderBy(t, "_o").rowsBetween(Window.unboundedPreceding, 0)
    frame = F.when(F.col("_o") == 0, F.col(t))
    m = both.withColumn("frame", F.last(frame, True).over(ahead)).withColumn("_p", F.last(frame, True).over(behind)).where("_o = 1 AND frame IS NOT NULL AND _p IS NOT NULL")
    return m.groupBy(key, "frame").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def trapezoid(samples: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Running integral of value over t per key, 0 at the first sample."""
    w = Window.partitionBy(key).orderBy(t)
    area = (F.col(value) + F.lag(value).over(w)) / 2 * (F.col(t) - F.lag(t).over(w))
    return samples.withColumn("_a", F.coalesce(area, F.lit(0.0))).withColumn("integral", F.sum("_a").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_a")


def jerk(rows: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Norm of the third difference of values along order, and path length, per key; null for fewer than 4 rows."""
    w = Window.partitionBy(key).orderBy(order)
    third = [F.col(v) - 3 * F.lag(v).over(w) + 3 * F.lag(v, 2).over(w) - F.lag(v, 3).over(w) for v in values]
    first = [F.col(v) - F.lag(v).over(w) for v in values]
    size = lambda d: F.sqrt(sum((x * x for x in d[1:]), d[0] * d[0]))
    d = rows.select(key, size(third).alias("j"), size(first).alias("s"))
    return d.groupBy(key).agg(F.avg("j").alias("mean_jerk"), F.percentile("j", F.lit(0.95)).alias("p95_jerk"), F.sum("s").alias("length"))


def gap_runs(rows: DataFrame, key: str, t: str, gap: float, least: int, span: float) -> DataFrame:
    """Runs of rows without a step above gap, of at least `least` rows and span."""
    w = Window.partitionBy(key).orderBy(t)
    r = rows.withColumn("run", F.sum(F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(key, "run").agg(F.min(t).alias("lo"), F.max(t).alias("hi"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & (F.col("hi") - F.col("lo") >= span))


def previous_usable(frames: DataFrame, key: str, t: str, n: str, least: int) -> DataFrame:
    """The time of the last earlier frame with at least `least` points."""
    w = Window.partitionBy(key).orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("prev", F.last(F.when(F.col(n) >= least, F.col(t)), True).over(w))


def forward_fill(frames: DataFrame, key: str, t: str, value: str, valid) -> DataFrame:
    w = Window.partitionBy(key).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("filled", F.last(F.when(valid, F.col(value)), True).over(w))
