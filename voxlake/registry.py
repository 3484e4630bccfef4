"""Registered queries: each operator on the driver's tables, and the same in SQL.

Stand-ins: `embeddings` as points (first three components), `events` as timed samples, `lineitem` as a large cloud.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.binning import bin_of, local_maxima, peaks, top_peaks
from .functions.linalg import apply_matrix, arc_to_z, norm, yaw
from .operators import camera as cam
from .operators import floorplan as fp
from .operators import grid, layout, metrics, motion, ordered, planes, raster
from .operators.quantile import percentiles
from .plans import floor_plan, layouts
from .sources.calibration import camera

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("label"), *[e[k].cast("double").alias(c) for k, c in enumerate("xyz")], (F.col("label") % 2 == 0).alias("has_color"), *[(F.col("label") / 10.0).alias(c) for c in "rgb"])


PTS = "WITH pts AS (SELECT vec_id AS point_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label % 2 = 0 AS has_color, label / 10.0e0 AS r FROM embeddings)"


def samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


EV = "WITH ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t FROM events)"


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(PTS + """ SELECT CAST(floor(x / 0.1) AS BIGINT) AS vx, CAST(floor(y / 0.1) AS BIGINT) AS vy, CAST(floor(z / 0.1) AS BIGINT) AS vz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z,
  round(coalesce(avg(r) FILTER (has_color), 128 / 255.0e0), 6) AS r, count(*) AS n, bool_or(has_color) AS has_color FROM pts GROUP BY 1, 2, 3""")
def voxel_color_mean(spark, d):
    return r6(grid.voxel_color_mean(points(spark, d), 0.1).drop("g", "b"), "x", "y", "z", "r")


@query(PTS + """, c AS (SELECT *, CAST(floor(x / 0.1) AS BIGINT) AS vx, CAST(floor(y / 0.1) AS BIGINT) AS vy, CAST(floor(z / 0.1) AS BIGINT) AS vz FROM pts),
 k AS (SELECT * FROM c WHERE has_color UNION ALL SELECT * FROM c g WHERE NOT has_color AND NOT EXISTS (SELECT 1 FROM c o WHERE o.has_color AND o.vx = g.vx AND o.vy = g.vy AND o.vz = g.vz))
 SELECT vx, vy, vz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(avg(r), 6) AS r, bool_or(has_color) AS has_color FROM k GROUP BY 1, 2, 3""")
def voxel_color_priority(spark, d):
    return r6(grid.voxel_color_priority(points(spark, d), 0.1).drop("g", "b"), "x", "y", "z", "r")


@query(PTS + """, m AS (SELECT min(x) AS mx, min(y) AS my, min(z) AS mz FROM pts)
 SELECT CAST(floor((x - (mx - 0.05)) / 0.1) AS BIGINT) AS vx, CAST(floor((y - (my - 0.05)) / 0.1) AS BIGINT) AS vy, CAST(floor((z - (mz - 0.05)) / 0.1) AS BIGINT) AS vz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM pts, m GROUP BY 1, 2, 3""")
def voxel_downsample(spark, d):
    return r6(grid.voxel_downsample(points(spark, d), 0.1), "x", "y", "z")


@query(PTS + """, v AS (SELECT floor(x / 0.3) AS vx, floor(y / 0.3) AS vy, floor(z / 0.3) AS vz, avg(x) FILTER (has_color) AS a, avg(y) FILTER (has_color) AS b, avg(z) FILTER (has_color) AS c, avg(x) FILTER (NOT has_color) AS e, avg(y) FILTER (NOT has_color) AS f, avg(z) FILTER (NOT has_color) AS g FROM pts GROUP BY 1, 2, 3),
 gaps AS (SELECT sqrt((a - e) ** 2 + (b - f) ** 2 + (c - g) ** 2) AS gap FROM v WHERE a IS NOT NULL AND e IS NOT NULL)
 SELECT round(avg(gap), 6) AS coherence_mean, round(quantile_cont(gap, 0.95), 6) AS coherence_p95, count(*) AS mixed_voxels FROM gaps""")
def voxel_coherence(spark, d):
    return r6(metrics.coherence(points(spark, d), 0.3), "coherence_mean", "coherence_p95")


@query(PTS + """ SELECT point_id, ((CAST(floor(x / 0.1) AS BIGINT) + 1048576) << 42) + ((CAST(floor(y / 0.1) AS BIGINT) + 1048576) << 21) + (CAST(floor(z / 0.1) AS BIGINT) + 1048576) AS key FROM pts""")
def voxel_key(spark, d):
    return points(spark, d).select("point_id", *grid.cells(0.1)).select("point_id", grid.packed(F.col("vx"), F.col("vy"), F.col("vz")).alias("key"))


_TOL = 3 * 86400.0


@query(EV + f""", p AS (SELECT * FROM ev WHERE event_type = 'purchase'), c AS (SELECT * FROM ev WHERE event_type = 'click'),
 m AS (SELECT p.event_id, c.event_id AS match_id, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - c.t), c.t) AS k FROM p JOIN c ON p.user_id = c.user_id AND abs(p.t - c.t) <= {_TOL})
 SELECT p.event_id, m.match_id FROM p LEFT JOIN m ON p.event_id = m.event_id AND k = 1""")
def asof_nearest_image(spark, d):
    s = samples(spark, d)
    left, right = s.where("event_type = 'purchase'").select("event_id", "user_id", "t"), s.where("event_type = 'click'").select(F.col("event_id").alias("image_id"), "user_id", "t")
    return ordered.asof_nearest(left, right, "user_id", "t", "image_id", _TOL).select("event_id", "match_id")


@query(EV + """, f AS (SELECT DISTINCT user_id, t AS frame, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS prev FROM ev WHERE event_type = 'purchase')
 SELECT f.user_id, round(frame, 6) AS frame, round(avg(value), 6) AS mean, count(*) AS n FROM f JOIN ev s ON s.user_id = f.user_id AND s.event_type = 'click' AND s.t >= prev AND s.t < frame GROUP BY 1, 2""")
def asof_interval_mean(spark, d):
    s = samples(spark, d)
    return r6(ordered.interval_mean(s.where("event_type = 'purchase'"), s.where("event_type = 'click'"), "user_id", "t", "value"), "mean", "frame")


@query(EV + " SELECT CAST(round_even(value / 0.4, 0) AS BIGINT) AS bucket, count(*) AS n FROM ev GROUP BY 1")
def time_bucket_half_even(spark, d):
    return samples(spark, d).groupBy(F.rint(F.col("value") / 0.4).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(EV + """, a AS (SELECT *, coalesce((value + lag(value) OVER w) / 2 * (t - lag(t) OVER w), 0) AS area FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t))
 SELECT event_id, round(sum(area) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) / 86400, 3) AS integral FROM a""")
def trapezoid_integral(spark, d):
    return ordered.trapezoid(samples(spark, d), "user_id", "t", "value").select("event_id", F.round(F.col("integral") / 86400, 3).alias("integral"))


_THIRD = " + ".join(f"({c} - 3 * lag({c}) OVER o + 3 * lag({c}, 2) OVER o - lag({c}, 3) OVER o) ** 2" for c in "xyz")
_FIRST = " + ".join(f"({c} - lag({c}) OVER o) ** 2" for c in "xyz")


@query(PTS + f""", w AS (SELECT label, sqrt({_THIRD}) AS j, sqrt({_FIRST}) AS s FROM pts WINDOW o AS (PARTITION BY label ORDER BY point_id))
 SELECT label, round(avg(j), 6) AS mean_jerk, round(quantile_cont(j, 0.95), 6) AS p95_jerk, round(sum(s), 6) AS length FROM w GROUP BY 1""")
def trajectory_jerk(spark, d):
    return r6(ordered.jerk(points(spark, d), "label", "point_id", "x", "y", "z"), "mean_jerk", "p95_jerk", "length")


@query(EV + """, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 43200 THEN 1 ELSE 0 END AS brk FROM ev),
 r AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM g)
 SELECT user_id, CAST(run AS BIGINT) AS run, round(min(t), 6) AS lo, round(max(t), 6) AS hi, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 3 AND max(t) - min(t) >= 60""")
def gap_split(spark, d):
    return r6(ordered.gap_runs(samples(spark, d), "user_id", "t", 43200, 3, 60.0).withColumn("run", F.col("run").cast("long")), "lo", "hi")


@query(EV + """ SELECT event_id, max(CASE WHEN value >= 50 THEN round(t, 6) END) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ev""")
def previous_frame_stamp(spark, d):
    return r6(ordered.previous_usable(samples(spark, d), "user_id", "t", "value", 50).select("event_id", "prev"), "prev")


@query(EV + """ SELECT event_id, last_value(CASE WHEN value >= 50 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS filled FROM ev""")
def forward_fill_pose(spark, d):
    return ordered.forward_fill(samples(spark, d), "user_id", "t", "value", F.col("value") >= 50).select("event_id", "filled")


LINE = "WITH pts AS (SELECT l_orderkey * 10 + l_linenumber AS point_id, l_quantity AS x, l_extendedprice / 1000 AS y, l_extendedprice / 10000 AS z FROM lineitem)"


def cloud(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_extendedprice") / 10000).alias("z"))


@query(LINE + """, b AS (SELECT quantile_cont(z, 0.01) + 0.3 * (max(z) - min(z)) AS cut FROM pts), low AS (SELECT z FROM pts, b WHERE z < cut), e AS (SELECT min(z) AS lo, max(z) AS hi FROM low),
 h AS (SELECT least(CAST(floor((z - lo) / (hi - lo) * 100) AS BIGINT), 99) AS bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n FROM low, e GROUP BY 1)
 SELECT round(lo + (bin + 0.5e0) * (hi - lo) / 100, 6) AS floor_z FROM h ORDER BY n DESC, bin LIMIT 1""")
def histogram_floor(spark, d):
    return r6(planes.histogram_floor(cloud(spark, d)), "floor_z")


def _walls(spark, d):
    return points(spark, d).select("point_id", F.pmod(F.degrees(F.atan2("y", "x")), F.lit(180.0)).alias("angle"), F.sqrt(F.col("x") ** 2 + F.col("y") ** 2).alias("length"))


WALLS = PTS + ", walls AS (SELECT point_id, fmod(degrees(atan2(y, x)) + 360, 180) AS angle, sqrt(x ** 2 + y ** 2) AS length FROM pts)"


@query(WALLS + """, h AS (SELECT CAST(floor(fmod(angle, 90)) AS INTEGER) AS bin, round(sum(length), 6) AS w FROM walls GROUP BY 1)
 SELECT bin + 0.5e0 AS mode, CASE WHEN bin + 0.5 > 45 THEN 90 - (bin + 0.5e0) ELSE -(bin + 0.5e0) END AS turn FROM h ORDER BY w DESC, bin LIMIT 1""")
def weighted_angle_mode(spark, d):
    return fp.angle_mode(_walls(spark, d)).select(F.col("mode").cast("double").alias("mode"), F.col("turn").cast("double").alias("turn"))


@query(EV + """, m AS (SELECT event_type, median(value) AS med, count(*) AS cnt FROM ev GROUP BY 1), a AS (SELECT ev.*, abs(value - med) AS dev, cnt FROM ev JOIN m USING (event_type)), s AS (SELECT event_type, median(dev) AS mad FROM a GROUP BY 1)
 SELECT event_id, event_type, value FROM a JOIN s USING (event_type) WHERE cnt < 3 OR mad < 1e-6 OR dev < 3 * 1.4826 * mad""")
def mad_filter(spark, d):
    return cam.depth_mad(samples(spark, d).select("event_id", "event_type", "value"), "event_type", "value")


@query(EV + """, a AS (SELECT event_type, abs(value - median(value) OVER (PARTITION BY event_type)) / 1000 AS dev FROM ev)
 SELECT event_type, round(least(greatest(2.5 * 1.4826 * median(dev), 0.02), 0.06), 6) AS threshold FROM a GROUP BY 1""")
def adaptive_threshold(spark, d):
    s = samples(spark, d)
    med = s.groupBy("event_type").agg(F.median("value").alias("med"))
    dev = s.join(med, "event_type").groupBy("event_type").agg(F.median(F.abs(F.col("value") - F.col("med")) / 1000).alias("mad"))
    return dev.select("event_type", F.round(F.least(F.greatest(2.5 * 1.4826 * F.col("mad"), F.lit(0.02)), F.lit(0.06)), 6).alias("threshold"))


_N, _D = (0.36, 0.48, 0.8), 0.01


@query(PTS + f" SELECT point_id, round(x * {_N[0]} + y * {_N[1]} + z * {_N[2]} + {_D}, 6) AS dist FROM pts WHERE abs(x * {_N[0]} + y * {_N[1]} + z * {_N[2]} + {_D}) < 0.05")
def plane_band(spark, d):
    dist = planes.plane_distance(_N, _D)
    return points(spark, d).where(F.abs(dist) < 0.05).select("point_id", F.round(dist, 6).alias("dist"))


@query(PTS + f", e AS (SELECT x * {_N[0]} + y * {_N[1]} + z * {_N[2]} + {_D} AS dist FROM pts) SELECT round(sqrt(avg(dist * dist)), 6) AS rmse, count(*) AS inliers FROM e WHERE abs(dist) < 0.05")
def plane_rmse(spark, d):
    return r6(planes.plane_rmse(points(spark, d), _N, _D, 0.05), "rmse")


_PLANES = [(1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.05), (0.36, 0.48, 0.8, 0.01), (0.0, 0.6, 0.8, -0.02)]


@query(PTS + " " + " UNION ALL ".join(f"SELECT {k} AS plane, count(*) AS votes FROM pts WHERE abs(x * {a} + y * {b} + z * {c} + {e}) < 0.03" for k, (a, b, c, e) in enumerate(_PLANES)))
def plane_hypothesis_vote(spark, d):
    return planes.hypothesis_votes(points(spark, d), _PLANES, 0.03)


@query(PTS + """, n AS (SELECT g.point_id AS gray_id, o.r, (g.x - o.x) ** 2 + (g.y - o.y) ** 2 + (g.z - o.z) ** 2 AS d2, o.point_id FROM pts g, pts o WHERE NOT g.has_color AND o.has_color),
 k AS (SELECT *, row_number() OVER (PARTITION BY gray_id ORDER BY d2, point_id) AS i FROM n WHERE d2 <= 0.12 * 0.12)
 SELECT gray_id, round(sum(r / (sqrt(d2) + 1e-3)) / sum(1 / (sqrt(d2) + 1e-3)), 6) AS r, count(*) AS n FROM k WHERE i <= 8 GROUP BY 1 HAVING count(*) >= 2""")
def knn_idw(spark, d):
    p = points(spark, d)
    gray = p.where("NOT has_color").select(F.col("point_id").alias("gray_id"), "x", "y", "z")
    return r6(grid.idw_colors(gray, p.where("has_color").select("point_id", "x", "y", "z", "r", "g", "b"), 0.12).drop("g", "b"), "r")


_FAR = [(-1, 5.0, 0.0, 0.0), (-2, -7.0, 3.0, 1.0), (-3, 0.0, 0.0, 9.0)]  # points that stand alone


@query(PTS + f""", p AS (SELECT point_id, x, y, z FROM pts UNION ALL SELECT * FROM (VALUES {", ".join(f"({i}, {x}e0, {y}e0, {z}e0)" for i, x, y, z in _FAR)})),
 n AS (SELECT a.point_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS dist, row_number() OVER (PARTITION BY a.point_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2, b.point_id) AS i FROM p a, p b),
 m AS (SELECT point_id, avg(dist) AS mean_d FROM n WHERE i <= 10 GROUP BY 1), t AS (SELECT avg(mean_d) + 1.5 * stddev_samp(mean_d) AS most FROM m)
 SELECT point_id, round(mean_d, 6) AS mean_d FROM m, t WHERE mean_d <= most""")
def statistical_outliers(spark, d):
    p = points(spark, d).select("point_id", "x", "y", "z").unionByName(spark.createDataFrame(_FAR, "point_id long, x double, y double, z double"))
    return r6(grid.statistical_outliers(p, 0.15, 10, 1.5), "mean_d")


_RING = [(-0.2, -0.2), (0.25, -0.15), (0.05, 0.0), (0.2, 0.2), (-0.15, 0.18)]
_EDGES = ", ".join(f"({a}, {b}, {c}, {e})" for (a, b), (c, e) in zip(_RING, _RING[1:] + _RING[:1]))


@query(PTS + f", e(ax, ay, bx, b_y) AS (SELECT CAST(a AS DOUBLE), CAST(b AS DOUBLE), CAST(c AS DOUBLE), CAST(d AS DOUBLE) FROM (VALUES {_EDGES}) v(a, b, c, d)) SELECT point_id FROM pts, e WHERE (ay > y) <> (b_y > y) AND x < (bx - ax) * (y - ay) / (b_y - ay) + ax GROUP BY 1 HAVING count(*) % 2 = 1")
def point_in_polygon(spark, d):
    return points(spark, d).where(fp.in_polygon(F.col("x"), F.col("y"), _RING)).select("point_id")


_SEGS = [(-0.3, -0.3, 0.3, -0.3), (0.3, -0.3, 0.3, 0.3), (0.3, 0.3, -0.3, 0.3), (-0.3, 0.3, -0.3, -0.3)]
_SEG_SQL = ", ".join(f"({k}, {a}, {b}, {c}, {e})" for k, (a, b, c, e) in enumerate(_SEGS))


@query(PTS + f""", s AS (SELECT k, CAST(a AS DOUBLE) AS ax, CAST(b AS DOUBLE) AS ay, CAST(c - a AS DOUBLE) AS dx, CAST(e - b AS DOUBLE) AS dy FROM (VALUES {_SEG_SQL}) v(k, a, b, c, e)),
 t AS (SELECT *, least(greatest(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy), 0), 1) AS t FROM pts, s), d AS (SELECT point_id, k, (x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2 AS d2 FROM t)
 SELECT point_id, arg_min(k, d2) AS wall, round(min(d2), 6) AS d2 FROM d GROUP BY 1""")
def nearest_segment(spark, d):
    return r6(fp.nearest_segment(points(spark, d), _SEGS).select("point_id", "wall", "d2"), "d2")


@query(PTS + " " + " UNION ALL ".join(
    f"SELECT point_id, {k} AS wall, round((x - ({(a + c) / 2})) * {(c - a) / 0.6} + (y - ({(b + e) / 2})) * {(e - b) / 0.6}, 6) AS along FROM pts WHERE abs((y - ({(b + e) / 2})) * {(c - a) / 0.6} - (x - ({(a + c) / 2})) * {(e - b) / 0.6}) < 0.25 AND abs((x - ({(a + c) / 2})) * {(c - a) / 0.6} + (y - ({(b + e) / 2})) * {(e - b) / 0.6}) < 0.35" for k, (a, b, c, e) in enumerate(_SEGS)))
def wall_band_join(spark, d):
    return r6(fp.wall_band(points(spark, d), _SEGS, 0.25, 0.05).select("point_id", "wall", "along"), "along")


CAM = camera([[757.0278, 0, 628.3847], [0, 757.7271, 355.7657], [0, 0, 1]], (0.20348, -0.45501, 0.00026302, -0.00133517, 0.24492526), (1280, 720), (0.2121777, 0, 0, 0.9772311), (0, 0.07, -0.072))
_ROW = lambda k: " + ".join(f"({v!r}) * {c}" for v, c in zip(CAM.rotation[k], "xyz")) + f" + ({CAM.translation[k]!r})"
_K1, _K2, _P1, _P2, _K3 = CAM.dist
CAM_SQL = PTS + f""", c AS (SELECT point_id, {_ROW(0)} AS a, {_ROW(1)} AS b, {_ROW(2)} AS depth FROM pts), n AS (SELECT point_id, depth, a / depth AS a, b / depth AS b FROM c WHERE depth > 0), q AS (SELECT *, a * a + b * b AS r FROM n),
 w AS (SELECT *, 1 + r * ({_K1} + r * ({_K2} + r * {_K3})) AS k FROM q),
 px AS (SELECT point_id, depth, {CAM.fx} * (a * k + 2 * {_P1} * a * b + ({_P2}) * (r + 2 * a * a)) + {CAM.cx} AS u, {CAM.fy} * (b * k + {_P1} * (r + 2 * b * b) + 2 * ({_P2}) * a * b) + {CAM.cy} AS v FROM w)"""


@query(CAM_SQL + " SELECT point_id, CAST(trunc(u) AS INTEGER) AS u, CAST(trunc(v) AS INTEGER) AS v, round(depth, 6) AS depth FROM px WHERE u >= 0 AND u < 1280 AND v >= 0 AND v < 720")
def camera_project(spark, d):
    p = cam.project(points(spark, d), CAM).where(cam.in_image(CAM))
    return p.select("point_id", F.col("u").try_cast("int").alias("u"), F.col("v").try_cast("int").alias("v"), F.round("depth", 6).alias("depth"))


@query(CAM_SQL + """, img AS (SELECT u.range AS u, v.range AS v FROM range(1280) u, range(720) v WHERE (u.range * 7 + v.range * 3) % 5 < 3),
 hit AS (SELECT point_id, (img.u + img.v) % 256 AS r, img.u * 3 % 256 AS g, img.v * 5 % 256 AS b FROM px JOIN img ON img.u = CAST(trunc(px.u) AS BIGINT) AND img.v = CAST(trunc(px.v) AS BIGINT) WHERE px.u >= 0 AND px.u < 1280 AND px.v >= 0 AND px.v < 720)
 SELECT pts.point_id, h.point_id IS NOT NULL AS has_color, round(coalesce(h.r, 128) / 255.0e0, 6) AS r, round(coalesce(h.g, 128) / 255.0e0, 6) AS g, round(coalesce(h.b, 128) / 255.0e0, 6) AS b FROM pts LEFT JOIN hit h ON h.point_id = pts.point_id""")
def pixel_color(spark, d):
    p = cam.project(points(spark, d).drop("r", "g", "b", "has_color"), CAM).withColumn("image_id", F.lit(0))
    at = spark.range(1280 * 720).select(F.lit(0).alias("image_id"), (F.col("id") % 1280).cast("int").alias("u"), F.expr("id div 1280").cast("int").alias("v"))
    u, v = F.col("u"), F.col("v")
    pixels = at.where((u * 7 + v * 3) % 5 < 3).withColumns({"r": (u + v) % 256, "g": u * 3 % 256, "b": v * 5 % 256})
    return r6(cam.sample_colors(p, pixels, CAM).select("point_id", "has_color", "r", "g", "b"), "r", "g", "b")


@query(CAM_SQL + """, b AS (SELECT nation.n_nationkey AS det_id, n_nationkey * 50 AS x1, n_nationkey * 25 AS y1, n_nationkey * 50 + 120 AS x2, n_nationkey * 25 + 90 AS y2 FROM nation)
 SELECT det_id, point_id FROM px, b WHERE u >= 0 AND u < 1280 AND v >= 0 AND v < 720 AND u BETWEEN x1 - 15 AND x2 + 15 AND v BETWEEN y1 - 15 AND y2 + 15""")
def frustum_points(spark, d):
    k = F.col("n_nationkey").cast("double")
    boxes = table(spark, d, "nation").select(F.col("n_nationkey").alias("det_id"), (k * 50).alias("x1"), (k * 25).alias("y1"), (k * 50 + 120).alias("x2"), (k * 25 + 90).alias("y2"))
    return cam.frustum_points(cam.project(points(spark, d), CAM), boxes, CAM).select("det_id", "point_id")


@query(PTS + f" SELECT point_id, round({_ROW(0)}, 6) AS x, round({_ROW(1)}, 6) AS y, round({_ROW(2)}, 6) AS z FROM pts")
def rigid_transform(spark, d):
    x, y, z = apply_matrix(CAM.rotation, ("x", "y", "z"), CAM.translation)
    return points(spark, d).select("point_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"))


@query(PTS + f" SELECT point_id, round(x * {math.cos(0.3)!r} - y * {math.sin(0.3)!r}, 6) AS x, round(x * {math.sin(0.3)!r} + y * {math.cos(0.3)!r}, 6) AS y FROM pts")
def yaw_rotate(spark, d):
    x, y = yaw("x", "y", 0.3)
    return points(spark, d).select("point_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


_ARC = arc_to_z(_N)


@query(PTS + " SELECT point_id, " + ", ".join("round(" + " + ".join(f"({v!r}) * {k}" for v, k in zip(row, "xyz")) + f", 6) AS {c}" for c, row in zip("xyz", _ARC)) + " FROM pts")
def gravity_level(spark, d):
    return points(spark, d).select("point_id", *[F.round(e, 6).alias(c) for c, e in zip("xyz", apply_matrix(_ARC, ("x", "y", "z")))])


@query(LINE + """, c AS (SELECT CAST(floor(x / 1) AS BIGINT) AS ix, CAST(floor(y / 2) AS BIGINT) AS iy, count(*) AS n FROM (SELECT x / 2 AS x, y FROM pts) GROUP BY 1, 2), t AS (SELECT quantile_cont(n, 0.9) AS top FROM c)
 SELECT ix, iy, n, CAST(trunc(least(n, top) / top * 255) AS INTEGER) AS v FROM c, t""")
def density_raster(spark, d):
    return raster.density(cloud(spark, d).select((F.col("x") / 2).alias("x"), (F.col("y") / 2).alias("y")), 1.0)


_DENSE = LINE + """, c AS (SELECT CAST(floor(x / 2) AS BIGINT) AS ix, CAST(floor(y / 2) AS BIGINT) AS iy, count(*) AS n FROM pts GROUP BY 1, 2), t AS (SELECT quantile_cont(n, 0.9) AS top FROM c), v AS (SELECT ix, iy, CAST(trunc(least(n, top) / top * 255) AS INTEGER) AS v FROM c, t)"""


def _dense(spark, d):
    return raster.density(cloud(spark, d).select((F.col("x") / 2).alias("x"), (F.col("y") / 2).alias("y")), 1.0)


@query(_DENSE + """, h AS (SELECT v, count(*) AS n FROM v GROUP BY 1), c2 AS (SELECT v, sum(n) OVER w AS n0, sum(n * v) OVER w AS s0 FROM h WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)), a AS (SELECT sum(n) AS nn, sum(n * v) AS ss FROM h)
 SELECT v AS threshold FROM c2, a WHERE n0 < nn ORDER BY round(n0 * (nn - n0) * CAST(s0 / n0 - (ss - s0) / (nn - n0) AS DOUBLE) ** 2, 6) DESC, v LIMIT 1""")
def raster_otsu(spark, d):
    return raster.otsu(_dense(spark, d))


@query(_DENSE + " SELECT DISTINCT ix + dx AS ix, iy + dy AS iy FROM v, (SELECT unnest(range(-1, 2)) AS dx), (SELECT unnest(range(-1, 2)) AS dy) WHERE v > 200")
def raster_dilate(spark, d):
    return raster.dilate(_dense(spark, d).where("v > 200"), 1)


@query(_DENSE + " SELECT ix + dx AS ix, iy + dy AS iy FROM v, (SELECT unnest(range(-1, 2)) AS dx), (SELECT unnest(range(-1, 2)) AS dy) WHERE v > 100 GROUP BY 1, 2 HAVING count(*) = 9")
def raster_erode(spark, d):
    return raster.erode(_dense(spark, d).where("v > 100"), 1)


@query(_DENSE + """, f AS (SELECT ix, iy FROM v WHERE v > 200),
 r AS (WITH RECURSIVE w AS (SELECT ix AS sx, iy AS sy, ix, iy FROM f UNION SELECT w.sx, w.sy, f.ix, f.iy FROM w JOIN f ON abs(f.ix - w.ix) <= 1 AND abs(f.iy - w.iy) <= 1) SELECT * FROM w),
 l AS (SELECT ix, iy, min(row(sx, sy)) AS label FROM r GROUP BY 1, 2), b AS (SELECT label FROM l GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1)
 SELECT ix, iy FROM l JOIN b USING (label)""")
def raster_largest_component(spark, d):
    return raster.largest_component(_dense(spark, d).where("v > 200"))


@query(PTS + """, s AS (SELECT * FROM pts WHERE abs(z - 0) < 0.05), m AS (SELECT min(x) AS mx, min(y) AS my FROM s)
 SELECT CAST(floor((x - mx) / 0.1) AS BIGINT) AS px, CAST(floor((y - my) / 0.1) AS BIGINT) AS py, arg_max(r, point_id) AS r FROM s, m GROUP BY 1, 2""")
def slice_raster(spark, d):
    return raster.slice_image(points(spark, d), 0.0, 0.1, 0.1).select("px", "py", "r")


def _lines(spark, d):
    n = lambda k: F.format_string("%.4f", F.col("embedding")[k].cast("double"))
    e = table(spark, d, "embeddings")
    text = F.when(F.col("vec_id") % 5 == 0, F.concat(F.lit("note "), F.col("vec_id").cast("string"))).otherwise(F.concat(F.lit("bbox_"), F.col("vec_id").cast("string"), F.lit("=Bbox(chair,"), F.concat_ws(",", *[n(k) for k in range(7)]), F.lit(")")))
    return e.select((F.col("vec_id") % 3).cast("int").alias("layout_id"), F.col("vec_id").cast("int").alias("line_idx"), text.alias("line"))


@query("SELECT vec_id % 3 AS layout_id, vec_id AS line_idx, 'bbox' AS kind, vec_id AS idx, 'chair' AS cls, " + ", ".join(f"CAST(format('{{:.4f}}', CAST(embedding[{k + 1}] AS DOUBLE)) AS DOUBLE) AS v{k}" for k in range(7)) + " FROM embeddings WHERE vec_id % 5 <> 0")
def layout_parse(spark, d):
    p = layout.parse(_lines(spark, d))
    return p.select(*[F.col(c).cast("long").alias(c) if c in ("layout_id", "line_idx", "idx") else F.col(c) for c in ("layout_id", "line_idx", "kind", "idx", "cls")], *[F.col("v")[k].alias(f"v{k}") for k in range(7)])


@query("""SELECT vec_id AS line_idx FROM embeddings WHERE vec_id % 5 <> 0 AND (vec_id % 2 = 0 OR -(label / 10.0e0) >= -0.5)""")
def confidence_filter(spark, d):
    side = table(spark, d, "embeddings").where("vec_id % 2 = 1").groupBy((F.col("vec_id") % 3).cast("int").alias("layout_id")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("bbox_"), F.col("vec_id").cast("string")), -F.col("label") / 10.0)))).alias("json"))
    return layout.confidence_filter(layout.parse(_lines(spark, d)), layout.confidences(side), -0.5).select(F.col("line_idx").cast("long").alias("line_idx"))


_NUM4 = lambda k: f"format('{{:.4f}}', CAST(e[{k}] AS DOUBLE))"


@query(f"""WITH k AS (SELECT vec_id, vec_id % 3 AS layout_id, row_number() OVER (PARTITION BY vec_id % 3 ORDER BY vec_id) AS n, embedding AS e FROM embeddings WHERE vec_id % 5 <> 0)
 SELECT layout_id, n AS line_idx, 'bbox_' || (n - 1) || '=Bbox(chair,' || {" || ',' || ".join(_NUM4(k) for k in range(1, 8))} || ')' AS line FROM k""")
def layout_write(spark, d):
    return layout.write(layout.parse(_lines(spark, d)), places=4).select(F.col("layout_id").cast("long").alias("layout_id"), F.col("line_idx").cast("long").alias("line_idx"), "line")


@query(PTS + """, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY point_id) AS i FROM pts),
 g AS (WITH RECURSIVE s AS (SELECT label, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)[]) AS kept FROM (SELECT DISTINCT label FROM pts)
   UNION ALL SELECT s.label, s.i + 1, CASE WHEN len(list_filter(s.kept, lambda k: (k.x - o.x) ** 2 + (k.y - o.y) ** 2 + (k.z - o.z) ** 2 < 0.1 * 0.1)) = 0 THEN list_append(s.kept, {'id': o.point_id, 'x': o.x, 'y': o.y, 'z': o.z}) ELSE s.kept END
   FROM s JOIN o ON o.label = s.label AND o.i = s.i + 1) SELECT * FROM s),
 e AS (SELECT label, arg_max(kept, i) AS kept FROM g GROUP BY 1) SELECT label, unnest(list_transform(kept, lambda k: k.id)) AS line_idx FROM e""")
def greedy_dedup(spark, d):
    return layout.greedy_dedup(points(spark, d).withColumn("line_idx", F.col("point_id")), "label", r=0.1).select("label", "line_idx")


@query(PTS + """, c AS (SELECT *, floor(x / 0.2) * 100 + floor(y / 0.2) AS cluster FROM pts) SELECT CAST(cluster AS BIGINT) AS cluster, count(DISTINCT point_id % 3) AS votes, round(median(x), 6) AS x, round(median(y), 6) AS y FROM c GROUP BY 1 HAVING count(DISTINCT point_id % 3) >= 2""")
def vote_median(spark, d):
    p = points(spark, d).withColumns({"cluster": (F.floor(F.col("x") / 0.2) * 100 + F.floor(F.col("y") / 0.2)).cast("long"), "layout": F.col("point_id") % 3})
    return r6(layout.vote_median(p, "cluster", "layout", 2, "x", "y"), "x", "y")


@query(PTS + " SELECT label, round(atan2(avg(sin(2 * x)), avg(cos(2 * x))) / 2, 6) AS yaw FROM pts GROUP BY 1")
def axial_mean(spark, d):
    return points(spark, d).groupBy("label").agg(F.round(layout.axial_mean(F.col("x")), 6).alias("yaw"))


@query(PTS + """, s AS (SELECT point_id, x AS ax, y AS ay, z AS az, x + r AS bx, y AS by, z + 0.3 AS bz FROM pts), n AS (SELECT *, greatest(2, CAST(ceil(sqrt((bx - ax) ** 2 + (bz - az) ** 2) / 0.02) AS BIGINT) + 1) AS n FROM s), k AS (SELECT *, unnest(range(n)) AS k FROM n)
 SELECT point_id, k, round(ax * (1 - k / (n - 1)) + bx * (k / (n - 1)), 6) + 0e0 AS x, round(az * (1 - k / (n - 1)) + bz * (k / (n - 1)), 6) + 0e0 AS z FROM k""")
def wireframe_points(spark, d):
    s = points(spark, d).select("point_id", F.struct("x", "y", "z").alias("a"), F.struct((F.col("x") + F.col("r")).alias("x"), "y", (F.col("z") + 0.3).alias("z")).alias("b"))
    return layout.densify(s, 0.02, "point_id").select("point_id", "k", *[(F.round(c, 6) + 0.0).alias(c) for c in "xz"])


@query(PTS + """, g(a, b, c) AS (SELECT a, b, c FROM (VALUES (-1), (1)) p(a), (VALUES (-1), (1)) q(b), (VALUES (-1), (1)) o(c))
 SELECT point_id, 3 AS edges, round(x + cos(r) * a * 0.1 - sin(r) * b * 0.2, 6) + 0e0 AS x, round(y + sin(r) * a * 0.1 + cos(r) * b * 0.2, 6) + 0e0 AS y, round(z + c * 0.15, 6) + 0e0 AS z FROM pts, g""")
def box_corners(spark, d):
    boxes = points(spark, d).select(F.col("point_id").alias("box_id"), "x", "y", "z", F.col("r").alias("yaw"), F.lit(0.2).alias("sx"), F.lit(0.4).alias("sy"), F.lit(0.3).alias("sz"))
    ends = layout.box_edges(boxes).select("box_id", F.explode(F.array("a", "b")).alias("p")).select(F.col("box_id").alias("point_id"), *[(F.round(F.col(f"p.{c}"), 6) + 0.0).alias(c) for c in "xyz"])
    return ends.groupBy("point_id", "x", "y", "z").agg(F.count(F.lit(1)).cast("int").alias("edges"))


@query("""WITH a(cls, grp, rank) AS (VALUES ('PROMO', 'offer', 2), ('ECONOMY', 'offer', 1), ('SMALL', 'size', 1))
 SELECT p_partkey, coalesce(grp, split_part(p_type, ' ', 1)) AS grp, CAST(coalesce(rank, 0) AS INTEGER) AS rank FROM part LEFT JOIN a ON a.cls = split_part(p_type, ' ', 1)""")
def class_alias(spark, d):
    a = spark.createDataFrame([("PROMO", "offer", 2), ("ECONOMY", "offer", 1), ("SMALL", "size", 1)], "cls string, grp string, rank int")
    return layout.with_alias(table(spark, d, "part").select("p_partkey", F.split("p_type", " ")[0].alias("cls")), a).select("p_partkey", "grp", "rank")


@query(PTS + " SELECT round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z, count(*) AS n FROM pts")
def extent(spark, d):
    return r6(metrics.extent(points(spark, d)), *[f"{m}_{c}" for m in ("min", "max") for c in "xyz"])


@query(LINE + " SELECT round(quantile_cont(z, 0.01), 6) AS p1, round(quantile_cont(z, 0.05), 6) AS p5, round(quantile_cont(z, 0.95), 6) AS p95, round(quantile_cont(z, 0.98), 6) AS p98 FROM pts")
def height_percentiles(spark, d):
    found = percentiles(cloud(spark, d), "z", [0.01, 0.05, 0.95, 0.98])
    return r6(spark.createDataFrame([tuple(found)], "p1 double, p5 double, p95 double, p98 double"), "p1", "p5", "p95", "p98")


@query(LINE + ", e AS (SELECT min(z) AS lo, max(z) AS hi FROM pts), h AS (SELECT least(CAST(floor((z - lo) / (hi - lo) * 64) AS INTEGER), 63) AS bin, count(*) AS n FROM pts, e GROUP BY 1) SELECT CAST(r.range AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(64) r LEFT JOIN h ON h.bin = r.range")
def height_histogram(spark, d):
    from .functions.binning import dense

    c = cloud(spark, d)
    e = c.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    return dense(c.join(F.broadcast(e)).groupBy(bin_of(F.col("z"), F.col("lo"), F.col("hi"), 64).alias("bin")).agg(F.count(F.lit(1)).alias("n")), 64)  # one row


@query(LINE + """, e AS (SELECT min(z) AS lo, max(z) AS hi FROM pts), h AS (SELECT least(CAST(floor((z - lo) / (hi - lo) * 64) AS INTEGER), 63) AS bin, count(*) AS n FROM pts, e GROUP BY 1), f AS (SELECT CAST(r.range AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(64) r LEFT JOIN h ON h.bin = r.range),
 w AS (SELECT *, lag(n) OVER (ORDER BY bin) AS l, lead(n) OVER (ORDER BY bin) AS q FROM f) SELECT bin, n FROM w WHERE n > l AND n > q AND n >= 3""")
def histogram_peaks(spark, d):
    return local_maxima(height_histogram(spark, d), 3)


@query(EV + ", f AS (SELECT * FROM ev ORDER BY t, event_id LIMIT 50) SELECT round(avg(value), 6) AS mean, count(*) AS n FROM f")
def first_samples_mean(spark, d):
    return samples(spark, d).orderBy("t", "event_id").limit(50).agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(PTS + " SELECT count(*) AS n_points, round(avg(CAST(has_color AS INTEGER)), 6) AS colorized_fraction FROM pts")
def color_share(spark, d):
    return r6(metrics.color_share(points(spark, d)), "colorized_fraction")


def _rings(spark, d):
    w = Window.partitionBy("label").orderBy(F.atan2("y", "x"), "point_id")
    return points(spark, d).select(F.col("label").alias("poly"), (F.row_number().over(w) - 1).alias("i"), "x", "y")


RINGS = PTS + """, ring AS (SELECT label AS poly, row_number() OVER (PARTITION BY label ORDER BY atan2(y, x), point_id) - 1 AS i, x, y FROM pts),
 e AS (SELECT poly, i, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM ring WINDOW w AS (PARTITION BY poly ORDER BY i))"""


@query(RINGS + " SELECT poly, i AS wall, round(fmod(degrees(atan2(y2 - y1, x2 - x1)) + 360, 180), 6) AS angle, round(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2), 6) AS length FROM e WHERE sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) > 0.15")
def ring_walls(spark, d):
    return r6(fp.ring_walls(_rings(spark, d)).select("poly", F.col("wall").cast("long").alias("wall"), "angle", "length"), "angle", "length")


@query(RINGS + " SELECT poly, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 6) AS area, round(sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)), 6) AS perimeter FROM e GROUP BY 1")
def polygon_area(spark, d):
    return r6(fp.polygon_area(_rings(spark, d)), "area", "perimeter")


@query(WALLS + ", s(a) AS (VALUES (0), (45), (90), (135)) SELECT point_id, CAST(arg_min(a, round(least(fmod(angle - a + 360, 180), 180 - fmod(angle - a + 360, 180)), 9) * 1000 + a / 1000.0e0) AS DOUBLE) AS snapped FROM walls, s GROUP BY 1")
def snap_angles(spark, d):
    return fp.snap_angles(_walls(spark, d)).select("point_id", "snapped")


@query(WALLS + """, t(a, later, tol, k) AS (VALUES (12, 0, 7, 0), (101, 0, 7, 1), (0, 1, 7, 2), (90, 1, 7, 3), (45, 1, 4, 4), (135, 1, 4, 5), (30, 1, 3, 6), (60, 1, 3, 7), (120, 1, 3, 8), (150, 1, 3, 9)),
 g AS (SELECT point_id, a, later, k, tol, least(fmod(angle - a + 360, 180), 180 - fmod(angle - a + 360, 180)) AS gap FROM walls, t),
 h AS (SELECT point_id, a, row_number() OVER (PARTITION BY point_id ORDER BY later, gap, k) AS i FROM g WHERE gap <= tol) SELECT walls.point_id, CAST(a AS DOUBLE) AS snapped FROM walls LEFT JOIN h ON h.point_id = walls.point_id AND i = 1""")
def tiered_snap(spark, d):
    return fp.tiered_snap(_walls(spark, d), [12.0, 101.0]).select("point_id", "snapped")


@query(PTS + """, l AS (SELECT label AS poly, point_id AS i, x AS px, y AS py, cos(radians(45 * (point_id // 3 % 8))) AS dx, sin(radians(45 * (point_id // 3 % 8))) AS dy FROM pts),
 n AS (SELECT *, coalesce(lead(px) OVER w, first_value(px) OVER w) AS qx, coalesce(lead(py) OVER w, first_value(py) OVER w) AS qy, coalesce(lead(dx) OVER w, first_value(dx) OVER w) AS ex, coalesce(lead(dy) OVER w, first_value(dy) OVER w) AS ey FROM l WINDOW w AS (PARTITION BY poly ORDER BY i)),
 t AS (SELECT *, abs(dx * ey - dy * ex) < 1e-6 AS flat, ((qx - px) * ey - (qy - py) * ex) / (dx * ey - dy * ex) AS t FROM n)
 SELECT poly, i, round(CASE WHEN flat THEN (px + qx) / 2 ELSE px + t * dx END, 6) AS x, round(CASE WHEN flat THEN (py + qy) / 2 ELSE py + t * dy END, 6) AS y FROM t""")
def line_corners(spark, d):
    turn = F.radians(45 * (F.expr("point_id div 3") % 8))
    p = points(spark, d).select(F.col("label").alias("poly"), F.col("point_id").alias("i"), F.col("x").alias("px"), F.col("y").alias("py"), F.cos(turn).alias("dx"), F.sin(turn).alias("dy"))
    return r6(fp.line_corners(p), "x", "y")


@query(PTS + ", f AS (SELECT label, avg(z) AS z, count(*) AS n FROM pts GROUP BY 1), lo AS (SELECT arg_min(label, z) AS floor, min(z) AS fz FROM f) SELECT any_value(floor) AS floor, arg_max(label, z) FILTER (z > fz + 0.001) AS ceiling FROM f, lo")
def floor_ceiling_pick(spark, d):
    f = points(spark, d).groupBy("label").agg(F.avg("z").alias("z"))
    lo = f.agg(F.min_by("label", "z").alias("floor"), F.min("z").alias("fz"))
    return f.join(F.broadcast(lo)).groupBy("floor").agg(F.max_by("label", F.when(F.col("z") > F.col("fz") + 0.001, F.col("z"))).alias("ceiling"))  # one row


@query(PTS + " SELECT point_id, has_color, round(x, 6) AS x FROM pts WHERE has_color UNION ALL SELECT point_id, has_color, round(x, 6) AS x FROM pts WHERE NOT has_color AND point_id NOT IN (SELECT point_id FROM pts WHERE z > 0)")
def map_union_difference(spark, d):
    p = points(spark, d)
    kept = p.where("NOT has_color").join(p.where("z > 0").select("point_id"), "point_id", "left_anti")
    return r6(p.where("has_color").unionByName(kept).select("point_id", "has_color", "x"), "x")


@query(PTS + " SELECT '{\"n_points\":' || count(*) || ',\"colored\":' || count(*) FILTER (has_color) || '}' AS json FROM pts")
def metrics_json(spark, d):
    return metrics.as_json(points(spark, d).agg(F.count(F.lit(1)).alias("n_points"), F.count_if("has_color").alias("colored")))


@query(PTS + """ SELECT max(x) - min(x) > 0.5 OR max(y) - min(y) > 0.5 OR max(z) - min(z) > 0.5 AS diverged FROM pts""")
def pose_sanity(spark, d):
    from .operators.motion import diverged

    return diverged(points(spark, d).select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz")), 0.5)


@query(LINE + """, h AS (SELECT * FROM pts WHERE z >= 1.5), e AS (SELECT min(z) AS lo, max(z) AS hi, greatest(8, CAST(ceil((max(z) - min(z)) / 0.05) AS INTEGER)) AS k FROM h), c AS (SELECT least(CAST(floor((z - lo) / (hi - lo) * k) AS INTEGER), k - 1) AS bin, count(*) AS n FROM h, e GROUP BY 1),
 f AS (SELECT r.range AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(k)) AS range FROM e) r LEFT JOIN c ON c.bin = r.range), w AS (SELECT *, lag(n) OVER (ORDER BY bin) AS l, lead(n) OVER (ORDER BY bin) AS q, max(n) OVER () AS most FROM f),
 p AS (SELECT coalesce(min(bin) FILTER (n > l AND n > q AND n >= greatest(3, 0.15 * most)), arg_max(bin, n * 1000000 - bin)) AS b FROM w) SELECT point_id FROM pts, p, e WHERE z >= lo + (b + 0.5e0) * (hi - lo) / k - 0.3""")
def ceiling_slice(spark, d):
    return fp.ceiling_slice(cloud(spark, d)).select("point_id")


_ROOM = [(-0.3, -0.3), (0.3, -0.3), (0.3, 0.0), (0.0, 0.0), (0.0, 0.3), (-0.3, 0.3)]


@query(PTS + """ SELECT point_id FROM pts WHERE z BETWEEN -0.15 AND 0.2 AND x BETWEEN -0.38 AND 0.38 AND y BETWEEN -0.38 AND 0.38 AND NOT (x > 0.08 AND y > 0.08)""")
def crop_room(spark, d):
    return floor_plan.crop_to_room(points(spark, d).where("abs(x) <> 0.38 AND abs(y) <> 0.38"), _ROOM, -0.05, 0.1)[0].select("point_id")


@query(PTS + """, r AS (SELECT * FROM pts WHERE z BETWEEN -0.15 AND 0.2 AND x BETWEEN -0.38 AND 0.38 AND y BETWEEN -0.38 AND 0.38 AND NOT (x > 0.08 AND y > 0.08))
 SELECT CAST(round(0.76 * 0.76 - 0.3 * 0.3, 2) AS DOUBLE) AS room_area_m2, 0.08e0 AS buffer_m, (SELECT count(*) FROM pts) AS n_in, count(*) AS n_out FROM r""")
def crop_counts(spark, d):
    info = floor_plan.crop_to_room(points(spark, d), _ROOM, -0.05, 0.1)[1]
    return spark.createDataFrame([(info["room_area_m2"], info["buffer_m"], info["n_in"], info["n_out"])], "room_area_m2 double, buffer_m double, n_in long, n_out long")


def _items(spark, d):
    """Walls, doors, windows and boxes of scenes by label, in three layouts each."""
    p = points(spark, d).withColumn("i", F.col("point_id") % 7)
    kind = F.when(F.col("i") == 0, "wall").when(F.col("i") == 1, "door").when(F.col("i") == 2, "window").otherwise("bbox")
    num = lambda *e: F.array(*[F.round(x, 4).cast("double") for x in e])
    x, y, z = (F.col(c) for c in "xyz")
    v = F.when(F.col("i") == 0, num(x, y, z, x + 0.5, y, z, F.lit(2.5), F.lit(0.1))).when(F.col("i") < 3, num(x, y, z, F.lit(0.9), F.lit(2.0))).otherwise(num(x, y, z, F.lit(0.0), F.lit(0.2), F.lit(0.4), F.lit(0.3)))
    cls = F.when(F.col("i") >= 3, F.when(F.col("i") < 5, "sofa").otherwise("lamp"))
    return p.select(F.col("label").cast("long").alias("scan_id"), (F.col("point_id") % 3).alias("layout_id"), F.col("point_id").alias("line_idx"), kind.alias("kind"), F.col("point_id").cast("int").alias("idx"), cls.alias("cls"), v.alias("v"))


_ITEMS = PTS + """, it AS (SELECT label AS scan_id, point_id % 3 AS layout_id, point_id AS line_idx, point_id % 7 AS i, CASE point_id % 7 WHEN 0 THEN 'wall' WHEN 1 THEN 'door' WHEN 2 THEN 'window' ELSE 'bbox' END AS kind,
   CASE WHEN point_id % 7 >= 3 THEN CASE WHEN point_id % 7 < 5 THEN 'sofa' ELSE 'lamp' END END AS cls, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(x + 0.5, 4) AS x2 FROM pts)"""


@query(_ITEMS + """, o AS (SELECT *, row_number() OVER (PARTITION BY scan_id, layout_id, cls ORDER BY line_idx) AS n FROM it WHERE kind = 'bbox'),
 g AS (WITH RECURSIVE s AS (SELECT scan_id, layout_id, cls, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)[]) AS kept FROM (SELECT DISTINCT scan_id, layout_id, cls FROM o)
   UNION ALL SELECT s.scan_id, s.layout_id, s.cls, s.n + 1, CASE WHEN len(list_filter(s.kept, lambda k: (k.x - o.x) ** 2 + (k.y - o.y) ** 2 + (k.z - o.z) ** 2 < 0.2 * 0.2)) = 0 THEN list_append(s.kept, {'id': o.line_idx, 'x': o.x, 'y': o.y, 'z': o.z}) ELSE s.kept END
   FROM s JOIN o ON o.scan_id = s.scan_id AND o.layout_id = s.layout_id AND o.cls = s.cls AND o.n = s.n + 1) SELECT * FROM s),
 b AS (SELECT unnest(list_transform(kept, lambda k: k.id)) AS line_idx FROM (SELECT arg_max(kept, n) AS kept FROM g GROUP BY scan_id, layout_id, cls)),
 a AS (SELECT * FROM it WHERE kind <> 'bbox' AND layout_id = 0 UNION ALL SELECT it.* FROM it JOIN b USING (line_idx) WHERE layout_id = 1),
 k AS (SELECT *, row_number() OVER (PARTITION BY scan_id, kind ORDER BY line_idx) - 1 AS n, array_position(['wall', 'door', 'window', 'bbox'], kind) AS rank FROM a)
 SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY rank, n) AS line_idx, kind || '_' || n || CASE kind WHEN 'wall' THEN '=Wall(' WHEN 'door' THEN '=Door(wall_0,' WHEN 'window' THEN '=Window(wall_0,' ELSE '=Bbox(' || cls || ',' END AS head, x FROM k""")
def layout_merge(spark, d):
    items = _items(spark, d)
    lines = layouts.merge(items.where("layout_id = 0"), items.where("layout_id = 1"))
    numbers = F.regexp_replace(F.regexp_extract("line", r"\((.*)\)", 1), r"^(wall_0|sofa|lamp),", "")
    return lines.select("scan_id", F.col("line_idx").cast("long").alias("line_idx"), F.regexp_extract("line", r"^([a-z]+_\d+=[A-Za-z]+\((wall_0,|sofa,|lamp,)?)", 1).alias("head"), F.split(numbers, ",")[0].cast("double").alias("x"))


@query(_ITEMS + """, seg AS (SELECT scan_id, 'w' AS part, 0 AS r, x AS ax, y AS ay, z AS az, x2 AS bx, y AS b_y, z AS bz FROM it WHERE kind = 'wall'
   UNION ALL SELECT scan_id, kind, CASE kind WHEN 'door' THEN 255 ELSE 0 END, x - 0.1 * (k = 0)::INT, y - 0.1 * (k = 1)::INT, z - 0.1 * (k = 2)::INT, x + 0.1 * (k = 0)::INT, y + 0.1 * (k = 1)::INT, z + 0.1 * (k = 2)::INT FROM it, (SELECT unnest([0, 1, 2]) AS k) WHERE kind IN ('door', 'window')
   UNION ALL SELECT scan_id, 'b', 255, CASE WHEN ax = 0 THEN x - 0.1 ELSE x + s * 0.1 END, CASE WHEN ax = 1 THEN y - 0.2 ELSE y + CASE WHEN ax = 0 THEN s ELSE t END * 0.2 END, CASE WHEN ax = 2 THEN z - 0.15 ELSE z + t * 0.15 END,
     CASE WHEN ax = 0 THEN x + 0.1 ELSE x + s * 0.1 END, CASE WHEN ax = 1 THEN y + 0.2 ELSE y + CASE WHEN ax = 0 THEN s ELSE t END * 0.2 END, CASE WHEN ax = 2 THEN z + 0.15 ELSE z + t * 0.15 END
     FROM it, (SELECT unnest([0, 1, 2]) AS ax), (SELECT unnest([-1, 1]) AS s), (SELECT unnest([-1, 1]) AS t) WHERE kind = 'bbox'),
 n AS (SELECT *, greatest(2, CAST(ceil(sqrt((bx - ax) ** 2 + (b_y - ay) ** 2 + (bz - az) ** 2) / 0.029) AS BIGINT) + 1) AS n FROM seg),
 p AS (SELECT scan_id, r, ax + (bx - ax) * k / (n - 1) AS x, ay + (b_y - ay) * k / (n - 1) AS y, az + (bz - az) * k / (n - 1) AS z FROM (SELECT *, unnest(range(n)) AS k FROM n))
 SELECT scan_id, r, count(*) AS n, round(sum(x), 4) AS sx, round(sum(y), 4) AS sy, round(sum(z), 4) AS sz, round(sum(x * x), 4) AS sxx, round(min(z), 4) AS lo FROM p GROUP BY 1, 2""")
def layout_drawn(spark, d):
    p = layouts.drawn(_items(spark, d), 0.029).withColumn("r", F.round(F.col("r") * 255).cast("int"))
    return p.groupBy("scan_id", "r").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(c), 4).alias(f"s{c}") for c in "xyz"], F.round(F.sum(F.col("x") * F.col("x")), 4).alias("sxx"), F.round(F.min("z"), 4).alias("lo"))


@query(CAM_SQL + """, m AS (SELECT n_nationkey AS det_id, x.range AS mx, y.range AS my FROM nation, range(64) x, range(36) y WHERE (x.range + y.range * 2 + n_nationkey) % 11 = 0)
 SELECT det_id, point_id FROM px JOIN m ON mx = least(greatest(CAST(floor(u * (64 / 1280.0e0)) AS BIGINT), 0), 63) AND my = least(greatest(CAST(floor(v * (36 / 720.0e0)) AS BIGINT), 0), 35) WHERE u >= 0 AND u < 1280 AND v >= 0 AND v < 720""")
def mask_points(spark, d):
    cells = spark.range(64 * 36).select((F.col("id") % 64).cast("int").alias("mx"), F.expr("id div 64").cast("int").alias("my"))
    det = table(spark, d, "nation").select(F.col("n_nationkey").alias("det_id"))
    masks = cells.withColumn("det_id", F.explode(F.sequence(F.lit(0), F.lit(24)))).join(det, "det_id", "left_semi").where("(mx + my * 2 + det_id) % 11 = 0")
    return cam.mask_points(cam.project(points(spark, d), CAM), masks, CAM, 64, 36).select("det_id", "point_id")


@query(PTS + " SELECT point_id, abs(r - 0.5e0) > 0.15 OR abs(label / 10.0e0 - 0.5e0) > 0.15 AS colorized, sqrt(x * x + y * y + z * z) > 0.05 AS far FROM pts")
def point_flags(spark, d):
    return points(spark, d).select("point_id", grid.is_colorized(0.15, gray=0.5).alias("colorized"), (norm("x", "y", "z") > 0.05).alias("far"))


@query("WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), t AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, a.vec_id AS i, b.vec_id AS j FROM p a, p b WHERE a.vec_id <> b.vec_id AND a.vec_id % 5 = 0 AND b.vec_id % 5 = 0), e AS (SELECT ax, ay, bx, b_y FROM t WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.vec_id % 5 = 0 AND (bx - ax) * (c.y - ay) - (b_y - ay) * (c.x - ax) < 0)) SELECT round(sum(ax * b_y - bx * ay) / 2, 6) AS area FROM e")
def hull_area(spark, d):
    return spark.createDataFrame([(round(planes.hull_area(points(spark, d).where("point_id % 5 = 0")), 6),)], "area double")


@query(EV + """, b AS (SELECT CAST(floor(value / 5) AS BIGINT) AS bin, count(*) AS n FROM ev GROUP BY 1), w AS (SELECT *, lag(n) OVER (ORDER BY bin) AS l, lead(n) OVER (ORDER BY bin) AS q FROM b), p AS (SELECT bin, n FROM w WHERE n > l AND n > q ORDER BY n DESC, bin DESC LIMIT 2)
 SELECT bin, n FROM p""")
def top_two_peaks(spark, d):
    rows = samples(spark, d).groupBy(F.floor(F.col("value") / 5).alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("bin").collect()  # bins of a histogram
    values = [r.n for r in rows]
    return spark.createDataFrame([(rows[i].bin, rows[i].n) for i in top_peaks(values, peaks(values))], "bin long, n long")


@query("""WITH im AS (SELECT epoch_us(ts) / 1e6 AS t, value / 100 AS g FROM events WHERE user_id = 1), s AS (SELECT t, avg(g) AS g FROM im GROUP BY 1), seg AS (SELECT t AS t0, lead(t) OVER (ORDER BY t) AS t1, g AS g0, lead(g) OVER (ORDER BY t) AS g1 FROM s),
 e AS (SELECT min(t) AS lo, max(t) AS hi FROM s), b AS (SELECT r.range AS bucket, lo + (hi - lo) / 2 + r.range * 1000.0 AS t, lo + (hi - lo) / 2 + 40 * 1000.0 AS ref FROM range(41) r, e),
 a AS (SELECT bucket, sum(CASE WHEN least(t1, ref) > greatest(t0, t) THEN (least(t1, ref) - greatest(t0, t)) * (2 * g0 + (g1 - g0) / (t1 - t0) * (least(t1, ref) + greatest(t0, t) - 2 * t0)) / 2 ELSE 0 END) AS w FROM b, seg WHERE t1 IS NOT NULL GROUP BY 1)
 SELECT bucket, round(w, 4) + 0e0 AS w FROM a""")
def rotation_between(spark, d):
    imu = samples(spark, d).where("user_id = 1").select("t", *[(F.col("value") / 100).alias(c) for c in ("gx", "gy", "gz")])
    lo, hi = imu.agg(F.min("t"), F.max("t")).first()
    scan = spark.range(41).select(F.lit(0).cast("long").alias("scan_id"), F.lit((lo or 0.0) + ((hi or 0.0) - (lo or 0.0)) / 2).alias("stamp"), (F.col("id") * 1000.0).alias("t_off"))
    return motion.rotation_angles(scan, imu, bucket=1000.0).select("bucket", (F.round("wx", 4) + 0.0).alias("w"))
