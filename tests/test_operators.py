"""Operators that SQL does not express, on synthetic rooms, scans and layouts."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import camera as cam
from voxlake.operators import floorplan as fp
from voxlake.operators import grid, layout, motion, ordered, planes, raster
from voxlake.plans.backends import get_backend
from voxlake.plans.build_map import build_map
from voxlake.sources import ply


def imu_rows(spark, gyro, duration=0.1, rate=250, t0=1000.0):
    n = max(int(duration * rate), 2)
    return spark.createDataFrame([(float(t), *map(float, gyro), 0.0, 0.0, 9.8) for t in np.linspace(t0, t0 + duration, n)], "t double, gx double, gy double, gz double, ax double, ay double, az double")


def scan(spark, xyz, off, stamp=1000.0):
    return spark.createDataFrame([(1, i, stamp, float(t), *map(float, p)) for i, (p, t) in enumerate(zip(xyz, off))], "scan_id long, point_idx int, stamp double, t_off double, x double, y double, z double")


def got(df):
    return np.array([[r.x, r.y, r.z] for r in df.orderBy("point_idx").collect()])


def test_deskew(spark):
    eye, off = np.eye(3), [0, 0.04, 0.08]
    assert np.allclose(got(motion.deskew(scan(spark, eye, off), imu_rows(spark, (0, 0, 0)))), eye, atol=1e-12)
    ones = np.array([[1.0, 0, 0]] * 3)
    out = got(motion.deskew(scan(spark, ones, off), imu_rows(spark, (0, 0, 1.0))))
    want = [[math.cos(-(0.08 - t)), math.sin(-(0.08 - t)), 0] for t in off]
    assert np.allclose(out, want, atol=2e-3)
    out = got(motion.deskew(scan(spark, ones[:2], [0, 0.08]), imu_rows(spark, (0, 0, 1.0)), "start"))
    assert np.allclose(out[0], [1, 0, 0], atol=1e-6) and np.allclose(out[1], [math.cos(0.08), math.sin(0.08), 0], atol=2e-3)
    assert np.allclose(got(motion.deskew(scan(spark, ones, off), imu_rows(spark, (0, 0, 1.0), t0=500.0))), ones, atol=1e-12)
    assert (got(motion.deskew(scan(spark, ones, [0, 0, 0]), imu_rows(spark, (0, 0, 5.0)))) == ones).all()
    with pytest.raises(ValueError):
        motion.deskew(scan(spark, ones, off), imu_rows(spark, (0, 0, 1.0)), "middle")


def test_deskew_kernel_agrees_and_is_fast(spark):
    rng = np.random.default_rng(0)
    xyz, off = rng.normal(size=(5000, 3)), rng.uniform(0, 0.08, 5000)
    t = np.linspace(1000, 1000.1, 25)
    gyro = np.tile([0.1, 0.2, 0.3], (25, 1))
    motion.deskew_kernel(off, xyz, 1000.0, t, gyro)
    began = time.perf_counter()
    k = motion.deskew_kernel(off, xyz, 1000.0, t, gyro)
    assert time.perf_counter() - began < 0.05
    out = got(motion.deskew(scan(spark, xyz[:200], off[:200]), imu_rows(spark, (0.1, 0.2, 0.3))))
    assert np.allclose(out, motion.deskew_kernel(off[:200], xyz[:200], 1000.0, t, gyro), atol=1e-6) and k.shape == xyz.shape


CAM = cam.Camera(100, 100, 50, 50, 100, 100, rotation=((0, -1, 0), (0, 0, -1), (1, 0, 0)))


def colored(spark, times, images, tolerance=0.15):
    """Times of points at (1, 0, 0) and {image time: (r, g, b)} -> colours."""
    pts = spark.createDataFrame([(i, float(t), 1.0, 0.0, 0.0, 1) for i, t in enumerate(times)], "point_id long, t double, x double, y double, z double, one int")
    im = spark.createDataFrame([(1, float(t), k) for k, t in enumerate(images)], "one int, t double, image_id long")
    px = spark.createDataFrame([(k, u, v, *c) for k, c in enumerate(images.values()) for u in range(45, 55) for v in range(45, 55)], "image_id long, u int, v int, r int, g int, b int")
    m = ordered.asof_nearest(pts, im, "one", "t", "image_id", tolerance).withColumnRenamed("match_id", "image_id")
    out = cam.sample_colors(cam.project(m, CAM), px, CAM)
    return [(r.r, r.g, r.b) for r in out.orderBy("point_id").collect()]


def test_color_by_time(spark):
    gray = (128 / 255,) * 3
    assert colored(spark, [100, 100, 100.1, 100.1], {100.0: (255, 0, 0), 100.1: (0, 0, 255)}) == [(1, 0, 0)] * 2 + [(0, 0, 1)] * 2
    assert colored(spark, [100, 100.01], {200.0: (255, 0, 0)}) == [gray] * 2
    assert colored(spark, [100, 100.02, 200], {100.0: (255, 0, 0)}) == [(1, 0, 0)] * 2 + [gray]
    assert colored(spark, [10], {8.0: (255, 0, 0), 12.0: (0, 255, 0)}, 5) == [(1, 0, 0)]  # the earlier on a tie


def room(n=3000, seed=0, noise=0.005):
    rng = np.random.default_rng(seed)
    u, v = rng.uniform(0, 1, (2, 6, n))
    w, d, h = 4.0, 3.0, 2.5
    faces = [(w * u[0], d * v[0], 0 * u[0]), (w * u[1], d * v[1], h + 0 * u[1]), (0 * u[2], d * u[2], h * v[2]), (w + 0 * u[3], d * u[3], h * v[3]), (w * u[4], 0 * u[4], h * v[4]), (w * u[5], d + 0 * u[5], h * v[5])]
    p = np.concatenate([np.stack(f, 1) for f in faces])
    return p + rng.normal(scale=noise, size=p.shape)


def frame(spark, p):
    return spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "point_id long, x double, y double, z double")


def test_room_and_floor(spark):
    cloud = frame(spark, room()).cache()
    found = planes.detect_room(cloud, 0.03)
    assert abs(found["floor"][2][2]) < 0.03 and abs(found["ceiling"][2][2] - 2.5) < 0.03 and len(found["walls"]) >= 3
    n, d, centre, k = planes.detect_floor(cloud, 0.03)
    assert n[2] > 0.999
    levelled = planes.level(cloud, n).agg(F.percentile("z", F.lit(0.05)).alias("p")).first().p
    assert abs(levelled) < 0.05


def test_small_plane_among_clutter(spark):
    p = np.random.default_rng(3).uniform(-2, 2, (3000, 3))
    p[:450, 2] = 0.5
    cloud = frame(spark, p).cache()
    for seed in (3, 4):
        n, _, centre, k = planes.detect_plane(cloud, 0.02, seed=seed)
        assert abs(n[2]) > 0.999 and abs(centre[2] - 0.5) < 0.01 and k >= 450
    some = [(0.0, 0.0, 1.0, -0.5), (1.0, 0.0, 0.0, 9.0), (0.6, 0.0, 0.8, 0.1)]
    want = {r.plane: r.votes for r in planes.hypothesis_votes(cloud, some, 0.02).collect()}
    assert {r.plane: r.votes for r in planes.many_votes(cloud, some, 0.02).collect()} == want


def test_level_rotation_is_orthonormal():
    from voxlake.functions.linalg import arc_to_z

    for n in ((0, 0, 1.0), (0.36, 0.48, 0.8), (0, 0, -1.0), (0.6, 0, -0.8)):
        r = np.array(arc_to_z(n))
        assert np.allclose(r @ r.T, np.eye(3)) and np.allclose(r @ n, [0, 0, 1]) and np.isclose(np.linalg.det(r), 1)


def test_outliers_of_a_sparse_cloud(spark):
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.normal(size=(300, 3)) * 0.05, rng.uniform(-1, 1, (60, 3)), [[9.0, 9, 9], [9, 9, 9], [-7, 0, 0]]])
    far = np.sort(np.linalg.norm(p[:, None] - p[None], axis=2), 1)[:, :10].mean(1)
    keep = far <= far.mean() + 1.5 * far.std(ddof=1)
    out = {r.point_id: r.mean_d for r in grid.statistical_outliers(frame(spark, p), 0.03, 10, 1.5).collect()}
    assert set(out) == set(np.flatnonzero(keep)) and not {360, 361, 362} & set(out)
    assert all(abs(out[i] - far[i]) < 1e-9 for i in out)
    few = [[0.0, 0, 0], [1, 0, 0], [0, 3, 0]]
    rows = frame(spark, few).unionByName(spark.createDataFrame([(3, None, 0.0, 0.0), (4, math.nan, 0.0, 0.0)], "point_id long, x double, y double, z double"))
    got = {r.point_id: r.mean_d for r in grid.nearest_means(rows, 0.03, 10).collect()}
    assert set(got) == {0, 1, 2} and abs(got[0] - 4 / 3) < 1e-9
    assert grid.nearest_means(rows.where("point_id > 2"), 0.03, 10).count() == 0


def test_oriented_box_and_hull(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(-0.5, 0.5, (400, 3)) * [2.0, 1.0, 0.8]
    a = 0.5
    q = np.c_[p[:, 0] * math.cos(a) - p[:, 1] * math.sin(a), p[:, 0] * math.sin(a) + p[:, 1] * math.cos(a), p[:, 2]]
    rows = [(1, *map(float, x)) for x in q] + [(2, 0.0, 0.0, 0.0)] * 2 + [(3, float(i), 0.0, 0.0) for i in range(5)]
    out = {r.det_id: r for r in fp.oriented_boxes(spark.createDataFrame(rows, "det_id long, x double, y double, z double")).collect()}
    assert set(out) == {1, 3} and out[3].grade == "low" and out[1].grade == "high"
    assert abs((out[1].yaw - a + math.pi / 2) % math.pi - math.pi / 2) < 0.1 and abs(out[1].sx - 2) < 0.15 and abs(out[1].sy - 1) < 0.15


def test_wall_fit(spark):
    rng = np.random.default_rng(2)
    t = rng.uniform(0, 3, 200)
    p = np.c_[t, 1 + rng.normal(scale=0.01, size=200)]
    p[:20, 1] += rng.uniform(0.1, 0.2, 20)
    rows = [(0, *map(float, x)) for x in p] + [(1, 0.0, 0.0)]
    out = {r.wall: r for r in fp.fit_walls(spark.createDataFrame(rows, "wall int, x double, y double")).collect()}
    assert out[1].fallback and abs(out[0].dy) < 0.02 and abs(out[0].py - 1) < 0.02


def test_simplify_and_directions(spark):
    ring = np.array([(x, 0.0) for x in np.linspace(0, 4, 40)] + [(4, y) for y in np.linspace(0, 3, 30)][1:] + [(x, 3.0) for x in np.linspace(4, 0, 40)][1:] + [(0, y) for y in np.linspace(3, 0, 30)][1:-1])
    assert len(fp.simplify_ring(ring, 0.05)) == 4
    w = spark.createDataFrame([(1.0, 4.0), (91.0, 3.0), (1.4, 4.0), (91.0, 3.0)], "angle double, length double")
    assert all(min(abs(d - x) for x in (1, 91, 0, 90)) <= 2 for d in fp.dominant_directions(w)[:2])


def test_consensus(spark):
    box = lambda s, l, i, c, x: (s, l, i, c, [x, 0.0, 0.0, 0.1, 1.0, 1.0, 1.0])
    rows = [box(1, 0, 0, "sofa", 0.0), box(1, 1, 0, "couch", 0.1), box(1, 2, 0, "sofa", 0.05), box(1, 0, 1, "table", 3.0), box(1, 1, 1, "sofa", 0.31)]
    items = spark.createDataFrame(rows, "scan_id long, layout_id int, line_idx int, cls string, v array<double>")
    alias = spark.createDataFrame([("sofa", "seat", 1), ("couch", "seat", 2)], "cls string, grp string, rank int")
    out = layout.consensus_boxes(items, alias).collect()
    assert len(out) == 1 and out[0].cls == "sofa" and out[0].votes == 3 and out[0].v[0] == 0.05
    wall = lambda l, a, b: (1, l, 0, [*map(float, (*a, *b)), 2.5, 0.1])
    walls = spark.createDataFrame([wall(0, (0.0, 0, 0), (4.0, 0, 0)), wall(1, (4.1, 0, 0), (0.1, 0, 0)), wall(2, (9.0, 0, 0), (9.0, 5, 0))], "scan_id long, layout_id int, line_idx int, v array<double>")
    out = layout.consensus_walls(walls).collect()
    assert len(out) == 1 and out[0].v[:2] == [0.05, 0.0]
    doors = spark.createDataFrame([(1, k, 0, "door", [0.1 * k, 0.0, 0.0, 0.9, 2.0]) for k in range(3)], "scan_id long, layout_id int, line_idx int, kind string, v array<double>")
    assert layout.consensus_openings(doors).collect()[0].votes == 3


def test_overlap_merge(spark):
    rows = [(1, k, "chair", [x, 0.0, 0.0, a, 1.0, 1.0, 1.0]) for k, (x, a) in enumerate(((0.0, 0.05), (0.2, math.pi - 0.05), (5.0, 0.0)))]
    out = sorted(layout.merge_overlaps(spark.createDataFrame(rows, "scan_id long, line_idx int, cls string, v array<double>")).collect(), key=lambda r: r.v[0])
    assert [r.merged for r in out] == [2, 1] and abs(math.sin(out[0].v[3])) < 1e-6
    assert abs(layout.footprint_iou([0, 0, 0, 0, 1, 1, 1], [0.5, 0, 0, 0, 1, 1, 1]) - 1 / 3) < 1e-9


def test_layout_round_trip(spark):
    lines = ["wall_7=Wall(0,0,0,4,0,0,2.5,0.1)", "door_2=Door(wall_7,1,0,1,0.9,2)", "bbox_5=Bbox(chair,1,2,0,0.1,1e-05,1,1)", "noise", "bbox_x=Bbox(a,1)"]
    parsed = layout.parse(spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "layout_id int, line_idx int, line string"))
    assert [(r.kind, r.idx) for r in parsed.orderBy("line_idx").collect()] == [("wall", 7), ("door", 2), ("bbox", 5)]
    out = [r.line for r in layout.write(parsed).orderBy("line_idx").collect()]
    assert out[0].startswith("wall_0=Wall(0.0,") and out[1].startswith("door_0=Door(wall_0,1.0") and "1.0E-5" in out[2]
    again = layout.parse(spark.createDataFrame([(0, i, x) for i, x in enumerate(out)], "layout_id int, line_idx int, line string"))
    assert sorted(map(str, (r.v for r in again.collect()))) == sorted(map(str, (r.v for r in parsed.collect())))


def test_ply(spark, tmp_path):
    p = room(50)
    (tmp_path / "a.ply").write_bytes(ply.encode(dict(zip("xyz", p.T)), ["floor_leveled 0.0"]))
    back = ply.read_ply(spark, f"{tmp_path}/a.ply").orderBy("point_id").collect()
    assert np.allclose([[r.x, r.y, r.z] for r in back], p, atol=1e-6)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert ply.has_comment(files, "floor_leveled").first().marked
    mixed = b"ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty uchar red\nproperty double x\nend_header\n" + b"\x07" + np.array([1.5]).tobytes()
    assert ply.decode(mixed)[0]["x"][0] == 1.5
    for bad in (b"nothing", mixed[:-1], mixed.replace(b"vertex 1", b"vertex 0")):
        with pytest.raises(ValueError):
            ply.decode(bad)


def test_poses_and_map(spark):
    p = room(60, noise=0.0)
    rng = np.random.default_rng(3)
    rows = []
    for s in range(3):
        q = p[rng.choice(len(p), 300, replace=False)] - [0.02 * s, 0, 0]
        rows += [(1, s, i, 1000.0 + s, 0.0, *map(float, x)) for i, x in enumerate(q)]
    pts = spark.createDataFrame(rows, "bag_id long, scan_id long, point_idx int, stamp double, t_off double, x double, y double, z double")
    poses = get_backend("scan_to_map")(pts, voxel=0.3)
    found = poses.orderBy("scan_id").collect()
    assert len(found) == 3 and all(abs(np.linalg.det(np.array([[r[f"r{i}{j}"] for j in range(3)] for i in range(3)])) - 1) < 1e-6 for r in found)
    assert not motion.diverged(poses).first().diverged
    scans = pts.select("scan_id", "stamp").distinct()
    assert motion.trajectory(poses, scans).count() == 3
    m = build_map(pts.drop("bag_id"), imu_rows(spark, (0, 0, 0)), poses.drop("bag_id"), voxel=0.1, neighbours=5, level=False)
    assert m.count() > 100 and m.where("has_color").count() == 0
    with pytest.raises(KeyError):
        get_backend("none")
    with pytest.raises(Exception):
        motion.apply_poses(pts, poses.where("scan_id < 2").drop("bag_id")).collect()


def test_raster_morphology(spark):
    cells = spark.createDataFrame([(x, y) for x in range(5) for y in range(5) if (x, y) != (2, 2)] + [(20, 20)], "ix long, iy long")
    as_set = lambda df: {(r.ix, r.iy) for r in df.collect()}
    assert (2, 2) in as_set(raster.close(cells, 1)) and (20, 20) not in as_set(raster.open_(cells, 1))
    assert len(as_set(raster.largest_component(cells))) == 24


def test_results_do_not_depend_on_partitions(spark):
    p = frame(spark, room(100)).withColumns({"has_color": F.col("point_id") % 2 == 0, **{c: F.lit(0.5) for c in "rgb"}})
    rows = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert rows(grid.voxel_color_mean(p.repartition(1), 0.5)) == rows(grid.voxel_color_mean(p.repartition(8), 0.5))


def test_streaming(spark, tmp_path):
    from voxlake.streaming.live import each_frame, live_voxels

    p = frame(spark, room(50)).withColumns({"has_color": F.lit(True), **{c: F.lit(0.5) for c in "rgb"}})
    p.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(p.schema).parquet(f"{tmp_path}/in")
    q = live_voxels(stream, 0.5).writeStream.outputMode("complete").format("memory").queryName("vox").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("vox").count() == grid.voxel_color_mean(p, 0.5).count()
    seen = []
    q = each_frame(stream, lambda df, k: seen.append(df.count()), f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == p.count()
