"""Sources and composed plans on data made here: bags, rooms, layouts, files."""

import math
import struct
import warnings
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxlake import storage
from voxlake.functions import binning, polygon
from voxlake.operators import camera, grid, metrics, motion, planes, quantile, raster, walls
from voxlake.plans import floor_plan, layouts, level_cloud, scan
from voxlake.plans.backends import register
from voxlake.sources import bag, calibration, ply, png


class Writer:
    """A message in the common data representation, little-endian."""

    def __init__(self):
        self.data = bytearray(b"\0\1\0\0")

    def put(self, kind, *values):
        size = struct.calcsize(kind)
        for v in values:
            self.data += b"\0" * (-(len(self.data) - 4) % size) + struct.pack("<" + kind, v)
        return self

    def raw(self, b):
        self.put("I", len(b))
        self.data += b
        return self

    def head(self, stamp):
        return self.put("i", int(stamp)).put("I", round((stamp - int(stamp)) * 1e9)).raw(b"frame\0")


def cloud_message(stamp, xyz, t):
    w = Writer().head(stamp).put("I", 1, len(xyz)).put("I", 5)
    for name, at, kind in ((b"x\0", 0, 7), (b"y\0", 4, 7), (b"z\0", 8, 7), (b"intensity\0", 16, 7), (b"time\0", 24, 7)):
        w.raw(name).put("I", at).put("B", kind).put("I", 1)
    body = np.zeros(len(xyz), np.dtype({"names": ["x", "y", "z", "i", "t"], "formats": ["<f4"] * 5, "offsets": [0, 4, 8, 16, 24], "itemsize": 32}))
    for k, c in enumerate("xyz"):
        body[c] = xyz[:, k]
    body["t"], body["i"] = t, 7
    return bytes(w.put("B", 0).put("I", 32, 32 * len(xyz)).raw(body.tobytes()).put("B", 1).data)


def record(kind, body):
    return bytes([kind]) + len(body).to_bytes(8, "little") + body


def text(s):
    return len(s).to_bytes(4, "little") + s.encode()


def bag_bytes(messages, compression):
    topics = list(dict.fromkeys(t for t, _ in messages))
    inner = b"".join(record(4, struct.pack("<HH", k, 0) + text(t) + text("cdr") + b"\0\0\0\0") for k, t in enumerate(topics))
    inner += b"".join(record(5, struct.pack("<HIQQ", topics.index(t), 0, 5, 5) + m) for t, m in messages)
    packed = inner if not compression else pa.Codec(compression).compress(inner).to_pybytes()
    chunk = struct.pack("<QQQI", 0, 9, len(inner), 0) + text(compression) + len(packed).to_bytes(8, "little") + packed
    return bag.MARK + record(1, text("") + text("")) + record(6, chunk) + record(15, b"\0" * 4) + record(2, b"\0" * 20) + bag.MARK


@pytest.mark.parametrize("compression", ["", "lz4", "zstd"])
def test_bag(spark, tmp_path, compression):
    rng = np.random.default_rng(0)
    xyz = rng.normal(size=(50, 3)).astype(np.float32)
    xyz[3] = 0.01  # too near
    imu = bytes(Writer().head(9.25).put("d", *range(13)).put("d", 1, 2, 3).put("d", *[0] * 9).put("d", 4, 5, 9.8).put("d", *[0] * 9).data)
    image = bytes(Writer().head(9.5).raw(b"jpeg\0").raw(b"pixels").data)
    names = bag.TOPICS
    for k in range(2):
        (tmp_path / f"b{k}.mcap").write_bytes(bag_bytes([(names["cloud"], cloud_message(10.5 + k, xyz, np.arange(50) / 100)), (names["imu"], imu), ("/other", b"x"), (names["image"], image), (names["cloud"], cloud_message(11.5, xyz[:0], []))], compression))
    (tmp_path / "notes.txt").write_text("no bag")
    found = bag.read_bag(spark, str(tmp_path))
    p = found["points"].where("path LIKE '%b0%'").orderBy("point_idx").toPandas()
    far = np.delete(xyz, 3, 0)
    assert len(p) == 49 and (p[["x", "y", "z"]].to_numpy() == far).all() and set(p.stamp) == {10.5} and p.intensity.eq(7).all() and math.isclose(p.t_off.iloc[-1], 0.49, rel_tol=1e-6)
    assert [tuple(r)[1:] for r in found["imu"].collect()] == [(9.25, 1.0, 2.0, 3.0, 4.0, 5.0, 9.8)] * 2
    assert [tuple(r)[1:] for r in found["images"].collect()] == [(0, 9.5, b"pixels", "jpeg")] * 2
    with pytest.raises(FileNotFoundError):
        bag.read_bag(spark, str(tmp_path / "notes.txt"))
    with pytest.raises(ValueError):
        list(bag.messages(b"PK"))


def test_bag_metadata():
    doc = "rosbag2_bagfile_information:\n  duration: {nanoseconds: 1500000000}\n  starting_time: {nanoseconds_since_epoch: 7}\n  message_count: 3\n  topics_with_message_count:\n  - topic_metadata: {name: /a}\n    message_count: 3\n"
    assert bag.bag_metadata(doc) == {"seconds": 1.5, "start_ns": 7, "messages": 3, "topics": {"/a": 3}}


INTRINSICS = "image_width: 100\nimage_height: 80\ncamera_matrix: {data: [90, 0, 50, 0, 91, 40, 0, 0, 1]}\ndistortion_coefficients: {data: [0.1, 0.2, 0.3, 0.4, 0.5]}\n"
EXTRINSICS = "rotation: {w: 0.2121777, x: 0.0, y: 0.0, z: 0.9772311}\ntranslation: {x: 0.0, y: 0.07, z: -0.072}\n"


def test_calibration(spark, tmp_path):
    assert calibration.load_calibration(INTRINSICS, None) is None and calibration.read_calibration(spark, str(tmp_path)) is None
    storage.save_file(spark, f"{tmp_path}/intrinsics.yaml", INTRINSICS.encode())
    storage.save_file(spark, f"{tmp_path}/extrinsics.yaml", EXTRINSICS.encode())
    cam = calibration.read_calibration(spark, str(tmp_path))
    assert (cam.fx, cam.fy, cam.cx, cam.cy, cam.width, cam.height, cam.dist) == (90, 91, 50, 40, 100, 80, (0.1, 0.2, 0.3, 0.4, 0.5))
    r = np.array(cam.rotation)
    assert np.allclose(r @ r.T, np.eye(3)) and np.allclose(r @ [0, 0.07, -0.072] + cam.translation, 0)


def test_percentiles(spark, monkeypatch):
    rng = np.random.default_rng(1)
    for v in (rng.normal(size=5000), np.repeat([1.0, 2.0, 2.0, 9.0], 700), rng.exponential(size=3000) ** 8, np.array([3.0]), np.array([-0.0, 0.0])):
        df = spark.createDataFrame(pd.DataFrame({"v": v})).union(spark.createDataFrame([(None,), (float("nan"),)], "v double"))
        for few in (20_000, 5):
            monkeypatch.setattr(quantile, "FEW", few)
            shares = [0.0, 0.01, 0.5, 0.95, 1.0]
            assert np.allclose(quantile.percentiles(df, "v", shares), np.percentile(v, [100 * s for s in shares]), rtol=1e-12)
    assert quantile.percentiles(df.where("v > 100 AND NOT isnan(v)"), "v", [0.5]) is None


def test_nearest_means_by_search_and_by_scan(spark, monkeypatch):
    rng = np.random.default_rng(9)
    p = np.concatenate([rng.normal(size=(200, 3)) * 0.1, rng.uniform(-2, 2, (60, 3)), [[30.0, 0, 0], [30, 0, 0]]])
    want = np.sort(np.linalg.norm(p[:, None] - p[None], axis=2), 1)[:, :6].mean(1)
    for few in (0, 5, 1000):
        monkeypatch.setattr(grid, "FEW", few)
        got = {r.point_id: r.mean_d for r in grid.nearest_means(cloud(spark, p), 0.05, 6).collect()}
        assert np.allclose([got[k] for k in range(len(p))], want)
    few = cloud(spark, p[:3])
    assert np.allclose([r.mean_d for r in grid.nearest_means(few, 0.01, 6).orderBy("point_id").collect()], np.linalg.norm(p[:3, None] - p[None, :3], axis=2).mean(1))


def room(n=9000, w=4.0, d=3.0, h=2.5, noise=0.005, seed=0):
    rng = np.random.default_rng(seed)
    u = lambda k: (rng.random(k), rng.random(k))
    parts = []
    for z in (0.0, h):
        a, b = u(n * (1 + (z > 0)))
        parts.append(np.stack([a * w, b * d, np.full(len(a), z)], 1))
    for k in range(2):
        a, b = u(n // 2)
        parts.append(np.stack([a * w, np.full(len(a), k * d), b * h], 1))
        a, b = u(n // 2)
        parts.append(np.stack([np.full(len(a), k * w), a * d, b * h], 1))
    p = np.concatenate(parts)
    return p + rng.normal(0, noise, p.shape)


def cloud(spark, p):
    return spark.createDataFrame(pd.DataFrame({"point_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))


@pytest.fixture(scope="module")
def plan(spark):
    df = storage.stored(cloud(spark, room()))
    return df, floor_plan.floor_plan(df)


def test_floor_plan(plan):
    _, found = plan
    assert abs(found["floor_z"]) < 0.02 and abs(found["ceiling_z"] - 2.5) < 0.02
    name, ring = floor_plan.usable_ring(found["variants"])
    assert name == "D_refined" and len(ring) == 4
    corners = sorted(map(tuple, ring.round(2).tolist()))
    assert np.abs(np.array(corners) - [(0, 0), (0, 3), (4, 0), (4, 3)]).max() <= 0.02
    assert abs(abs(polygon.signed_area(found["variants"]["A_natural"])) - 12) < 0.6 and len(found["variants"]["C_snapped"]) >= 4
    b = found["variants"]["B_corners"]
    assert found["n_corners_detected"] == len(b) >= 4 and min(np.linalg.norm(b - c, axis=1).min() for c in ((0, 0), (4, 0))) < 0.25
    doc = floor_plan.plan_metadata(found)
    assert '"D_refined"' in doc and '"snapped_to": "dominant"' in doc and '"area_m2": 12.0' in doc
    with pytest.raises(ValueError):
        floor_plan.usable_ring({"A_natural": np.array([(0, 0), (0.5, 0), (0.5, 0.5)])})


def pixels_of(data):
    """Rows of a PNG, with whatever its parts' checksums say."""
    at, body, size = 8, b"", None
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    while at < len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        assert zlib.crc32(name + part) == struct.unpack_from(">I", data, at + 8 + n)[0]
        size = struct.unpack_from(">IIBB", part) if name == b"IHDR" else size
        body += part if name == b"IDAT" else b""
        at += 12 + n
    wide = size[0] * (3 if size[3] == 2 else 1)
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], wide + 1)
    assert (rows[:, 0] == 0).all()
    return rows[:, 1:].reshape(size[1], size[0], -1)


def test_pictures(plan, spark, tmp_path, monkeypatch):
    df, found = plan
    colored = df.withColumns({"r": F.lit(1.0), "g": F.lit(0.0), "b": F.lit(0.0)})
    path = f"{tmp_path}/a/slice.png"
    assert png.slice_png(colored, path, 1.2) and not png.slice_png(colored, path, 99.0)
    rows = pixels_of(storage.load_file(spark, path))
    assert abs(rows.shape[1] * 0.02 - 4) < 0.1 and abs(rows.shape[0] * 0.02 - 3) < 0.1
    assert {tuple(c) for c in rows.reshape(-1, 3)} == {(255, 255, 255), (255, 0, 0)} and (rows[20:-20, 20:-20] == 255).all()
    monkeypatch.setattr(raster, "MAX_SIDE", 50)
    assert png.slice_png(colored, path, 1.2) and pixels_of(storage.load_file(spark, path)).shape[1] == 50
    png.mask_png(spark, found["mask"], path)
    assert (pixels_of(storage.load_file(spark, path)) > 0).sum() == found["mask"].sum()
    png.plan_png(spark, found["variants"], path)
    assert (pixels_of(storage.load_file(spark, path)) == (220, 0, 0)).all(2).sum() > 1000


def test_crop(plan, spark):
    df, found = plan
    out = cloud(spark, np.array([[-0.5, 1, 1], [2, 1, 3.0], [2, 1, 1.0]])).withColumn("point_id", F.col("point_id") + 10**6)
    kept, info = floor_plan.crop_to_room(df.unionByName(out), floor_plan.usable_ring(found["variants"])[1], found["floor_z"], found["ceiling_z"])
    assert info["n_in"] == df.count() + 3 and info["n_out"] == kept.count() == df.count() + 1 and info["buffer_m"] == 0.08


def test_heights_without_planes(spark):
    rng = np.random.default_rng(2)
    thin = cloud(spark, np.concatenate([rng.normal([0, 0, 0], [3, 3, 0.03], (40, 3)), rng.normal([0, 0, 2.4], [3, 3, 0.03], (40, 3))]))
    floor, ceiling, plane = floor_plan.floor_and_ceiling(thin)
    assert abs(floor) < 0.1 and abs(ceiling - 2.4) < 0.1 and plane is None
    with pytest.raises(ValueError):
        floor_plan.floor_and_ceiling(thin.where("x > 1000"))


def test_ceiling_is_the_wider_plane(spark):
    rng = np.random.default_rng(3)
    low, high = rng.random((500, 3)) * [4, 4, 0], rng.random((500, 3)) * [2, 2, 0] + [0, 0, 2.5]
    df = cloud(spark, np.concatenate([low, high]))
    p = lambda z: ((0.0, 0.0, 1.0), -z, (0, 0, z), 500)
    assert planes.pick_ceiling(df, {"floor": p(0.0), "ceiling": p(2.5)}) == (p(0.0), p(2.5), True)
    assert not planes.pick_ceiling(df, {"floor": p(2.5), "ceiling": p(0.0)})[2]
    assert planes.pick_ceiling(df, {"floor": None, "ceiling": p(0.0)}) == (p(0.0), None, False)


def test_point_normals(spark):
    p = room(600, noise=0.0)
    found = grid.point_normals(cloud(spark, p), 0.6).toPandas().set_index("point_id")
    inner = [i for i, q in enumerate(p) if q[2] == 0 and 0.7 < q[0] < 3.3 and 0.7 < q[1] < 2.3]
    assert len(inner) > 100 and (found.loc[[i for i in inner if i in found.index], "nz"].abs() > 0.99).all()


def test_polygons():
    ring = [(0, 0), (4, 0), (4, 3), (0, 3)]
    assert np.allclose(sorted(polygon.buffered(ring[::-1], 0.1).tolist()), sorted([[-0.1, -0.1], [4.1, -0.1], [4.1, 3.1], [-0.1, 3.1]]))
    spike = polygon.buffered([(0, 0), (10, 0.2), (0, 0.4)], 0.1, 5.0)
    assert len(spike) > 3 and spike[:, 0].max() <= 10.51
    tie = polygon.largest_loop([(0, 0), (4, 3), (4, 0), (0, 1)])
    assert polygon.is_simple(tie) and np.isclose(abs(polygon.signed_area(tie)), 4.5)
    assert not polygon.is_simple([(0, 0), (2, 2), (2, 0), (0, 2)]) and polygon.is_simple(ring)
    mask = np.zeros((20, 30), bool)
    mask[3:15, 4:25] = True
    mask[6:9, 8:12] = False
    mask[18, 28] = True
    whole, others = polygon.largest_part(polygon.filled(mask))
    assert whole.sum() == 12 * 21 and others == 1
    line = polygon.outline(whole)
    assert len(line) == 2 * (11 + 20) and np.isclose(abs(polygon.signed_area(line)), 11 * 20)
    assert len(polygon.outline(polygon.filled(mask) & ~whole)) == 1 and len(polygon.outline(whole & False)) == 0
    assert (polygon.eroded(polygon.dilated(whole, 5), 5) == whole).all()


def test_peaks():
    assert binning.peaks([0, 1, 3, 3, 1, 0, 2, 0, 5, 0]) == [2, 6, 8] and binning.peaks([0, 1, 3, 3, 1, 0, 2, 0, 5, 0], 0, 3) == [2, 8]
    assert binning.peaks([5, 1, 5]) == [] and binning.top_peaks([0, 9, 0, 3, 0, 5, 0], [1, 3, 5]) == [1, 5]
    assert np.isclose(binning.smoothed(np.ones(50), 3), 1).all()


def wall(a, b, n=200, residual=0.01, **more):
    a, b = np.array(a, float), np.array(b, float)
    d = (b - a) / np.linalg.norm(b - a)
    half = np.linalg.norm(b - a) / 2
    return walls.Wall(a, b, (a + b) / 2, d, -half, half, n, n * (half**2 / 3 * np.outer(d, d)), residual, 0.5, **more)


def test_walls_join_meet_and_hold():
    ring = [wall((0, 0), (2, 0.01)), wall((2.1, 0), (4, 0)), wall((4, 0), (4, 3)), wall((4, 3), (0, 3)), wall((0, 3), (0, 1.6)), wall((0, 1.4), (0, 0))]
    one = walls.joined(ring)
    assert len(one) == 4 and one[0].n == 400 and np.allclose(one[0].end, [4, 0], atol=0.02)
    met = walls.cornered(one)
    assert np.abs(np.array(sorted(tuple(w.start) for w in met)) - [(0, 0), (0, 3), (4, 0), (4, 3)]).max() < 0.03
    far = [wall((0, 0), (4, 0)), wall((4, 0), (4, 3)), wall((4, 3), (0, 3)), wall((0, 3), (0, 0))]
    far[0] = walls.replace(far[0], end=np.array([6.0, 0]))
    far[1] = walls.replace(far[1], start=np.array([6.0, 0]))
    kept, moved = walls.held(far)
    assert moved == 1 and kept[0].end[0] < 5.3 and (kept[0].end == kept[1].start).all()
    assert walls.held(far[:2])[1] == 0 and not walls.continues(ring[0], walls.replace(ring[1], fallback=True))


def test_layout_merge(spark):
    rows = []
    for layout_id in range(3):
        rows += [(1, layout_id, 0, "wall", 0, None, [0.0, 0, 0, 4, 0.01 * layout_id, 0, 2.5, 0.1]), (1, layout_id, 1, "door", 0, None, [1.0 + 0.01 * layout_id, 0, 1, 0.9, 2]), (1, layout_id, 2, "window", 0, None, [3.0, 0, 1.5, 1, 1])]
        rows += [(1, layout_id, 3, "bbox", 0, "sofa", [1.0, 1 + 0.05 * layout_id, 0.4, 0, 2, 0.9, 0.8]), (1, layout_id, 4, "bbox", 1, "sofa", [1.05, 1.0, 0.4, 0, 2, 0.9, 0.8]), (1, layout_id, 5, "bbox", 2, "lamp", [3.0 + layout_id, 2, 1, 0, 0.3, 0.3, 1.5])]
    items = spark.createDataFrame([(*r[:6], [float(x) for x in r[6]]) for r in rows], "scan_id long, layout_id int, line_idx int, kind string, idx int, cls string, v array<double>")
    aliases = spark.createDataFrame([("sofa", "seat", 0)], "cls string, grp string, rank int")
    kinds = lambda df: [r.line.split("=")[0] for r in df.orderBy("line_idx").collect()]
    first = items.where("layout_id = 0")
    assert kinds(layouts.merge(first, first)) == ["wall_0", "door_0", "window_0", "bbox_0", "bbox_1"]
    conf = spark.createDataFrame([(1, 0, "door", 0, -3.0), (1, 0, "bbox", 2, -3.0)], "scan_id long, layout_id int, kind string, idx int, logprob double")
    assert kinds(layouts.merge(first, first, conf=conf, least={"door": -1.0})) == ["wall_0", "window_0", "bbox_0", "bbox_1"]
    assert kinds(layouts.merge_consensus(first, items, aliases)) == ["wall_0", "door_0", "window_0", "bbox_0"]
    full = layouts.merge_full_consensus(items, items, aliases)
    assert kinds(full) == ["wall_0", "door_0", "window_0", "bbox_0"]
    lines = [r.line for r in full.orderBy("line_idx").collect()]
    assert lines[1] == "door_0=Door(wall_0,1.01,0.0,1.0,0.9,2.0)" and lines[3].startswith("bbox_0=Bbox(sofa,1.0,1.05,0.4,")


def test_embedded_layout(spark):
    one = [0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0]
    items = spark.createDataFrame([(1, 0, 0, "bbox", 0, "chair", one), (1, 0, 1, "bbox", 1, "thing", [5.0, *one[1:]]), (1, 0, 2, "door", 0, None, [9.0, 0.0, 0.0, 1.0, 2.0])], "scan_id long, layout_id int, line_idx int, kind string, idx int, cls string, v array<double>")
    base = spark.createDataFrame([(1, 0.5, 0.5, 0.5, 0.1, 0.2, 0.3)], "scan_id long, x double, y double, z double, r double, g double, b double")
    out = layouts.embed(base, items, 0.3).toPandas()
    colors = out.groupby(["r", "g", "b"]).size()
    assert colors[(0.0, 200 / 255, 0.0)] == 12 * 5 and colors[(1.0, 0.0, 1.0)] == 12 * 5 and colors[(1.0, 0.0, 0.0)] == 3 * 2 and len(out) == 1 + 120 + 6


def test_level_once(spark, tmp_path):
    tilt = np.array([[1, 0, 0], [0, math.cos(0.2), -math.sin(0.2)], [0, math.sin(0.2), math.cos(0.2)]])
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.random((3000, 3)) * [4, 3, 0], rng.random((600, 3)) * [4, 0, 2.5]]) @ tilt.T + [0, 0, 1.0]
    source, target, again = (f"{tmp_path}/{n}.ply" for n in ("a", "b", "c"))
    storage.save_file(spark, source, ply.encode({"x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "w": np.arange(len(p))}, ["made here"]))
    assert level_cloud.level_ply(spark, source, target) and not level_cloud.level_ply(spark, target, again)
    v, comments = ply.decode(storage.load_file(spark, target))
    assert comments[0] == "made here" and comments[1].startswith("floor_leveled rotation_deg=11.") and v.dtype.names == ("x", "y", "z", "w")
    assert abs(np.median(v["z"][:3000])) < 0.03 and (v["w"] == np.arange(len(p))).all()
    assert storage.load_file(spark, again) == storage.load_file(spark, target) and storage.load_file(spark, f"{tmp_path}/none") is None


def test_whole_scan(spark):
    rng = np.random.default_rng(6)
    base = room(1500, noise=0.0) - [2, 1.5, 1.2]
    rows = []
    for k in range(3):
        own = base[rng.choice(len(base), 1500, replace=False)] - [0.02 * k, 0, 0]
        rows.append(pd.DataFrame({"bag_id": 0, "scan_id": k, "point_idx": np.arange(1500), "stamp": 10.0 + k, "t_off": np.linspace(0, 0.08, 1500), "x": own[:, 0], "y": own[:, 1], "z": own[:, 2]}))
    points = spark.createDataFrame(pd.concat(rows)).withColumn("bag_id", F.col("bag_id").cast("long"))
    imu = spark.createDataFrame([(9.9 + 0.02 * k, 0.0, 0.0, 0.0) for k in range(200)], "t double, gx double, gy double, gz double")

    @register("fails")
    def fails(points, imu):
        raise RuntimeError("not here")

    seen = []
    cloud_, poses, stats = scan.run(points, imu, estimators=("fails", "scan_to_map"), voxel=0.05, per_frame=lambda i, t, p: seen.append((i, t)), level=False)
    assert stats["backend"] == "scan_to_map" and stats["gave_way"] == {"fails": "not here"} and stats["scans"] == 3 and stats["points"] == cloud_.count() > 1000
    assert seen == [(0, 10.0), (1, 11.0), (2, 12.0)]
    assert np.allclose(sorted(r.tx for r in poses.collect()), [0, 0.02, 0.04], atol=0.01)
    with pytest.raises(RuntimeError, match="not here"):
        scan.run(points, imu, estimators=("fails",))
    flat = scan.all_metrics(cloud_, poses)
    assert set(flat) == {"wall_rmse_m", "n_walls", "floor_rmse_m", "floor_inliers", "coherence_mean", "coherence_p95", "mixed_voxels", "mean_jerk", "p95_jerk", "trajectory_length_m"} and abs(flat["trajectory_length_m"] - 0.04) < 0.01


def test_map_with_colour_level_and_outliers(spark, tmp_path):
    """Two scans of a tilted room whose camera sees one wall; lone points go, the floor comes to 0, the trajectory is kept."""
    from voxlake.plans.build_map import build_map

    base = room(2500, noise=0.002)
    tilt = np.array([[1, 0, 0], [0, math.cos(0.1), -math.sin(0.1)], [0, math.sin(0.1), math.cos(0.1)]])
    world = np.concatenate([base, [[2.0, 1.5, 9.0], [20.0, 1.0, 1.0]]]) @ tilt.T
    rows = [(0, s, k, 100.0 + s, 0.0, *map(float, p)) for s in (0, 1) for k, p in enumerate(world[s::2])]
    points = spark.createDataFrame(rows, "bag_id long, scan_id long, point_idx int, stamp double, t_off double, x double, y double, z double")
    imu = spark.createDataFrame([(0, 99.0 + 0.1 * k, 0.0, 0.0, 0.0) for k in range(40)], "bag_id long, t double, gx double, gy double, gz double")
    poses = spark.createDataFrame([(s, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0) for s in (0, 1)], "scan_id long, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)) + ", tx double, ty double, tz double")
    images = spark.createDataFrame([(0, 7, 100.02)], "bag_id long, image_id long, t double")
    cam = camera.Camera(50.0, 50.0, 50.0, 50.0, 100, 100, (0.0,) * 5, ((0, -1, 0), (0, 0, -1), (1, 0, 0)), (1.5, 1.2, 0.5))
    pixels = spark.range(10_000).select(F.lit(7).cast("long").alias("image_id"), (F.col("id") % 100).cast("int").alias("u"), F.expr("id div 100").cast("int").alias("v"), F.lit(255).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    out = build_map(points, imu, poses, images, pixels, cam, voxel=0.05, neighbours=8).toPandas()
    assert len(out) > 2000 and out.z.max() < 4 and out.x.max() < 5 and abs(out.z[out.z < 0.1].median()) < 0.05
    red = out[out.has_color]
    assert 0 < len(red) < len(out) and (red.r == 1).all() and (out[~out.has_color].r == grid.GRAY).all()
    motion.write_trajectory(poses, points.select("scan_id", "stamp").distinct(), f"{tmp_path}/t")
    assert spark.read.option("header", True).csv(f"{tmp_path}/t").columns == ["timestamp", "x", "y", "z", "qw", "qx", "qy", "qz"]


def test_deskew_warns_and_holds_rates(spark):
    t = np.linspace(0, 0.08, 9)
    xyz = np.tile([1.0, 0, 0], (9, 1))
    with pytest.warns(UserWarning, match="imu samples missing"):
        assert motion.deskew_kernel(t, xyz, 1000.0, np.linspace(500, 500.1, 25), np.ones((25, 3))) is xyz
    with pytest.raises(ValueError):
        motion.deskew_kernel(t, xyz, 1000.0, np.array([1000.0]), np.ones((1, 3)), "middle")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        # one sample alone holds for the whole scan; after the last sample its rate holds
        one = motion.deskew_kernel(t, xyz, 1000.0, np.array([1000.04]), np.array([[0, 0, 1.0]]))
        late = motion.deskew_kernel(t, xyz, 1000.0, np.array([999.0, 1000.005]), np.array([[0, 0, 0.5], [0, 0, 2.0]]))
    angle = lambda p: np.arctan2(p[:, 1], p[:, 0])
    assert np.allclose(angle(one), -(0.08 - t)) and np.allclose(angle(late)[1:], -2.0 * (0.08 - t[1:]))
    rows = [(b, 1, k, 1000.0, float(o), 1.0, 0.0, 0.0) for b in (0, 1, 2) for k, o in enumerate(t)]
    points = spark.createDataFrame(rows, "bag_id long, scan_id long, point_idx int, stamp double, t_off double, x double, y double, z double")
    imu = spark.createDataFrame([(0, 1000.04, 0.0, 0.0, 1.0), (1, 999.0, 0.0, 0.0, 0.5), (1, 1000.005, 0.0, 0.0, 2.0), (2, 5.0, 0.0, 0.0, 9.0)], "bag_id long, t double, gx double, gy double, gz double")
    out = motion.deskew(points, imu, by=("bag_id",)).orderBy("bag_id", "point_idx").toPandas()
    for b, want in ((0, one), (1, late), (2, xyz)):
        assert np.allclose(out[out.bag_id == b][["x", "y", "z"]].to_numpy(), want)
    with pytest.warns(UserWarning, match="1 scans"):
        assert motion.unmet_scans(points, imu, ("bag_id",)) == 1


def test_neighbours_of_many():
    rng = np.random.default_rng(7)
    target, source = rng.random((400, 3)), rng.random((300, 3)) * 1.4 - 0.2
    i, j = motion.NearGrid(target, 0.2).pairs(source, 3)
    for k, p in enumerate(source):
        d = np.linalg.norm(target - p, axis=1)
        want = [x for x in np.argsort(d)[:3] if d[x] <= 0.2]
        assert j[i == k].tolist() == want


def test_largest_component_over_tiles(spark, monkeypatch):
    rng = np.random.default_rng(8)
    cells = np.argwhere(rng.random((60, 70)) < 0.47) - 20
    monkeypatch.setattr(raster, "TILE", 8)
    got = {(r.ix, r.iy) for r in raster.largest_component(spark.createDataFrame(pd.DataFrame(cells, columns=["ix", "iy"]))).collect()}
    mask = np.zeros((60, 70), bool)
    mask[tuple((cells + 20).T)] = True
    assert got == {tuple(c - 20) for c in np.argwhere(polygon.largest_part(mask)[0])}


def test_projection_compiles(spark, capfd):
    cam = camera.Camera(757.0, 757.0, 628.0, 355.0, 1280, 720, (0.2, -0.4, 0.0003, -0.001, 0.2), ((0, -1, 0), (0, 0, -1), (1, 0, 0)), (0.1, 0.2, 0.3))
    df = spark.range(100).select("id", *[(F.col("id") * k).cast("double").alias(c) for c, k in (("x", 1.0), ("y", 0.01), ("z", 0.02))])
    assert camera.project(df, cam).where(camera.in_image(cam)).count() > 0
    assert "64 KB" not in capfd.readouterr().err


def test_measures(spark):
    df = cloud(spark, room(3000))
    rms, n = metrics.floor_measure(df)
    assert rms < 0.02 and n > 1000 and metrics.floor_measure(df.limit(10)) == (None, 0) and metrics.floor_flatness(df) == rms
    found = metrics.wall_rmse(df, walls=2, attempts=6, least=500)
    assert len(found) == 2 and max(found) < 0.03
    crossed = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "mark_id long, x double, y double, z double")
    from voxlake.operators.layout import crosses

    assert crosses(crossed, 0.1, 0.1).count() == 9
    imu = spark.createDataFrame([(float(k), 0.0, 0.0, 9.8) for k in range(60)] + [(99.0, 9.0, 9.0, 9.0)], "t double, ax double, ay double, az double")
    assert tuple(camera.gravity(imu).first()) == (0.0, 0.0, 1.0)
