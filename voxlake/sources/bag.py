"""Recorded bags: chunked, indexed containers of serialised messages, read record by record.

A container is a sequence of records (a byte of kind, eight of length, the body) between two marks. Channels name their
topic, messages their channel; chunks hold records, compressed or not. Messages are in the common data representation:
little- or big-endian, each number aligned to its size from behind a head of four bytes.

One file is one task, which hands its messages on one at a time, so it holds the file and one message, not a stream.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The container's mark, kinds of records, topics, types of fields by their code.
MARK = b"\x89MCAP0\r\n"
_CHANNEL, _MESSAGE, _CHUNK, _FOOTER = 0x04, 0x05, 0x06, 0x02
TOPICS = {"cloud": "/unilidar/cloud", "imu": "/unilidar/imu", "image": "/camera/image_raw/compressed"}
_FIELDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}


def _unpacked(kind: str, data: bytes, size: int) -> bytes:
    if kind == "":
        return data
    if kind not in ("lz4", "zstd"):
        raise ValueError(f"compression {kind}")
    return pa.Codec(kind).decompress(data, size).to_pybytes()


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(kind, body) of the records of a file or of a chunk's content, chunks taken apart."""
    at, stop = (len(MARK), len(data) - len(MARK)) if data.startswith(MARK) else (0, len(data))
    while at + 9 <= stop:
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 9], "little")
        body = data[at + 9 : at + 9 + size]
        if len(body) < size:
            raise ValueError("a record is cut off")
        at += 9 + size
        if kind == _CHUNK:
            raw, _, n = struct.unpack_from("<QIi", body, 16)
            name = body[32 : 32 + n].decode()
            (held,) = struct.unpack_from("<Q", body, 32 + n)
            yield from records(_unpacked(name, body[40 + n : 40 + n + held], raw))
        elif kind == _FOOTER:
            return
        else:
            yield kind, body


def messages(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(topic, log time in nanoseconds, serialised message) in the file's order."""
    if not data.startswith(MARK):
        raise ValueError("not a bag")
    topics: dict[int, str] = {}
    for kind, body in records(data):
        if kind == _CHANNEL:
            channel, _, n = struct.unpack_from("<HHI", body)
            topics[channel] = body[8 : 8 + n].decode()
        elif kind == _MESSAGE:
            channel, _, log_time, _ = struct.unpack_from("<HIQQ", body)
            yield topics[channel], log_time, body[22:]


class Reader:
    """Values of one serialised message, one after the other."""

    def __init__(self, data: bytes):
        self.data, self.at, self.order = data, 4, "<" if data[1] & 1 else ">"

    def take(self, kind: str, n: int = 1):
        size = struct.calcsize(kind)
        self.at += -(self.at - 4) % size
        out = struct.unpack_from(f"{self.order}{n}{kind}", self.data, self.at)
        self.at += n * size
        return out[0] if n == 1 else out

    def raw(self) -> bytes:
        n = self.take("I")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def text(self) -> str:
        return self.raw().rstrip(b"\0").decode("utf-8", "replace")

    def stamp(self) -> float:
        sec, nano = self.take("i"), self.take("I")
        self.text()  # the frame's name
        return sec + nano * 1e-9


def read_cloud(data: bytes, nearest: float = 0.05) -> tuple[float, dict[str, np.ndarray]]:
    """Stamp, and x, y, z, intensity and time offset of the points farther than nearest; absent fields are 0."""
    r = Reader(data)
    stamp = r.stamp()
    height, width = r.take("I"), r.take("I")
    fields = {}
    for _ in range(r.take("I")):
        name, offset, code = r.text(), r.take("I"), r.take("B")
        r.take("I")
        fields[name] = (offset, code)
    big = r.take("B")
    step = r.take("I")
    r.take("I")
    body = r.raw()
    n = min(height * width, len(body) // step) if step else 0
    wanted = [k for k in ("x", "y", "z", "intensity", "time") if k in fields]
    kind = np.dtype({"names": wanted, "formats": [(">" if big else "<") + _FIELDS[fields[k][1]] for k in wanted], "offsets": [fields[k][0] for k in wanted], "itemsize": max(step, 1)})
    p = np.frombuffer(body, kind, n)
    out = {k: p[k].astype(float) if k in wanted else np.zeros(n) for k in ("x", "y", "z", "intensity", "time")}
    far = np.sqrt(out["x"] ** 2 + out["y"] ** 2 + out["z"] ** 2) > nearest
    return stamp, {k: v[far] for k, v in out.items()}


def read_imu(data: bytes) -> tuple[float, ...]:
    """Stamp, angular velocity, linear acceleration."""
    r = Reader(data)
    stamp = r.stamp()
    r.take("d", 13)  # orientation and its covariance
    turn = r.take("d", 3)
    r.take("d", 9)
    return stamp, *turn, *r.take("d", 3)


def read_image(data: bytes) -> tuple[float, str, bytes]:
    r = Reader(data)
    return r.stamp(), r.text(), r.raw()


#: Rows that are handed on together.
ROWS = 20_000
_SCHEMAS = {
    "points": "path string, scan_id long, point_idx int, stamp double, t_off double, x double, y double, z double, intensity double",
    "imu": "path string, t double, gx double, gy double, gz double, ax double, ay double, az double",
    "images": "path string, image_id long, t double, data binary, format string",
}


def read_bag(spark: SparkSession, path: str, topics: dict[str, str] = TOPICS, nearest: float = 0.05) -> dict[str, DataFrame]:
    """The tables points, imu and images of the bags at path (a file, a folder or a pattern). scan_id and image_id count a
    file's clouds and images in its order; order by stamp for the order in time. Fails if there is no bag."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mcap").load(path).select("path", "content")
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no bag at {path}")

    def tables(name: str, topic: str, rows):
        def run(batches):
            for b in batches:
                for at, data in zip(b.column(0).to_pylist(), b.column(1)):
                    held, n = [], 0
                    for k, message in enumerate(m for t, _, m in messages(data.as_py()) if t == topic):
                        row = rows(k, message)
                        size = len(next(iter(row.values())))
                        held.append(pa.RecordBatch.from_pydict({"path": pa.array([at] * size, pa.string()), **row}))
                        n += size
                        if n >= ROWS or name == "images":
                            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                            held, n = [], 0
                    if held:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()

        return files.mapInArrow(run, _SCHEMAS[name])

    def points(k, message):
        stamp, p = read_cloud(message, nearest)
        n = len(p["x"])
        return {"scan_id": pa.array([k] * n, pa.int64()), "point_idx": pa.array(np.arange(n, dtype=np.int32)), "stamp": pa.array([stamp] * n, pa.float64()), "t_off": pa.array(p["time"]), **{c: pa.array(p[c]) for c in ("x", "y", "z", "intensity")}}

    def imu(k, message):
        return {c: pa.array([v], pa.float64()) for c, v in zip(("t", "gx", "gy", "gz", "ax", "ay", "az"), read_imu(message))}

    def images(k, message):
        stamp, kind, data = read_image(message)
        return {"image_id": pa.array([k], pa.int64()), "t": pa.array([stamp], pa.float64()), "data": pa.array([data], pa.binary()), "format": pa.array([kind], pa.string())}

    return {"points": tables("points", topics["cloud"], points), "imu": tables("imu", topics["imu"], imu), "images": tables("images", topics["image"], images)}


def bag_metadata(text: str) -> dict:
    """Counts, start and duration in seconds from a bag's metadata document."""
    import yaml

    info = yaml.safe_load(text)["rosbag2_bagfile_information"]
    topics = {t["topic_metadata"]["name"]: t["message_count"] for t in info.get("topics_with_message_count", [])}
    return {"seconds": info["duration"]["nanoseconds"] / 1e9, "start_ns": info["starting_time"]["nanoseconds_since_epoch"], "messages": info["message_count"], "topics": topics}
