"""Binary PLY clouds: reading any vertex element with scalar properties, and writing floats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import load_file, save_file

# Property types of the format.
_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def decode(data: bytes) -> tuple[np.ndarray, list[str]]:
    """Vertices as a structured array, and the comments."""
    end = data.find(b"end_header\n")
    if end < 0:
        raise ValueError("no PLY header")
    head = data[:end].decode("ascii", "replace").splitlines()
    if "format binary_little_endian 1.0" not in head:
        raise ValueError("only binary little-endian PLY")
    fields, count, inside = [], 0, False
    for line in head:
        w = line.split()
        if w[:1] == ["element"]:
            if w[1] != "vertex" and not fields:
                raise ValueError("vertices come first")
            inside = w[1] == "vertex"
            count = int(w[2]) if inside else count
        elif w[:1] == ["property"] and inside:
            if w[1] not in _TYPES:
                raise ValueError(f"property type {w[1]}")
            fields.append((w[2], "<" + _TYPES[w[1]]))
    kind = np.dtype(fields)
    body = data[end + 11 :]
    if not count or len(body) < count * kind.itemsize:
        raise ValueError("no vertices, or fewer than the header says")
    return np.frombuffer(body, kind, count), [x[8:] for x in head if x.startswith("comment ")]


def encode(columns: dict[str, np.ndarray], comments=()) -> bytes:
    names = list(columns)
    n = len(columns[names[0]])
    head = ["ply", "format binary_little_endian 1.0", *(f"comment {c}" for c in comments), f"element vertex {n}", *(f"property float {k}" for k in names), "end_header", ""]
    rows = np.empty(n, [(k, "<f4") for k in names])
    for k in names:
        rows[k] = columns[k]
    return "\n".join(head).encode() + rows.tobytes()


def read_ply(spark: SparkSession, path: str, columns=("x", "y", "z")) -> DataFrame:
    """path, point_id and columns of every vertex of the files at path, a task a file at least."""
    schema = "path string, point_id long, " + ", ".join(f"{c} double" for c in columns)

    def run(batches):
        for b in batches:
            for path, data in zip(b.path, b.content):
                v = decode(bytes(data))[0]
                for i in range(0, len(v), 100_000):
                    part = v[i : i + 100_000]
                    yield pd.DataFrame({"path": path, "point_id": np.arange(i, i + len(part)), **{c: part[c].astype(float) for c in columns}})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def ply_files(points: DataFrame, key: str, columns=("x", "y", "z"), comments=()) -> DataFrame:
    """key and content: one file's bytes per value of key; a cloud that is one file fits one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [encode({c: pdf[c].to_numpy() for c in columns}, comments)]})

    kind = points.schema[key].dataType.simpleString()
    return points.groupBy(key).applyInPandas(run, f"{key} {kind}, content binary")


def has_comment(files: DataFrame, prefix: str) -> DataFrame:
    """path and whether a comment of the header starts with prefix: the mark of a cloud already processed."""
    head = F.split(F.decode(F.substring("content", 1, 4096), "ISO-8859-1"), "end_header")[0]
    return files.select("path", F.exists(F.split(head, "\n"), lambda x: x.startswith(f"comment {prefix}")).alias("marked"))


def write_ply(points: DataFrame, path: str, columns=("x", "y", "z"), comments=()) -> int:
    """One file of a cloud, in the order of point_id; returns its points. A file is one task's and then the driver's, up
    to storage.MAX_FILE; larger clouds are kept as tables."""
    whole = ply_files(points.withColumn("_file", F.lit(0)), "_file", columns, comments).first()
    content = bytes(whole.content) if whole else encode({c: np.zeros(0) for c in columns}, comments)
    save_file(points.sparkSession, path, content)
    return len(decode(content)[0]) if whole else 0


def comments_of(spark: SparkSession, path: str) -> list[str]:
    return decode(load_file(spark, path))[1]
