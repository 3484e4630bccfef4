"""Intermediate tables and single files in the storage that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a file that the driver writes as a whole.
MAX_FILE = 1 << 30


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if driver and executors are one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="voxlake-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, written once in the shared folder and read back: later steps do not repeat it, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/steps/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def save_file(spark: SparkSession, path: str, content: bytes) -> None:
    """One file in any store that Spark writes to, replacing it; parent folders are made."""
    if len(content) > MAX_FILE:
        raise ValueError(f"more than {MAX_FILE} bytes")
    p, fs = _file(spark, path)
    out = fs.create(p, True)
    try:
        for i in range(0, len(content), 1 << 20):
            out.write(bytearray(content[i : i + (1 << 20)]))
    finally:
        out.close()


def load_file(spark: SparkSession, path: str) -> bytes | None:
    """A file's bytes, None where there is none."""
    p, fs = _file(spark, path)
    if not fs.exists(p):
        return None
    return bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
