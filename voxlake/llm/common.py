"""Shared plumbing: table access, intermediate tables in the cluster's shared folder, word counting."""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one if driver and
    executors are one process, as in tests; elsewhere that would lose data."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="voxlake-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Tables(threading.local):
    """Intermediate tables by owner, of one thread: those of lazy queries belong to nobody and stay."""

    def __init__(self):
        self.owner: str | None = None
        self.paths: dict[str, list[str]] = {}


_TABLES = Tables()


@contextmanager
def owned_by(owner: str):
    """Intermediate tables written inside belong to owner, who can release them."""
    before, _TABLES.owner = _TABLES.owner, owner
    try:
        yield
    finally:
        _TABLES.owner = before


def write_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Materialise df once as Parquet in the shared folder and read it back; cuts the lineage."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _TABLES.owner is not None:
        _TABLES.paths.setdefault(_TABLES.owner, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def row_by_row(spark: SparkSession, rows: int = 1):
    """Tables written inside read their large rows and hand them to Python one at a time, or few, not as many as fill a
    batch."""
    names = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, owner: str) -> None:
    """Delete an owner's intermediate tables; its results must be stored by now."""
    for path in _TABLES.paths.pop(owner, []):
        delete(spark, path)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, longer where docs has such columns."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by a hash of keys over as many partitions as a shuffle has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def tidy(run):
    """A function of batches that, at the end of its task, hands freed memory back to the system: workers are reused,
    and what a stage's kernels keep would add to the next stage's peak."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return tidied


def extended(schema, ddl: str):
    """A schema with the columns of ddl appended."""
    from pyspark.sql.types import StructType

    return StructType(schema.fields + StructType.fromDDL(ddl).fields)
