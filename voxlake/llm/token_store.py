"""Content-addressed store of token-id streams.

A document's ids are cut into chunks where a rolling hash over the last ids meets a mask, within a least and
a greatest length. A chunk's address is a hash of its packed ids; each distinct chunk is stored once, in the
table chunks(address, n, data). A document is kept as a recipe, the addresses of its chunks in order, with the recipe's
Merkle root, in the table manifest(doc_id, file_no, row, in_file, n_tokens, root, recipe), whose files, in the order of
their names, hold the documents in ascending doc_id. The table roots has for each file its Merkle root over its rows,
and the ids before it, and the store's root over the files. Reading recomputes every chunk's address, every recipe's
root and the trees up to the store's root, and fails on any difference.

Documents are digested without moving their ids again: the crc32 of a document is combined from the crc32
of its chunks, each read and verified once.

Defined cases: a null text is empty and has its end id alone; null doc_ids come first; repeated rows are kept
as often as they occur; a text of any length is cut into chunks of bounded length; an empty table gives an empty store;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, shared_dir, tidy
from .tokens import encoder

#: Ids that the rolling hash covers; bits that must be zero at a cut (1 cut in 1024 ids); bounds of a chunk.
SPAN, CUT_BITS, LEAST, GREATEST = 16, 10, 256, 8192
ADDRESS_BYTES = 16
#: Ids that are cut at a time, more only for a longer document; documents of a segment of the manifest.
GROUP, SEGMENT = 1 << 19, 4096
#: Files of a manifest, whose rows the driver holds.
MAX_FILES = 1_000_000
_M = np.uint64(0x9E3779B97F4A7C15)


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * _M
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def _powers(n: int, held: list = []) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse."""
    if not held or len(held[0]) < n:
        size = max(n, GROUP)
        up, down = np.full(size, _M, np.uint64), np.full(size, np.uint64(pow(int(_M), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        held[:] = [np.cumprod(up), np.cumprod(down)]
    return held[0][:n], held[1][:n]


def group_cuts(ids: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """Ends of the chunks of each of several id streams that lie one after the other in ids."""
    n = len(ids)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_scatter(ids) * up, out=sums[1:])
    # the window's hash times the power at its start; comparing after a multiplication by the inverse power
    rolled = (sums[SPAN:] - sums[:-SPAN]) * down[: max(0, n + 1 - SPAN)]
    ends = np.flatnonzero(rolled >> np.uint64(64 - CUT_BITS) == 0) + SPAN
    edges = np.cumsum([0, *sizes])
    at = np.searchsorted(ends, edges, side="right")
    out = []
    for k, size in enumerate(sizes):
        if size <= LEAST:
            out.append([size] if size else [])
            continue
        own, last = [], 0
        for e in (ends[at[k] : at[k + 1]] - edges[k]).tolist():
            if e < SPAN:  # the window began in the stream before
                continue
            while e - last > GREATEST:
                last += GREATEST
                own.append(last)
            if e - last >= LEAST:
                own.append(e)
                last = e
        while size - last > GREATEST:
            last += GREATEST
            own.append(last)
        if last < size:
            own.append(size)
        out.append(own)
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream."""
    return group_cuts(ids, [len(ids)])[0]


def address(data) -> bytes:
    return hashlib.blake2b(data, digest_size=ADDRESS_BYTES).digest()


def merkle_root(recipe: bytes) -> bytes:
    return root_of([recipe[i : i + ADDRESS_BYTES] for i in range(0, len(recipe), ADDRESS_BYTES)])


def root_of(level: list[bytes]) -> bytes:
    level = level or [b""]
    while len(level) > 1:
        level = [address(b"".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0]


def _zero_byte_powers() -> np.ndarray:
    """For k up to 47, four tables of 256 that advance a crc32 over 2**k zero bytes."""
    # one zero byte: c -> plain[c & 255] ^ (c >> 8), plain being the crc table; crc32(b"\0", x) does it on inverted values
    plain = np.array([zlib.crc32(b"\0", c ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for c in range(256)], np.uint32)
    byte = np.arange(256, dtype=np.uint32)
    ops = [np.stack([plain, byte, byte << np.uint32(8), byte << np.uint32(16)])]
    for _ in range(47):
        ops.append(np.stack([advance_once(ops[-1], advance_once(ops[-1], byte << np.uint32(8 * j))) for j in range(4)]))
    return np.stack(ops)


def advance_once(op: np.ndarray, c: np.ndarray) -> np.ndarray:
    f = np.uint32(255)
    return op[0][c & f] ^ op[1][c >> np.uint32(8) & f] ^ op[2][c >> np.uint32(16) & f] ^ op[3][c >> np.uint32(24)]


def advance_crc(crc: np.ndarray, n_bytes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """crc32 values carried over n_bytes that follow; those of all parts of a stream xor to the stream's crc32."""
    crc, n_bytes = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for k in range(len(powers)):
        on = (n_bytes >> k & 1).astype(bool)
        if on.any():
            crc = np.where(on, advance_once(powers[k], crc), crc)
    return crc


def _group(streams, end: bytes, width: int) -> list:
    """The next streams, with end appended, of GROUP ids or just beyond."""
    out, held = [], 0
    for doc_id, one in streams:
        out.append((doc_id, one + end))
        held += len(out[-1][1])
        if held >= GROUP * width:
            break
    return out


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2) -> None:
    """Encode docs(doc_id, text) and write the store at path."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        enc, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end, width = enc._pack([end_id]), enc.dtype.itemsize
        written: set[bytes] = set()
        names = ["is_doc", "key", "data", "doc_id", "n"]
        kinds = [pa.bool_(), pa.binary(), pa.binary(), None, pa.int64()]
        for b in batches:
            kinds[3] = b.schema.field(0).type
            streams = zip(b.column(0).to_pylist(), enc.encode(b.column(1)))
            while group := _group(streams, end, width):
                rows: list[list] = [[] for _ in names]
                flat = np.frombuffer(b"".join(one for _, one in group), enc.dtype)
                for (doc_id, one), ends in zip(group, group_cuts(flat, [len(one) // width for _, one in group])):
                    recipe, last = [], 0
                    for e in ends:
                        data = one[last * width : e * width]
                        recipe.append(address(data))
                        if recipe[-1] not in written:
                            if len(written) < 1 << 17:
                                written.add(recipe[-1])
                            for col, v in zip(rows, (False, recipe[-1], data, None, e - last)):
                                col.append(v)
                        last = e
                    for col, v in zip(rows, (True, b"%d:%d" % (part, at), b"".join(recipe), doc_id, last)):
                        col.append(v)
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, kinds)], names=names)

    parts = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(run), f"is_doc boolean, key binary, data binary, doc_id {kind}, n long")
    once = parts.groupBy("is_doc", "key").agg(F.first("data").alias("data"), F.first("doc_id").alias("doc_id"), F.first("n").alias("n"))
    once.write.option("compression", "zstd").partitionBy("is_doc").parquet(f"{path}/parts")

    recipes = spark.read.schema(f"key binary, data binary, doc_id {kind}, n long").parquet(f"{path}/parts/is_doc=true") if _exists(spark, f"{path}/parts/is_doc=true") else spark.createDataFrame([], f"key binary, data binary, doc_id {kind}, n long")
    def number(batches):
        from pyspark import TaskContext

        file_no, row, start = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n = b.column(2).to_numpy(zero_copy_only=False)
            ends = start + np.cumsum(n)
            roots = [merkle_root(r) for r in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(n), file_no, np.int32)), pa.array(np.arange(row, row + len(n))), pa.array(ends - n), b.column(2), pa.array(roots, pa.binary()), b.column(1)],
                names=["doc_id", "file_no", "row", "in_file", "n_tokens", "root", "recipe"],
            )
            if len(n):
                row, start = row + len(n), int(ends[-1])

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = recipes.repartitionByRange(n_parts, F.col("doc_id").asc_nulls_first(), "key").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "key")
    # a file a range, in the ranges' order; the ids before a file come from the roots table
    numbered = ranged.select("doc_id", F.col("data").alias("recipe"), F.col("n").alias("n_tokens")).mapInArrow(tidy(number), f"doc_id {kind}, file_no int, row long, in_file long, n_tokens long, root binary, recipe binary")
    numbered.write.option("compression", "zstd").parquet(f"{path}/manifest")
    files = _file_roots(spark.read.parquet(f"{path}/manifest"))
    spark.createDataFrame(files, _ROOTS).coalesce(1).write.parquet(f"{path}/roots")


#: file_no -1 stands for the store: its root is that of the files' roots in order.
_ROOTS = "file_no int, base long, docs long, n_tokens long, root binary"


def _file_roots(manifest: DataFrame) -> list[tuple]:
    """Rows of the roots table, from the manifest: a Merkle tree over documents in order, by segments, files and store."""
    leaf = F.unhex(F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "row", "in_file", "n_tokens", F.hex("root")), 256))
    tree = F.udf(lambda level: root_of([bytes(x) for x in level]), "binary", useArrow=True)
    ordered = lambda place, x: F.transform(F.array_sort(F.collect_list(F.struct(place, x))), lambda p: p[x])
    leaves = manifest.select("file_no", F.expr(f"row div {SEGMENT}").alias("segment"), "row", "n_tokens", leaf.alias("leaf"))
    segments = leaves.groupBy("file_no", "segment").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("n_tokens"), ordered("row", "leaf").alias("level"))  # SEGMENT leaves
    segments = segments.select("file_no", "segment", "docs", "n_tokens", tree("level").alias("root"))
    files = segments.groupBy("file_no").agg(F.sum("docs").alias("docs"), F.sum("n_tokens").alias("n_tokens"), ordered("segment", "root").alias("level")).select("file_no", "docs", "n_tokens", tree("level").alias("root"))
    rows = files.orderBy("file_no").limit(MAX_FILES + 1).collect()  # a short row a file
    if len(rows) > MAX_FILES:
        raise ValueError(f"more than {MAX_FILES} files")
    base, out = 0, []
    for r in rows:
        out.append((r.file_no, base, r.docs, r.n_tokens, bytes(r.root)))
        base += r.n_tokens
    return [*out, (-1, 0, sum(r.docs for r in rows), base, root_of([x[4] for x in out]))]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with start, the ids of all documents before; fails if a row was lost, added, changed or moved."""
    manifest = spark.read.parquet(f"{path}/manifest")
    stored = spark.read.schema(_ROOTS).parquet(f"{path}/roots")
    held = sorted((r.file_no, r.base, r.docs, r.n_tokens, bytes(r.root)) for r in stored.collect())  # MAX_FILES short rows at most
    if held != sorted(_file_roots(manifest)):
        raise ValueError("the manifest does not match its roots")
    bases = stored.select(F.col("file_no").alias("of_file"), "base")
    return manifest.join(F.broadcast(bases), F.col("file_no") == F.col("of_file")).withColumn("start", F.col("base") + F.col("in_file"))


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    schema = "key binary, data binary, n long"
    at = f"{path}/parts/is_doc=false"
    return spark.read.schema(schema).parquet(at) if _exists(spark, at) else spark.createDataFrame([], schema)


def _links(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, i, key: a row per chunk of a recipe, its Merkle root verified."""
    verify = F.udf(lambda r, root: merkle_root(bytes(r)) == bytes(root), "boolean", useArrow=True)
    sound = manifest.withColumn("recipe", F.when(verify("recipe", "root"), F.col("recipe")).otherwise(F.raise_error(F.lit("a recipe does not match its root")).cast("binary")))
    n = F.length("recipe") / ADDRESS_BYTES
    return sound.select("doc_id", "start", "n_tokens", "recipe", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("i")).select("doc_id", "start", "n_tokens", "i", F.substring(F.col("recipe"), F.col("i") * ADDRESS_BYTES + 1, F.lit(ADDRESS_BYTES)).alias("key"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), n_chunks, from the files alone."""

    def chunk_crc(batches):
        for b in batches:
            crc = []
            for key, data, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                data = data.as_buffer()
                if address(data) != key:
                    raise ValueError("a chunk does not match its address")
                crc.append(zlib.crc32(np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(crc, pa.int64())], names=["key", "n", "crc"])

    def carry(batches):
        powers = _zero_byte_powers()
        for b in batches:
            crc = advance_crc(b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False), powers)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc.astype(np.int64))], names=["start", "n_tokens", "n", "crc"])

    manifest = _manifest(spark, path)
    crcs = _chunks(spark, path).select("key", "data", "n").mapInArrow(tidy(chunk_crc), "key binary, n long, crc long")
    linked = _links(manifest).join(crcs, "key", "left")
    linked = linked.withColumn("n", F.coalesce("n", F.raise_error(F.lit("a chunk is missing")).cast("long")))
    # start names a document: every document has an id at least
    up_to = Window.partitionBy("start").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rest = linked.withColumn("after", (F.col("n_tokens") - F.sum("n").over(up_to)) * 4)
    carried = rest.select("start", "n_tokens", "n", "crc", "after").mapInArrow(tidy(carry), "start long, n_tokens long, n long, crc long")
    whole = carried.groupBy("start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("found"), F.count(F.lit(1)).alias("n_chunks"))
    whole = whole.select("start", F.when(F.col("found") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document's length differs")).cast("long")).alias("ids_crc32"), "n_chunks")
    return manifest.select("doc_id", "start", "n_tokens").join(whole, "start").select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array<int>), rebuilt from recipes and chunks."""
    unpack = F.udf(lambda d, n: np.frombuffer(d, "<u2" if len(d) == 2 * n else "<u4").astype(int).tolist(), "array<int>", useArrow=True)
    linked = _links(_manifest(spark, path)).join(_chunks(spark, path), "key").select("doc_id", "start", "i", unpack("data", "n").alias("ids"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "ids")))
    return linked.groupBy("doc_id", "start").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def op7_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}"
    write_store(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path, end_id=2)
    return read_digests(spark, path)
