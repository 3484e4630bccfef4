"""Near-duplicate groups: a multi-index Hamming join of b-bit minwise signatures, confirmed on full sets.

A document's set is its distinct five-word shingles. Equal sets form one node. A node's signature has
65 symbols, 16 bits of the least hash under 65 hash functions. Two sets with similarity s differ in a symbol
with probability 1 - s, so at 0.85 in 9.75 symbols of 65, and in over DISTANCE = 25 with probability below
1e-6. Signatures are split into 13 chunks of 5 symbols. By the pigeonhole principle two signatures within 25
symbols have a chunk that differs in one symbol at most; every chunk is therefore indexed under its five
forms with one symbol left out, and all pairs within the distance meet in a bucket.

Pairs of a bucket are never expanded. Each member is linked to the bucket's least node, if their signatures
are within the distance and their full sets confirm it; components of these links are formed; what is left
are buckets with members of different components, which are compared in blocks of BLOCK by BLOCK members,
dealt out over tasks, with pairs of one component left out. Each pair within the distance is named in its
first bucket only, in a list of partners, a row per member; then the members' full sets join their block
and the pairs are confirmed there, which yields only links that span what is connected. All links between
different components are found this way, so the components are those of all pairs within the distance.

Defined cases: null or wordless texts have an empty set and are linked with nothing; repeated rows are one
node and get the same component; a null doc_id takes no part in minima; a text of any length is compared whole; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, tidy, write_table
from .graph import components
from .shingles import mix, shingle_sets

CHUNKS, CHUNK_SYMBOLS = 13, 5
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
#: A chunk may differ in one symbol, so 2 * CHUNKS - 1 symbols in all.
DISTANCE = 2 * CHUNKS - 1
#: Members of a bucket, and shingles they have on average, that are compared with as many others in one task.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
SHINGLE, PERCENT = 5, 85

_MULTIPLIERS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(hashes: np.ndarray) -> bytes:
    """16 bits of the least hash under each function."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[None, i : i + 1024] * _MULTIPLIERS[:, None]).min(1), out=least)
    return (least & np.uint64(0xFFFF)).astype("<u2").tobytes()


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """signatures (n, SYMBOLS) -> keys (n, CHUNKS * CHUNK_SYMBOLS): every chunk with each symbol left out."""
    chunks = signatures.reshape(-1, CHUNKS, CHUNK_SYMBOLS).astype(np.uint64)
    out = np.empty((len(chunks), CHUNKS, CHUNK_SYMBOLS), np.uint64)
    for gone in range(CHUNK_SYMBOLS):
        value = np.zeros(chunks.shape[:2], np.uint64)
        for k in range(CHUNK_SYMBOLS):
            if k != gone:
                value = value << np.uint64(16) | chunks[:, :, k]
        tag = mix(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK_SYMBOLS) + np.uint64(gone + 1))
        out[:, :, gone] = mix(value + tag[None, :])
    return out.reshape(len(chunks), -1)


def _fixed(column: pa.Array, dtype, width: int) -> np.ndarray:
    """A column of binary values of one length as a matrix."""
    data = np.frombuffer(b"".join(column.to_pylist()), dtype)
    return data.reshape(-1, width)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, set_key (null if empty), n_shingles, sig."""

    def run(batches):
        for b in batches:
            keys, sizes, sigs = [], [], []
            for s in shingle_sets(b.column(1), SHINGLE):
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s, digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "set_key", "n_shingles", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(run), f"doc_id {kind}, set_key binary, n_shingles long, sig binary")


def full_sets(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> set_key, shingles."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                sets = list(shingle_sets(b.column(1).slice(i, 500), SHINGLE))
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["set_key", "shingles"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(run), "set_key binary, shingles array<long>")


def _keys(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            node = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, b.num_rows, 2000):
                keys = bucket_keys(_fixed(b.column(1).slice(i, 2000), "<u2", SYMBOLS)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(node[i : i + 2000], keys.shape[1]))], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(tidy(run), "key long, node long")


def _within(pairs: DataFrame) -> DataFrame:
    """Of pairs(a, b, sig_a, sig_b) those within the distance."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                far = (_fixed(b.column(2), "<u2", SYMBOLS) != _fixed(b.column(3), "<u2", SYMBOLS)).sum(1)
                yield b.filter(pa.array(far <= DISTANCE)).select(["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(tidy(run), "a long, b long")


def _sizes_allow(a: str, b: str):
    """Sizes without which the similarity can't be reached."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs(a, b) those whose full sets are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(left, "a").join(right, "b").where(100 * shared >= PERCENT * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def _first_bucket(differs: np.ndarray) -> np.ndarray:
    """Of pairs' differing symbols (n, SYMBOLS): the first bucket both are in, by its place in bucket_keys."""
    d = differs.reshape(-1, CHUNKS, CHUNK_SYMBOLS)
    per = d.sum(2)
    chunk = (per <= 1).argmax(1)
    at = np.arange(len(d))
    return chunk * CHUNK_SYMBOLS + np.where(per[at, chunk] == 0, 0, d[at, chunk].argmax(1))


def _by_group(batches, columns: int):
    """Join batches sorted by their first columns into tables that hold whole groups, at least one each."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        keys = [t.column(k).to_numpy() for k in range(columns)]
        whole = int(np.flatnonzero(np.logical_and.reduce([x == x[-1] for x in keys]))[0])
        if whole:
            yield t.slice(0, whole).combine_chunks()
        held = t.slice(whole)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _group_edges(keys: list[np.ndarray]) -> list[int]:
    new = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
    return [0, *(np.flatnonzero(new) + 1).tolist(), len(keys[0])]


def _candidates(members: DataFrame) -> DataFrame:
    """members(key, node, component, n, sig) of buckets with several components -> task, node, partners: for each
    pair of blocks of a bucket, the nodes that have a pair of different components within the distance there,
    and of each the partners (packed) it is to be confirmed with. A pair is named in its first bucket only."""
    # as many blocks as keep both a block's members and their full sets small
    blocks = members.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = members.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "component", "n", "sig")
    n_parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n_parts, "key", "p", "q").sortWithinPartitions("key", "p", "q")

    def compare(place, own, node, comp, n, sig, p, q):
        x = np.flatnonzero(own == p)
        y = x if p == q else np.flatnonzero(own == q)
        for i in range(0, len(x), 64):
            rows = x[i : i + 64]
            ok = comp[rows][:, None] != comp[y][None, :]
            ok &= 100 * np.minimum(n[rows][:, None], n[y][None, :]) >= PERCENT * np.maximum(n[rows][:, None], n[y][None, :])
            if p == q:
                ok &= node[rows][:, None] < node[y][None, :]
            i1, i2 = np.nonzero(ok)
            for k in range(0, len(i1), 20_000):
                r, c = rows[i1[k : k + 20_000]], y[i2[k : k + 20_000]]
                differs = sig[r] != sig[c]
                near = np.flatnonzero(differs.sum(1) <= DISTANCE)
                near = near[_first_bucket(differs[near]) == place]
                yield r[near], c[near]

    def run(batches):
        for t in _by_group(batches, 3):
            key, p, q, own, node, comp, n = (t.column(k).to_numpy() for k in range(7))
            sig = _fixed(t.column(7).combine_chunks(), "<u2", SYMBOLS)
            edges = _group_edges([key, p, q])
            out: list[list] = [[], [], []]
            for i, j in zip(edges, edges[1:]):
                if j - i < 2:
                    continue
                place = int((bucket_keys(sig[i : i + 1]).view(np.int64)[0] == key[i]).argmax())
                found = list(compare(place, own[i:j], node[i:j], comp[i:j], n[i:j], sig[i:j], p[i], q[i]))
                a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
                if not len(a):
                    continue
                task = int(mix(np.array([key[i] ^ (int(p[i]) << 20) ^ int(q[i])], np.int64).view(np.uint64)).view(np.int64)[0])
                order = np.argsort(a, kind="stable")
                a, b = a[order], b[order]
                for x in np.union1d(a, b).tolist():
                    lo, hi = np.searchsorted(a, [x, x + 1])
                    for col, v in zip(out, (task, int(node[i + x]), node[i + b[lo:hi]].tobytes())):
                        col.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["task", "node", "partners"])

    return dealt.mapInArrow(tidy(run), "task long, node long, partners binary")


#: Pairs of a task up to which sets are met one by one; columns of a table of memberships beyond.
FEW_PAIRS, TABLE_COLUMNS = 48, 8192


def shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    if len(a) <= FEW_PAIRS:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, column = row[count[column] > 1], column[count[column] > 1]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    met = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, TABLE_COLUMNS):
        i, j = np.searchsorted(column, [lo, lo + TABLE_COLUMNS])
        m = np.zeros((len(sets), TABLE_COLUMNS), np.float32)
        m[row[i:j], column[i:j] - lo] = 1
        met += m @ m.T
    return met[a, b].round().astype(np.int64)


def _confirm_tasks(tasks: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirm the pairs of tasks on full sets -> a, b: links that span what a task's similar pairs connect."""
    n_parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tasks.join(sets, "node").select("task", "node", "partners", "shingles").repartition(n_parts, "task").sortWithinPartitions("task", "node")

    def run(batches):
        for t in _by_group(batches, 1):
            task, node = t.column(0).to_numpy(), t.column(1).to_numpy()
            partners, shingles = t.column(2).to_pylist(), t.column(3).combine_chunks()
            edges = _group_edges([task])
            out: list[list] = [[], []]
            for i, j in zip(edges, edges[1:]):
                own = node[i:j]
                lists = [np.frombuffer(x, np.int64) for x in partners[i:j]]
                a = np.repeat(np.arange(j - i), [len(x) for x in lists])
                b = np.searchsorted(own, np.concatenate(lists))
                held = [shingles[k].values.to_numpy() for k in range(i, j)]
                size = np.array([len(x) for x in held])
                got = shared_counts([np.sort(x) for x in held], a, b)
                alike = np.flatnonzero(100 * got >= PERCENT * (size[a] + size[b] - got))
                root = list(range(j - i))
                for x, y in zip(a[alike].tolist(), b[alike].tolist()):
                    u, v = x, y
                    while root[u] != u:
                        u = root[u] = root[root[u]]
                    while root[v] != v:
                        v = root[v] = root[root[v]]
                    if u != v:
                        root[max(u, v)] = min(u, v)
                        out[0].append(int(own[x]))
                        out[1].append(int(own[y]))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept, a row per row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    prints = write_table(spark, fingerprints(docs), "dup-prints")
    classes = prints.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("label"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    nodes = write_table(spark, classes.withColumn("node", F.monotonically_increasing_id()), "dup-nodes")

    keys = _keys(nodes)
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("lead")).where("size > 1").select("key", "lead")
    members = write_table(spark, keys.join(buckets.hint("merge"), "key"), "dup-members")

    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi")
    some = docs.join(wanted.select(F.col("label").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = full_sets(some).dropDuplicates(["set_key"]).join(nodes.select("set_key", "node"), "set_key").select("node", "shingles")
    sets = write_table(spark, sets, "dup-sets")

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    stars = members.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    near = _within(stars.join(side("a"), "a").join(side("b"), "b").where(_sizes_allow("n_a", "n_b")))
    first = write_table(spark, components(_confirm(near, sets), "dup-cc"), "dup-first")

    placed = members.select("key", "node").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    rest = placed.join(mixed, "key").join(nodes.select("node", "n", "sig"), "node").select("key", "node", "component", "n", "sig")
    links = write_table(spark, _confirm_tasks(_candidates(rest), sets), "dup-links")
    final = first
    if not links.isEmpty():
        final = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links), "dup-cc")

    labelled = nodes.select("node", "set_key", "label").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("label").alias("component_id"))
    by_set = labelled.select("set_key", "component").join(least, "component").select("set_key", "component_id")
    out = prints.select("doc_id", "set_key", "n_shingles").join(by_set, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents that have a near-duplicate of smaller doc_id in their group; all columns stay."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
