"""Mixing sources to target weights in fixed-length blocks.

The words of each source's documents form one stream, cut into blocks of BLOCK_WORDS. The mix has as many
slots as its targets have blocks, in shards of SHARD_SLOTS, and STRATUM shards form a stratum. A stratum's source
counts are its part of the targets, apportioned to whole slots; inside it a shard's source counts are drawn
multinomially on the condition that the stratum's shards together hold these counts: the stratum's slots are split in
halves again and again, and a half's counts are drawn from the whole's without replacement, from seeds of the half's
place, so any shard finds its counts by itself in a few draws, as many for a mix of any size. A source's slots are
mapped through pseudorandom permutations of its block indices, a new one each time all its blocks are used up, and
blocks are joined to the slots by (source, index).

Targets: sources in the order of their code points, null last, weigh as the weights repeat; each gets its
part of all words, at most MAX_EPOCHS times its own, and what is above is shared among the others by weight
until no target is above.

A source's stream has its rows in the order of buckets by a hash of doc_id and row, then of doc_id and that hash.
Rows that are alike in every column are counted once and told apart by a number.

Defined cases: null texts and texts without words have size 0 and are never taken; a null source is a source;
repeated rows are documents of their own; a text of any length is cut into blocks like any other; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, load, n_words, tidy, write_table

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS, SHARD_SLOTS, STRATUM, MAX_EPOCHS = 64, 4096, 256, 3
#: Targets are worked out on the driver, one number a source.
MAX_SOURCES = 100_000
#: Documents of a source whose words are summed up in one window; buckets that are summed up in one.
DOCS_PER_BUCKET, BUCKETS_PER_GROUP = 2_000, 2_000


def targets(sizes: list[int], weights: list[float], total: float | None = None, most: float = MAX_EPOCHS) -> list[float]:
    """Words to take of each source."""
    left = float(sum(sizes)) if total is None else float(total)
    out = [0.0] * len(sizes)
    free = [k for k, n in enumerate(sizes) if n > 0]
    while free and left > 0:
        unit = left / sum(weights[k] for k in free)
        above = [k for k in free if weights[k] * unit > most * sizes[k]]
        if not above:
            for k in free:
                out[k] = weights[k] * unit
            break
        for k in above:
            out[k] = float(most * sizes[k])
            left -= out[k]
        free = [k for k in free if k not in set(above)]
    return out


def apportioned(filled: int, totals: np.ndarray) -> np.ndarray:
    """Slots of each source among the first `filled` ones when the i-th slot of a source of n has the due time
    (i + 1/2) / n; equal times go in the sources' order. Grows with filled in every source."""
    total = int(totals.sum())
    q = np.array([(2 * filled * n + total) // (2 * total) for n in totals.tolist()], np.int64)  # whole numbers of any size
    q = np.minimum(q, totals)
    lack = filled - int(q.sum())
    for _ in range(lack):
        q[np.where(q < totals, (q + 0.5) / totals, np.inf).argmin()] += 1
    for _ in range(-lack):
        due = np.where(q > 0, (q - 0.5) / np.maximum(totals, 1), -np.inf)
        q[totals.size - 1 - due[::-1].argmax()] -= 1
    return q


def _draw(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How n slots drawn without replacement fall on sources with counts slots, STRATUM * SHARD_SLOTS at most in all."""
    out, pool = np.zeros_like(counts), int(counts.sum())
    for k in np.flatnonzero(counts).tolist():
        if n <= 0:
            break
        c = int(counts[k])
        rest = pool - c
        out[k] = x = n if rest == 0 else int(rng.hypergeometric(c, rest, n))
        n, pool = n - x, rest
    return out


def shard_counts(shard: int, slots: np.ndarray, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A shard's slots of each source, and the slots of each source in the shards before it."""
    total = int(slots.sum())
    lo = shard // STRATUM * STRATUM
    hi = min(lo + STRATUM, -(-total // shard_slots))
    before = apportioned(lo * shard_slots, slots)
    counts = apportioned(min(hi * shard_slots, total), slots) - before
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _draw(np.random.default_rng([seed, lo, hi]), counts, (mid - lo) * shard_slots)
        if shard < mid:
            counts, hi = left, mid
        else:
            counts, before, lo = counts - left, before + left, mid
    return counts, before


def permute(index: np.ndarray, size: int, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(size) for each key: a four-round Feistel network over the next
    power of four, walked until the value falls in range."""
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while todo.size:
        left, right, k = out[todo] >> np.uint64(half), out[todo] & mask, key[todo]
        for r in range(4):
            f = (right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ (f >> np.uint64(32)) & mask
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def _row_hash(docs: DataFrame) -> Column:
    """64 bits of all columns of a row."""
    maps = [f.name for f in docs.schema.fields if "map<" in f.dataType.simpleString()]  # which have no hash of their own
    return F.xxhash64(*[c for c in docs.columns if c not in maps], *([F.to_json(F.struct(*maps))] if maps else []))


def _hashed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, text, ...) -> doc_id, source, size and tie, a hash of the whole row."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"), _row_hash(docs).alias("tie"))


def place(docs: DataFrame, weights=WEIGHTS) -> tuple[DataFrame, list[dict]]:
    """docs(doc_id, source, text, ...) -> a row per row that is unlike all others, with the number of copies: source_no,
    doc_id, tie, size, copies, start (of the first copy, in the source's words), source, source_size, target; and per
    source (name, size, target, slots), in order. Texts are read and counted once."""
    spark = docs.sparkSession
    sized = write_table(spark, _hashed(docs).groupBy("source", "doc_id", "tie", "size").agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count(F.lit(1)).alias("docs")).orderBy(F.col("source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = [r["size"] for r in per_source]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))])
    blocks = [-(-n // BLOCK_WORDS) for n in sizes]
    slots = [min(int(round(g / n * b)), MAX_EPOCHS * b) if n else 0 for g, n, b in zip(goal, sizes, blocks)]
    info = [{"source": r.source, "source_size": n, "target": g, "blocks": b, "slots": s, "buckets": -(-r.docs // DOCS_PER_BUCKET)} for r, n, g, b, s in zip(per_source, sizes, goal, blocks, slots)]
    table = spark.createDataFrame([(k, i["source"], i["source_size"], i["target"], i["buckets"]) for k, i in enumerate(info)], "source_no int, of_source string, source_size long, target double, buckets long")
    known = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")  # MAX_SOURCES rows at most
    known = known.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.col("buckets"))).drop("buckets").withColumn("n", F.col("size") * F.col("copies"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    sums = known.groupBy("source_no", "bucket").agg(F.sum("n").alias("n")).withColumn("far", F.expr(f"bucket div {BUCKETS_PER_GROUP}"))
    fars = sums.groupBy("source_no", "far").agg(F.sum("n").alias("n")).select("source_no", "far", running(before("source_no").orderBy("far")).alias("far_base"))
    bases = sums.select("source_no", "far", "bucket", running(before("source_no", "far").orderBy("bucket")).alias("base")).join(fars, ["source_no", "far"])
    inside = before("source_no", "bucket").orderBy("doc_id", "tie")
    placed = known.withColumn("inside", running(inside)).join(bases, ["source_no", "bucket"]).withColumn("start", F.col("far_base") + F.col("base") + F.col("inside"))
    return placed.select("source_no", "doc_id", "tie", "size", "copies", "start", "source", "source_size", "target"), info


def drawn_slots(spark: SparkSession, info: list[dict], seed: int = 0) -> DataFrame:
    """shard, source_no, epoch, block of every slot of the mix."""
    slots = np.array([i["slots"] for i in info], np.int64)
    sizes = [i["blocks"] for i in info]
    n_shards = -(-int(slots.sum()) // SHARD_SLOTS)

    def run(batches):
        for b in batches:
            for shard in b.column(0).to_pylist():
                counts, before = shard_counts(shard, slots, seed=seed)
                for k in np.flatnonzero(counts):
                    j = np.arange(before[k], before[k] + counts[k])
                    epoch = j // sizes[k]
                    block = permute(j % sizes[k], sizes[k], (epoch + np.int64(7919) * int(k) + np.int64(seed) * 104729).astype(np.uint64))
                    n = len(j)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.full(n, k, np.int32)), pa.array(epoch.astype(np.int32)), pa.array(block)], names=["shard", "source_no", "epoch", "block"])

    n_parts = max(1, min(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(0, n_shards, 1, n_parts).mapInArrow(tidy(run), "shard long, source_no int, epoch int, block long")


def mix(docs: DataFrame, weights=WEIGHTS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, source, text, ...) -> (documents, pieces). documents: source_no, doc_id, tie, size, start, source,
    source_size, target, a row per row. pieces: source_no, start, doc_id, tie, size, block, epochs (those that take the
    block), from_word and words (the document's part of the block). source_no and start name a document with words."""
    spark = docs.sparkSession
    placed, info = place(docs, weights)
    placed = write_table(spark, placed, "mix-placed")
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("copy", "copies")
    taken = drawn_slots(spark, info, seed).groupBy("source_no", "block").agg(F.collect_set("epoch").alias("epochs"))  # MAX_EPOCHS values at most
    first, last = F.col("start") / BLOCK_WORDS, (F.col("start") + F.col("size") - 1) / BLOCK_WORDS
    cut = each.where("size > 0").select("source_no", "start", "doc_id", "tie", "size", F.explode(F.sequence(F.floor(first), F.floor(last))).alias("block"))
    at = F.greatest(F.col("start"), F.col("block") * BLOCK_WORDS)
    cut = cut.withColumn("from_word", at - F.col("start")).withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS) - at)
    # the planner can't tell how many slots a shard draws and would broadcast them
    return each, cut.join(taken.hint("merge"), ["source_no", "block"])


def mixed_documents(docs: DataFrame, weights=WEIGHTS, seed: int = 0) -> DataFrame:
    """The mix as documents: a row per document and epoch with the text of the words taken then; all columns of
    docs, other texts as they were. A text taken whole is kept as it is, else its pieces are cut at words and
    joined by a line break where words between them were not taken."""
    _, pieces = mix(docs, weights, seed)
    per_doc = pieces.select("source_no", "start", "doc_id", "tie", "size", "from_word", "words", F.explode("epochs").alias("epoch")).groupBy("source_no", "start", "doc_id", "tie", "size", "epoch").agg(F.sum("words").alias("got"), F.array_sort(F.collect_list(F.struct("from_word", "words"))).alias("parts"))
    key = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit(""))  # never null
    per_doc = per_doc.select(key.alias("key"), "tie", "size", "got", "parts")
    # rows that are alike are one here, combined before the shuffle; their copies are rows of per_doc
    rows = docs.select(key.alias("key"), _row_hash(docs).alias("tie"), F.struct(*docs.columns).alias("row_columns")).groupBy("key", "tie").agg(F.first("row_columns").alias("row_columns"))
    joined = per_doc.hint("merge").join(rows, ["key", "tie"])

    def run(batches):
        import re

        word = re.compile(WORD)
        for b in batches:
            text, size, got, parts = (b.column(b.schema.get_field_index(x)).to_pylist() for x in ("text", "size", "got", "parts"))
            out = []
            for t, n, g, p in zip(text, size, got, parts):
                if g < n:
                    spans = [m.span() for m in word.finditer(t)]
                    made, end = [], None
                    for x in p:
                        i, j = x["from_word"], x["from_word"] + x["words"]
                        made.append(t[spans[i - 1][1] if end == i else spans[i][0] : spans[j - 1][1]])
                        if end is not None and end != i:
                            made.insert(-1, "\n")
                        end = j
                    t = "".join(made)
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column(b.schema.get_field_index("row_columns"))], names=["new_text", "row_columns"])

    taken = joined.select(F.col("row_columns.text").cast("string").alias("text"), "size", "got", "parts", "row_columns")
    done = taken.mapInArrow(tidy(run), joined.select(F.lit(None).cast("string").alias("new_text"), "row_columns").schema)
    return done.select(*[F.col("new_text").alias(c) if c == "text" else F.col("row_columns")[c].alias(c) for c in docs.columns])


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, pieces = mix(load(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    got = pieces.groupBy(F.col("source_no").alias("s"), F.col("start").alias("at")).agg(F.sum(F.col("words") * F.size("epochs")).alias("taken"))
    # start names a document that has words
    same = (F.col("source_no") == F.col("s")) & (F.col("start") == F.col("at")) & (F.col("size") > 0)
    return documents.join(got.hint("merge"), same, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
