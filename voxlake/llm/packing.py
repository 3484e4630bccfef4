"""Mixture-controlled packing of token streams into fixed windows by deficit round-robin.

Every source is a queue of its documents. In each round a source's deficit grows by its quantum, the window size times
its target share, and it is served whole documents from the head of its queue while the deficit holds them; what is
left is carried into the next round. An empty queue is passed over. What is served, round by round and in a round
source by source, fills the windows one after the other; a document is cut only where a window ends.

A document that ends e tokens into its queue is served in the first round in which all quanta so far hold e, round
(e - 1) // quantum, whatever the other queues do. So the state that a partition starts from, deficits included, comes
from running sums, without a chain of tasks:

1. Documents are encoded once; ids go to a table in the shared folder with the running token position in their task's
   part of their source's queue.
2. Token sums per (task, source), one short row each, give each document's place in its queue, and so its round.
3. Rounds are summed up in stretches of STRETCH rounds, these in stretches of FAR, one short row each, and documents
   inside their stretch, which gives each document's place in the stream of windows.
4. That place joins the ids, which are cut at the windows' ends.

The last, partial window is cut into sequences of powers of two, so nothing is padded.

Targets: shares of the sources by name, the sources' own parts of all tokens by default, by which all queues end
together; a source without a share has its own part of what the others leave, at least a tenth of its part of all
tokens. Quanta are counted in parts of a token, UNIT to one.

Defined cases: a null text is empty and yields its end id alone; a null source is a source of its own, the last;
repeated rows are packed as often as they occur; a text longer than a window is cut at each window's end; an empty
table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, tidy, write_table
from .tokens import encoder

WINDOW = 4096
#: Quanta are worked out on the driver, one number a source; more sources than this are refused.
MAX_SOURCES = 100_000
#: Parts of a token in which quanta are counted.
UNIT = 1 << 16
#: Rounds whose documents are placed by one window function; stretches that are summed by one.
STRETCH, FAR = 256, 4096


def quanta(sizes: dict, targets: dict | None = None, window: int = WINDOW) -> dict:
    """Parts of a token by which each source's deficit grows in a round. sizes: tokens of each source."""
    total = sum(sizes.values())
    share = {s: n / total for s, n in sizes.items()}
    if targets is not None:
        given = {s: float(targets[s]) for s in sizes if s in targets}
        if any(not v > 0 for v in given.values()):
            raise ValueError("a target share is above 0")
        rest = {s: share[s] for s in sizes if s not in given}
        left = max(1.0 - sum(given.values()), 0.1 * sum(rest.values()))
        share = given | {s: v / sum(rest.values()) * left for s, v in rest.items()}
        share = {s: v / sum(share.values()) for s, v in share.items()}
    return {s: max(1, round(window * UNIT * share[s])) for s in sizes}


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, source, part, row, local, n_tokens, ids (packed), with end_id appended.
    local counts the tokens of the same source before the document in its task; part and row name the document."""

    def run(batches):
        from pyspark import TaskContext

        enc, part, row = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end, width = enc._pack([end_id]), enc.dtype.itemsize
        before: dict = {}
        for b in batches:
            ids, local, n = [], [], []
            for source, one in zip(b.column(1).to_pylist(), enc.encode(b.column(2))):
                ids.append(one + end)
                n.append(len(ids[-1]) // width)
                local.append(before.get(source, 0))
                before[source] = local[-1] + n[-1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([part] * len(n), pa.int64()), pa.array(range(row, row + len(n)), pa.int64()), pa.array(local, pa.int64()), pa.array(n, pa.int64()), pa.array([width] * len(n), pa.int32()), pa.array(ids, pa.binary())],
                names=["doc_id", "source", "part", "row", "local", "n_tokens", "width", "ids"],
            )
            row += len(n)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(tidy(run), f"doc_id {kind}, source string, part long, row long, local long, n_tokens long, width int, ids binary")


def tail_cuts(rest: int) -> np.ndarray:
    """Ends of the sequences of powers of two that a last window of rest tokens is cut into."""
    return np.cumsum([1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1], dtype=np.int64)


def cut_pieces(at: np.ndarray, n: np.ndarray, total: int, window: int = WINDOW):
    """Cut documents at [at, at + n) of a stream of total tokens; returns document index, start, length, sequence and
    offset of each piece."""
    last, rest = divmod(total, window)
    cuts = tail_cuts(rest)
    ends = np.concatenate([[last * window], last * window + cuts])  # of the last whole window, then of the tail's sequences

    def sequence(x):
        return np.where(x < last * window, x // window, last + np.searchsorted(ends[1:], x, side="right"))

    first, final = sequence(at), sequence(at + n - 1)
    count = final - first + 1
    doc = np.repeat(np.arange(len(at)), count)
    seq = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    tail = np.maximum(seq - last, 0)
    low = np.where(seq < last, seq * window, ends[np.minimum(tail, len(ends) - 1)])
    high = np.where(seq < last, (seq + 1) * window, ends[np.minimum(tail + 1, len(ends) - 1)])
    begin, stop = np.maximum(low, at[doc]), np.minimum(high, at[doc] + n[doc])
    return doc, begin - at[doc], stop - begin, seq, begin - low


def place(tokens: DataFrame, targets: dict | None, window: int) -> tuple[DataFrame, int]:
    """tokens(part, row, source, local, n_tokens) -> part, row, queued_at (in its queue), at (in the stream of windows);
    and all tokens."""
    spark = tokens.sparkSession
    sums = tokens.groupBy("part", "source").agg(F.sum("n_tokens").alias("n"))
    in_queue = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a short row a task
    bases = write_table(spark, sums.select("part", "source", "n", F.coalesce(F.sum("n").over(in_queue), F.lit(0)).alias("base")), "pack-bases")
    per_source = bases.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if not per_source:
        return tokens.select("part", "row", F.col("local").alias("queued_at"), F.col("local").alias("at")), 0
    quantum = quanta({r.source: r.n for r in per_source}, targets, window)
    order = spark.createDataFrame([(r.source, k, quantum[r.source]) for k, r in enumerate(per_source)], "of_source string, source_no int, quantum long")
    bases = bases.join(F.broadcast(order), F.col("source").eqNullSafe(F.col("of_source"))).select(F.col("part").alias("in_part"), F.col("source").alias("in_source"), "base", "source_no", "quantum")  # MAX_SOURCES rows at most
    short = tokens.select("part", "row", "source", "local", "n_tokens").join(bases, (F.col("part") == F.col("in_part")) & F.col("source").eqNullSafe(F.col("in_source")))
    queued = F.col("base") + F.col("local")
    served = F.expr(f"((base + local + n_tokens) * {UNIT}L - 1) div quantum")
    dealt = short.select("part", "row", queued.alias("queued_at"), "source_no", "n_tokens", served.alias("round")).withColumn("stretch", F.expr(f"round div {STRETCH}"))
    sums = dealt.groupBy("stretch").agg(F.sum("n_tokens").alias("n")).withColumn("far", F.expr(f"stretch div {FAR}"))
    ahead = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    fars = sums.groupBy("far").agg(F.sum("n").alias("n")).select("far", running(ahead().orderBy("far")).alias("far_base"))  # a short row for FAR * STRETCH windows of tokens
    stretches = sums.select("stretch", "far", running(ahead("far").orderBy("stretch")).alias("base")).join(fars, "far")
    inside = ahead("stretch").orderBy("round", "source_no", "queued_at")
    placed = dealt.withColumnRenamed("n_tokens", "n").withColumn("inside", running(inside)).join(stretches, "stretch")
    return placed.select("part", "row", "queued_at", (F.col("far_base") + F.col("base") + F.col("inside")).alias("at")), sum(r.n for r in per_source)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, targets: dict | None = None) -> DataFrame:
    """docs(doc_id, source, text) -> a row per piece: doc_id, source, queued_at, start, length, doc_tokens,
    sequence_id, offset, ids (little-endian unsigned 32-bit). queued_at is the place of the row's first token in
    its source's queue; with source it names the row, also among rows of one doc_id. Sequences are whole windows
    or, at the end, powers of two."""
    spark = docs.sparkSession
    tokens = write_table(spark, encode_documents(docs, tokenizer, end_id), "pack-ids")
    placed, total = place(tokens, targets, window)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            at, n = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            dtype = "<u2" if b.column(5)[0].as_py() == 2 else "<u4"
            doc, start, length, seq, offset = cut_pieces(at, n, total, window)
            edges = np.searchsorted(doc, np.arange(0, b.num_rows + 1000, 1000))
            for x, y in zip(edges, edges[1:]):
                if x == y:
                    continue
                ids, wide, held = [], b"", -1
                for d, o, k in zip(doc[x:y].tolist(), start[x:y].tolist(), length[x:y].tolist()):
                    if d != held:
                        wide, held = np.frombuffer(b.column(6)[d].as_buffer(), dtype).astype("<u4").tobytes(), d
                    ids.append(wide[4 * o : 4 * (o + k)])
                own = pa.array(doc[x:y])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(own), b.column(1).take(own), b.column(2).take(own), pa.array(start[x:y]), pa.array(length[x:y]), b.column(4).take(own), pa.array(seq[x:y]), pa.array(offset[x:y]), pa.array(ids, pa.binary())],
                    names=["doc_id", "source", "queued_at", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = tokens.select("part", "row", "doc_id", "source", "n_tokens", "width", "ids").join(placed, ["part", "row"])
    return joined.select("doc_id", "source", "queued_at", "at", "n_tokens", "width", "ids").mapInArrow(
        tidy(run), f"doc_id {kind}, source string, queued_at long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")
