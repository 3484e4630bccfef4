"""A corpus pipeline over `documents`: language, near-duplicates, secrets, mixture, packing.

Each stage takes the documents its predecessor kept, written as Parquet and read back, and decides on all of
them. A stage's intermediate tables are deleted when the next one starts, by when its result is stored. No column of
documents changes but text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from voxlake.llm.common import delete, load, owned_by, release, shared_dir
from voxlake.llm.langid import keep_known
from voxlake.llm.mixing import mixed_documents
from voxlake.llm.neardup import keep_one
from voxlake.llm.packing import pack
from voxlake.llm.secret_scan import redacted

#: Owner of the stages' intermediate tables; those of other queries of the session are not touched.
OWNER = "corpus_pipeline"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words' languages can be told; mixed texts stay, and every column as it is. Null, empty and
    letterless texts go; repeated rows get equal decisions; an empty table stays empty; very long texts count whole."""
    release(spark, OWNER)
    return keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the least doc_id, with all its rows and columns. Texts without
    words, and rows without doc_id, stay; an empty table stays empty; very long texts are compared whole."""
    release(spark, OWNER)
    with owned_by(OWNER):
        return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in text replaced by its kind in brackets; other columns as they are. A null text
    stays null; repeated rows stay alike; an empty table stays empty; very long texts are scanned whole."""
    release(spark, OWNER)
    return redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per document and epoch, text being the words taken then; other columns as they are. Null, empty
    and wordless texts are never taken; repeated rows are documents of their own; an empty table stays empty; very long
    texts are cut into blocks like others."""
    release(spark, OWNER)
    with owned_by(OWNER):
        return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids. A null text yields its end id alone; repeated rows are packed as often
    as they occur; an empty table gives no pieces; very long texts are cut at windows' ends."""
    import public_tokenizers

    release(spark, OWNER)
    with owned_by(OWNER):
        return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("packing", packing)]

#: Learned automata and fields, signatures and draws are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read from the run's own folder; all else that the run stored is deleted."""
    docs, before = load(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            delete(spark, before)
        before = f"{base}/{name}"
    release(spark, OWNER)
    return docs
