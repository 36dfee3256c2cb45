"""The corpus pipeline: toxicity, exact and near duplicates, mixing, byte-level BPE.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet to the shared folder and read
again as the docs of the next; run() deletes the files of a stage once the next one is written. All but the last return the columns of documents. A stage drops or repeats rows only by its own decision; with
no rows left, the later stages return empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atomweave.llm import bpe, exact_dedup, mixing, simhash, toxicity
from atomweave.llm.common import removed, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator, fitted on these documents' labels, doesn't reject."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.drop_exact(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the row with the smallest doc_id."""
    return simhash.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a document stands as often as its source's budget begins it."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row's ids and decoded bytes."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Learned scores, fingerprints' components and BPE have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name)
        removed(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
