"""A corpus made ready for training: five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import bpe, decontaminate, lines, quality, simhash
from galley.plans.joins import use_checkpoint_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(model.scorer(spark)(F.col("text").cast("string")) >= 0.5)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of lines that stand elsewhere already.

    A document that loses all it has goes; ``n_chars`` follows the text.
    """
    done = lines.drop_repeated_passages(docs)
    some = (F.col("lines_dropped") == 0) | (F.trim("text") != "")
    n_chars = F.when(F.col("lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.filter(some).withColumn("n_chars", n_chars).select(docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return simhash.keep_one_of_each_group(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids, and whether these decode to the text again."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, check="round_trip")
    names = [c for c in encoded.columns if c != "round_trip"]
    return encoded.select(*names, F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", fresh_lines),
    ("SimHash near-dedup", one_of_near_copies),
    ("benchmark decontamination", no_benchmark),
    ("byte-level BPE", tokens),
]

# A trained network and a tokenizer have no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared folder."""
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stored = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(stored)
        docs = spark.read.parquet(stored)
    return docs
