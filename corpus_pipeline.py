"""A training-corpus pipeline: each stage takes all documents that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm import decontamination, mixing, near_duplicates, quality, token_files, toxicity
from meridia.llm.shared import fresh_path

TOKENIZER = "word_bpe_49k.json"


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon, learned from the labelled rows, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("y"))
    lexicon = toxicity.learn(docs, labels.where(~quality.held_out(2, 4)))
    return toxicity.without_toxic(docs, lexicon)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (found by SimHash as in op3 and by MinHash, 0.8 of the five-word shingles or more): the smallest doc_id."""
    return near_duplicates.one_of_each_similar(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def _token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left; per document its start, length and checksum as read back."""
    return token_files.token_files(docs, public_tokenizers.path(TOKENIZER), end_id=2)


STAGES = [
    ("toxicity", _toxicity),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("mixing", _mixing),
    ("token_files", _token_files),
]

#: no SQL expresses learned lexicons, fingerprints or tokenizers; the tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
