"""A corpus pipeline: five stages over `documents`, each a corpus operator whose decisions take effect.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next one's docs.  All
but the last return the columns of documents.  `run` does so in a new folder under the shared one.

Defined results, for all stages: rows are kept or dropped whole, and other columns than those of documents are left out; an empty table gives
an empty one.  What a null or repeated id and a null or empty text give is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm import decontaminate, mixing, ngram_join, quality, secrets, shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling rejects go: texts that are null or without words always, toxic ones, and those that the sample leaves out.
    Rows without an id are sampled by their text; rows that share id and text stay or go together."""
    return quality.kept(docs, quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest id stays.
    Rows that share an id are one document and stay or go together; rows without an id can't be named and stay; texts without words are like nothing and stay."""
    group = ngram_join.groups(docs, k=5, t=(80, 100))
    gone = group.where("component_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go, however long they are: no test passage is trained on.
    Each row is scanned by itself, whatever its id; texts without words stay, and an empty benchmark takes none."""
    found = decontaminate.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(decontaminate.hit_words() == 0).select(COLUMNS)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the secrets in their texts are replaced by a mark, and n_chars is that of the new text (null for a null text)."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: one row for each copy of a document that the mix takes, range-sorted by position.
    Texts without words have no copy; rows without an id, and each of rows that share one, are placed on their own."""
    return mixing.curriculum(mixing.allocate(docs))


STAGES = [("good_quality", good_quality), ("one_of_each", one_of_each), ("not_in_benchmark", not_in_benchmark), ("no_secrets", no_secrets), ("mixed", mixed)]

#: SQL can't express the fitted model of the first stage, nor the entropy spans of the fourth; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared.fresh(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}-{name}")
        docs = spark.read.parquet(f"{root}/{i}-{name}")
    return docs
