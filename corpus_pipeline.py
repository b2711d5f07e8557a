"""The corpus pipeline: quality classifier, near-copies, benchmark leaks, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All stages but the last return the
columns of ``documents``. The caller writes each result as Parquet and reads it again for the next stage; ``run`` does so in the
folder that driver and executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.cotraining import keep_good
from lexmill.llm.decontaminate import decontaminate
from lexmill.llm.entries import tokenizer
from lexmill.llm.jaccard_join import jaccard_join
from lexmill.llm.piece_codec import piece_digests
from lexmill.llm.scratch import Scratch, unused
from lexmill.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies. Rows are told apart by a number of their own, so doc_ids may repeat."""
    (row,) = unused(docs, "row")
    rows = Scratch(spark, "near-copies").save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = jaccard_join(spark, rows.select(F.col(row).alias("doc_id"), "text"))
    stay = found.where("component_id = doc_id").select(F.col("doc_id").alias(row))
    return rows.join(stay, row, "left_semi").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return redact(spark, docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    return piece_digests(spark, docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality),
    ("near copies", near_copies),
    ("benchmark leaks", benchmark_leaks),
    ("secrets", secrets),
    ("token ids", token_ids),
]
#: The classifier is trained, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
