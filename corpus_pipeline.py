"""From raw documents to packed sequences: the stages of a training-data pipeline, each on what the one before kept.

Every stage but the last returns the columns of ``documents``, whatever further columns there are. Its rows are written
as Parquet and read again as the next stage's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outpulse.llm import decontaminate, near_dedup, packing, quality_rules, suffix_dedup
from outpulse.llm.common import ROW, numbered, shared_folder, ship, table, without_rows, written
from outpulse.llm.queries import vocabulary

#: Near copies share this percentage of their five-word shingles.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their own rules and their host's verdict leave."""
    ship(spark)
    return quality_rules.judge(docs).filter("kept").select("doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id. A text without words is no copy."""
    ship(spark)
    rows = numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))
    found = near_dedup.grouped(rows.select(ROW, "doc.doc_id", "doc.text"), "text", SHINGLE_WORDS, SIMILAR_PERCENT)
    dropped = written(found.filter(F.col("keeper") != F.col(ROW)).select(ROW), "near-copies")
    return without_rows(rows, dropped).select("doc.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages of 200 bytes or more that occur elsewhere, whole characters kept.

    A document may become empty, and stays. ``n_chars`` is counted anew; a null text stays null.
    """
    ship(spark)
    found = suffix_dedup.dedup(docs)
    text = F.when(F.col("doc.text").isNotNull(), F.col("kept_text"))
    changed = F.col("doc").withField("text", text).withField("n_chars", F.coalesce(F.length(text).cast("long"), F.col("doc.n_chars")))
    return found.select(F.when(F.col("n_removed") > 0, changed).otherwise(F.col("doc")).alias("doc")).select("doc.*")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    ship(spark)
    found = decontaminate.scanned(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("runs") == 0).select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    ship(spark)
    return packing.pack(docs, *vocabulary())


STAGES = [
    ("quality rules", quality),
    ("near copies", near_copies),
    ("repeated passages", repeated_passages),
    ("benchmark passages", benchmark_free),
    ("packing", packed),
]

#: Near copies, repeated passages and packing cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
