"""The feed as a stream of landed files.

Every micro-batch goes through the same load as a daily run. Its number names the folders it writes, so a batch that
is delivered again after a failure replaces its own output and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from outpulse import schemas
from outpulse.plans.refresh import load_feed_batch, load_pages
from outpulse.plans.staging import DEFAULT_FEED, FeedProfile


def landed_rows(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Feed rows from parquet files, oldest file first."""
    reader = spark.readStream.schema(schemas.FEED)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def landed_pages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Pages (file, value) as they land, oldest first. A file is one page; Spark takes each path once."""
    reader = spark.readStream.option("wholetext", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def follow_pages(
    pages: DataFrame, root: str, checkpoint: str, captured_at: Column, profile: FeedProfile = DEFAULT_FEED, once: bool = True
) -> StreamingQuery:
    """As ``follow``, from pages on. Rows, rejects and unreadable pages of a micro-batch are committed together."""

    def load(batch_pages: DataFrame, batch: int) -> None:
        load_pages(batch_pages.sparkSession, root, batch, batch_pages, captured_at, profile)

    writer = pages.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def follow(
    rows: DataFrame, root: str, checkpoint: str, profile: FeedProfile = DEFAULT_FEED, once: bool = True
) -> StreamingQuery:
    """Load what has landed, then stop, or go on when ``once`` is off."""

    def load(batch_rows: DataFrame, batch: int) -> None:
        # The rows feed three tables; reading the files once is cheaper, and a lost executor only reads them again.
        batch_rows.persist()
        try:
            load_feed_batch(batch_rows.sparkSession, root, batch, batch_rows, profile)
        finally:
            batch_rows.unpersist()

    writer = rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
