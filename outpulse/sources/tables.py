"""The tables of a run, written so that a reader sees a batch wholly or not at all, and that repeating one changes nothing.

Every batch writes folders of its own and then one commit that names what is live (``commits``). Raw tables and open
versions are keyed tables (``keyed``): a batch adds what it brings. Closed versions and rejects are only added to. The
observation fact names a folder per day, and a batch replaces the days that it touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from outpulse import schemas
from outpulse.operators import history
from outpulse.plans.staging import DEFAULT_FEED, FeedProfile
from outpulse.sources import commits, keyed


def read_if_written(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table at ``path``, or an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Materialise a mart; what follows reads the files instead of repeating the work."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Which commits tell of a table: the curated files and the feed are loaded by runs of their own.
LOGS = {"sources": "curated", "events": "curated", "feed": "feed", "open_versions": "feed"}
SCHEMAS = {
    "feed": schemas.FEED,
    "sources": schemas.SOURCES,
    "events": schemas.EVENTS,
    "open_versions": history.HISTORY_SCHEMA,
}
KEYS = {**schemas.KEYS, "open_versions": [history.KEY]}


class Batch:
    """What one batch writes. Nothing of it is live before ``commit``."""

    def __init__(
        self, spark: SparkSession, root: str, log: str, batch: int, buckets: int = keyed.BUCKETS, carries_on: bool = True
    ) -> None:
        """``carries_on``: from what was live after the batch before, which must be there."""
        self.spark, self.root, self.log, self.batch, self.buckets = spark, root, log, batch, buckets
        before = commits.read(spark, root, log, batch - 1) if carries_on else {}
        self.content = {"tables": {}, "closed_versions": [], "observation_days": {}, **before, "counts": {}, "folders": {}}

    def declared(self, name: str) -> StructType:
        return self.spark.createDataFrame([], SCHEMAS[name]).schema

    def read(self, name: str, only: DataFrame | None = None) -> DataFrame:
        meta = self.content["tables"].get(name) or keyed.new(self.buckets)
        return keyed.read(self.spark, self.root, meta, self.declared(name), KEYS[name], only)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Add ``rows``, a key at most once, and merge the buckets that are due."""
        meta = self.content["tables"].get(name) or keyed.new(self.buckets)
        meta, counts = keyed.append(self.root, name, meta, self.declared(name), rows, KEYS[name], self.batch)
        self.content["tables"][name] = meta
        self.content["counts"][name] = counts
        self.merge(name, keyed.due(meta))

    def merge(self, name: str, buckets: Sequence[str] | None = None) -> None:
        """Merge ``buckets`` of a keyed table into new bases; all that have deltas where none are named."""
        meta = self.content["tables"][name]
        chosen = keyed.due(meta, share=0.0) if buckets is None else buckets
        self.content["tables"][name] = keyed.compact(
            self.spark, self.root, name, meta, self.declared(name), KEYS[name], self.batch, chosen
        )

    def folder(self, name: str, df: DataFrame, **metrics: Column) -> DataFrame:
        """``df`` written to a folder that the commit names, and read back. ``metrics`` are taken from the rows as they
        pass, and kept by the commit."""
        if metrics:
            observed = Observation()
            df = df.observe(observed, *[metric.alias(key) for key, metric in metrics.items()])
        self.content["folders"][name] = commits.write_folder(df, self.root, name, self.batch)
        if metrics:
            self.content["counts"][name] = {key: observed.get.get(key, 0) for key in metrics}
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.content['folders'][name]}")

    def snapshot(self, captured: DataFrame) -> None:
        """Take captured states into the change history. Only versions of their keys are read and written."""
        keys = captured.select(history.KEY).distinct()
        versions = history.touched_versions(self.read("open_versions", only=keys), captured).persist()
        try:
            self.upsert("open_versions", versions.filter("valid_to is null"))
            closed = commits.write_folder(versions.filter("valid_to is not null"), self.root, "closed_versions", self.batch)
        finally:
            versions.unpersist()
        self.content["closed_versions"] = [*self.content["closed_versions"], closed]

    def observe(self, rows: DataFrame, profile: FeedProfile = DEFAULT_FEED) -> None:
        """Record rows in the observation fact. The days from the last recorded one on are read and written anew."""
        days = self.content["observation_days"]
        last = max(days, default="1900-01-01")
        fresh = history.new_observations(F.lit(last).cast("date"), rows, profile)
        recorded = _observation_days(self.spark, self.root, {d: f for d, f in days.items() if d >= last})
        kept = recorded.join(fresh.select(*history.OBSERVATION_KEY), history.OBSERVATION_KEY, "left_anti")
        complete = kept.unionByName(fresh).withColumn("day", F.col("observed_on").cast("string"))
        folder = commits.write_folder(complete, self.root, "observations", self.batch, "day")
        # One row a day of the batch.
        written = self.spark.read.option("basePath", f"{self.root}/{folder}").schema("day string").parquet(f"{self.root}/{folder}")
        touched = [r[0] for r in written.select("day").distinct().collect()]
        self.content["observation_days"] = {**days, **{day: folder for day in touched}}

    def commit(self) -> None:
        commits.commit(self.spark, self.root, self.log, self.batch, self.content)


def state(spark: SparkSession, root: str, name: str, batch: int) -> DataFrame:
    """A keyed table after a batch, with the columns it was written with and any declared since, which are NULL."""
    content = commits.read(spark, root, LOGS[name], batch)
    declared = spark.createDataFrame([], SCHEMAS[name])
    if name not in content.get("tables", {}):
        return declared
    return keyed.read(spark, root, content["tables"][name], declared.schema, KEYS[name])


def batch_counts(spark: SparkSession, root: str, log: str, batch: int) -> dict[str, dict[str, int]]:
    """What a batch counted, by table."""
    return commits.read(spark, root, log, batch)["counts"]


def open_versions(spark: SparkSession, root: str, batch: int) -> DataFrame:
    return state(spark, root, "open_versions", batch)


def load_counts(spark: SparkSession, root: str, name: str, batch: int) -> DataFrame:
    """One row with ``inserted`` and ``updated`` of the batch, as its commit states them."""
    counts = batch_counts(spark, root, LOGS[name], batch)[name]
    return spark.createDataFrame([(counts["inserted"], counts["updated"])], "inserted bigint, updated bigint")


def whole_history(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """All versions after a batch: what is open then, and whatever a batch up to it closed."""
    closed = commits.read(spark, root, "feed", batch).get("closed_versions", [])
    still_open = state(spark, root, "open_versions", batch).select(*history.HISTORY_COLUMNS)
    if not closed:
        return still_open
    return still_open.unionByName(spark.read.schema(history.HISTORY_SCHEMA).parquet(*[f"{root}/{folder}" for folder in closed]))


def _observation_days(spark: SparkSession, root: str, days: dict[str, str]) -> DataFrame:
    if not days:
        return spark.createDataFrame([], history.OBSERVATION_SCHEMA)
    return spark.read.schema(history.OBSERVATION_SCHEMA).parquet(*[f"{root}/{folder}/day={day}" for day, folder in sorted(days.items())])


def observations(spark: SparkSession, root: str, batch: int | None = None) -> DataFrame:
    """The observation fact after a batch, or after the last one."""
    content = commits.latest(spark, root, "feed") if batch is None else commits.read(spark, root, "feed", batch)
    return _observation_days(spark, root, content.get("observation_days", {}))


#: All that the commits of a log name.
TABLES = {
    "curated": ["sources", "events"],
    "feed": ["feed", "open_versions", "closed_versions", "observations", "feed_rows", "feed_rejects", "feed_bad_pages"],
    "marts": ["candidates", "organizations", "reliability"],
}


def expire(spark: SparkSession, root: str, log: str, keep: int) -> list[str]:
    """Delete the folders that none of the last ``keep`` batches reads. What earlier batches stood for is gone then."""
    return commits.expire(spark, root, log, TABLES[log], keep)


def batch_folder(spark: SparkSession, root: str, log: str, name: str, batch: int) -> DataFrame:
    """A table that a batch wrote whole, such as its rejects or a mart."""
    return spark.read.parquet(f"{root}/{commits.read(spark, root, log, batch)['folders'][name]}")
