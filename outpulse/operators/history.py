"""Type-2 change history and the observation fact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outpulse import schemas
from outpulse.functions.text import is_cancelled_title
from outpulse.operators.joins import MAX_BROADCAST_ROWS, is_small
from outpulse.operators.upsert import last_per_key
from outpulse.plans.staging import DEFAULT_FEED, FeedProfile

KEY = "source_record_id"
CAPTURED_AT = "ingested_at"
HISTORY_COLUMNS = [KEY, *schemas.HISTORY_CHECKED, *schemas.HISTORY_CARRIED, "version_id", "valid_from", "valid_to"]
HISTORY_SCHEMA = """source_record_id string, title string, startdate date, enddate date, starttime string,
 endtime string, location string, parknames string, categories string, link_url string, registration_url string,
 lat double, lon double, ingested_at timestamp_ntz, version_id string, valid_from timestamp_ntz,
 valid_to timestamp_ntz"""
OBSERVATION_KEY = ["event_id", "observed_on"]
OBSERVATION_SCHEMA = """source_record_id string, scheduled_for date, observed_on date, event_id string,
 was_cancelled_on_that_date boolean, days_ahead_of_event int"""


def version_id(key: Column, valid_from: Column) -> Column:
    return F.md5(F.concat_ws("~", key, F.date_format(valid_from, "yyyy-MM-dd HH:mm:ss.SSSSSS")))


def history_from_batches(
    batches: DataFrame, checked: Sequence[str] = schemas.HISTORY_CHECKED, carried: Sequence[str] = schemas.HISTORY_CARRIED
) -> DataFrame:
    """The whole history of many dated batches in one pass: one shuffle on the key, one sort, two windows over it.

    A batch holds a key at most once, so a key's window is as long as the number of batches, however often the key
    occurs in the data behind them.
    """
    by_time = W.partitionBy(KEY).orderBy(CAPTURED_AT)
    state = F.struct(*checked)
    is_change = F.lag(F.lit(True)).over(by_time).isNull() | ~state.eqNullSafe(F.lag(state).over(by_time))
    changes = batches.select(KEY, *checked, *carried).withColumn("_changed", is_change).filter("_changed").drop("_changed")
    return changes.withColumns(
        {
            "valid_from": F.col(CAPTURED_AT),
            "valid_to": F.lead(CAPTURED_AT).over(by_time),
            "version_id": version_id(F.col(KEY), F.col(CAPTURED_AT)),
        }
    ).select(KEY, *checked, *carried, "version_id", "valid_from", "valid_to")


def snapshot(
    current: DataFrame,
    batch: DataFrame,
    checked: Sequence[str] = schemas.HISTORY_CHECKED,
    carried: Sequence[str] = schemas.HISTORY_CARRIED,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """The open versions after a batch, together with the versions that this batch closes.

    ``current`` holds open versions only, so closed history is neither read nor rewritten. A key that is absent from
    the batch stays open: leaving the feed is no deletion. Columns are compared one by one and NULL equals NULL.
    The batch must hold a key once; its capture time closes the old version and opens the new one.
    """
    payload = [*checked, *carried]
    new = batch.select(KEY, *[F.col(name).alias(f"_new_{name}") for name in payload], F.lit(True).alias("_in_batch"))
    new = new.withColumnRenamed(KEY, "_new_key")
    old = current.select(*HISTORY_COLUMNS)
    same = F.lit(True)
    for name in checked:
        same = same & F.col(name).eqNullSafe(F.col(f"_new_{name}"))
    captured_at = F.col(f"_new_{CAPTURED_AT}")
    opens = F.col("_in_batch") & (F.col(KEY).isNull() | ~same)
    closes = F.coalesce(F.col("_in_batch") & ~same, F.lit(False))

    def old_version() -> Column:
        fields = [F.col(name) for name in HISTORY_COLUMNS if name != "valid_to"]
        return F.struct(*fields, F.when(closes, captured_at).otherwise(F.col("valid_to")).alias("valid_to"))

    def new_version() -> Column:
        return F.struct(
            F.col("_new_key").alias(KEY),
            *[F.col(f"_new_{name}").alias(name) for name in payload],
            version_id(F.col("_new_key"), captured_at).alias("version_id"),
            captured_at.alias("valid_from"),
            F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        )

    on = F.col(KEY) == F.col("_new_key")
    if is_small(batch.select(KEY), max_broadcast_rows):
        # The open versions stay where they are; keys that are new to the history are found among the batch keys.
        touched = old.join(F.broadcast(new), on, "left")
        known = current.join(F.broadcast(batch.select(KEY)), KEY, "left_semi").select(KEY)
        first_seen = (
            new.join(F.broadcast(known), F.col("_new_key") == known[KEY], "left_anti")
            .select(new_version().alias("v"))
            .select("v.*")
        )
        versions = F.array_compact(F.array(old_version(), F.when(opens, new_version())))
        return touched.select(F.inline(versions)).unionByName(first_seen)
    both = old.join(new, on, "full_outer")
    versions = F.array_compact(F.array(F.when(F.col(KEY).isNotNull(), old_version()), F.when(opens, new_version())))
    return both.select(F.inline(versions))


def touched_versions(
    touched: DataFrame,
    batches: DataFrame,
    checked: Sequence[str] = schemas.HISTORY_CHECKED,
    carried: Sequence[str] = schemas.HISTORY_CARRIED,
) -> DataFrame:
    """The versions that rows of several capture times make of the open versions of their keys (``touched``).

    A key is there at most once per capture time. A state captured before the open version began is late and is dropped.
    """
    new = batches.select(
        KEY,
        *checked,
        *carried,
        version_id(F.col(KEY), F.col(CAPTURED_AT)).alias("version_id"),
        F.col(CAPTURED_AT).alias("valid_from"),
        F.lit(0).alias("_was_open"),
    )
    touched = touched.drop("valid_to").withColumn("_was_open", F.lit(1))
    by_key = W.partitionBy(KEY)
    by_time = by_key.orderBy("valid_from", F.desc("_was_open"))
    state = F.struct(*checked)
    late = (F.max("_was_open").over(by_key) == 1) & (
        F.max("_was_open").over(by_time.rowsBetween(W.unboundedPreceding, W.currentRow)) == 0
    )
    return (
        touched.unionByName(new)
        .withColumn("_late", late)
        .filter("not _late")
        .withColumn("_first", F.lag(F.lit(True)).over(by_time).isNull())
        .withColumn("_changed", F.col("_first") | ~state.eqNullSafe(F.lag(state).over(by_time)))
        .filter("_changed")
        .withColumn("valid_to", F.lead("valid_from").over(by_time))
        .select(*HISTORY_COLUMNS)
    )


def snapshot_batches(
    current: DataFrame,
    batches: DataFrame,
    checked: Sequence[str] = schemas.HISTORY_CHECKED,
    carried: Sequence[str] = schemas.HISTORY_CARRIED,
) -> DataFrame:
    """As ``snapshot`` for rows of several capture times at once. Only keys that occur in the batches take part."""
    keys = batches.select(KEY).distinct()
    versions = touched_versions(current.join(keys, KEY, "left_semi"), batches, checked, carried)
    return current.join(keys, KEY, "left_anti").select(*HISTORY_COLUMNS).unionByName(versions)


def snapshot_history(history: DataFrame, batch: DataFrame, **options) -> DataFrame:
    """The whole history after a batch."""
    closed = history.filter("valid_to is not null").select(*HISTORY_COLUMNS)
    return closed.unionByName(snapshot(history.filter("valid_to is null"), batch, **options))


def arrival_order(feed: DataFrame) -> list[str]:
    """The columns by which the last of several rows with one key is told: capture, arrival where it is known, text."""
    return [name for name in (CAPTURED_AT, "arrival", "raw_payload") if name in feed.columns]


def observe(feed: DataFrame, profile: FeedProfile = DEFAULT_FEED) -> DataFrame:
    """What the feed says on the day it was captured. A row asserts presence and never absence."""
    observed_on = F.to_date(CAPTURED_AT)
    return feed.select(
        KEY,
        F.col("startdate").alias("scheduled_for"),
        observed_on.alias("observed_on"),
        F.concat(F.lit(profile.id_prefix), KEY).alias("event_id"),
        is_cancelled_title(F.col("title")).alias("was_cancelled_on_that_date"),
        F.datediff("startdate", observed_on).alias("days_ahead_of_event"),
    )


def high_water_mark(recorded: DataFrame) -> Column:
    """The last recorded day as a scalar subquery."""
    return recorded.agg(F.coalesce(F.max("observed_on"), F.lit("1900-01-01").cast("date")).alias("mark")).scalar()


def new_observations(mark: Column, feed: DataFrame, profile: FeedProfile = DEFAULT_FEED) -> DataFrame:
    """The feed's observations from the mark on; an older batch is late and is dropped. One row per event and day."""
    fresh = feed.filter(F.to_date(CAPTURED_AT) >= mark)
    return observe(last_per_key(fresh.withColumn("_day", F.to_date(CAPTURED_AT)), [KEY, "_day"], arrival_order(feed)), profile)


def record_observations(recorded: DataFrame, feed: DataFrame, profile: FeedProfile = DEFAULT_FEED) -> DataFrame:
    """The observation table after a batch: same event and day are replaced, so a second run changes nothing.

    Only days from the mark on can be touched; older days pass through without a join.
    """
    mark = high_water_mark(recorded)
    fresh = new_observations(mark, feed, profile)
    older = recorded.filter(F.col("observed_on") < mark)
    replaced = recorded.filter(F.col("observed_on") >= mark).join(
        fresh.select(*OBSERVATION_KEY), OBSERVATION_KEY, "left_anti"
    )
    return older.unionByName(replaced).unionByName(fresh)
