"""Staging: every feed reshaped onto one event contract and one source contract.

Nothing is invented here. What a feed does not publish stays NULL, because NULL means unknown.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outpulse.functions.text import blank_to, feed_category, is_cancelled_title, mentions_any

EVENT_COLUMNS = [
    "event_id",
    "source_id",
    "event_name",
    "activity_category",
    "start_at",
    "end_at",
    "price_amount",
    "location",
    "solo_friendly",
    "event_source_url",
    "event_last_checked",
    "zip_code",
    "lat",
    "lon",
    "vibe_tags",
    "image_url",
    "event_description",
    "is_cancelled",
    "is_virtual",
]

# A time of day is read only from a full timestamp text of this form.
FULL_TIMESTAMP = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


@dataclass(frozen=True)
class FeedProfile:
    """The source a machine feed stands for, since no curated row describes it."""

    source_id: str = "parks-feed"
    source_name: str = "Parks open data feed"
    category: str = "outdoors"
    channel_type: str = "api"
    url: str = "https://feed.example.org/events.json"
    update_cadence: str = "daily"
    notes: str = "Public feed of upcoming park events, loaded by machine"
    id_prefix: str = "parks-"


DEFAULT_FEED = FeedProfile()


def stage_sources(sources: DataFrame) -> DataFrame:
    return sources.select(
        "source_id",
        F.col("name").alias("source_name"),
        F.col("category").alias("source_category"),
        "channel_type",
        F.col("url").alias("source_url"),
        "update_cadence",
        F.col("last_checked").alias("source_last_checked"),
        F.col("notes").alias("source_notes"),
        "is_active",
        F.col("image_url").alias("source_image_url"),
    )


def stage_events(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        "source_id",
        F.col("title").alias("event_name"),
        F.col("category").alias("activity_category"),
        F.col("start_time").alias("start_at"),
        F.col("end_time").alias("end_at"),
        F.col("cost").alias("price_amount"),
        "location",
        "solo_friendly",
        F.col("source_url").alias("event_source_url"),
        F.col("last_checked").alias("event_last_checked"),
        "zip_code",
        "lat",
        "lon",
        "vibe_tags",
        "image_url",
    )


def time_of_day_seconds(text: Column) -> Column:
    """Seconds after midnight of a full timestamp text; NULL for any other text.

    A text of the right form that is no real time gives NULL here; ``bad_time_counts`` counts such rows.
    """
    parsed = F.when(text.rlike(FULL_TIMESTAMP), text).try_cast("timestamp_ntz")
    return F.hour(parsed) * 3600 + F.minute(parsed) * 60 + F.second(parsed)


def bad_time_counts() -> dict[str, Column]:
    """How many start and end texts look like timestamps but are none, as aggregates by name."""

    def broken(name: str) -> Column:
        return F.count_if(F.col(name).rlike(FULL_TIMESTAMP) & time_of_day_seconds(F.col(name)).isNull())

    return {"bad_starttime": broken("starttime"), "bad_endtime": broken("endtime")}


def bad_times(feed: DataFrame) -> DataFrame:
    return feed.agg(*[count.alias(name) for name, count in bad_time_counts().items()])


def _at(day: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, day.cast("timestamp_ntz"))


def stage_feed(feed: DataFrame, profile: FeedProfile = DEFAULT_FEED) -> DataFrame:
    """The feed on the event contract.

    The date part of its time fields is the publication date, so only the time of day is used and put on the event's
    own date. An end that is not after its start is unknown, never a roll-over past midnight.
    """
    start_at = _at(F.col("startdate"), F.coalesce(time_of_day_seconds(F.col("starttime")), F.lit(0)))
    end_at = _at(F.coalesce("enddate", "startdate"), time_of_day_seconds(F.col("endtime")))
    timed = feed.withColumns({"_start": start_at, "_end": end_at})
    return timed.select(
        F.concat(F.lit(profile.id_prefix), "source_record_id").alias("event_id"),
        F.lit(profile.source_id).alias("source_id"),
        F.col("title").alias("event_name"),
        feed_category("categories").alias("activity_category"),
        F.col("_start").alias("start_at"),
        F.when(F.col("_end") > F.col("_start"), F.col("_end")).alias("end_at"),
        F.lit(None).cast("decimal(12,2)").alias("price_amount"),
        blank_to(F.col("location"), F.col("parknames")).alias("location"),
        F.lit(None).cast("boolean").alias("solo_friendly"),
        blank_to(F.col("registration_url"), F.col("link_url")).alias("event_source_url"),
        F.to_date("ingested_at").alias("event_last_checked"),
        F.lit(None).cast("string").alias("zip_code"),
        "lat",
        "lon",
        F.lit(None).cast("string").alias("vibe_tags"),
        F.lit(None).cast("string").alias("image_url"),
        F.col("description").alias("event_description"),
        is_cancelled_title(F.col("title")).alias("is_cancelled"),
        mentions_any("categories", ["Virtual/Online"]).alias("is_virtual"),
    )


def feed_source(feed: DataFrame, profile: FeedProfile = DEFAULT_FEED) -> DataFrame:
    """The feed as one source row, also for an empty feed; it was last checked when it was last ingested."""
    return feed.agg(F.to_date(F.max("ingested_at")).alias("source_last_checked")).select(
        F.lit(profile.source_id).alias("source_id"),
        F.lit(profile.source_name).alias("source_name"),
        F.lit(profile.category).alias("source_category"),
        F.lit(profile.channel_type).alias("channel_type"),
        F.lit(profile.url).alias("source_url"),
        F.lit(profile.update_cadence).alias("update_cadence"),
        "source_last_checked",
        F.lit(profile.notes).alias("source_notes"),
        F.lit(True).alias("is_active"),
        F.lit(None).cast("string").alias("source_image_url"),
    )


def all_events(curated: DataFrame, feed: DataFrame, profile: FeedProfile = DEFAULT_FEED) -> DataFrame:
    """Both feeds as one event table. The curated feed has no descriptions, cancellations or online events."""
    staged = stage_events(curated).withColumns(
        {
            "event_description": F.lit(None).cast("string"),
            "is_cancelled": F.lit(False),
            "is_virtual": F.lit(False),
        }
    )
    return staged.select(*EVENT_COLUMNS).unionByName(stage_feed(feed, profile).select(*EVENT_COLUMNS))


def all_sources(sources: DataFrame, feed: DataFrame, profile: FeedProfile = DEFAULT_FEED) -> DataFrame:
    return stage_sources(sources).unionByName(feed_source(feed, profile))
