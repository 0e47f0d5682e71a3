"""Marts: the gate that decides what may be recommended, and what each organisation contributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outpulse.clock import Clock
from outpulse.plans.enrich import freshness

CANDIDATE_COLUMNS = [
    "event_id",
    "event_name",
    "activity_category",
    "activity_family",
    "secondary_badge",
    "social_structure",
    "group_suitability",
    "audience_data_available",
    "solo_private_score",
    "solo_social_score",
    "couple_score",
    "small_group_score",
    "beginner_friendly",
    "price_amount",
    "start_at",
    "end_at",
    "location",
    "borough",
    "zip_code",
    "lat",
    "lon",
    "solo_friendly",
    "vibe_tags",
    "is_virtual",
    "freshness_status",
    "actionability_score",
    "discovery_score",
    "image_url",
    "source_id",
    "source_name",
    "channel_type",
    "update_cadence",
    "source_last_checked",
]


def event_rules(clock: Clock) -> dict[str, Column]:
    """What an event must satisfy by itself. A NULL result fails the rule."""
    url = F.col("event_source_url")
    price = F.col("price_amount")
    return {
        "not_ended": F.coalesce("end_at", "start_at") >= clock.now_local(),
        "has_start": F.col("start_at").isNotNull(),
        "has_url": url.isNotNull() & (url != ""),
        "renderable": F.col("event_name").isNotNull()
        & F.col("location").isNotNull()
        & F.col("activity_category").isNotNull(),
        "legal_price": price.isNull() | (price >= 0),
        "not_cancelled": ~F.col("is_cancelled"),
    }


def source_rules() -> dict[str, Column]:
    """What its source must satisfy."""
    return {
        "active_source": F.col("is_active"),
        "not_abandoned": F.col("freshness_status") != "abandoned",
    }


def all_of(rules: dict[str, Column]) -> Column:
    combined = F.lit(True)
    for rule in rules.values():
        combined = combined & rule
    return combined


def candidates(enriched: DataFrame, clock: Clock) -> DataFrame:
    """The events that could be shown today. The event rules reach the scan; the source rules follow the join."""
    return enriched.filter(all_of(event_rules(clock)) & all_of(source_rules())).select(
        *CANDIDATE_COLUMNS, F.col("event_source_url").alias("source_url")
    )


def organizations(events: DataFrame, sources: DataFrame, clock: Clock) -> DataFrame:
    """Active sources with the number of their candidates and the next start; zero is a value, not a gap.

    The events are reduced to one row per source before they meet the sources, so a source that owns a third of the
    events costs one partial count per task, and the join sees both sides at source grain.
    """
    per_source = (
        events.filter(all_of(event_rules(clock)))
        .groupBy("source_id")
        .agg(F.count(F.lit(1)).alias("_count"), F.min("start_at").alias("_next"))
    )
    joined = sources.filter("is_active").join(per_source, "source_id", "left")
    counts = freshness(clock) != "abandoned"
    return joined.select(
        "source_id",
        "source_name",
        "source_category",
        "channel_type",
        "source_url",
        "source_image_url",
        "update_cadence",
        "source_last_checked",
        "is_active",
        F.when(counts, F.col("_next")).alias("next_event_at"),
        F.coalesce(F.when(counts, F.col("_count")), F.lit(0)).cast("bigint").alias("upcoming_event_count"),
    )


def organization_list(organizations_mart: DataFrame) -> DataFrame:
    """Busiest first, then by name."""
    return organizations_mart.select(
        "source_id",
        F.col("source_name").alias("name"),
        F.col("source_category").alias("category"),
        "channel_type",
        F.col("source_url").alias("url"),
        F.col("source_image_url").alias("image_url"),
        "upcoming_event_count",
    ).orderBy(F.desc("upcoming_event_count"), F.asc("name"))


def category_counts(candidates_mart: DataFrame) -> DataFrame:
    return (
        candidates_mart.groupBy("activity_category")
        .agg(F.count(F.lit(1)).alias("events"))
        .orderBy(F.desc("events"), F.asc("activity_category"))
    )
