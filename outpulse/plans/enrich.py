"""Enrichment: freshness, audience fit and discoverability for every event.

Whatever depends on the source alone (freshness, discovery) is computed once per source and travels with the join;
whatever depends on the event alone needs no join at all. The grain never changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outpulse.clock import Clock
from outpulse.operators.joins import lookup_join

# How many days each update cadence stands for, and how many cadences make a source stale or abandoned.
CADENCE_DAYS = {"daily": 1, "weekly": 7, "seasonal": 90}
DEFAULT_CADENCE_DAYS = 7
FRESH_CADENCES = 2
STALE_CADENCES = 8

# How hard a channel's events are to come across by chance.
DISCOVERY_SCORES = {"instagram": 100, "meetup": 80, "website": 50, "api": 30}
DEFAULT_DISCOVERY_SCORE = 40

# The broader family of each category.
FAMILIES = {
    "active": "active",
    "outdoors": "active",
    "volunteer": "community",
    "social": "social_learning",
    "culture": "creative",
}
DEFAULT_FAMILY = "other"


def pick(value: Column, table: dict, default) -> Column:
    """``table[value]``, or ``default`` for a NULL or unlisted value."""
    result: Column | None = None
    for key, mapped in table.items():
        result = F.when(value == key, F.lit(mapped)) if result is None else result.when(value == key, F.lit(mapped))
    return result.otherwise(F.lit(default))


def cadence_days() -> Column:
    return pick(F.col("update_cadence"), CADENCE_DAYS, DEFAULT_CADENCE_DAYS)


def days_since_checked(clock: Clock) -> Column:
    return F.datediff(clock.today_local(), F.col("source_last_checked"))


def freshness(clock: Clock) -> Column:
    """How far a source is past its own cadence; a source that was never checked counts as abandoned."""
    age, cadence = days_since_checked(clock), cadence_days()
    return (
        F.when(age <= cadence * FRESH_CADENCES, "fresh")
        .when(age <= cadence * STALE_CADENCES, "stale")
        .otherwise("abandoned")
    )


def source_profile(sources: DataFrame, clock: Clock) -> DataFrame:
    """Narrow per-source attributes that the events need."""
    return sources.select(
        "source_id",
        "source_name",
        "channel_type",
        "update_cadence",
        "source_last_checked",
        "is_active",
        F.lower(F.coalesce("source_notes", F.lit(""))).contains("beginner").alias("_source_for_beginners"),
        cadence_days().alias("cadence_days"),
        days_since_checked(clock).alias("days_since_checked"),
        freshness(clock).alias("_freshness"),
        pick(F.col("channel_type"), DISCOVERY_SCORES, DEFAULT_DISCOVERY_SCORE).alias("_discovery"),
    )


def with_source(events: DataFrame, sources: DataFrame, clock: Clock) -> DataFrame:
    """Events with their source's attributes; an event without a source gets what an unknown source gets."""
    joined = lookup_join(events, source_profile(sources, clock), "source_id", spread_by="event_id")
    return joined.withColumns(
        {
            "cadence_days": F.coalesce("cadence_days", F.lit(DEFAULT_CADENCE_DAYS)),
            "freshness_status": F.coalesce("_freshness", F.lit("abandoned")),
            "discovery_score": F.coalesce("_discovery", F.lit(DEFAULT_DISCOVERY_SCORE)),
            "_source_for_beginners": F.coalesce("_source_for_beginners", F.lit(False)),
        }
    ).drop("_freshness", "_discovery")


def points(condition: Column, amount: int) -> Column:
    """``amount`` when the condition holds; an unknown condition earns nothing."""
    return F.when(condition, F.lit(amount)).otherwise(F.lit(0))


def score_0_100(total: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def with_audience_fit(events: DataFrame) -> DataFrame:
    """Audience scores from the solo flag and the tags. With neither known, scores and summaries stay NULL."""
    tags, solo = F.col("vibe_tags"), F.col("solo_friendly")
    # LIKE on purpose: its underscore stands for any character, so "solo-focus" counts as well.
    flags = {
        "_solo_tag": tags.like("%solo_focus%"),
        "_social_tag": tags.like("%social%"),
        "_chill_tag": tags.like("%chill%"),
        "_creative_tag": tags.like("%creative%"),
        "_energetic_tag": tags.like("%energetic%"),
        "audience_data_available": solo.isNotNull() | tags.isNotNull(),
    }
    flagged = events.withColumns(flags)
    known = F.col("audience_data_available")
    has = {name: F.col(f"_{name}_tag") for name in ("solo", "social", "chill", "creative", "energetic")}
    category = F.col("activity_category")

    solo_private = (
        points(solo, 50) + points(has["solo"], 30) + points(has["chill"], 20) - points(has["social"], 20)
    )
    solo_social = points(solo, 50) + points(has["social"], 40) + points(has["energetic"], 10)
    couple = F.lit(60) + points(has["chill"] | has["creative"], 20) + points(~solo, 10)
    small_group = F.lit(50) + points(~solo, 30) + points(category.isin("active", "outdoors"), 20)
    scored = flagged.withColumns(
        {
            "solo_private_score": F.when(known, score_0_100(solo_private)),
            "solo_social_score": F.when(known, score_0_100(solo_social)),
            "couple_score": F.when(known, score_0_100(couple)),
            "small_group_score": F.when(known, score_0_100(small_group)),
        }
    )

    # The best score names the group; earlier entries win ties.
    ranking = ["solo_private", "solo_social", "couple", "small_group"]
    best = F.greatest(*[F.col(f"{name}_score") for name in ranking])
    suitability = F.coalesce(*[F.when(F.col(f"{name}_score") == best, name) for name in ranking])
    structure = (
        F.when(~known, None)
        .when(~solo, "group_required")
        .when(has["solo"], "solo_friendly")
        .when(has["social"], "solo_or_social")
        .otherwise("solo_or_group")
    )
    badge = (
        F.when((category == "active") & has["social"], "social")
        .when((category == "outdoors") & has["chill"], "chill")
        .when((category == "culture") & has["creative"], "creative")
        .when(has["social"], "social")
        .when(has["chill"], "chill")
    )
    return scored.withColumns(
        {
            "group_suitability": F.when(known, suitability),
            "social_structure": structure,
            "secondary_badge": badge,
            "activity_family": pick(category, FAMILIES, DEFAULT_FAMILY),
        }
    ).drop(*[name for name in flags if name.startswith("_")])


def with_discoverability(events: DataFrame) -> DataFrame:
    """Needs the source attributes of ``with_source``."""
    description = F.lower(F.coalesce("event_description", F.lit("")))
    beginner = (
        F.col("_source_for_beginners")
        | F.lower("event_name").contains("beginner")
        | description.contains("beginner")
        | description.contains("all levels")
        | description.contains("no experience")
    )
    url = F.col("event_source_url")
    freshness_points = pick(F.col("freshness_status"), {"fresh": 100, "stale": 50}, 0)
    return events.withColumns(
        {
            "beginner_friendly": beginner,
            "actionability_score": (freshness_points + points(url.isNotNull() & (url != ""), 100)) / F.lit(2.0),
        }
    ).drop("_source_for_beginners")


def with_borough(events: DataFrame, zips: DataFrame) -> DataFrame:
    """ZIP codes are few in any city, yet the size is checked; events without a ZIP are spread, not piled up."""
    return lookup_join(events, zips.select("zip_code", "borough"), "zip_code", spread_by="event_id")


ENRICHED_COLUMNS = [
    "event_id",
    "event_name",
    "source_id",
    "source_name",
    "channel_type",
    "is_active",
    "activity_category",
    "activity_family",
    "secondary_badge",
    "start_at",
    "end_at",
    "price_amount",
    "location",
    "solo_friendly",
    "event_source_url",
    "image_url",
    "zip_code",
    "borough",
    "vibe_tags",
    "freshness_status",
    "beginner_friendly",
    "discovery_score",
    "actionability_score",
    "solo_private_score",
    "solo_social_score",
    "couple_score",
    "small_group_score",
    "audience_data_available",
    "is_cancelled",
    "is_virtual",
    "event_description",
    "lat",
    "lon",
    "update_cadence",
    "source_last_checked",
    "group_suitability",
    "social_structure",
]


def enrich(events: DataFrame, sources: DataFrame, zips: DataFrame, clock: Clock) -> DataFrame:
    sourced = with_source(events, sources, clock)
    located = with_borough(sourced, zips)
    return with_discoverability(with_audience_fit(located)).select(*ENRICHED_COLUMNS)
