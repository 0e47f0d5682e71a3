"""The expectations of every table of the pipeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outpulse.clock import Clock
from outpulse.functions.text import is_cancelled_title
from outpulse.operators.quality import (
    Expectations,
    check_against_feed,
    check_reference,
    check_tables,
    union_reports,
)
from outpulse.plans import staging

# The accepted values of the enum-like columns.
CATEGORIES = ["active", "outdoors", "social", "culture", "food_drink", "learn", "volunteer"]
CURATED_CHANNELS = ["website", "meetup", "instagram"]
FEED_CHANNELS = ["api"]
FRESHNESS = ["fresh", "stale", "abandoned"]
FAMILIES = ["active", "community", "social_learning", "creative", "other"]
STRUCTURES = ["group_required", "solo_friendly", "solo_or_social", "solo_or_group"]
SUITABILITY = ["solo_private", "solo_social", "couple", "small_group"]


@dataclass(frozen=True)
class Tables:
    """The tables of one run: raw inputs, then what the plans made of them."""

    sources: DataFrame
    curated: DataFrame
    feed: DataFrame
    zips: DataFrame
    history: DataFrame
    lifecycle: DataFrame
    observations: DataFrame
    enriched: DataFrame
    candidates: DataFrame
    organizations: DataFrame
    reliability: DataFrame


def candidate_expectations(clock: Clock) -> Expectations:
    url = F.col("source_url")
    return Expectations(
        unique=[["event_id"]],
        not_null=["event_id", "event_name", "start_at", "source_url"],
        accepted={
            "activity_family": FAMILIES,
            "social_structure": STRUCTURES,
            "group_suitability": SUITABILITY,
            "freshness_status": FRESHNESS[:2],
        },
        rules={
            "no_abandoned": F.col("freshness_status") == "abandoned",
            "no_cancelled": is_cancelled_title(F.col("event_name")),
            "no_expired": F.coalesce("end_at", "start_at") < clock.now_local(),
            "no_missing_url": url.isNull() | (url == ""),
        },
    )


def quality_report(tables: Tables, clock: Clock) -> DataFrame:
    staged_sources = staging.stage_sources(tables.sources)
    staged_events = staging.stage_events(tables.curated)
    simple = {
        "sources": (tables.sources, Expectations([["source_id"]], ["source_id", "is_active"])),
        "events": (tables.curated, Expectations([["event_id"]], ["event_id", "source_id"])),
        "feed": (tables.feed, Expectations([["source_record_id"]], ["source_record_id"])),
        "zip_centroids": (tables.zips, Expectations([["zip_code"]], ["zip_code"])),
        "stg_sources": (
            staged_sources,
            Expectations([["source_id"]], ["source_id"], {"channel_type": CURATED_CHANNELS}),
        ),
        "stg_events": (staged_events, Expectations([["event_id"]], ["event_id", "source_id"])),
        "stg_feed": (
            staging.stage_feed(tables.feed),
            Expectations(
                [["event_id"]],
                ["event_id", "source_id", "start_at", "is_cancelled", "is_virtual"],
                {"activity_category": CATEGORIES},
            ),
        ),
        "stg_feed_source": (
            staging.feed_source(tables.feed),
            Expectations([["source_id"]], ["source_id"], {"channel_type": FEED_CHANNELS}),
        ),
        "history": (
            tables.history,
            Expectations([["version_id"]], ["version_id", "source_record_id", "valid_from"]),
        ),
        "lifecycle": (
            tables.lifecycle,
            Expectations(
                [["event_id"], ["source_record_id"]],
                [
                    "event_id",
                    "source_record_id",
                    "first_captured_at",
                    "version_count",
                    "is_cancelled_now",
                    "was_cancelled_at_first_capture",
                    "cancellation_observed",
                ],
            ),
        ),
        "observations": (
            tables.observations,
            Expectations(
                [["event_id", "observed_on"]], ["event_id", "observed_on", "was_cancelled_on_that_date"]
            ),
        ),
        "enriched": (
            tables.enriched,
            Expectations([["event_id"]], ["event_id", "source_id"], {"freshness_status": FRESHNESS}),
        ),
        "candidates": (tables.candidates, candidate_expectations(clock)),
        "organizations": (
            tables.organizations,
            Expectations(
                [["source_id"]],
                ["source_id", "source_name", "upcoming_event_count"],
                {"channel_type": CURATED_CHANNELS + FEED_CHANNELS},
            ),
        ),
        "reliability": (
            tables.reliability,
            Expectations(
                [["source_id"]],
                [
                    "source_id",
                    "observation_window_days",
                    "events_tracked",
                    "events_with_observed_lifecycle",
                    "cancelled_before_tracking",
                    "cancellations_observed",
                ],
            ),
        ),
    }
    reports = [check_tables(simple)]
    reports.append(check_reference(tables.curated, "events", "source_id", tables.sources, "source_id"))
    reports.append(check_against_feed(tables.candidates, "candidates", staged_events, staged_sources))
    return union_reports(reports)
