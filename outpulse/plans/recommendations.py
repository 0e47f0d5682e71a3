"""Recommendations for a table of requests: feasible, ranked, selected, explained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outpulse.clock import Clock
from outpulse.functions import presentation
from outpulse.operators import matching
from outpulse.operators.favorites import flag_favorites
from outpulse.operators.joins import is_small, salted_join

RESULT_COLUMNS = [
    "event_id",
    "title",
    "category",
    "start_time",
    "end_time",
    "cost",
    "location",
    "solo_friendly",
    "source_url",
    "source_name",
    "source_verified_date",
    "distance_miles",
    "confidence_label",
    "confidence_score",
    "score",
    "explanation",
    "image_url",
    "category_label",
    "badges",
    "tags",
    "estimated_transit_minutes",
    "duration_minutes",
    "is_favorited",
]


def serving_view(candidates: DataFrame) -> DataFrame:
    """The mart in the names and types of the serving layer."""
    return candidates.withColumnsRenamed(
        {"event_name": "title", "activity_category": "category", "start_at": "start_time", "end_at": "end_time"}
    ).withColumn("cost", F.col("price_amount").cast("double")).drop("price_amount")


def _if_there(candidates: DataFrame, name: str, kind: str) -> Column:
    """A column that a mart need not have: what was not written is unknown."""
    return F.col(name) if name in candidates.columns else F.lit(None).cast(kind).alias(name)


def _ranked(
    requests: DataFrame, candidates: DataFrame, zips: DataFrame, clock: Clock, reused: bool
) -> tuple[DataFrame, matching.Ranking]:
    wishes = matching.asked(requests, zips)
    ranking = matching.rank(wishes, matching.rankable(candidates, clock))
    return wishes, ranking.settled() if reused else ranking


def score_pools(
    requests: DataFrame, candidates: DataFrame, zips: DataFrame, clock: Clock, reused: bool = False
) -> DataFrame:
    """The pool of every request with all score components. ``reused`` says that the plan will read it repeatedly."""
    return matching.pools(*_ranked(requests, candidates, zips, clock, reused))


def top_results(
    requests: DataFrame,
    candidates: DataFrame,
    zips: DataFrame,
    clock: Clock,
    seed: int = 0,
    reused: bool = False,
) -> DataFrame:
    return matching.chosen_results(*_ranked(requests, candidates, zips, clock, reused), seed)


def explained(
    results: DataFrame, candidates: DataFrame, favorites: DataFrame, clock: Clock
) -> DataFrame:
    """Results with everything that is shown about them.

    Few candidates are ever chosen, so the mart is first cut down to those; an event that a third of the requests get
    is spread over the requests.
    """
    chosen = results.select("event_id").distinct()
    few = is_small(chosen)
    wanted = F.broadcast(chosen) if few else chosen
    details = serving_view(candidates).join(wanted, "event_id", "left_semi").select(
        "event_id",
        "title",
        F.col("category"),
        "start_time",
        "end_time",
        "cost",
        "location",
        "solo_friendly",
        "source_url",
        "source_name",
        F.col("source_last_checked").alias("source_verified_date"),
        "image_url",
        "vibe_tags",
        _if_there(candidates, "beginner_friendly", "boolean"),
        _if_there(candidates, "source_notes", "string"),
        "channel_type",
        "update_cadence",
    )
    asked = results.select(
        "request_id",
        "rank",
        "event_id",
        "mode",
        F.col("category").alias("asked_category"),
        "max_cost",
        F.col("solo_friendly").alias("asked_solo"),
        "date",
        F.col("zip_code").alias("asked_zip"),
        "vibe",
        "hours_free",
        "intent",
        "device_id",
        F.col("total").alias("score"),
        "confidence_score",
        "confidence_label",
        "vibe_score",
        "distance_miles",
    )
    flagged = flag_favorites(asked, favorites)
    if few:
        # There is one row of details per chosen event.
        rows = flagged.join(F.broadcast(details), "event_id")
    else:
        rows = salted_join(flagged, details, ["event_id"], spread_by="request_id", how="inner")
    days = F.datediff(clock.today_local(), F.col("source_verified_date"))
    return (
        rows.withColumn(
            "confidence_reason",
            presentation.confidence_reason(F.col("channel_type"), F.col("update_cadence"), days),
        )
        .withColumns(
            {
                "explanation": presentation.explanation(),
                "category_label": presentation.category_label(F.col("category")),
                "badges": presentation.badges(),
                "tags": presentation.tags(F.col("source_notes")),
                "estimated_transit_minutes": presentation.transit_minutes(F.col("distance_miles")),
                "duration_minutes": presentation.duration_minutes(F.col("start_time"), F.col("end_time")),
            }
        )
        .select("request_id", "rank", *RESULT_COLUMNS)
    )


def recommend(
    requests: DataFrame,
    candidates: DataFrame,
    zips: DataFrame,
    favorites: DataFrame,
    clock: Clock,
    seed: int = 0,
) -> DataFrame:
    return explained(top_results(requests, candidates, zips, clock, seed, reused=True), candidates, favorites, clock)
