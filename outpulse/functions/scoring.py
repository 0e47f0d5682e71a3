"""The three components of a score and their blend. Each is a plain function of visible columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outpulse.functions.rounding import round_tenth

# Fixed values of the scoring model.
MAX_PROXIMITY_MILES = 8.0
UNKNOWN_LOCATION_PROXIMITY = 0.5
WEIGHT_CONFIDENCE = 0.25
WEIGHT_PROXIMITY = 0.35
WEIGHT_VIBE = 0.4
CHANNEL_TRUST = {"website": 1.0, "api": 1.0, "meetup": 0.85, "instagram": 0.6}
DEFAULT_CHANNEL_TRUST = 0.5
# The cadence table of the score. Its default differs from the one of the freshness status.
CADENCE_DAYS = {"daily": 1, "weekly": 7, "seasonal": 90}
DEFAULT_CADENCE_DAYS = 30
STALE_CADENCES = 3
HIGH_CONFIDENCE = 0.75
MEDIUM_CONFIDENCE = 0.45


def _lookup(value: Column, table: dict, default) -> Column:
    result: Column | None = None
    for key, mapped in table.items():
        condition = F.lower(value) == key
        result = F.when(condition, F.lit(mapped)) if result is None else result.when(condition, F.lit(mapped))
    return result.otherwise(F.lit(default))


def unit(value: Column) -> Column:
    """Clamped to 0..1; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def confidence(channel: Column, cadence: Column, days_since_checked: Column) -> Column:
    """Half the channel's trust, half how far the source is from being stale; NULL when it was never checked."""
    ceiling = _lookup(cadence, CADENCE_DAYS, DEFAULT_CADENCE_DAYS) * STALE_CADENCES
    freshness = unit(F.lit(1.0) - days_since_checked.cast("double") / ceiling)
    return F.lit(0.5) * _lookup(channel, CHANNEL_TRUST, DEFAULT_CHANNEL_TRUST) + F.lit(0.5) * freshness


def confidence_label(score: Column) -> Column:
    return F.when(score >= HIGH_CONFIDENCE, "High").when(score >= MEDIUM_CONFIDENCE, "Medium").otherwise("Low")


def proximity(distance_miles: Column, origin_known: Column) -> Column:
    """Falls to zero at the radius. An event without a place is neither rewarded nor punished; no origin, no score."""
    near = unit(F.lit(1.0) - distance_miles / MAX_PROXIMITY_MILES)
    return F.when(origin_known, F.coalesce(near, F.lit(UNKNOWN_LOCATION_PROXIMITY)))


def vibe_match(tags: Column, vibe: Column) -> Column:
    """One for an exact tag, else zero; NULL when no vibe was asked for."""
    return F.when(vibe.isNotNull(), F.array_contains(tags, vibe).cast("double"))


def known_weight(confidence_part: Column, proximity_part: Column, vibe_part: Column) -> Column:
    """The sum of the weights of the known components; one when nothing is known."""
    total = F.lit(0.0)
    for part, weight in (
        (confidence_part, WEIGHT_CONFIDENCE),
        (proximity_part, WEIGHT_PROXIMITY),
        (vibe_part, WEIGHT_VIBE),
    ):
        total = total + F.when(part.isNotNull(), F.lit(weight)).otherwise(F.lit(0.0))
    return F.when(total > 0, total).otherwise(F.lit(1.0))


def weighted_percent(confidence_part: Column, proximity_part: Column, vibe_part: Column, weight: Column) -> Column:
    """The weighted mean of the known components in 0..100, given the weight that they share."""
    total = F.lit(0.0)
    for part, share in (
        (confidence_part, WEIGHT_CONFIDENCE),
        (proximity_part, WEIGHT_PROXIMITY),
        (vibe_part, WEIGHT_VIBE),
    ):
        total = total + F.coalesce(part * (F.lit(share) / weight), F.lit(0.0))
    return total * 100


def percent_tenth(part: Column) -> Column:
    return round_tenth(part * 100)
