"""What the recorded history says about events and about their publisher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outpulse.clock import to_local
from outpulse.functions.text import is_cancelled_title
from outpulse.operators.history import KEY
from outpulse.operators.selection import exact_median
from outpulse.plans.staging import DEFAULT_FEED, FeedProfile


def _varies(value: Column) -> Column:
    """More than one distinct known value. Minimum against maximum needs no distinct count, hence no second shuffle."""
    return F.coalesce(F.min(value) < F.max(value), F.lit(False))


def event_lifecycle(
    versions: DataFrame, staged: DataFrame, profile: FeedProfile = DEFAULT_FEED, compat_utc_skew: bool = False
) -> DataFrame:
    """One row per event that has an open version, from one aggregation over its versions.

    The lead time of a cancellation exists only where the change from live to cancelled was observed. Start times are
    local and capture times UTC; ``compat_utc_skew`` subtracts them as they are, without converting.
    """
    cancelled = is_cancelled_title(F.col("title"))
    is_open = F.col("valid_to").isNull()
    schedule = F.concat(F.col("startdate").cast("string"), F.lit("@"), F.coalesce("starttime", F.lit("?")))
    per_event = (
        versions.withColumn("_cancelled", cancelled)
        .groupBy(KEY)
        .agg(
            F.max(F.when(is_open, F.col("title"))).alias("current_title"),
            F.max(F.when(is_open, F.col("_cancelled"))).alias("is_cancelled_now"),
            F.count_if(is_open).alias("_open"),
            F.min("valid_from").alias("first_captured_at"),
            F.min_by("_cancelled", "valid_from").alias("was_cancelled_at_first_capture"),
            F.count(F.lit(1)).alias("version_count"),
            F.min(F.when(F.col("_cancelled"), F.col("valid_from"))).alias("cancelled_first_seen_at"),
            _varies(schedule).alias("was_rescheduled"),
            _varies(F.col("location")).alias("was_relocated"),
        )
        .filter("_open > 0")
        .withColumn("event_id", F.concat(F.lit(profile.id_prefix), KEY))
    )
    scheduled = staged.select(
        "event_id",
        F.col("start_at").alias("scheduled_start_at"),
        "activity_category",
        F.col("event_last_checked").alias("last_seen_in_feed_on"),
    )
    seen_at = F.col("cancelled_first_seen_at")
    if not compat_utc_skew:
        seen_at = to_local(seen_at)
    observed = F.col("is_cancelled_now") & ~F.col("was_cancelled_at_first_capture")
    hours = F.timestamp_diff("MICROSECOND", seen_at, F.col("scheduled_start_at")).cast("decimal(20,0)") / 3_600_000_000
    # Both sides hold an event once, so the join has no hot key.
    return per_event.join(scheduled, "event_id", "left").select(
        KEY,
        "current_title",
        "activity_category",
        "scheduled_start_at",
        "first_captured_at",
        "last_seen_in_feed_on",
        "version_count",
        "is_cancelled_now",
        "was_cancelled_at_first_capture",
        "cancelled_first_seen_at",
        "event_id",
        "was_rescheduled",
        "was_relocated",
        observed.alias("cancellation_observed"),
        F.when(observed, F.round(hours, 1).cast("double")).alias("cancellation_lead_hours"),
    )


def percent(part: Column, whole: Column) -> Column:
    """Percentage with two decimals; NULL, not zero, when there is nothing to divide by."""
    ratio = part.cast("decimal(20,0)") * 100 / whole.cast("decimal(20,0)")
    return F.when(whole > 0, F.round(ratio, 2).cast("double"))


def source_reliability(
    lifecycle: DataFrame, observations: DataFrame, feeds: DataFrame, profile: FeedProfile = DEFAULT_FEED
) -> DataFrame:
    """One row per machine feed in ``feeds`` (``source_id, source_name``), also for a feed without any history.

    Both inputs are reduced to one row per feed before they meet, on the feed's id. Inputs without a ``source_id``
    belong to ``profile``. The median is exact, and looked for in a range of lead times (``selection``).
    """

    def labelled(df: DataFrame) -> DataFrame:
        return df if "source_id" in df.columns else df.withColumn("source_id", F.lit(profile.source_id))

    observed = (
        labelled(observations)
        .groupBy("source_id")
        .agg(
            F.min("observed_on").alias("first_observed_on"),
            F.max("observed_on").alias("last_observed_on"),
            F.count_distinct("observed_on").alias("_days"),
        )
    )
    events = (
        labelled(lifecycle)
        .groupBy("source_id")
        .agg(
            F.count(F.lit(1)).alias("_tracked"),
            F.count_if("cancellation_observed").alias("_cancelled"),
            F.count_if("was_cancelled_at_first_capture").alias("_before"),
            F.count_if(~F.col("was_cancelled_at_first_capture")).alias("_observable"),
            F.count_if("was_rescheduled").alias("_rescheduled"),
            F.count_if("was_relocated").alias("_relocated"),
            F.sum("version_count").alias("_versions"),
            F.min("cancellation_lead_hours").alias("min_cancellation_lead_hours"),
        )
    )
    counts = {
        "events_tracked": "_tracked",
        "events_with_observed_lifecycle": "_observable",
        "cancelled_before_tracking": "_before",
        "cancellations_observed": "_cancelled",
        "reschedules_observed": "_rescheduled",
        "relocations_observed": "_relocated",
    }
    median = exact_median(labelled(lifecycle), "source_id", "cancellation_lead_hours")
    median = median.withColumnRenamed("median", "median_cancellation_lead_hours")
    joined = feeds.select("source_id", "source_name")
    for part in (events, observed, median):
        joined = joined.join(part, "source_id", "left")
    average = F.col("_versions").cast("decimal(20,0)") / F.col("_tracked").cast("decimal(20,0)")
    return joined.select(
        "source_id",
        "source_name",
        "first_observed_on",
        "last_observed_on",
        F.coalesce("_days", F.lit(0)).cast("bigint").alias("distinct_observation_days"),
        *[F.coalesce(short, F.lit(0)).cast("bigint").alias(name) for name, short in counts.items()],
        "median_cancellation_lead_hours",
        "min_cancellation_lead_hours",
        F.round(average, 2).cast("double").alias("avg_versions_per_event"),
        F.datediff("last_observed_on", "first_observed_on").alias("observation_window_days"),
        percent(F.col("_cancelled"), F.col("_observable")).alias("observed_cancellation_rate_pct"),
        percent(F.col("_rescheduled"), F.col("_tracked")).alias("reschedule_rate_pct"),
    )
