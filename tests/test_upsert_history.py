import random

import pytest
from helpers import at, day, feed_row
from pyspark.sql import functions as F

from outpulse.operators import history, upsert
from outpulse.plans import reliability, staging

KEY = ["source_record_id"]


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("limit", [0, 1000])
def test_upsert_twice(feed_frame, no_feed, limit):
    batch = feed_frame(feed_row("1", "2026-07-20 10:00:00"))
    first = upsert.upsert(no_feed, batch, KEY, max_broadcast_rows=limit)
    assert tuple(upsert.upsert_counts(first).first()) == (1, 0)
    second = upsert.upsert(first.drop(upsert.STATUS), batch, KEY, max_broadcast_rows=limit)
    assert tuple(upsert.upsert_counts(second).first()) == (0, 1) and second.count() == 1
    assert rows_of(second.drop(upsert.STATUS)) == rows_of(batch)


@pytest.mark.parametrize("limit", [0, 1000])
def test_upsert_updates_only_given_columns_and_keeps_the_rest(spark, limit):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, t string")
    batch = spark.createDataFrame([("a", None, 7.0), ("c", 3, 8.0), ("c", 4, 9.0)], "k string, n int, extra double")
    result = upsert.upsert(table, batch, ["k"], ["extra"], max_broadcast_rows=limit)
    got = {r["k"]: (r["n"], r["t"], r["extra"], r["_status"]) for r in result.collect()}
    assert got == {
        "a": (None, "x", 7.0, "updated"),
        "b": (2, "y", None, "kept"),
        "c": (4, None, 9.0, "inserted"),
    }


def random_batches(seed, days=8, keys=12):
    rng = random.Random(seed)
    batches = []
    for d in range(days):
        rows = []
        for k in range(keys):
            if rng.random() < 0.7:
                title = rng.choice(["CANCELED: ", "", ""]) + f"Class {k}"
                rows.append(
                    feed_row(
                        str(k),
                        f"2026-07-{d + 1:02d} 23:00:00",
                        title=title,
                        location=rng.choice([None, "Field", ""]),
                        startdate=day(rng.choice(["2026-08-01", "2026-08-02"])),
                    )
                )
        batches.append(rows)
    return batches


@pytest.mark.parametrize("seed, limit", [(1, 0), (2, 1000)])
def test_day_by_day_history_equals_one_pass(spark, feed_frame, seed, limit):
    batches = random_batches(seed, days=5)
    stepped = spark.createDataFrame([], history.HISTORY_SCHEMA)
    for rows in batches:
        stepped = history.snapshot_history(stepped, feed_frame(*rows), max_broadcast_rows=limit)
        stepped = spark.createDataFrame(stepped.collect(), history.HISTORY_SCHEMA)
    one_pass = history.history_from_batches(feed_frame(*sum(batches, [])))
    assert rows_of(stepped) == rows_of(one_pass)


@pytest.mark.parametrize("cut", [0, 3, 7])
def test_any_split_into_batches_gives_the_same_history(spark, feed_frame, cut):
    batches = random_batches(7)
    head, tail = sum(batches[:cut], []), sum(batches[cut:], [])
    before = history.history_from_batches(feed_frame(*head)) if head else spark.createDataFrame([], history.HISTORY_SCHEMA)
    before = spark.createDataFrame(before.collect(), history.HISTORY_SCHEMA)
    after = before.filter("valid_to is not null").unionByName(
        history.snapshot_batches(before.filter("valid_to is null"), feed_frame(*tail))
    )
    assert rows_of(after) == rows_of(history.history_from_batches(feed_frame(*head, *tail)))


def test_history_invariants(feed_frame):
    versions = history.history_from_batches(feed_frame(*sum(random_batches(3), []))).cache()
    per_key = versions.groupBy("source_record_id").agg(F.count_if(F.col("valid_to").isNull()).alias("open"))
    assert {r["open"] for r in per_key.collect()} == {1}
    a, b = versions.alias("a"), versions.alias("b")
    overlap = a.join(b, F.col("a.source_record_id") == F.col("b.source_record_id")).filter(
        "a.valid_from < b.valid_from and coalesce(a.valid_to, timestamp_ntz'9999-01-01 00:00:00') > b.valid_from"
    )
    assert overlap.count() == 0
    assert versions.select("version_id").distinct().count() == versions.count()


def test_repeated_and_late_batches_change_nothing(spark, feed_frame):
    first = [feed_row("1", "2026-07-02 23:00:00"), feed_row("2", "2026-07-02 23:00:00", location=None)]
    versions = history.history_from_batches(feed_frame(*first)).cache()
    assert rows_of(history.snapshot_history(versions, feed_frame(*first))) == rows_of(versions)
    assert rows_of(history.snapshot_batches(versions, feed_frame(*first))) == rows_of(versions)
    late = feed_frame(feed_row("1", "2026-07-01 23:00:00", title="Older"))
    assert rows_of(history.snapshot_batches(versions, late)) == rows_of(versions)


def test_absent_keys_stay_open(feed_frame):
    versions = history.history_from_batches(feed_frame(feed_row("1", "2026-07-01 23:00:00")))
    after = history.snapshot_history(versions, feed_frame(feed_row("2", "2026-07-02 23:00:00")))
    assert after.filter("valid_to is null").count() == 2


def test_observations_are_idempotent_and_drop_late_batches(feed_frame):
    day1 = feed_frame(feed_row("1", "2026-07-01 23:00:00"))
    day2 = feed_frame(feed_row("1", "2026-07-02 23:00:00", title="CANCELLED 1"), feed_row("2", "2026-07-02 23:00:00"))
    once = history.record_observations(history.observe(day1), day2).cache()
    assert once.count() == 3
    assert rows_of(history.record_observations(once, day2)) == rows_of(once)
    assert rows_of(history.record_observations(once, day1)) == rows_of(once)
    row = once.filter("was_cancelled_on_that_date").first()
    assert row["days_ahead_of_event"] == 23 and row["event_id"] == "parks-1"


def lifecycle_of(feed_frame, *rows, **options):
    versions = history.history_from_batches(feed_frame(*rows))
    state = upsert.last_per_key(feed_frame(*rows), KEY, ["ingested_at"])
    return reliability.event_lifecycle(versions, staging.stage_feed(state), **options)


def test_observed_cancellation_has_lead_time(feed_frame):
    rows = [feed_row("1", "2026-07-20 10:00:00"), feed_row("1", "2026-07-24 10:30:00", title="CANCELED: 1")]
    row = lifecycle_of(feed_frame, *rows).first()
    # Seen at 06:30 local time, due at 18:30 the next day.
    assert row["cancellation_observed"] is True and row["cancellation_lead_hours"] == 36.0
    assert lifecycle_of(feed_frame, *rows, compat_utc_skew=True).first()["cancellation_lead_hours"] == 32.0


def test_cancelled_before_first_capture_has_none(feed_frame):
    row = lifecycle_of(feed_frame, feed_row("1", "2026-07-20 10:00:00", title="CANCELED: 1")).first()
    assert row["cancellation_observed"] is False and row["cancellation_lead_hours"] is None
    assert row["was_cancelled_at_first_capture"] is True


def test_moves_and_unknowns(feed_frame):
    rows = [
        feed_row("1", "2026-07-20 10:00:00", location=None),
        feed_row("1", "2026-07-21 10:00:00", location="Field"),
        feed_row("1", "2026-07-22 10:00:00", location="Field", starttime=None),
    ]
    row = lifecycle_of(feed_frame, *rows).first()
    assert row["was_relocated"] is False and row["was_rescheduled"] is True and row["version_count"] == 3


def test_reliability_of_a_feed_without_history(spark, no_feed):
    lifecycle = reliability.event_lifecycle(spark.createDataFrame([], history.HISTORY_SCHEMA), staging.stage_feed(no_feed))
    row = reliability.source_reliability(lifecycle, history.observe(no_feed), staging.feed_source(no_feed)).first()
    assert row["events_tracked"] == 0 and row["observed_cancellation_rate_pct"] is None
    assert row["median_cancellation_lead_hours"] is None


def test_reliability_median_and_rates(spark):
    lifecycle = spark.createDataFrame(
        [
            ("a", True, False, False, False, 2, 1.0), ("b", True, False, True, False, 3, 4.0),
            ("c", False, False, False, True, 1, None), ("d", False, True, False, False, 1, None),
        ],
        "event_id string, cancellation_observed boolean, was_cancelled_at_first_capture boolean,"
        "was_rescheduled boolean, was_relocated boolean, version_count bigint, cancellation_lead_hours double",
    )
    seen = spark.createDataFrame([("a", day("2026-07-01")), ("a", day("2026-07-04"))], "event_id string, observed_on date")
    feeds = spark.createDataFrame([("parks-feed", "Feed")], "source_id string, source_name string")
    row = reliability.source_reliability(lifecycle, seen, feeds).first()
    assert row["median_cancellation_lead_hours"] == 2.5 and row["observed_cancellation_rate_pct"] == 66.67
    assert row["reschedule_rate_pct"] == 25.0 and row["avg_versions_per_event"] == 1.75
    assert row["observation_window_days"] == 3 and row["distinct_observation_days"] == 2
