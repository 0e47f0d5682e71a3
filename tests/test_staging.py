import datetime as dt

import pytest
from helpers import EVENTS, at, day, feed_row
from pyspark.sql import functions as F

from outpulse.functions.text import category_label, feed_category, is_cancelled_title, plain_number, tag_set
from outpulse.plans import staging


def staged(feed_frame, **values):
    return staging.stage_feed(feed_frame(feed_row("1", "2026-07-20 10:00:00", **values))).first()


def test_time_of_day_is_put_on_the_event_date(feed_frame):
    row = staged(feed_frame)
    assert row["start_at"] == at("2026-07-25 18:30:00") and row["end_at"] == at("2026-07-25 20:00:00")
    assert row["event_id"] == "parks-1" and row["event_last_checked"] == day("2026-07-20")


def test_missing_times(feed_frame):
    row = staged(feed_frame, starttime="TBD", endtime=None)
    assert row["start_at"] == at("2026-07-25 00:00:00") and row["end_at"] is None


def test_impossible_end_is_unknown_and_end_date_is_used(feed_frame):
    assert staged(feed_frame, endtime="2026-07-20 18:30:00")["end_at"] is None
    row = staged(feed_frame, endtime="2026-07-20 02:00:00", enddate=day("2026-07-26"))
    assert row["end_at"] == at("2026-07-26 02:00:00")


def test_a_time_that_is_none_counts_as_bad(feed_frame):
    feed = feed_frame(feed_row("1", "2026-07-20 10:00:00", starttime="2026-07-20 99:99:99"))
    assert staging.stage_feed(feed).first()["start_at"] == at("2026-07-25 00:00:00")
    assert staging.bad_times(feed).first()["bad_starttime"] == 1


def test_blank_location_and_link(feed_frame):
    row = staged(feed_frame, location="", registration_url="")
    assert row["location"] == "Park" and row["event_source_url"] == "https://p.example.org"
    assert staged(feed_frame, location="", parknames="")["location"] == ""


def test_an_empty_feed_still_is_a_source(no_feed):
    rows = staging.feed_source(no_feed).collect()
    assert len(rows) == 1 and rows[0]["source_last_checked"] is None


@pytest.mark.parametrize(
    "text, category",
    [
        ("Fitness | Volunteer | Gardening", "volunteer"),
        ("Food | Nature", "food_drink"),
        ("Fitness | Birding", "outdoors"),
        ("Tournament", "learn"),
        ("Games | Art", "social"),
        ("Block Party", "culture"),
        ("outdoor fitness", "active"),
        ("Seniors", None),
        (None, None),
    ],
)
def test_category_priority(spark, text, category):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(feed_category("c")).first()[0] == category


def test_cancelled_prefix(spark):
    df = spark.createDataFrame([("CANCELED: x",), ("Cancelled y",), ("Not canceled",), (None,)], "t string")
    assert [r[0] for r in df.select(is_cancelled_title(F.col("t"))).collect()] == [True, True, False, None]


def test_text_helpers(spark):
    df = spark.createDataFrame([(" Chill | |SOCIAL", 10.0, "food_drink")], "t string, n double, c string")
    assert df.select(tag_set(F.col("t"))).first()[0] == ["chill", "social"]
    numbers = {0.0: "0", 10.0: "10", 10.5: "10.5", 100.0: "100", 0.3: "0.3", 1234.56: "1234.56", 12345.67: "12345.7"}
    rows = spark.createDataFrame([(n,) for n in numbers], "n double").select("n", plain_number(F.col("n")).alias("t"))
    assert {r["n"]: r["t"] for r in rows.collect()} == numbers
    labels = spark.createDataFrame([("food_drink",), ("Active",), ("a_b cd",), ("rock climbing",)], "c string")
    assert [r[0] for r in labels.select(category_label(F.col("c"))).collect()] == [
        "Food & Drink", "Active", "A_B Cd", "Rock Climbing",
    ]


def test_union_has_the_contract(curated, feed_frame):
    events = staging.all_events(curated, feed_frame(feed_row("1", "2026-07-20 10:00:00")))
    assert events.columns == staging.EVENT_COLUMNS and events.count() == len(EVENTS) + 1
    assert isinstance(events.first()["start_at"], dt.datetime)
