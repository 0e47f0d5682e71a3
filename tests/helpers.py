"""Rows that tests build their tables from. Kept apart from conftest.py, which each test folder has its own of."""

import datetime as dt
from decimal import Decimal

from outpulse import schemas


def day(text):
    return dt.date.fromisoformat(text) if text else None


def at(text):
    return dt.datetime.fromisoformat(text) if text else None


SOURCES = [
    # A source per freshness rule: source, name, category, channel, cadence, last checked, notes, active
    ("kites", "Kite Makers", "learn", "api", "daily", "2026-07-18", "Bring string", True),  # fresh for the last day
    ("chorus", "River Chorus", "culture", "meetup", "weekly", "2026-07-04", "Singing for every beginner", True),  # stale
    ("dunes", "Dune Walks", "outdoors", "instagram", "seasonal", "2026-03-02", None, True),  # fresh by its long cadence
    ("supper", "Supper Club", "food_drink", "website", "weekly", "2026-05-25", "Shared tables", True),  # stale for the last day
    ("ember", "Ember Theatre", "culture", "website", "weekly", "2026-05-24", None, True),  # abandoned since today
    ("lapsed", "Lapsed Gym", "active", "website", "daily", "2026-07-20", None, False),  # fresh, but not active
]

EVENTS = [
    # An event per branch: event, source, title, category, start, end, cost, zip, lat, lon, tags, has url
    ("v01", "kites", "Kite workshop", "learn", "2026-07-24T15:00", "2026-07-24T17:00", 12, "10025", 40.801, -73.972, "creative|chill", 1),
    ("v02", "chorus", "Evening chorus", "culture", "2026-07-21T19:30", "2026-07-21T21:00", 0, "11215", 40.66, -73.969, "social|creative", 1),
    ("v03", "dunes", "Dawn walk", "outdoors", "2026-07-22T06:00", "2026-07-22T08:30", 0, "11999", 40.58, -73.83, "chill|solo_focus", 1),
    ("v04", "supper", "Long table for beginners", "food_drink", "2026-07-25T20:00", "2026-07-25T23:00", 35, "11377", 40.746, -73.9, "social", 1),
    ("v05", "dunes", "Ends right now", "outdoors", "2026-07-20T10:30", "2026-07-20T12:00", 4, "10463", 40.889, -73.899, "energetic", 1),
    ("v06", "kites", "Price on request", "learn", "2026-07-26T11:00", "2026-07-26T12:00", None, "10025", 40.801, -73.972, "chill", 1),
    ("v07", "chorus", "Over a minute ago", "culture", "2026-07-20T09:15", "2026-07-20T11:59", 6, "11215", 40.66, -73.969, "social", 1),
    ("v08", "supper", "Brunch without a link", "food_drink", "2026-07-26T10:00", "2026-07-26T12:00", 8, "11377", 40.746, -73.9, "social", 0),
    ("v09", "lapsed", "Class of a closed gym", "active", "2026-07-23T07:00", "2026-07-23T08:00", 18, "10463", 40.88, -73.906, "energetic", 1),
    ("v10", "ember", "Play nobody verified", "culture", "2026-07-21T22:00", "2026-07-21T23:30", 20, "10025", 40.799, -73.968, "creative", 1),
]

BROKEN = [
    # Events that only a gate rule keeps out; such rows fail the quality report as well.
    ("w01", "kites", "No start", "learn", None, "2026-07-24T17:00", 1, "10025", 40.8, -73.97, None, 1),
    ("w02", "kites", "No category", None, "2026-07-24T15:00", None, 1, "10025", 40.8, -73.97, None, 1),
    ("w03", "kites", None, "learn", "2026-07-24T15:00", None, 1, "10025", 40.8, -73.97, None, 1),
    ("w04", "kites", "Pays its guests", "learn", "2026-07-24T15:00", None, -3, "10025", 40.8, -73.97, None, 1),
    ("w05", "nobody", "Of an unlisted source", "learn", "2026-07-24T15:00", None, 1, "10025", 40.8, -73.97, None, 1),
]

ZIPS = [
    ("10025", 40.799, -73.968, "Manhattan"),
    ("10463", 40.88, -73.906, "Bronx"),
    ("11215", 40.665, -73.975, "Brooklyn"),
    ("11377", 40.745, -73.905, "Queens"),
]


def events_frame(spark, events):
    rows = [
        (e, s, t, c, at(a), at(b), None if cost is None else Decimal(cost), "Place", True,
         f"https://x.example.org/{e}" if url else None, day("2026-07-01"), z, lat, lon, tags, None)
        for e, s, t, c, a, b, cost, z, lat, lon, tags, url in events
    ]
    return spark.createDataFrame(rows, schemas.EVENTS)


def feed_row(key, captured, **values):
    base = dict(
        source_record_id=key, title=f"Class {key}", startdate=day("2026-07-25"), enddate=None,
        starttime="2026-07-20 18:30:00", endtime="2026-07-20 20:00:00", location="Field", parknames="Park",
        categories="Fitness", link_url="https://p.example.org", registration_url=None, lat=40.7, lon=-73.9,
        description=None, raw_payload="{}", ingested_at=at(captured),
    )
    return {**base, **values}
