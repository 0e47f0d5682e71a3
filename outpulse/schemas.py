"""Declared schemas of the raw tables. Inference is never used: a ZIP code stays text, an unknown stays NULL."""

from __future__ import annotations

SOURCES = """source_id string, name string, category string, channel_type string, url string, update_cadence string,
 last_checked date, notes string, is_active boolean, image_url string"""

EVENTS = """event_id string, source_id string, title string, category string, start_time timestamp_ntz,
 end_time timestamp_ntz, cost decimal(12,2), location string, solo_friendly boolean, source_url string,
 last_checked date, zip_code string, lat double, lon double, vibe_tags string, image_url string"""

FEED = """source_record_id string, title string, startdate date, enddate date, starttime string, endtime string,
 location string, parknames string, categories string, link_url string, registration_url string, lat double,
 lon double, description string, raw_payload string, ingested_at timestamp_ntz"""

ZIP_CENTROIDS = "zip_code string, lat double, lon double, borough string"

FAVORITES = "device_id string, event_id string, created_at timestamp_ntz"

REQUESTS = """request_id string, category string, max_cost double, solo_friendly boolean, date date, zip_code string,
 mode string, vibe string, hours_free double, intent string, after_time string, device_id string"""

# The natural key of every raw table.
KEYS = {
    "sources": ["source_id"],
    "events": ["event_id"],
    "feed": ["source_record_id"],
    "favorites": ["device_id", "event_id"],
}

REQUIRED_SOURCE_COLUMNS = ["source_id", "name", "category", "channel_type", "url"]
REQUIRED_EVENT_COLUMNS = ["event_id", "source_id", "title", "category", "start_time", "location"]

# The columns whose change makes a new version of a feed record.
HISTORY_CHECKED = [
    "title",
    "startdate",
    "enddate",
    "starttime",
    "endtime",
    "location",
    "parknames",
    "categories",
    "link_url",
    "registration_url",
]
HISTORY_CARRIED = ["lat", "lon", "ingested_at"]
