import json

import pytest
from pyspark.sql import functions as F

from outpulse.clock import Clock
from outpulse.functions.geo import parse_position
from outpulse.operators.validate import ValidationError
from outpulse.plans import refresh
from outpulse.sources import curated, landed, tables

CLOCK = Clock("2026-07-20 16:00:00")

# One value for every field that the reader takes, made up for these tests.
RECORD = {
    "title": "Kite making", "guid": "k-7", "link": {"url": "http://feed.example.net/k-7"}, "description": "Paper is provided",
    "parknames": "Hill Green", "startdate": "2026-08-03T00:00:00.000", "enddate": "2026-08-04T00:00:00.000",
    "starttime": "2026-08-03 15:15:00", "endtime": "2026-08-03 16:45:00", "location": "Shed",
    "categories": "Crafts", "registration_url": {"url": "https://join.example.net/7"}, "coordinates": "40.65, -74.02",
}

SOURCE_HEADER = "source_id,name,category,channel_type,url,update_cadence,last_checked,notes\n"
EVENT_HEADER = "event_id,source_id,title,category,start_time,end_time,cost,location,zip_code,lat\n"


def csv(spark, tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return curated.read_text_table(spark, str(path))


def test_sources_without_flag_are_active(spark, tmp_path):
    raw = csv(spark, tmp_path, SOURCE_HEADER + "s1,One,active,website,https://x,weekly,2026-07-01,\n")
    row = curated.load_sources(raw)[0].first()
    assert row["is_active"] is True and row["notes"] is None and row["image_url"] is None
    assert str(row["last_checked"]) == "2026-07-01"


def test_missing_column_and_value(spark, tmp_path):
    with pytest.raises(ValidationError, match="url"):
        curated.load_sources(csv(spark, tmp_path, "source_id,name,category,channel_type\ns,n,c,w\n"), "s.csv")
    with pytest.raises(ValidationError, match="name.*'s2'"):
        curated.load_sources(csv(spark, tmp_path, SOURCE_HEADER + "s2,,active,website,u,weekly,,\n"))


def test_events_keep_unknowns_and_text_zip(spark, tmp_path):
    raw = csv(spark, tmp_path, EVENT_HEADER + "e1,s1,T,active,2026-07-22T18:30:00,,,Pier,01234,nan\n")
    row = curated.load_events(raw)[0].first()
    assert row["cost"] is None and row["end_time"] is None and row["zip_code"] == "01234" and row["lat"] is None


def test_bad_date_fails_or_is_set_aside(spark, tmp_path):
    text = EVENT_HEADER + "e1,s1,T,active,2026-07-22T18:30:00,,1,Pier,,\ne2,s1,T,active,someday,,1,Pier,,\n"
    raw = csv(spark, tmp_path, text)
    with pytest.raises(ValidationError, match="start_time.*someday.*e2"):
        curated.load_events(raw)
    good, rejects = curated.load_events(raw, policy="quarantine")
    assert [r["event_id"] for r in good.collect()] == ["e1"]
    assert [r["reason"] for r in rejects.collect()] == ["malformed_start_time"]


def parse(spark, *records):
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "raw_payload string")
    return landed.parse_records(df, CLOCK.now_utc())


def test_record_fields(spark):
    row = parse(spark, RECORD)[0].first()
    assert row["source_record_id"] == "k-7" and str(row["startdate"]) == "2026-08-03"
    assert row["link_url"] == "http://feed.example.net/k-7" and row["registration_url"] == "https://join.example.net/7"
    assert row["lat"] == 40.65 and row["lon"] == -74.02
    assert json.loads(row["raw_payload"]) == RECORD and row["ingested_at"] is not None


def test_bare_link_and_missing_position(spark):
    record = {**RECORD, "link": "http://q.example.org"}
    del record["coordinates"], record["registration_url"]
    row = parse(spark, record)[0].first()
    assert row["link_url"] == "http://q.example.org" and row["registration_url"] is None and row["lat"] is None


def test_malformed_records_are_set_aside(spark):
    no_id = {k: v for k, v in RECORD.items() if k != "guid"}
    rows, rejects = parse(spark, RECORD, no_id, {**RECORD, "guid": "9", "startdate": "not-a-date"})
    assert rows.count() == 1
    assert sorted(r["reason"] for r in rejects.collect()) == ["bad_startdate", "missing_id"]


@pytest.mark.parametrize(
    "text, ok",
    [("2026-08-03", 1), ("2026-08-03T10:00:00Z", 1), (" ", None), (None, None), ("2026-02-30", 0), ("2026-07", 0), ("3.8.2026", 0)],
)
def test_dates(spark, text, ok):
    rows, rejects = parse(spark, {**RECORD, "startdate": text})
    assert rejects.count() == (1 if ok == 0 else 0)
    if ok is None:
        assert rows.first()["startdate"] is None


@pytest.mark.parametrize("text", [None, "", "  ", "41", "north, west", "0, 0", "12.5, -74.02", "40.65, 12.5", "40.65, -74.02, 3"])
def test_unusable_positions(spark, text):
    lat, lon = parse_position(F.col("t"))
    row = spark.createDataFrame([(text,)], "t string").select(lat, lon).first()
    assert tuple(row) == (None, None)


def test_pages(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps([RECORD, {**RECORD, "guid": "z-2"}]))
    (tmp_path / "p2.json").write_text(json.dumps([{**RECORD, "guid": "a-1"}], indent=2))
    (tmp_path / "p3.json").write_text(json.dumps({"error": True}))
    (tmp_path / "p4.json").write_text("[]")
    records, bad = landed.read_pages(spark, str(tmp_path))
    rows, rejects = landed.parse_records(landed.first_records(records, 2), CLOCK.now_utc())
    assert sorted(r["source_record_id"] for r in rows.collect()) == ["a-1", "k-7"]
    assert records.count() == 3 and bad.count() == 1 and rejects.count() == 0


def test_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps(RECORD) + "\n" + "not json\n")
    rows, rejects = landed.parse_records(landed.read_lines(spark, str(tmp_path)), CLOCK.now_utc())
    assert rows.count() == 1 and rejects.first()["reason"] == "missing_id"


def test_unreadable_numbers_and_flags(spark, tmp_path):
    text = EVENT_HEADER + "e1,s1,T,active,2026-07-22T18:30:00,,twelve,Pier,,\ne2,s1,T,active,2026-07-22T18:30:00,,1,Pier,,nan\n"
    raw = csv(spark, tmp_path, text)
    with pytest.raises(ValidationError, match="cost.*twelve.*e1") as error:
        curated.load_events(raw)
    assert [tuple(r) for r in error.value.offenders.collect()] == [("value_format", "cost", "e1", "twelve")]
    good, rejects = curated.load_events(raw, policy="quarantine")
    assert [r["event_id"] for r in good.collect()] == ["e2"]
    assert [r["reason"] for r in rejects.collect()] == ["malformed_cost"]


def test_a_flag_that_is_there_has_a_value(spark):
    rows = [("s1", "true"), ("s2", "maybe"), ("s3", None)]
    raw = spark.createDataFrame([(key, "n", "c", "w", "u", flag) for key, flag in rows], "source_id string, name string, category string, channel_type string, url string, is_active string")
    good, rejects = curated.load_sources(raw, policy="quarantine")
    assert [r["source_id"] for r in good.collect()] == ["s1"]
    assert {r["source_id"]: r["reason"] for r in rejects.collect()} == {"s2": "malformed_is_active", "s3": "missing_is_active"}
    with pytest.raises(ValidationError, match="is_active"):
        curated.load_sources(raw)


def test_dates_without_hyphens(spark):
    texts = ["20260719", "2026-07-19", "20261340", "2026071", "x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(landed.iso_date(F.col("t")).cast("string")).collect()
    assert [r[0] for r in got] == ["2026-07-19", "2026-07-19", None, None, None]


def test_a_landed_batch_takes_the_last_arrival(spark, tmp_path):
    pages, root = tmp_path / "pages", str(tmp_path / "run")
    pages.mkdir()
    named = lambda title, **more: {**RECORD, "title": title, **more}
    (pages / "p1.json").write_text(json.dumps([named("z first"), named("b"), named("other", guid="o-1")]))
    (pages / "p2.json").write_text(json.dumps([named("y"), named("a last"), named("no id", guid="")]))
    (pages / "p3.json").write_text("{}")
    feed = refresh.load_landed_batch(spark, root, 0, str(pages), CLOCK.now_utc())
    assert {r["source_record_id"]: r["title"] for r in feed.collect()} == {"k-7": "a last", "o-1": "other"}
    versions = tables.open_versions(spark, root, 0)
    assert {r["source_record_id"]: r["title"] for r in versions.collect()} == {"k-7": "a last", "o-1": "other"}
    assert tables.observations(spark, root).count() == 2
    counts = refresh.landed_counts(spark, root, 0).first().asDict()
    assert counts == {"inserted": 2, "updated": 0, "failed": 1, "bad_pages": 1}
    again = refresh.load_landed_batch(spark, root, 1, str(pages), CLOCK.now_utc())
    assert again.count() == 2 and refresh.landed_counts(spark, root, 1).first()["updated"] == 2
