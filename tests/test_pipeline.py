import duckdb
import pytest
from helpers import day, feed_row
from test_upsert_history import random_batches, rows_of

from __spark_entry__ import entry, oracle_sql, queries
from outpulse.operators import history, joins, matching, quality, upsert
from outpulse.operators.quality import Expectations
from outpulse.operators.validate import ValidationError
from outpulse.plans import recommendations, refresh
from outpulse.plans.refresh import Inputs
from outpulse.registry import QUERIES
from outpulse.sources import tables
from outpulse.streaming import feed_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


# Every query of the library has SQL; of those on training data, some cannot be expressed in it and have tests of their own.
@pytest.mark.parametrize("name", sorted({*QUERIES, *oracle_sql()}))
def test_query_equals_sql(spark, duck, name):
    frame = queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(str(tuple(row)) for row in frame.select(*columns).collect())
    duck.execute(f"select {', '.join(columns)} from ({oracle_sql()[name]}) q")
    assert got == sorted(str(row) for row in duck.fetchall())
    spark.catalog.clearCache()


@pytest.mark.parametrize(
    "name",
    ["candidate_mart", "favorites_flag", "request_explained", "request_feasible", "scd2_incremental", "upsert_final_state"],
)
def test_query_equals_sql_when_nothing_is_small(spark, duck, monkeypatch, name):
    for module in (joins, matching, upsert, history, recommendations):
        monkeypatch.setattr(module, "is_small", lambda df, *limit: False)
    test_query_equals_sql(spark, duck, name)


def test_entry(spark):
    assert entry(spark).count() > 0


def failing(report):
    return {(r["table_name"], r["check_name"], r["column_name"]): r["failing_rows"] for r in report.collect()}


def test_checks_count_failures(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "y"), (None, "z")], "k string, v string")
    expected = Expectations(unique=[["k"], ["v"], ["k", "v"]], not_null=["k", "v"], accepted={"v": ["x", "y"]})
    assert failing(quality.check_table(df, "t", expected)) == {
        ("t", "unique", "k"): 1, ("t", "unique", "v"): 0, ("t", "unique", "k,v"): 0, ("t", "not_null", "k"): 2,
        ("t", "not_null", "v"): 1, ("t", "accepted_values", "v"): 1,
    }
    assert set(failing(quality.check_table(df.limit(0), "t", expected)).values()) == {0}


def test_reference_check_counts_rows(spark):
    child = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "ref string")
    parent = spark.createDataFrame([("a",)], "id string")
    assert list(failing(quality.check_reference(child, "c", "ref", parent, "id")).values()) == [2]


def test_a_whole_refresh_is_clean_and_repeatable(spark, tmp_path, feed_frame, sources, curated, zips, clock):
    root = str(tmp_path)
    # Curated files name no API as a channel; the report would find it.
    inputs = Inputs(sources.replace("api", "website", ["channel_type"]), curated, zips)
    days = [
        feed_frame(feed_row("1", "2026-07-18 12:00:00"), feed_row("2", "2026-07-18 12:00:00")),
        feed_frame(
            feed_row("1", "2026-07-19 12:00:00", title="CANCELED: 1"),
            feed_row("3", "2026-07-19 12:00:00", startdate=day("2026-07-22")),
        ),
    ]
    refresh.load_feed_batch(spark, root, 0, days[0])
    built, report = refresh.refresh(spark, root, 1, days[1], inputs, clock)
    assert {key: n for key, n in failing(report).items() if n} == {}
    assert len(failing(report)) == 75
    assert built.feed.count() == 3 and built.observations.count() == 4
    assert built.history.count() == 4 and built.history.filter("valid_to is null").count() == 3
    found = {r["event_id"] for r in built.candidates.collect()}
    assert {"parks-2", "parks-3", "v01"} <= found and "parks-1" not in found
    before = [rows_of(df) for df in (built.feed, built.history, built.observations, built.candidates)]
    again, _ = refresh.refresh(spark, root, 1, days[1], inputs, clock)
    assert [rows_of(df) for df in (again.feed, again.history, again.observations, again.candidates)] == before
    reliability = again.reliability.first()
    assert reliability["cancellations_observed"] == 1 and reliability["events_tracked"] == 3


def test_a_missing_batch_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.state(spark, str(tmp_path), "feed", 4)


def test_curated_files_are_upserted(spark, tmp_path):
    sources, events, root = (str(tmp_path / name) for name in ("s.csv", "e.csv", "tables"))
    (tmp_path / "s.csv").write_text("source_id,name,category,channel_type,url\ns1,One,active,website,u\n")
    header = "event_id,source_id,title,category,start_time,location,cost\n"
    (tmp_path / "e.csv").write_text(header + "e1,s1,Old,active,2026-07-22T18:30:00,P,\ne1,s1,New,active,2026-07-22T18:30:00,P,5\n")
    refresh.load_curated(spark, root, 0, sources, events)
    assert tuple(tables.load_counts(spark, root, "events", 0).first()) == (1, 0)
    assert [r["title"] for r in tables.state(spark, root, "events", 0).collect()] == ["New"]
    (tmp_path / "e.csv").write_text(header + "e1,s1,Newer,active,bad,P,5\ne2,s1,Two,active,2026-07-22T18:30:00,P,\n")
    rejects = refresh.load_curated(spark, root, 1, sources, events, policy="quarantine")
    assert tuple(tables.load_counts(spark, root, "events", 1).first()) == (1, 0)
    assert tuple(tables.load_counts(spark, root, "sources", 1).first()) == (0, 1)
    assert [r["event_id"] for r in rejects["events"].collect()] == ["e1"]
    assert {r["event_id"]: r["title"] for r in tables.state(spark, root, "events", 1).collect()} == {"e1": "New", "e2": "Two"}
    with pytest.raises(ValidationError, match="start_time"):
        refresh.load_curated(spark, root, 1, sources, events)


def test_a_written_state_may_lack_later_columns(spark, tmp_path):
    old = tables.Batch(spark, str(tmp_path), "curated", 0)
    old.upsert("sources", spark.createDataFrame([("s1", "One")], "source_id string, name string"))
    old.commit()
    state = tables.state(spark, str(tmp_path), "sources", 0)
    assert "image_url" in state.columns and state.first()["image_url"] is None


@pytest.mark.parametrize("files_per_batch", [1, None])
def test_stream_equals_one_pass(spark, tmp_path, feed_frame, files_per_batch):
    batches = random_batches(11, days=3, keys=6)
    landed, root, checkpoint = (str(tmp_path / name) for name in ("landed", "tables", "checkpoint"))
    for rows in batches[:2]:
        feed_frame(*rows).coalesce(1).write.mode("append").parquet(landed)
    for rows in (None, batches[2]):
        if rows:
            feed_frame(*rows).coalesce(1).write.mode("append").parquet(landed)
        stream = feed_stream.landed_rows(spark, landed, files_per_batch)
        query = feed_stream.follow(stream, root, checkpoint)
        query.awaitTermination()
        last = query.lastProgress["batchId"]
    everything = feed_frame(*sum(batches, []))
    batch = max(int(p.name.split("=")[1]) for p in (tmp_path / "tables" / "feed").iterdir() if "=" in p.name)
    assert last >= batch
    assert rows_of(tables.whole_history(spark, root, batch)) == rows_of(history.history_from_batches(everything))
    observed = tables.observations(spark, root)
    assert rows_of(observed) == rows_of(history.observe(everything))
