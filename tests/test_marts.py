import pytest
from helpers import BROKEN, EVENTS, events_frame, feed_row
from pyspark.sql import functions as F

from outpulse.clock import Clock
from outpulse.plans import enrich, marts, staging


def ids(df):
    return sorted(row["event_id"] for row in df.select("event_id").collect())


def test_freshness_per_source(sources, clock):
    rows = staging.stage_sources(sources).withColumn("f", enrich.freshness(clock)).collect()
    assert {r["source_id"]: r["f"] for r in rows} == {
        "kites": "fresh", "chorus": "stale", "dunes": "fresh", "supper": "stale", "ember": "abandoned", "lapsed": "fresh",
    }


def test_candidates(enriched, clock):
    mart = marts.candidates(enriched, clock)
    assert ids(mart) == ["v01", "v02", "v03", "v04", "v05", "v06"]
    assert mart.filter("event_id = 'v06'").first()["price_amount"] is None
    assert len(mart.columns) == 34


@pytest.fixture(scope="module")
def with_broken(spark, no_feed, sources, zips, clock):
    feed_like = staging.all_events(events_frame(spark, EVENTS + BROKEN), no_feed)
    cancelled = feed_like.filter("event_id = 'v01'").withColumns({"event_id": F.lit("w06"), "is_cancelled": F.lit(True)})
    return enrich.enrich(feed_like.union(cancelled), staging.all_sources(sources, no_feed), zips, clock).cache()


RULES = "not_ended has_start has_url renderable legal_price not_cancelled active_source not_abandoned".split()


@pytest.mark.parametrize("name", RULES)
def test_every_rule_excludes_its_violations(with_broken, clock, name):
    rules = {**marts.event_rules(clock), **marts.source_rules()}
    assert sorted(rules) == sorted(RULES)
    rule = rules[name]
    violations = ids(with_broken.filter(~F.coalesce(rule, F.lit(False))))
    kept = ids(marts.candidates(with_broken, clock))
    assert violations and not set(violations) & set(kept)
    assert kept == ["v01", "v02", "v03", "v04", "v05", "v06"]


@pytest.mark.parametrize(
    "event, scores, group, structure, badge, discovery, actionability",
    [
        # Solo 50, its tag 30, chill 20; couples 60 and chill 20; groups 50 and outdoors 20. Fresh, with a link.
        ("v03", (100, 50, 80, 70), "solo_private", "solo_friendly", "chill", 100, 100.0),
        # Solo 50 less 20 for social; 50 and social 40; couples 60 and creative 20. Stale, with a link.
        ("v02", (30, 90, 80, 50), "solo_social", "solo_or_social", "creative", 80, 75.0),
    ],
)
def test_scores_of_an_event(enriched, event, scores, group, structure, badge, discovery, actionability):
    row = enriched.filter(F.col("event_id") == event).first()
    assert (row["solo_private_score"], row["solo_social_score"], row["couple_score"], row["small_group_score"]) == scores
    assert (row["group_suitability"], row["social_structure"], row["secondary_badge"]) == (group, structure, badge)
    assert (row["discovery_score"], row["actionability_score"]) == (discovery, actionability)


def test_borough_is_unknown_outside_the_lookup(enriched):
    rows = {r["event_id"]: r["borough"] for r in enriched.collect()}
    assert rows["v01"] == "Manhattan" and rows["v03"] is None


def test_beginner_from_title_and_from_source_notes(enriched):
    rows = {r["event_id"]: r["beginner_friendly"] for r in enriched.collect()}
    assert rows["v04"] and rows["v02"] and not rows["v01"]


def test_unknown_audience_has_no_scores(feed_frame, sources, zips, clock, curated):
    feed = feed_frame(feed_row("1", "2026-07-20 10:00:00", description="All levels"))
    row = (
        enrich.enrich(staging.all_events(curated, feed), staging.all_sources(sources, feed), zips, clock)
        .filter("event_id = 'parks-1'")
        .first()
    )
    assert row["couple_score"] is None and row["group_suitability"] is None and row["social_structure"] is None
    assert row["audience_data_available"] is False and row["beginner_friendly"] is True
    assert row["freshness_status"] == "fresh" and row["discovery_score"] == 30


def test_underscore_in_solo_tag_is_a_wildcard(spark):
    df = spark.createDataFrame([("solo-focus", None, "active")], "vibe_tags string, solo_friendly boolean, activity_category string")
    assert enrich.with_audience_fit(df).first()["social_structure"] == "solo_friendly"


def test_organizations(curated, no_feed, sources, clock):
    mart = marts.organizations(
        staging.all_events(curated, no_feed), staging.all_sources(sources, no_feed), clock
    )
    counts = {r["source_id"]: r["upcoming_event_count"] for r in mart.collect()}
    assert counts == {"kites": 2, "chorus": 1, "dunes": 2, "supper": 1, "ember": 0, "parks-feed": 0}
    names = [r["source_id"] for r in marts.organization_list(mart).collect()]
    assert names == ["dunes", "kites", "chorus", "supper", "ember", "parks-feed"]


def test_organizations_count_what_the_mart_holds(curated, no_feed, sources, enriched, clock):
    mart = marts.candidates(enriched, clock).groupBy("source_id").count().collect()
    counted = marts.organizations(
        staging.all_events(curated, no_feed), staging.all_sources(sources, no_feed), clock
    ).filter("upcoming_event_count > 0")
    assert {r["source_id"]: r["count"] for r in mart} == {
        r["source_id"]: r["upcoming_event_count"] for r in counted.collect()
    }


def test_the_local_day_differs_from_the_utc_day(spark):
    late = Clock("2026-07-21 00:13:00")
    row = spark.range(1).select(late.now_local().alias("n"), late.today_local().alias("d")).first()
    assert str(row["n"]) == "2026-07-20 20:13:00" and str(row["d"]) == "2026-07-20"
