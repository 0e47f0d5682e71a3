import datetime as dt
import math
import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from helpers import ZIPS, at, day
from pyspark.sql import functions as F

from outpulse import schemas
from outpulse.functions import presentation, scoring
from outpulse.functions.rounding import round_tenth
from outpulse.operators import matching
from outpulse.operators.favorites import add_favorites, flag_favorites, remove_favorites
from outpulse.plans import marts, recommendations

NAMES = [part.split()[0] for part in schemas.REQUESTS.split(",")]
MART = """event_id string, activity_category string, start_at timestamp_ntz, end_at timestamp_ntz,
 price_amount decimal(12,2), solo_friendly boolean, vibe_tags string, lat double, lon double, channel_type string,
 update_cadence string, source_last_checked date"""


def ask(request_id="r", **values):
    row = dict.fromkeys(NAMES) | {"request_id": request_id, "mode": "specific"} | values
    return tuple(row[name] for name in NAMES)


@pytest.fixture(scope="module")
def mart(enriched, clock):
    return marts.candidates(enriched, clock).cache()


def top(spark, mart, zips, clock, *requests, seed=0):
    df = spark.createDataFrame(list(requests), schemas.REQUESTS)
    return recommendations.top_results(df, mart, zips, clock, seed).orderBy("request_id", "rank").collect()


def test_feasibility_of_one_request(enriched, clock):
    def ids(**constraints):
        return {r["event_id"] for r in matching.feasible_for(enriched, clock, **constraints).collect()}

    assert not ids() & {"v05", "v07"} and len(ids()) == 8
    assert ids(category="LEARN") == {"v01", "v06"}
    assert ids(category="learn", mode="mood") == ids()
    assert ids(max_cost=0) == {"v02", "v03"}
    assert ids(hours_free=1.0) == {"v06", "v09"}
    assert ids(after_time="19:30:00") == {"v02", "v04", "v10"}
    assert ids(date="2026-07-21") == {"v02", "v10"}


def test_nearby_events_rank_higher(spark, mart, zips, clock):
    rows = top(spark, mart, zips, clock, ask(mode="mood", vibe="social", zip_code=" 11215 "))
    assert rows[0]["event_id"] == "v02" and rows[0]["distance_miles"] < 1.0
    assert [r["total"] for r in rows] == sorted((r["total"] for r in rows), reverse=True) and len(rows) == 5


def test_unknown_zip_drops_the_component(spark, mart, zips, clock):
    rows = top(spark, mart, zips, clock, ask(zip_code="99999"))
    assert rows and all(r["distance_miles"] is None and r["proximity_score"] is None for r in rows)


def test_mood_prefers_its_vibe_and_intent_overrides(spark, mart, zips, clock):
    rows = top(spark, mart, zips, clock, ask("a", mode="mood", vibe="creative"), ask("b", intent="meet_people"))
    assert rows[0]["vibe_score"] == 100.0
    assert all(r["vibe_score"] is not None for r in rows if r["request_id"] == "b")


def test_nothing_feasible_keeps_the_schema(spark, mart, zips, clock):
    df = spark.createDataFrame([ask(category="volunteer")], schemas.REQUESTS)
    results = recommendations.top_results(df, mart, zips, clock)
    assert results.count() == 0 and "total" in results.columns


def small_mart(spark, *rows):
    base = dict(
        event_id="e", activity_category="active", start_at=at("2026-07-21 18:00:00"), end_at=at("2026-07-21 19:00:00"),
        price_amount=None, solo_friendly=None, vibe_tags=None, lat=40.84, lon=-73.93, channel_type="api",
        update_cadence="daily", source_last_checked=day("2026-07-20"),
    )
    return spark.createDataFrame([tuple({**base, **row}.values()) for row in rows], MART)


def test_unlocatable_event_does_not_outrank_a_near_one(spark, zips, clock):
    mart = small_mart(
        spark, dict(event_id="a-nowhere", lat=None, lon=None), dict(event_id="near", lat=40.799, lon=-73.968)
    )
    rows = top(spark, mart, zips, clock, ask(zip_code="10025"))
    assert [r["event_id"] for r in rows] == ["near", "a-nowhere"] and rows[1]["distance_miles"] is None


def test_unknown_cost_and_solo_fail_only_when_asked_for(spark, zips, clock):
    mart = small_mart(spark, dict(event_id="u"), dict(event_id="k", price_amount=Decimal(0), solo_friendly=True))
    got = Counter(r["request_id"] for r in top(spark, mart, zips, clock, ask("0"), ask("1", max_cost=0.0), ask("2", solo_friendly=True), ask("3", solo_friendly=False)))
    assert got == {"0": 2, "1": 1, "2": 1, "3": 2}


# --- brute force -------------------------------------------------------------------------------------------------


def unit_vectors(lat, lon):
    a, b = np.radians(lat.astype(float)), np.radians(lon.astype(float))
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])


def all_pairs(asks, events, places, now):
    """Every request with every event that satisfies it, and the total, column by column; distances from chords."""
    pairs = pd.DataFrame(asks).merge(pd.DataFrame(events), how="cross", suffixes=("_ask", ""))
    price, start = pd.to_numeric(pairs.price_amount.astype(float)), pd.to_datetime(pairs.start_at)
    hours = (pd.to_datetime(pairs.end_at) - start) / pd.Timedelta(hours=1)
    asked = pairs.category.fillna("").str.lower()
    rules = [
        start >= now,
        pairs["mode"].ne("specific") | asked.eq("") | asked.eq(pairs.activity_category.str.lower()),
        pairs.max_cost.isna() | (price <= pairs.max_cost),
        ~pairs.solo_friendly_ask.eq(True) | pairs.solo_friendly.eq(True),
        pairs.date.isna() | (pairs.date == start.dt.date),
        start.dt.strftime("%H:%M:%S") >= pairs.after_time.fillna("00:00:00"),
        pairs.hours_free.isna() | ~(hours > pairs.hours_free),
    ]
    pairs = pairs[np.logical_and.reduce(rules)].reset_index(drop=True)

    trust = pairs.channel_type.str.lower().map(scoring.CHANNEL_TRUST).fillna(scoring.DEFAULT_CHANNEL_TRUST)
    cadence = pairs.update_cadence.map({"daily": 1, "weekly": 7, "seasonal": 90}).fillna(30)
    age = (pd.Timestamp(now.date()) - pd.to_datetime(pairs.source_last_checked)).dt.days
    confidence = 0.5 * trust + 0.5 * (1 - age / (cadence * 3)).clip(0, 1)

    origin = pairs.zip_code.fillna("").str.strip().map(places)
    here = unit_vectors(origin.str[0], origin.str[1])
    chord = np.linalg.norm(here - unit_vectors(pairs.lat, pairs.lon), axis=0)
    nearness = pd.Series(1 - 2 * 3958.8 * np.arcsin(chord / 2) / 8).clip(0, 1).fillna(0.5)

    vibe = pairs.vibe.where(pairs["mode"].eq("mood"), None).where(pairs.intent.ne("meet_people"), "social")
    padded = "|" + pairs.vibe_tags.fillna("").str.lower().str.replace(" ", "") + "|"
    matched = pd.Series([isinstance(v, str) and f"|{v.lower()}|" in t for v, t in zip(vibe, padded, strict=True)], dtype=float)

    weights = [np.full(len(pairs), 0.25), np.where(origin.isna(), 0, 0.35), np.where(vibe.isna(), 0, 0.4)]
    total = sum(value * (weight / sum(weights)) for value, weight in zip([confidence, nearness, matched], weights, strict=True))
    return pairs.assign(total=[round(t * 100, 1) for t in total])


@pytest.mark.parametrize("seed, broadcast", [(1, True), (2, False)])
def test_pools_equal_brute_force(spark, zips, clock, monkeypatch, seed, broadcast):
    if not broadcast:
        monkeypatch.setattr(matching, "is_small", lambda df, *a: False)
    rng = random.Random(seed)
    pick = rng.choice
    events = []
    for i in range(300):
        start = at("2026-07-20 08:00:00") + dt.timedelta(hours=pick(range(0, 96, 3)))
        # A third of the events are copies of one another at one place.
        hot = i % 3 == 0
        events.append(
            dict(
                event_id=f"e{i:03d}", activity_category="active" if hot else pick(["Active", "culture", "*"]), start_at=start,
                end_at=pick([None, start + dt.timedelta(hours=pick([1, 2, 3]))]),
                price_amount=pick([None, Decimal(0), Decimal(5), Decimal(20)]), solo_friendly=pick([None, True, False]),
                vibe_tags=pick([None, "chill|social", " Social ", "creative", "solo_focus|chill"]),
                lat=40.72 if hot else pick([None, 40.70, 40.75, rng.uniform(40.4, 41.1)]),
                lon=-73.99 if hot else pick([-74.0, -73.95, rng.uniform(-74.4, -73.5)]),
                channel_type=pick(["website", "Meetup", "instagram", "fax"]), update_cadence=pick(["daily", "weekly", None]),
                source_last_checked=day(pick(["2026-07-20", "2026-07-12", "2026-06-01"])),
            )
        )
    asks = [
        dict(
            request_id=f"r{i:02d}", category=pick([None, "", "active", "Culture"]), max_cost=pick([None, 0.0, 5.0]),
            solo_friendly=pick([None, True, False]), date=pick([None, None, day("2026-07-22")]),
            zip_code=pick([None, "10025", " 11215", "99999"]), mode=pick(["specific", "mood", "surprise"]),
            vibe=pick([None, "social", "Chill", "zen"]), hours_free=pick([None, 1.0, 2.0]),
            intent=pick([None, "meet_people", "explore"]), after_time=pick([None, "15:00:00"]), device_id=None,
        )
        for i in range(60)
    ]
    columns = [part.split()[0] for part in MART.replace("decimal(12,2)", "decimal").split(",")]
    frame = spark.createDataFrame([tuple(event[name] for name in columns) for event in events], MART)
    requests = spark.createDataFrame([tuple(a[name] for name in NAMES) for a in asks], schemas.REQUESTS)
    got = {}
    for row in recommendations.score_pools(requests, frame, zips, clock).collect():
        got.setdefault(row["request_id"], []).append((row["position"], row["event_id"], row["total"]))
    counts = matching.feasible_counts(matching.asked(requests, zips), matching.rankable(frame, clock)).collect()
    places = {z: (lat, lon) for z, lat, lon, _ in ZIPS}
    now = at("2026-07-20 12:00:00")
    pairs = all_pairs(asks, events, places, now).sort_values(["total", "event_id"], ascending=[False, True])
    for request in asks:
        best = pairs[pairs.request_id == request["request_id"]]
        expected = [(n + 1, e, t) for n, (e, t) in enumerate(zip(best.event_id[:10], best.total[:10], strict=True))]
        assert sorted(got.get(request["request_id"], [])) == expected, request
        assert [r["feasible_events"] for r in counts if r["request_id"] == request["request_id"]] == [len(best)]


# --- surprise ----------------------------------------------------------------------------------------------------


def pool_frame(spark, requests, totals):
    rows = [(f"q{r}", "surprise", i + 1, f"e{i}", float(t)) for r in range(requests) for i, t in enumerate(totals)]
    return spark.createDataFrame(rows, "request_id string, mode string, position int, event_id string, total double")


def test_surprise_repeats_with_its_seed_and_varies_without(spark, mart, zips, clock):
    asks = [ask(f"s{i}", mode="surprise", max_cost=12.0) for i in range(20)]
    first, again = top(spark, mart, zips, clock, *asks, seed=7), top(spark, mart, zips, clock, *asks, seed=7)
    assert first == again
    assert [r["event_id"] for r in first] != [r["event_id"] for r in top(spark, mart, zips, clock, *asks, seed=8)]
    assert all(r["event_id"] != "v06" for r in first)
    assert max(Counter((r["request_id"], r["event_id"]) for r in first).values()) == 1


def test_surprise_chances_follow_the_totals(spark):
    drawn = matching.select_results(pool_frame(spark, 6000, [60, 30, 10, 0]), seed=3, results=1)
    share = {r["event_id"]: r["count"] / 6000 for r in drawn.groupBy("event_id").count().collect()}
    for event, weight in {"e0": 60, "e1": 30, "e2": 10, "e3": 1}.items():
        assert share.get(event, 0) == pytest.approx(weight / 101, abs=0.03)


def test_results_are_chosen_without_a_sort_of_the_requests(spark, mart, zips, clock):
    """A map task once sorted the pools of all requests that it read."""
    modes = ["surprise", "mood", "specific"]
    asks = [ask(f"a{i}", mode=modes[i % 3], vibe="social", zip_code=[None, "11215"][i % 2], max_cost=[None, 12.0][i % 5 == 0]) for i in range(60)]
    df = spark.createDataFrame(asks, schemas.REQUESTS)
    got = recommendations.top_results(df, mart, zips, clock, seed=5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(request_id" not in plan
    by_rows = matching.select_results(recommendations.score_pools(df, mart, zips, clock), seed=5)
    assert got.columns == by_rows.columns
    assert sorted(got.collect(), key=lambda r: (r["request_id"], r["rank"])) == by_rows.orderBy("request_id", "rank").collect()


# --- scores and presentation ---------------------------------------------------------------------------------------


def test_rounding_equals_python(spark):
    rng = random.Random(5)
    values = [i / 20 for i in range(2001)] + [rng.random() * 100 for _ in range(2000)]
    values += [math.nextafter(v, 0) for v in values[1:400]] + [math.nextafter(v, 200) for v in values[:400]]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", round_tenth(F.col("v")).alias("r"))
    assert [r["v"] for r in rows.collect() if r["r"] != round(r["v"], 1)] == []


def test_confidence(spark):
    df = spark.createDataFrame([("website", "weekly", 1), ("website", "weekly", 200), ("fax", None, 0), ("API", "DAILY", -1)], "c string, u string, d int")
    got = [r[0] for r in df.select(scoring.confidence(F.col("c"), F.col("u"), F.col("d"))).collect()]
    assert got == pytest.approx([0.5 + 0.5 * (1 - 1 / 21), 0.5, 0.75, 1.0])


def test_haversine(spark):
    from outpulse.functions.geo import haversine_miles

    quarter = 3958.8 * math.pi / 2
    for ends, miles in {(40.0, -74.0, 41.0, -74.0): quarter / 90, (0.0, 10.0, 0.0, 100.0): quarter, (5.0, 5.0, 5.0, 5.0): 0.0}.items():
        assert spark.range(1).select(haversine_miles(*map(F.lit, ends))).first()[0] == pytest.approx(miles, abs=1e-6)


def test_every_point_in_reach_is_in_a_tile_around(spark):
    from outpulse.functions.geo import haversine_miles, tile, tiles_within

    rng = random.Random(9)
    rows = []
    for _ in range(3000):
        lat, lon = rng.choice([40.7, -33.9, 0.0, 64.1, 85.0, rng.uniform(-89, 89)]), rng.choice([-74.0, 179.99, -179.99, rng.uniform(-180, 180)])
        spread = 0.13 / max(0.05, math.cos(math.radians(lat)))
        other = (lon + rng.uniform(-spread, spread) + 180) % 360 - 180
        rows.append((lat, lon, lat + rng.uniform(-0.12, 0.12), other))
    points = spark.createDataFrame(rows, "a double, b double, c double, d double")
    a, b, c, d = (F.col(name) for name in "abcd")
    near = points.filter(haversine_miles(a, b, c, d) < 8)
    assert near.count() > 1000
    assert near.filter(~F.array_contains(tiles_within(a, b, 8.0), tile(c, d))).count() == 0
    assert spark.range(1).select(F.size(tiles_within(F.lit(40.7), F.lit(-74.0), 8.0))).first()[0] <= 12


def shown(spark, **values):
    base = dict(
        title="T", category="active", vibe_tags=None, solo_friendly=None, beginner_friendly=None, cost=None,
        start_time=at("2026-07-21 18:00:00"), end_time=at("2026-07-21 19:30:00"),
    )
    schema = "title string, category string, vibe_tags string, solo_friendly boolean, beginner_friendly boolean, cost double, start_time timestamp_ntz, end_time timestamp_ntz"
    df = spark.createDataFrame([tuple({**base, **values}.values())], schema)
    return df.select(
        presentation.badges().alias("badges"),
        presentation.tags().alias("tags"),
        presentation.duration_minutes(F.col("start_time"), F.col("end_time")).alias("minutes"),
        presentation.cost_label(F.col("cost")).alias("cost"),
    ).first()


@pytest.mark.parametrize(
    "category, tags, badges",
    [
        ("active", "social|chill", ["Active", "Social"]),
        ("outdoors", "social|chill", ["Outdoors", "Chill"]),
        ("culture", "creative|social", ["Culture", "Creative"]),
        ("learn", "chill", ["Learn", "Chill"]),
        ("food_drink", None, ["Food & Drink"]),
        ("board games", "energetic", ["Board Games"]),
    ],
)
def test_badges(spark, category, tags, badges):
    assert shown(spark, category=category, vibe_tags=tags)["badges"] == badges


def test_tags_durations_and_costs(spark):
    row = shown(spark, category="outdoors", vibe_tags="solo_focus|social|chill", solo_friendly=True, title="Beginner walk")
    assert row["tags"] == ["Beginner friendly", "Great for solo", "Meet people", "Casual", "Outdoor"]
    assert row["minutes"] == 90 and row["cost"] == "Cost unknown"
    assert shown(spark, title="Beginner", beginner_friendly=False)["tags"] == []
    assert shown(spark, end_time=None)["minutes"] is None
    assert shown(spark, cost=0.0)["cost"] == "Free" and shown(spark, cost=12.0)["cost"] == "$12"


def test_transit(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (0.5,), (None,)], "d double")
    assert [r[0] for r in df.select(presentation.transit_minutes(F.col("d"))).collect()] == [5, 20, 2, None]


def test_explained_result(spark, mart, zips, clock):
    favorites = spark.createDataFrame([("dev", "v02", None)], schemas.FAVORITES)
    request = ask(mode="mood", vibe="creative", zip_code="11215", max_cost=0.0, hours_free=3.0, intent="solo_time", device_id="dev")
    df = spark.createDataFrame([request], schemas.REQUESTS)
    rows = recommendations.recommend(df, mart, zips, favorites, clock).orderBy("rank").collect()
    first = rows[0]
    assert len(first) == 25 and first["event_id"] == "v02" and first["is_favorited"] is True
    assert first["explanation"] == (
        "Fits because it costs $0, within your $0 budget, fits within the 3 hour(s) you have free, works well for solo "
        "time, matches the 'creative' vibe you asked for, is about 0.5 miles from ZIP 11215. "
        f"Score: {first['score']:g}/100 (confidence: Medium -- meetup source, last verified 16 day(s) ago (usually "
        "updated weekly)). Source: River Chorus -- last checked 2026-07-04."
    )
    plain = recommendations.recommend(
        spark.createDataFrame([ask()], schemas.REQUESTS), mart, zips, favorites, clock
    ).filter("event_id = 'v01'").first()
    assert plain["explanation"].startswith("Fits because it is a learn activity happening 2026-07-24. Score: ")
    assert plain["is_favorited"] is None


def test_favorites(spark):
    have = spark.createDataFrame([("d", "1"), ("d", "2")], "device_id string, event_id string")
    add = spark.createDataFrame([("d", "2"), ("d", "3"), ("d", "3")], "device_id string, event_id string")
    both = add_favorites(have, add)
    assert both.count() == 3
    assert remove_favorites(both, add.union(spark.createDataFrame([("x", "9")], add.schema))).collect() == have.limit(1).collect()
    rows = spark.createDataFrame([("r", "d", "1"), ("r", "", "1"), ("r", None, "1"), ("r", "e", "1")], "request_id string, device_id string, event_id string")
    assert [r["is_favorited"] for r in flag_favorites(rows, have).collect()] == [True, None, None, False]
