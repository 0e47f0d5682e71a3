"""Projections from the order/customer/event test tables onto this library's inputs.

They cover every row of their tables. Timestamps are written as zone-less literals, so that no session setting
changes their meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outpulse.clock import Clock

AS_OF_UTC = "2024-01-15 17:00:00"
CLOCK = Clock(AS_OF_UTC)


# Declared, so that opening a table reads no file.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
     o_orderdate timestamp_ntz, o_orderpriority string""",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('src-', s_suppkey) as source_id",
        "s_name as name",
        """case s_suppkey % 7 when 0 then 'active' when 1 then 'outdoors' when 2 then 'social' when 3 then 'culture'
           when 4 then 'food_drink' when 5 then 'learn' else 'volunteer' end as category""",
        """case s_suppkey % 5 when 0 then 'website' when 1 then 'meetup' when 2 then 'instagram'
           when 3 then 'website' else 'newsletter' end as channel_type""",
        "concat('https://s', s_suppkey, '.example.org') as url",
        "case s_suppkey % 4 when 0 then 'daily' when 1 then 'weekly' when 2 then 'seasonal' end as update_cadence",
        "date_sub(date'2024-01-15', cast(s_suppkey * 13 % 60 as int)) as last_checked",
        "case when s_suppkey % 6 = 0 then 'Weekly meetups; Beginner friendly' end as notes",
        "s_suppkey % 7 <> 5 as is_active",
        "cast(null as string) as image_url",
    )


def curated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('evt-', o_orderkey) as event_id",
        "case when o_orderkey % 97 = 0 then 'src-missing' else concat('src-', o_custkey % 10) end as source_id",
        "concat(case when o_orderkey % 11 = 0 then 'Beginner session ' else 'Session ' end, o_orderkey) as title",
        """case o_orderkey % 7 when 0 then 'active' when 1 then 'outdoors' when 2 then 'social' when 3 then 'culture'
           when 4 then 'food_drink' when 5 then 'learn' else 'volunteer' end as category""",
        "timestampadd(HOUR, cast(o_orderkey % 720 as int), timestamp_ntz'2024-01-01 08:00:00') as start_time",
        """case when o_orderkey % 5 <> 0 then timestampadd(HOUR, cast(o_orderkey % 720 + 1 + o_orderkey % 4 as int),
           timestamp_ntz'2024-01-01 08:00:00') end as end_time""",
        """case when o_orderkey % 13 = 0 then null when o_orderkey % 53 = 0 then cast(-1 as decimal(12,2))
           else cast(o_orderkey % 40 as decimal(12,2)) end as cost""",
        "concat('Venue ', o_orderkey % 40) as location",
        "case o_orderkey % 3 when 0 then true when 1 then false end as solo_friendly",
        """case when o_orderkey % 17 = 0 then '' when o_orderkey % 19 = 0 then null
           else concat('https://e.example.org/', o_orderkey) end as source_url""",
        "date'2024-01-10' as last_checked",
        "case when o_orderkey % 23 <> 0 then cast(10000 + o_custkey % 30 as string) end as zip_code",
        "case when o_orderkey % 29 <> 0 then 40.55d + (o_orderkey % 40) * 0.0075d end as lat",
        "case when o_orderkey % 29 <> 0 then -74.1d + (o_orderkey % 35) * 0.01d end as lon",
        """case o_orderkey % 6 when 0 then 'energetic|social' when 1 then 'chill|solo_focus'
           when 2 then 'creative|social' when 3 then 'chill' when 4 then 'energetic' end as vibe_tags""",
        "cast(null as string) as image_url",
    )


def _feed_columns() -> list[str]:
    return [
        "cast(user_id as string) as source_record_id",
        "concat(case when event_type = 'error' then 'CANCELED: ' else '' end, 'Class ', user_id) as title",
        """date_add(date'2024-01-10', cast(user_id % 20 as int)
           + case when event_type = 'purchase' and user_id % 3 = 0 then 1 else 0 end) as startdate""",
        "cast(null as date) as enddate",
        "case when user_id % 9 <> 0 then '2024-01-01 18:30:00' when user_id % 2 = 0 then 'TBD' end as starttime",
        """case when user_id % 4 = 0 then '2024-01-01 17:00:00' when user_id % 4 <> 3 then '2024-01-01 20:00:00' end
           as endtime""",
        """case when event_type = 'signup' and user_id % 2 = 0 then '' else concat('Field ', user_id % 12) end
           as location""",
        "concat('Park ', user_id % 5) as parknames",
        """case user_id % 6 when 0 then 'Fitness | Volunteer | Gardening' when 1 then 'Fitness | Outdoor Fitness'
           when 2 then 'Arts & Crafts' when 3 then 'Games' when 4 then 'Seniors'
           else 'Tours | Virtual/Online Events' end as categories""",
        "concat('https://p.example.org/', user_id) as link_url",
        "case when user_id % 3 = 0 then '' end as registration_url",
        "case when user_id % 7 <> 0 then 40.55d + (user_id % 50) * 0.006d end as lat",
        "case when user_id % 7 <> 0 then -74.1d + (user_id % 45) * 0.008d end as lon",
        "case when user_id % 10 = 0 then 'All levels welcome' when user_id % 10 = 1 then 'Bring water' end as description",
        "timestampadd(HOUR, 23, cast(day as timestamp_ntz)) as ingested_at",
    ]


def feed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state per record and day, the day's last; ``ingested_at`` is the capture time of the daily batch.

    ``row_number() = 1`` keeps one row per record and day inside each map task before the shuffle, so a record that
    owns a third of the events still sends one row per task and day.
    """
    # The day is a column of its own, so that a filter on the capture time can move below the window.
    latest_first = W.partitionBy("user_id", "day").orderBy(F.desc("ts"), F.desc("event_id"))
    return (
        table(spark, sf_dir, "events")
        .select("event_id", "ts", "user_id", "event_type", F.to_date("ts").alias("day"))
        .withColumn("_rn", F.row_number().over(latest_first))
        .filter("_rn = 1")
        .selectExpr(*_feed_columns())
    )


def feed_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's last state: what the raw feed table holds after all batches were upserted."""
    latest_first = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return (
        table(spark, sf_dir, "events")
        .select("event_id", "ts", "user_id", "event_type", F.to_date("ts").alias("day"))
        .withColumn("_rn", F.row_number().over(latest_first))
        .filter("_rn = 1")
        .selectExpr(*_feed_columns())
    )


def zip_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "nation")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .selectExpr(
            "cast(10000 + n_nationkey as string) as zip_code",
            "40.55d + n_nationkey * 0.0125d as lat",
            "-74.1d + n_nationkey * 0.014d as lon",
            "r_name as borough",
        )
    )


def favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .filter("o_orderpriority = '1-URGENT'")
        .selectExpr("concat('dev-', o_custkey % 50) as device_id", "concat('evt-', o_orderkey) as event_id")
        .distinct()
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per customer."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('req-', c_custkey) as request_id",
        "case c_custkey % 3 when 0 then 'specific' when 1 then 'mood' else 'surprise' end as mode",
        "case c_custkey % 4 when 0 then 'active' when 1 then 'Culture' end as category",
        "case when c_custkey % 5 = 0 then cast(c_custkey % 25 as double) end as max_cost",
        "case when c_custkey % 7 = 0 then true end as solo_friendly",
        "case when c_custkey % 11 = 0 then date'2024-01-20' end as date",
        "case when c_custkey % 2 = 0 then cast(10000 + c_nationkey + c_custkey % 8 as string) end as zip_code",
        "case c_custkey % 9 when 1 then 'chill' when 4 then 'social' when 7 then 'creative' end as vibe",
        "case when c_custkey % 6 = 0 then 2.0d end as hours_free",
        "case c_custkey % 10 when 3 then 'meet_people' when 6 then 'solo_time' when 9 then 'explore' end as intent",
        "case when c_custkey % 8 = 0 then '15:00:00' end as after_time",
        "concat('dev-', c_custkey % 60) as device_id",
    )


def feed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the capture times of the feed, for which no record needs to be reduced to its last state."""
    return table(spark, sf_dir, "events").selectExpr(
        "timestampadd(HOUR, 23, cast(cast(ts as date) as timestamp_ntz)) as ingested_at"
    )


def landed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one JSON record, with the defects that the feed has: no id, bad dates, garbage positions."""
    return table(spark, sf_dir, "events").selectExpr(
        """concat('{"guid": ', case when event_id % 50 = 0 then 'null' when event_id % 51 = 0 then '""'
               else concat('"', event_id, '"') end,
             ', "title": "Class ', user_id, '", "startdate": ',
             case event_id % 40 when 3 then '"not-a-date"' when 5 then '" "' when 7 then 'null'
               when 9 then concat('"', cast(cast(ts as date) as string), '"')
               when 11 then concat('"', cast(cast(ts as date) as string), 'T10:00:00Z"')
               else concat('"', cast(cast(ts as date) as string), 'T00:00:00.000"') end,
             case when event_id % 60 = 13 then ', "enddate": "2024-13-45"' when event_id % 3 = 0 then ''
               else concat(', "enddate": "', cast(date_add(cast(ts as date), 1) as string), 'T00:00:00.000"') end,
             ', "starttime": "2024-01-01 18:30:00", "categories": "Fitness | ', event_type, '"',
             case event_id % 4 when 0 then concat(', "link": {"url": "https://p.example.org/', user_id, '"}')
               when 1 then concat(', "link": "https://q.example.org/', user_id, '"')
               when 2 then ', "link": 17' else '' end,
             ', "registration_url": {"url": null}, "coordinates": ',
             case event_id % 9 when 0 then '"51.5074, -0.1278"' when 1 then '"40.6"' when 2 then '"not,numbers"'
               when 3 then '""' when 4 then 'null' when 5 then '"40.7, -73.9, 3"'
               else concat('"40.', user_id % 90 + 10, ', -73.', user_id % 40 + 50, '"') end,
             ', "props": ', props, '}') as raw_payload"""
    )


def records_of_any_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a JSON record whose id is a text, a number, a flag, a container or nothing."""
    return table(spark, sf_dir, "events").selectExpr(
        """concat('{"title": "t', event_id, '"', case event_id % 11 when 0 then '' else concat(', "guid": ',
             case event_id % 11 when 1 then '0' when 2 then '0.0' when 3 then 'false' when 4 then 'true' when 5 then '"0"'
               when 6 then 'null' when 7 then '""' when 8 then '[]' when 9 then '{}' else cast(event_id as string) end) end,
             '}') as raw_payload"""
    )


def display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as shown events: a stored beginner flag, notes and titles that say so or not, amounts from tiny to huge."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('evt-', o_orderkey) as event_id",
        "case o_orderkey % 4 when 0 then true when 1 then false end as beginner_friendly",
        "case o_orderkey % 3 when 0 then 'For BEGINNERS too' when 1 then 'Bring shoes' end as source_notes",
        "case o_orderkey % 5 when 0 then 'Beginner class' when 1 then 'Open class' end as title",
        "case when o_orderkey % 17 <> 0 then cast(o_orderkey % 1000 + 1 as double) / cast(power(10, o_orderkey % 9) as double) * cast(power(10, o_orderkey % 13) as double) end as amount",
    )


def raw_event_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated events as text cells, some required ones blank and some dates malformed."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('evt-', o_orderkey) as event_id",
        "case when o_orderkey % 31 <> 0 then concat('src-', o_custkey % 10) end as source_id",
        "case when o_orderkey % 43 <> 0 then concat('Session ', o_orderkey) end as title",
        "'active' as category",
        """case when o_orderkey % 71 = 0 then 'soon' when o_orderkey % 73 = 0 then '  ' when o_orderkey % 79 = 0 then null
           else date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss") end as start_time""",
        "case when o_orderkey % 59 = 0 then '2024-02-31' end as end_time",
        "'Venue' as location",
        "date_format(o_orderdate, 'yyyy-MM-dd') as last_checked",
    )


def device_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as something a device looks at; some looks come without a device."""
    return table(spark, sf_dir, "orders").selectExpr(
        "case when o_orderkey % 12 <> 0 then concat('dev-', o_custkey % 50) end as device_id",
        "concat('evt-', o_orderkey) as event_id",
    )


def favorite_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(added, removed)``: high-priority orders are added, repeats included; finished orders are removed."""
    pairs = ("concat('dev-', o_custkey % 50) as device_id", "concat('evt-', o_orderkey) as event_id")
    orders = table(spark, sf_dir, "orders")
    added = orders.filter("o_orderpriority in ('1-URGENT', '2-HIGH')").selectExpr(*pairs)
    removed = orders.filter("o_orderstatus = 'F'").selectExpr(*pairs)
    return added.unionByName(added), removed
