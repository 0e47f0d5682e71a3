"""DuckDB statements, one per registered query."""

from __future__ import annotations

import oracle.request_parts  # noqa: F401
from oracle.parts import block, compose

SQL: dict[str, str] = {}

block(
    "organizations",
    "stg_sources candidates",
    """
select s.source_id, source_name, source_category, channel_type, source_url, source_image_url, update_cadence,
  source_last_checked, is_active, next_event_at, coalesce(n, 0) as upcoming_event_count
from stg_sources s left join (
  select source_id, count(*) as n, min(start_at) as next_event_at from candidates group by source_id) c
  on s.source_id = c.source_id
where is_active""",
)
SQL["organizations"] = compose("organizations", "select * from organizations")

SQL["candidate_mart"] = compose("candidates", "select * from candidates")

SQL["enriched_freshness"] = compose(
    "fresh",
    """
select event_id, source_id, cadence_days, days_since_checked, freshness_status, borough from fresh""",
)

SQL["enriched_audience_fit"] = compose(
    "enriched",
    """
select event_id, activity_family, secondary_badge, solo_private_score, solo_social_score, couple_score,
  small_group_score, audience_data_available, group_suitability, social_structure, beginner_friendly, discovery_score,
  actionability_score
from enriched""",
)

SQL["feed_staging"] = compose("stg_feed", "select * from stg_feed")

SQL["synthetic_source"] = compose("stg_sources", "select * from stg_sources where source_id = 'parks-feed'")

SQL["category_counts"] = compose(
    "candidates", "select activity_category, count(*) as events from candidates group by activity_category"
)

RECORD_FIELDS = """
  case when event_id % 50 <> 0 and event_id % 51 <> 0 then cast(event_id as varchar) end as source_record_id,
  'Class ' || user_id as title,
  case when event_id % 40 not in (3, 5, 7) then cast(ts as date) end as startdate,
  case when event_id % 3 <> 0 and event_id % 60 <> 13 then cast(ts as date) + 1 end as enddate"""
USABLE = "event_id % 50 <> 0 and event_id % 51 <> 0 and event_id % 40 <> 3 and event_id % 60 <> 13"
DAY = "strftime(ts, '%Y-%m-%d')"

SQL["feed_parse_json"] = f"""
select {RECORD_FIELDS}, '2024-01-01 18:30:00' as starttime, cast(null as varchar) as endtime,
  cast(null as varchar) as location, cast(null as varchar) as parknames, 'Fitness | ' || event_type as categories,
  case event_id % 4 when 0 then 'https://p.example.org/' || user_id when 1 then 'https://q.example.org/' || user_id
    end as link_url,
  cast(null as varchar) as registration_url,
  case when event_id % 9 in (6, 7, 8) then cast('40.' || (user_id % 90 + 10) as double) end as lat,
  case when event_id % 9 in (6, 7, 8) then cast('-73.' || (user_id % 40 + 50) as double) end as lon,
  cast(null as varchar) as description,
  '{{"guid": "' || event_id || '", "title": "Class ' || user_id || '", "startdate": '
    || case event_id % 40 when 5 then '" "' when 7 then 'null' when 9 then '"' || {DAY} || '"'
       when 11 then '"' || {DAY} || 'T10:00:00Z"' else '"' || {DAY} || 'T00:00:00.000"' end
    || case when event_id % 3 = 0 then '' else ', "enddate": "' || strftime(ts + interval 1 day, '%Y-%m-%d')
       || 'T00:00:00.000"' end
    || ', "starttime": "2024-01-01 18:30:00", "categories": "Fitness | ' || event_type || '"'
    || case event_id % 4 when 0 then ', "link": {{"url": "https://p.example.org/' || user_id || '"}}'
       when 1 then ', "link": "https://q.example.org/' || user_id || '"' when 2 then ', "link": 17' else '' end
    || ', "registration_url": {{"url": null}}, "coordinates": '
    || case event_id % 9 when 0 then '"51.5074, -0.1278"' when 1 then '"40.6"' when 2 then '"not,numbers"'
       when 3 then '""' when 4 then 'null' when 5 then '"40.7, -73.9, 3"'
       else '"40.' || (user_id % 90 + 10) || ', -73.' || (user_id % 40 + 50) || '"' end
    || ', "props": ' || props || '}}' as raw_payload,
  timestamp '2024-01-15 17:00:00' as ingested_at
from events where {USABLE}"""

SQL["feed_rejects"] = """
select case when event_id % 50 = 0 or event_id % 51 = 0 then 'missing_id' when event_id % 40 = 3 then 'bad_startdate'
  else 'bad_enddate' end as reason, count(*) as records
from events where event_id % 50 = 0 or event_id % 51 = 0 or event_id % 40 = 3 or event_id % 60 = 13
group by all"""

SQL["feed_ids"] = """
select 't' || event_id as title,
  case when event_id % 11 = 4 then 'True' when event_id % 11 = 5 then '0' when event_id % 11 = 10 then cast(event_id as varchar)
    end as source_record_id,
  case when event_id % 11 in (4, 5, 10) then 'taken' else 'missing_id' end as reason
from events"""

SQL["display_details"] = """
select 'evt-' || o_orderkey as event_id,
  case o_orderkey % 4 when 0 then true when 1 then false else o_orderkey % 3 = 0 or o_orderkey % 5 = 0 end as for_beginners,
  case when o_orderkey % 17 <> 0 then format('{:g}', cast(o_orderkey % 1000 + 1 as double) / cast(pow(10, o_orderkey % 9) as double)
    * cast(pow(10, o_orderkey % 13) as double)) end as amount_text
from orders"""

SQL["feed_first_records"] = f"""
select source_record_id, title, startdate from (
  select *, {RECORD_FIELDS},
    case when event_id % 50 <> 0 and event_id % 51 <> 0 then cast(event_id as varchar) end as guid
  from events order by guid nulls last limit 200) t
where {USABLE}"""

SQL["validation_report"] = """
select 'required_value' as check_name, 'event_id' as column_name, cast(0 as bigint) as failing_rows
union all select 'required_value', 'source_id', count(*) filter (o_orderkey % 31 = 0) from orders
union all select 'required_value', 'title', count(*) filter (o_orderkey % 43 = 0) from orders
union all select 'required_value', 'category', 0
union all select 'required_value', 'start_time',
  count(*) filter (o_orderkey % 79 = 0 and o_orderkey % 71 <> 0 and o_orderkey % 73 <> 0) from orders
union all select 'required_value', 'location', 0
union all select 'time_format', 'start_time', count(*) filter (o_orderkey % 71 = 0) from orders
union all select 'time_format', 'end_time', count(*) filter (o_orderkey % 59 = 0) from orders
union all select 'time_format', 'last_checked', 0"""

SQL["lookup_evolved"] = compose(
    "zips", "select zip_code, lat, lon, borough, cast(null as varchar) as image_url, true as is_active from zips"
)

SQL["upsert_final_state"] = compose(
    "feed_batches",
    """
select * exclude (n), case when ingested_at < (select max(ingested_at) from feed_batches) then 'kept'
  when n > 1 then 'updated' else 'inserted' end as status
from (select *, count(*) over (partition by source_record_id) as n from feed_batches
  qualify row_number() over (partition by source_record_id order by ingested_at desc) = 1) t""",
)

SQL["stored_feed_state"] = SQL["stored_feed_merged"] = compose(
    "feed_batches",
    "select *, cast(null as varchar) as raw_payload from feed_batches qualify row_number() over (partition by source_record_id order by ingested_at desc) = 1",
)

SQL["upsert_counts"] = compose(
    "feed_batches",
    """
select ingested_at, count(*) filter (n = 1) as inserted, count(*) filter (n > 1) as updated
from (select *, row_number() over (partition by source_record_id order by ingested_at) as n from feed_batches) t
group by ingested_at""",
)

block(
    "history",
    "feed_batches",
    """
select source_record_id, title, startdate, enddate, starttime, endtime, location, parknames, categories, link_url,
  registration_url, lat, lon, ingested_at,
  md5(source_record_id || '~' || strftime(ingested_at, '%Y-%m-%d %H:%M:%S.%f')) as version_id,
  ingested_at as valid_from,
  lead(ingested_at) over (partition by source_record_id order by ingested_at) as valid_to
from (
  select *, lag(ingested_at) over w as before, (title, startdate, enddate, starttime, endtime, location, parknames,
      categories, link_url, registration_url) as state, lag(state) over w as state_before
  from feed_batches window w as (partition by source_record_id order by ingested_at)) t
where before is null or state is distinct from state_before""",
)
SQL["scd2_history"] = SQL["scd2_incremental"] = SQL["stored_history"] = compose("history", "select * from history")

block(
    "observations",
    "feed_batches",
    """
select source_record_id, startdate as scheduled_for, cast(ingested_at as date) as observed_on,
  'parks-' || source_record_id as event_id, starts_with(title, 'CANCELED') as was_cancelled_on_that_date,
  cast(startdate - cast(ingested_at as date) as int) as days_ahead_of_event
from feed_batches""",
)
SQL["event_observations"] = SQL["stored_observations"] = compose("observations", "select * from observations")

LIFECYCLE = """
select h.source_record_id, max(title) filter (valid_to is null) as current_title,
  any_value(s.activity_category) as activity_category, any_value(s.start_at) as scheduled_start_at,
  min(valid_from) as first_captured_at, any_value(s.event_last_checked) as last_seen_in_feed_on,
  count(*) as version_count, bool_or(c) filter (valid_to is null) as is_cancelled_now,
  arg_min(c, valid_from) as was_cancelled_at_first_capture,
  min(valid_from) filter (c) as cancelled_first_seen_at, 'parks-' || h.source_record_id as event_id,
  count(distinct startdate || '@' || coalesce(starttime, '?')) > 1 as was_rescheduled,
  count(distinct h.location) > 1 as was_relocated,
  is_cancelled_now and not was_cancelled_at_first_capture as cancellation_observed,
  case when is_cancelled_now and not was_cancelled_at_first_capture then cast(round(cast(date_diff('second',
    {seen}, any_value(s.start_at)) as decimal(18,6)) / 3600, 1) as double) end as cancellation_lead_hours
from (select *, regexp_matches(title, '^cancell?ed', 'i') as c from history) h
left join stg_feed s on s.event_id = 'parks-' || h.source_record_id
group by h.source_record_id having count(*) filter (valid_to is null) > 0"""
LOCAL_SEEN = "(min(valid_from) filter (c) at time zone 'UTC') at time zone 'America/New_York'"
block("lifecycle", "history stg_feed", LIFECYCLE.format(seen=LOCAL_SEEN))
block("lifecycle_utc", "history stg_feed", LIFECYCLE.format(seen="min(valid_from) filter (c)"))
SQL["event_lifecycle"] = compose("lifecycle", "select * from lifecycle")
SQL["event_lifecycle_utc"] = compose(
    "lifecycle_utc", "select event_id, cancellation_observed, cancellation_lead_hours from lifecycle_utc"
)

block(
    "reliability",
    "lifecycle observations",
    """
select 'parks-feed' as source_id, 'Parks open data feed' as source_name, *,
  cast(last_observed_on - first_observed_on as int) as observation_window_days,
  round(100e0 * cancellations_observed / nullif(events_with_observed_lifecycle, 0), 2) as observed_cancellation_rate_pct,
  round(100e0 * reschedules_observed / nullif(events_tracked, 0), 2) as reschedule_rate_pct
from (
  select count(*) as events_tracked,
    count(*) filter (not was_cancelled_at_first_capture) as events_with_observed_lifecycle,
    count(*) filter (was_cancelled_at_first_capture) as cancelled_before_tracking,
    count(*) filter (cancellation_observed) as cancellations_observed,
    count(*) filter (was_rescheduled) as reschedules_observed, count(*) filter (was_relocated) as relocations_observed,
    percentile_cont(0.5) within group (order by cancellation_lead_hours) as median_cancellation_lead_hours,
    min(cancellation_lead_hours) as min_cancellation_lead_hours, round(avg(version_count), 2) as avg_versions_per_event
  from lifecycle) t, (
  select min(observed_on) as first_observed_on, max(observed_on) as last_observed_on,
    count(distinct observed_on) as distinct_observation_days
  from observations) o""",
)
SQL["source_reliability"] = compose("reliability", "select * from reliability")

SQL["request_feasible"] = compose(
    "feasible asks",
    """
select request_id, coalesce(n, 0) as feasible_events
from asks left join (select request_id, count(*) as n from feasible group by request_id) f using (request_id)""",
)
SQL["request_scores"] = compose("pool", "select * exclude (mode) from pool")
SQL["request_top5"] = compose(
    "results", "select request_id, rank, event_id, total from results where mode <> 'surprise'"
)
SQL["request_surprise"] = compose(
    "results", "select request_id, rank, event_id, total from results where mode = 'surprise'"
)
SQL["request_explained"] = compose("shown", "select * exclude (reasons) from shown")

SQL["favorites_flag"] = compose(
    "favorites",
    """
select device_id, event_id, case when device_id is not null then f.event_id is not null end as is_favorited
from (select case when o_orderkey % 12 <> 0 then 'dev-' || (o_custkey % 50) end as device_id,
  'evt-' || o_orderkey as event_id from orders) d left join favorites f using (device_id, event_id)""",
)
SQL["favorites_count"] = compose(
    "favorites", "select device_id, count(*) as favorites from favorites group by device_id"
)
SQL["favorites_apply"] = """
select distinct 'dev-' || (o_custkey % 50) as device_id, 'evt-' || o_orderkey as event_id from orders
where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus <> 'F'"""

SQL["organization_list"] = compose(
    "organizations",
    """
select source_id, source_name as name, source_category as category, channel_type, source_url as url,
  source_image_url as image_url, upcoming_event_count from organizations""",
)
SQL["cost_labels"] = compose(
    "candidates",
    """
select event_id, case when price_amount is null then 'Cost unknown' when price_amount = 0 then 'Free'
  else '$' || cast(round(price_amount, 0) as int) end as cost_label,
  case activity_category when 'food_drink' then 'Food & Drink'
    else upper(activity_category[1]) || activity_category[2:] end as category_label
from candidates""",
)


def _rows_where(table: str, label: str, check: str, column: str, condition: str) -> str:
    return (
        f"select '{label}' as table_name, '{check}' as check_name, '{column}' as column_name, "
        f"count(*) as failing_rows from {table} where {condition}"
    )


def _null(table: str, label: str, columns: str) -> list[str]:
    return [_rows_where(table, label, "not_null", c, f"{c} is null") for c in columns.split()]


def _other(table: str, label: str, column: str, values: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values.split())
    return _rows_where(table, label, "accepted_values", column, f"{column} not in ({listed})")


def _repeated(table: str, label: str, key: str) -> str:
    inner = f"(select {key} from {table} group by {key} having count(*) > 1)"
    return _rows_where(inner, label, "unique", key, " and ".join(f"{c} is not null" for c in key.split(",")))


FEED_ROW = "(select * from stg_sources where source_id = 'parks-feed')"
CURATED_ROWS = "(select * from stg_sources where source_id <> 'parks-feed')"
ALL_CATEGORIES = "active outdoors social culture food_drink learn volunteer"

SQL["quality_report"] = compose(
    "raw_sources raw_events raw_feed zips stg_sources stg_feed history lifecycle observations enriched candidates "
    "organizations reliability clock",
    "\nunion all ".join(
        [
            *_null("raw_sources", "sources", "source_id is_active"),
            _repeated("raw_sources", "sources", "source_id"),
            *_null("raw_events", "events", "event_id source_id"),
            _repeated("raw_events", "events", "event_id"),
            _rows_where(
                "raw_events", "events", "relationships", "source_id", "source_id not in (select source_id from raw_sources)"
            ),
            *_null("raw_feed", "feed", "source_record_id"),
            _repeated("raw_feed", "feed", "source_record_id"),
            *_null("zips", "zip_centroids", "zip_code"),
            _repeated("zips", "zip_centroids", "zip_code"),
            *_null(CURATED_ROWS, "stg_sources", "source_id"),
            _repeated(CURATED_ROWS, "stg_sources", "source_id"),
            _other(CURATED_ROWS, "stg_sources", "channel_type", "website meetup instagram"),
            *_null("raw_events", "stg_events", "event_id source_id"),
            _repeated("raw_events", "stg_events", "event_id"),
            *_null("stg_feed", "stg_feed", "event_id source_id start_at is_cancelled is_virtual"),
            _repeated("stg_feed", "stg_feed", "event_id"),
            _other("stg_feed", "stg_feed", "activity_category", ALL_CATEGORIES),
            *_null(FEED_ROW, "stg_feed_source", "source_id"),
            _repeated(FEED_ROW, "stg_feed_source", "source_id"),
            _other(FEED_ROW, "stg_feed_source", "channel_type", "api"),
            *_null("history", "history", "version_id source_record_id valid_from"),
            _repeated("history", "history", "version_id"),
            *_null(
                "lifecycle",
                "lifecycle",
                "event_id source_record_id first_captured_at version_count is_cancelled_now "
                "was_cancelled_at_first_capture cancellation_observed",
            ),
            _repeated("lifecycle", "lifecycle", "event_id"),
            _repeated("lifecycle", "lifecycle", "source_record_id"),
            *_null("observations", "observations", "event_id observed_on was_cancelled_on_that_date"),
            _repeated("observations", "observations", "event_id,observed_on"),
            *_null("enriched", "enriched", "event_id source_id"),
            _repeated("enriched", "enriched", "event_id"),
            _other("enriched", "enriched", "freshness_status", "fresh stale abandoned"),
            *_null("candidates", "candidates", "event_id event_name start_at source_url"),
            _repeated("candidates", "candidates", "event_id"),
            _other("candidates", "candidates", "activity_family", "active community social_learning creative other"),
            _other(
                "candidates", "candidates", "social_structure", "group_required solo_friendly solo_or_social solo_or_group"
            ),
            _other("candidates", "candidates", "group_suitability", "solo_private solo_social couple small_group"),
            _other("candidates", "candidates", "freshness_status", "fresh stale"),
            _rows_where("candidates", "candidates", "no_abandoned", "", "freshness_status = 'abandoned'"),
            _rows_where("candidates", "candidates", "no_cancelled", "", "event_name ilike 'cancel%ed%'"),
            _rows_where(
                "candidates, clock", "candidates", "no_expired", "", "coalesce(end_at, start_at) < now_local"
            ),
            _rows_where("candidates", "candidates", "no_missing_url", "", "coalesce(source_url, '') = ''"),
            _rows_where(
                "candidates c join raw_events e using (event_id) join raw_sources s on e.source_id = s.source_id",
                "candidates",
                "no_inactive_source",
                "",
                "not s.is_active",
            ),
            _rows_where(
                "candidates c join raw_events e using (event_id)",
                "candidates",
                "unknown_price_stays_unknown",
                "",
                "e.cost is null and c.price_amount is not null",
            ),
            *_null("organizations", "organizations", "source_id source_name upcoming_event_count"),
            _repeated("organizations", "organizations", "source_id"),
            _other("organizations", "organizations", "channel_type", "website meetup instagram api"),
            *_null(
                "reliability",
                "reliability",
                "source_id observation_window_days events_tracked events_with_observed_lifecycle "
                "cancelled_before_tracking cancellations_observed",
            ),
            _repeated("reliability", "reliability", "source_id"),
        ]
    ),
)
