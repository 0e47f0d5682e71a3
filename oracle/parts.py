"""Named SQL building blocks for the DuckDB side of the comparison.

Each block may use the blocks listed with it; ``compose`` collects them in order. The blocks are written from the
rules, not generated from the DataFrame code, so that the two sides check each other.
"""

from __future__ import annotations

BLOCKS: dict[str, tuple[list[str], str]] = {}


def block(name: str, needs: str, sql: str) -> None:
    BLOCKS[name] = (needs.split(), sql)


def compose(needs: str, body: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in BLOCKS[name][0]:
            visit(other)
        ordered.append(name)

    for name in needs.split():
        visit(name)
    ctes = ",\n".join(f"{name} as ({BLOCKS[name][1].strip()})" for name in ordered)
    return f"with {ctes}\n{body.strip()}" if ctes else body.strip()


CATEGORY = """case {key} % 7 when 0 then 'active' when 1 then 'outdoors' when 2 then 'social' when 3 then 'culture'
  when 4 then 'food_drink' when 5 then 'learn' else 'volunteer' end"""

block(
    "raw_sources",
    "",
    f"""
select 'src-' || s_suppkey as source_id, s_name as name, {CATEGORY.format(key="s_suppkey")} as category,
  case s_suppkey % 5 when 0 then 'website' when 1 then 'meetup' when 2 then 'instagram' when 3 then 'website'
    else 'newsletter' end as channel_type,
  'https://s' || s_suppkey || '.example.org' as url,
  case s_suppkey % 4 when 0 then 'daily' when 1 then 'weekly' when 2 then 'seasonal' end as update_cadence,
  cast(date '2024-01-15' - cast(s_suppkey * 13 % 60 as int) as date) as last_checked,
  case when s_suppkey % 6 = 0 then 'Weekly meetups; Beginner friendly' end as notes,
  s_suppkey % 7 <> 5 as is_active, cast(null as varchar) as image_url
from supplier""",
)

block(
    "raw_events",
    "",
    f"""
select 'evt-' || o_orderkey as event_id,
  case when o_orderkey % 97 = 0 then 'src-missing' else 'src-' || (o_custkey % 10) end as source_id,
  (case when o_orderkey % 11 = 0 then 'Beginner session ' else 'Session ' end) || o_orderkey as title,
  {CATEGORY.format(key="o_orderkey")} as category,
  timestamp '2024-01-01 08:00:00' + (o_orderkey % 720) * interval '1' hour as start_time,
  case when o_orderkey % 5 <> 0
    then timestamp '2024-01-01 08:00:00' + (o_orderkey % 720 + 1 + o_orderkey % 4) * interval '1' hour end as end_time,
  case when o_orderkey % 13 = 0 then null when o_orderkey % 53 = 0 then cast(-1 as decimal(12,2))
    else cast(o_orderkey % 40 as decimal(12,2)) end as cost,
  'Venue ' || (o_orderkey % 40) as location,
  case o_orderkey % 3 when 0 then true when 1 then false end as solo_friendly,
  case when o_orderkey % 17 = 0 then '' when o_orderkey % 19 = 0 then null
    else 'https://e.example.org/' || o_orderkey end as source_url,
  date '2024-01-10' as last_checked,
  case when o_orderkey % 23 <> 0 then cast(10000 + o_custkey % 30 as varchar) end as zip_code,
  case when o_orderkey % 29 <> 0 then 40.55e0 + (o_orderkey % 40) * 0.0075e0 end as lat,
  case when o_orderkey % 29 <> 0 then -74.1e0 + (o_orderkey % 35) * 0.01e0 end as lon,
  case o_orderkey % 6 when 0 then 'energetic|social' when 1 then 'chill|solo_focus' when 2 then 'creative|social'
    when 3 then 'chill' when 4 then 'energetic' end as vibe_tags,
  cast(null as varchar) as image_url
from orders""",
)

FEED_COLUMNS = """cast(user_id as varchar) as source_record_id,
  (case when event_type = 'error' then 'CANCELED: ' else '' end) || 'Class ' || user_id as title,
  cast(date '2024-01-10' + cast(user_id % 20 as int)
    + case when event_type = 'purchase' and user_id % 3 = 0 then 1 else 0 end as date) as startdate,
  cast(null as date) as enddate,
  case when user_id % 9 <> 0 then '2024-01-01 18:30:00' when user_id % 2 = 0 then 'TBD' end as starttime,
  case when user_id % 4 = 0 then '2024-01-01 17:00:00' when user_id % 4 <> 3 then '2024-01-01 20:00:00' end as endtime,
  case when event_type = 'signup' and user_id % 2 = 0 then '' else 'Field ' || (user_id % 12) end as location,
  'Park ' || (user_id % 5) as parknames,
  case user_id % 6 when 0 then 'Fitness | Volunteer | Gardening' when 1 then 'Fitness | Outdoor Fitness'
    when 2 then 'Arts & Crafts' when 3 then 'Games' when 4 then 'Seniors' else 'Tours | Virtual/Online Events'
    end as categories,
  'https://p.example.org/' || user_id as link_url,
  case when user_id % 3 = 0 then '' end as registration_url,
  case when user_id % 7 <> 0 then 40.55e0 + (user_id % 50) * 0.006e0 end as lat,
  case when user_id % 7 <> 0 then -74.1e0 + (user_id % 45) * 0.008e0 end as lon,
  case when user_id % 10 = 0 then 'All levels welcome' when user_id % 10 = 1 then 'Bring water' end as description,
  cast(cast(ts as date) as timestamp) + interval '23' hour as ingested_at"""

block(
    "feed_batches",
    "",
    f"""
select {FEED_COLUMNS} from events
qualify row_number() over (partition by user_id, cast(ts as date) order by ts desc, event_id desc) = 1""",
)

block(
    "raw_feed",
    "feed_batches",
    """
select * from feed_batches
qualify row_number() over (partition by source_record_id order by ingested_at desc) = 1""",
)

block(
    "zips",
    "",
    """
select cast(10000 + n_nationkey as varchar) as zip_code, 40.55e0 + n_nationkey * 0.0125e0 as lat,
  -74.1e0 + n_nationkey * 0.014e0 as lon, r_name as borough
from nation join region on n_regionkey = r_regionkey""",
)

block(
    "favorites",
    "",
    """
select distinct 'dev-' || (o_custkey % 50) as device_id, 'evt-' || o_orderkey as event_id
from orders where o_orderpriority = '1-URGENT'""",
)

block(
    "requests",
    "",
    """
select 'req-' || c_custkey as request_id,
  case c_custkey % 3 when 0 then 'specific' when 1 then 'mood' else 'surprise' end as mode,
  case c_custkey % 4 when 0 then 'active' when 1 then 'Culture' end as category,
  case when c_custkey % 5 = 0 then cast(c_custkey % 25 as double) end as max_cost,
  case when c_custkey % 7 = 0 then true end as solo_friendly,
  case when c_custkey % 11 = 0 then date '2024-01-20' end as date,
  case when c_custkey % 2 = 0 then cast(10000 + c_nationkey + c_custkey % 8 as varchar) end as zip_code,
  case c_custkey % 9 when 1 then 'chill' when 4 then 'social' when 7 then 'creative' end as vibe,
  case when c_custkey % 6 = 0 then 2e0 end as hours_free,
  case c_custkey % 10 when 3 then 'meet_people' when 6 then 'solo_time' when 9 then 'explore' end as intent,
  case when c_custkey % 8 = 0 then '15:00:00' end as after_time,
  'dev-' || (c_custkey % 60) as device_id
from customer""",
)

block(
    "stg_sources",
    "raw_sources raw_feed",
    """
select source_id, name as source_name, category as source_category, channel_type, url as source_url, update_cadence,
  last_checked as source_last_checked, notes as source_notes, is_active, image_url as source_image_url
from raw_sources
union all
select 'parks-feed', 'Parks open data feed', 'outdoors', 'api', 'https://feed.example.org/events.json', 'daily',
  cast(max(ingested_at) as date), 'Public feed of upcoming park events, loaded by machine', true, null
from raw_feed""",
)

TIME_FORM = r"'^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$'"

block(
    "stg_feed",
    "raw_feed",
    f"""
select 'parks-' || source_record_id as event_id, 'parks-feed' as source_id, title as event_name,
  case when regexp_matches(categories, 'volunteer', 'i') then 'volunteer'
    when regexp_matches(categories, 'food', 'i') then 'food_drink'
    when regexp_matches(categories, 'nature|wildlife|gardening|waterfront|fishing|birding|urban park rangers', 'i')
      then 'outdoors'
    when regexp_matches(categories, 'education|stem|talk|tour', 'i') then 'learn'
    when regexp_matches(categories, 'games', 'i') then 'social'
    when regexp_matches(categories, 'art|film|concert|movie|history|theater|literary', 'i') then 'culture'
    when regexp_matches(categories,
      'fitness|exercise|dance|running|jogging|yoga|pilates|sports|recreation center', 'i') then 'active'
  end as activity_category,
  s as start_at, case when e > s then e end as end_at, cast(null as decimal(12,2)) as price_amount,
  coalesce(nullif(location, ''), parknames) as location, cast(null as boolean) as solo_friendly,
  coalesce(nullif(registration_url, ''), link_url) as event_source_url, cast(ingested_at as date) as event_last_checked,
  cast(null as varchar) as zip_code, lat, lon, cast(null as varchar) as vibe_tags, cast(null as varchar) as image_url,
  description as event_description,
  regexp_matches(title, '^cancell?ed', 'i') as is_cancelled,
  regexp_matches(categories, 'virtual/online', 'i') as is_virtual
from (
  select *,
    startdate + coalesce(
      case when regexp_matches(starttime, {TIME_FORM}) then try_cast(starttime[12:19] as time) end, time '00:00') as s,
    coalesce(enddate, startdate)
      + case when regexp_matches(endtime, {TIME_FORM}) then try_cast(endtime[12:19] as time) end as e
  from raw_feed) f""",
)

block(
    "all_events",
    "raw_events stg_feed",
    """
select event_id, source_id, title as event_name, category as activity_category, start_time as start_at,
  end_time as end_at, cost as price_amount, location, solo_friendly, source_url as event_source_url,
  last_checked as event_last_checked, zip_code, lat, lon, vibe_tags, image_url,
  cast(null as varchar) as event_description, false as is_cancelled, false as is_virtual
from raw_events
union all by name
select * from stg_feed""",
)

block("clock", "", "select timestamp '2024-01-15 12:00:00' as now_local, date '2024-01-15' as today_local")

block(
    "sourced",
    "all_events stg_sources zips clock",
    """
select e.*, s.source_name, s.channel_type, s.update_cadence, s.source_last_checked, s.source_notes, s.is_active,
  z.borough,
  case s.update_cadence when 'daily' then 1 when 'seasonal' then 90 else 7 end as cadence_days,
  cast(today_local - s.source_last_checked as int) as days_since_checked
from all_events e left join stg_sources s using (source_id) left join zips z using (zip_code), clock""",
)

block(
    "fresh",
    "sourced",
    """
select *,
  case when days_since_checked <= 2 * cadence_days then 'fresh' when days_since_checked <= 8 * cadence_days then 'stale'
    else 'abandoned' end as freshness_status,
  solo_friendly is not null or vibe_tags is not null as audience_data_available,
  coalesce(vibe_tags like '%solo_focus%', false) as t_solo, coalesce(vibe_tags like '%social%', false) as t_social,
  coalesce(vibe_tags like '%chill%', false) as t_chill, coalesce(vibe_tags like '%creative%', false) as t_creative,
  coalesce(vibe_tags like '%energetic%', false) as t_energetic,
  coalesce(solo_friendly, false) as solo_yes, coalesce(not solo_friendly, false) as solo_no
from sourced""",
)

block(
    "fit",
    "fresh",
    """
select *,
  case when audience_data_available then least(100, greatest(0,
    50 * solo_yes::int + 30 * t_solo::int + 20 * t_chill::int - 20 * t_social::int)) end as solo_private_score,
  case when audience_data_available then
    50 * solo_yes::int + 40 * t_social::int + 10 * t_energetic::int end as solo_social_score,
  case when audience_data_available then
    60 + 20 * (t_chill or t_creative)::int + 10 * solo_no::int end as couple_score,
  case when audience_data_available then
    50 + 30 * solo_no::int + 20 * coalesce(activity_category in ('active', 'outdoors'), false)::int
  end as small_group_score
from fresh""",
)

block(
    "enriched",
    "fit",
    """
select event_id, event_name, source_id, source_name, channel_type, is_active, activity_category,
  case when activity_category in ('active', 'outdoors') then 'active' when activity_category = 'volunteer'
    then 'community' when activity_category = 'social' then 'social_learning' when activity_category = 'culture'
    then 'creative' else 'other' end as activity_family,
  case when activity_category = 'active' and t_social then 'social'
    when activity_category = 'outdoors' and t_chill then 'chill'
    when activity_category = 'culture' and t_creative then 'creative'
    when t_social then 'social' when t_chill then 'chill' end as secondary_badge,
  start_at, end_at, price_amount, location, solo_friendly, event_source_url, image_url, zip_code, borough, vibe_tags,
  freshness_status,
  (source_notes is not null and contains(lower(source_notes), 'beginner')) or contains(lower(event_name), 'beginner')
    or coalesce(regexp_matches(event_description, 'beginner|all levels|no experience', 'i'), false)
    as beginner_friendly,
  case channel_type when 'instagram' then 100 when 'meetup' then 80 when 'website' then 50 when 'api' then 30
    else 40 end as discovery_score,
  (case freshness_status when 'fresh' then 100 when 'stale' then 50 else 0 end
    + case when coalesce(event_source_url, '') = '' then 0 else 100 end) / 2e0 as actionability_score,
  solo_private_score, solo_social_score, couple_score, small_group_score, audience_data_available, is_cancelled,
  is_virtual, event_description, lat, lon, update_cadence, source_last_checked,
  case when audience_data_available then
    list_extract(['solo_private', 'solo_social', 'couple', 'small_group'], list_position(
      [solo_private_score, solo_social_score, couple_score, small_group_score],
      greatest(solo_private_score, solo_social_score, couple_score, small_group_score))) end as group_suitability,
  case when not audience_data_available then null when solo_no then 'group_required' when t_solo then 'solo_friendly'
    when t_social then 'solo_or_social' else 'solo_or_group' end as social_structure
from fit""",
)

block(
    "candidates",
    "enriched clock",
    """
select event_id, event_name, activity_category, activity_family, secondary_badge, social_structure, group_suitability,
  audience_data_available, solo_private_score, solo_social_score, couple_score, small_group_score, beginner_friendly,
  price_amount, start_at, end_at, location, borough, zip_code, lat, lon, solo_friendly, vibe_tags, is_virtual,
  freshness_status, actionability_score, discovery_score, image_url, source_id, source_name, channel_type,
  update_cadence, source_last_checked, event_source_url as source_url
from enriched, clock
where start_at is not null and coalesce(end_at, start_at) >= now_local and is_active and event_source_url <> ''
  and event_name is not null and location is not null and activity_category is not null
  and coalesce(price_amount, 0) >= 0 and freshness_status in ('fresh', 'stale') and is_cancelled = false""",
)
