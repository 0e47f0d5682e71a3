"""Blocks for the requests: every request against every candidate, by brute force."""

from __future__ import annotations

from oracle.parts import block

# One decimal by the exact binary value, ties to even.
TENTH = """(floor(({x}) * 10) + case when (({x}) * 16 - (floor(({x}) * 10) * 2 + 1)) + ({x}) * 4 > 0
  or ((({x}) * 16 - (floor(({x}) * 10) * 2 + 1)) + ({x}) * 4 = 0 and floor(({x}) * 10) % 2 = 1) then 1e0 else 0e0 end) / 10"""


def tenth(expression: str) -> str:
    return TENTH.format(x=expression)


block(
    "asks",
    "requests zips",
    """
select r.*, z.zip_code as known_zip, z.lat as zlat, z.lon as zlon,
  case when intent = 'meet_people' then 'social' when mode = 'mood' then lower(nullif(vibe, '')) end as wanted
from requests r left join zips z on trim(r.zip_code) = z.zip_code""",
)

block(
    "open_candidates",
    "candidates clock",
    """
select c.*, [lower(trim(x)) for x in string_split(coalesce(vibe_tags, ''), '|') if trim(x) <> ''] as tag_list,
  cast(today_local - source_last_checked as int) as days,
  (case lower(channel_type) when 'website' then 1e0 when 'api' then 1e0 when 'meetup' then 0.85e0
    when 'instagram' then 0.6e0 else 0.5e0 end) as trust,
  3 * (case lower(update_cadence) when 'daily' then 1 when 'weekly' then 7 when 'seasonal' then 90 else 30 end)
    as ceiling,
  0.5e0 * trust + 0.5e0 * greatest(0e0, least(1e0, 1e0 - cast(days as double) / ceiling)) as conf,
  date_diff('second', start_at, end_at) / 3600e0 as hours
from candidates c, clock where start_at >= now_local""",
)

block(
    "feasible",
    "asks open_candidates",
    """
select a.request_id, a.mode, a.wanted, a.known_zip, a.zlat, a.zlon, c.*
from asks a join open_candidates c on
  (a.mode <> 'specific' or coalesce(a.category, '') = '' or lower(a.category) = lower(c.activity_category))
  and (a.max_cost is null or cast(c.price_amount as double) <= a.max_cost)
  and (a.solo_friendly is distinct from true or c.solo_friendly)
  and (a.date is null or cast(c.start_at as date) = a.date)
  and (a.after_time is null or strftime(c.start_at, '%H:%M:%S') >= a.after_time)
  and (a.hours_free is null or c.hours is null or c.hours <= a.hours_free)""",
)

block(
    "parts",
    "feasible",
    """
select request_id, mode, event_id, conf, known_zip,
  case when known_zip is not null then 2e0 * 3958.8e0 * asin(sqrt(
    sin((radians(lat) - radians(zlat)) / 2) * sin((radians(lat) - radians(zlat)) / 2)
    + cos(radians(zlat)) * cos(radians(lat))
      * (sin((radians(lon) - radians(zlon)) / 2) * sin((radians(lon) - radians(zlon)) / 2)))) end as miles,
  case when known_zip is not null then case when miles is null then 0.5e0
    else greatest(0e0, least(1e0, 1e0 - miles / 8e0)) end end as prox,
  case when wanted is not null then cast(list_contains(tag_list, wanted) as int)::double end as vibe,
  0.25e0 + case when prox is null then 0e0 else 0.35e0 end + case when vibe is null then 0e0 else 0.4e0 end as weight,
  (conf * (0.25e0 / weight) + coalesce(prox * (0.35e0 / weight), 0e0) + coalesce(vibe * (0.4e0 / weight), 0e0)) * 100
    as percent
from feasible""",
)

block("scored", "parts", f"select *, {tenth('percent')} as total from parts")

block(
    "pool",
    "scored",
    f"""
select request_id, mode, cast(row_number() over w as int) as position, event_id, total,
  {tenth("conf * 100")} as confidence_score,
  case when conf >= 0.75e0 then 'High' when conf >= 0.45e0 then 'Medium' else 'Low' end as confidence_label,
  {tenth("prox * 100")} as proximity_score, {tenth("miles")} as distance_miles, {tenth("vibe * 100")} as vibe_score
from scored window w as (partition by request_id order by total desc, event_id)
qualify row_number() over w <= 10""",
)

block(
    "results",
    "pool",
    """
select * exclude (chance), cast(row_number() over (partition by request_id order by
    case when mode = 'surprise' then -ln(chance) / greatest(total, 1e0) else position end, event_id) as int) as rank
from (select *, (cast(('0x' || md5('0|' || request_id || '|' || event_id)[1:13]) as bigint) + 1) / 4503599627370496e0
  as chance from pool) p
qualify rank <= 5""",
)

# A number of at most one decimal and below a million, as short text.
SHORT = "regexp_replace(cast(cast({x} as decimal(12,2)) as varchar), '\\.?0+$', '')"


def short(expression: str) -> str:
    return SHORT.format(x=expression)


block(
    "shown",
    "results asks open_candidates favorites",
    f"""
select r.request_id, r.rank, r.event_id, c.event_name as title, c.activity_category as category,
  c.start_at as start_time, c.end_at as end_time, cast(c.price_amount as double) as cost, c.location, c.solo_friendly,
  c.source_url, c.source_name, c.source_last_checked as source_verified_date, r.distance_miles, r.confidence_label,
  r.confidence_score, r.total as score,
  [x for x in [
    case when a.mode = 'specific' and a.category <> '' then 'matches your interest in ' || c.activity_category end,
    case when a.max_cost is not null then 'costs $' || {short("c.price_amount")} || ', within your $'
      || {short("a.max_cost")} || ' budget' end,
    case when a.solo_friendly then 'welcomes solo attendees' end,
    case when a.date is not null then 'is happening on ' || cast(c.start_at as date) end,
    case when a.hours_free is not null then 'fits within the ' || {short("a.hours_free")}
      || ' hour(s) you have free' end,
    case a.intent when 'meet_people' then 'is a good fit for meeting people'
      when 'solo_time' then 'works well for solo time' end,
    case when a.mode = 'mood' and r.vibe_score = 100 then 'matches the ''' || a.vibe || ''' vibe you asked for'
      when a.mode = 'mood' then 'was the closest available match for a ''' || a.vibe || ''' vibe' end,
    case when a.mode = 'surprise' then 'was picked as a surprise from your top-ranked feasible options' end,
    case when r.distance_miles is not null then 'is about ' || {short("r.distance_miles")} || ' miles from ZIP '
      || a.zip_code end] if x is not null] as reasons,
  'Fits because it ' || case when len(reasons) > 0 then array_to_string(reasons, ', ')
      else 'is a ' || c.activity_category || ' activity happening ' || cast(c.start_at as date) end
    || '. Score: ' || {short("r.total")} || '/100 (confidence: ' || r.confidence_label || ' -- ' || c.channel_type
    || ' source, last verified ' || c.days || ' day(s) ago (usually updated ' || coalesce(c.update_cadence, 'None')
    || ')). Source: ' || c.source_name || ' -- last checked ' || c.source_last_checked || '.' as explanation,
  c.image_url,
  case c.activity_category when 'food_drink' then 'Food & Drink'
    else upper(c.activity_category[1]) || c.activity_category[2:] end as category_label,
  category_label || case when c.activity_category = 'outdoors' and list_contains(tag_list, 'chill') then '|Chill'
    when c.activity_category = 'culture' and list_contains(tag_list, 'creative') then '|Creative'
    when list_contains(tag_list, 'social') then '|Social' when list_contains(tag_list, 'chill') then '|Chill'
    else '' end as badges,
  array_to_string([x for x in [case when c.beginner_friendly then 'Beginner friendly' end,
    case when c.solo_friendly and list_contains(tag_list, 'solo_focus') then 'Great for solo' end,
    case when list_contains(tag_list, 'social') then 'Meet people' end,
    case when list_contains(tag_list, 'chill') then 'Casual' end,
    case when c.activity_category = 'outdoors' then 'Outdoor' end] if x is not null], '|') as tags,
  cast(round_even(r.distance_miles / 12e0 * 60, 0) as int) as estimated_transit_minutes,
  cast(round_even(date_diff('second', c.start_at, c.end_at) / 60e0, 0) as int) as duration_minutes,
  f.event_id is not null as is_favorited
from results r join asks a using (request_id) join open_candidates c using (event_id)
left join favorites f on f.device_id = a.device_id and f.event_id = r.event_id""",
)
