"""Ranks the candidates for many requests at once.

A request is never paired with every candidate. The work goes through three reductions, each of them exact:

* requests that ask for the same thing share one *profile*, and profiles with the same hard constraints one *scope*;
* candidates that no profile of a scope can tell apart (same confidence, same tags, same place) form a *cell*, of
  which only the first few by id can ever be chosen, so a cell keeps no more than that, and neither does a class of
  candidates that are alike to all scopes, before any scope is met;
* a cell that ten others of a profile beat is left out before its events are unfolded.

Scopes meet candidates through an equality join on category and date, profiles meet cells through one on scope and
area. Beyond the proximity radius a place makes no difference to the score, so there a scope has one *far* cell for all
places; a profile with an origin meets the cells of the tiles around it, and the far cells. The size of all this depends
on the number of distinct constraints, confidence levels and places nearby, not on the number of rows: however many
copies of an event exist, they end in one cell.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outpulse.clock import Clock
from outpulse.functions import scoring
from outpulse.functions.geo import haversine_miles, tile, tiles_within
from outpulse.functions.rounding import round_tenth
from outpulse.functions.text import tag_set
from outpulse.operators.joins import is_small, lookup_join, salted_join
from outpulse.session import settle

# Results per request, and the pool that a surprise is drawn from.
MAX_RESULTS = 5
POOL_SIZE = 10

CONSTRAINTS = ["category_key", "max_cost", "solo_required", "date", "after_seconds", "hours_free"]
# What tells the candidates of a scope apart, as text: grouping by doubles would shuffle once more to normalise them.
CELL = ["scope_key", "area", "confidence_text", "tags_text", "cell_spot"]
NOWHERE = ""
FAR = "far"
TAG_SEPARATOR = "|"
# Stands for "any" in a route; real values carry a mark, so they cannot be mistaken for it.
ANY = "*"


def _key(*columns: str) -> Column:
    """A fixed-length text that is equal when the columns are equal, NULLs included."""
    return F.md5(F.to_json(F.struct(*columns)))


def _exact(value: Column) -> Column:
    return F.concat(F.lit("="), value.cast("string"))


def _seconds(text: Column) -> Column:
    parts = F.split(text, ":")
    hours, minutes = F.get(parts, 0).cast("int"), F.get(parts, 1).cast("int")
    return hours * 3600 + minutes * 60 + F.coalesce(F.get(parts, 2).try_cast("double"), F.lit(0.0))


def _given(text: Column) -> Column:
    """An empty text is as good as none."""
    return F.nullif(text, F.lit(""))


def asked(requests: DataFrame, zips: DataFrame) -> DataFrame:
    """Requests with what they ask for in comparable form, and with their profile and scope keys."""
    mode, intent = F.col("mode"), F.col("intent")
    vibe = F.when(intent == "meet_people", "social").when(mode == "mood", F.lower(_given(F.col("vibe"))))
    centroids = zips.select(
        F.col("zip_code").alias("zip_key"), F.col("lat").alias("origin_lat"), F.col("lon").alias("origin_lon")
    )
    located = lookup_join(
        requests.withColumn("zip_key", F.trim("zip_code")), centroids, "zip_key", spread_by="request_id"
    )
    known = F.col("origin_lat").isNotNull() & F.col("origin_lon").isNotNull()
    return (
        located.withColumns(
            {
                "category_key": F.when(mode == "specific", F.lower(_given(F.col("category")))),
                "max_cost": F.col("max_cost").cast("double"),
                "solo_required": F.coalesce("solo_friendly", F.lit(False)),
                "after_seconds": _seconds(F.col("after_time")),
                "wanted_vibe": vibe,
                "origin_known": known,
                "zip_key": F.when(known, F.col("zip_key")),
            }
        )
        .withColumn("scope_key", _key(*CONSTRAINTS, "origin_known"))
        .withColumn("profile_key", _key("scope_key", "wanted_vibe", "zip_key"))
    )


def rankable(candidates: DataFrame, clock: Clock) -> DataFrame:
    """What ranking needs of a candidate that has not started yet."""
    age = F.datediff(clock.today_local(), F.col("source_last_checked"))
    start, end = F.col("start_at"), F.col("end_at")
    return candidates.filter(start >= clock.now_local()).select(
        "event_id",
        F.lower("activity_category").alias("category_key"),
        F.to_date(start).alias("start_date"),
        (F.hour(start) * 3600 + F.minute(start) * 60 + F.extract(F.lit("SECOND"), start)).cast("double").alias("start_seconds"),
        (F.timestamp_diff("MICROSECOND", start, end) / F.lit(3.6e9)).alias("duration_hours"),
        F.col("price_amount").cast("double").alias("cost"),
        F.coalesce("solo_friendly", F.lit(False)).alias("solo_ok"),
        F.array_join(F.array_sort(F.array_distinct(tag_set(F.col("vibe_tags")))), TAG_SEPARATOR).alias("tags_text"),
        F.coalesce(
            scoring.confidence(F.col("channel_type"), F.col("update_cadence"), age).cast("string"), F.lit("")
        ).alias("confidence_text"),
        F.coalesce(F.concat(F.col("lat").cast("string"), F.lit(","), F.col("lon").cast("string")), F.lit(NOWHERE)).alias(
            "spot"
        ),
        tile(F.col("lat"), F.col("lon")).alias("tile"),
    )


def satisfies() -> Column:
    """The hard constraints that are no plain equality. An unknown price or solo flag fails, an unknown end passes."""
    return (
        (F.col("max_cost").isNull() | F.coalesce(F.col("cost") <= F.col("max_cost"), F.lit(False)))
        & (~F.col("solo_required") | F.col("solo_ok"))
        & (F.col("after_seconds").isNull() | (F.col("start_seconds") >= F.col("after_seconds")))
        & (
            F.col("hours_free").isNull()
            | F.col("duration_hours").isNull()
            | (F.col("duration_hours") <= F.col("hours_free"))
        )
    )


def feasible_for(candidates: DataFrame, clock: Clock, **constraints) -> DataFrame:
    """All candidates that one request allows: a filter, as the request's values are literals."""
    given = {name: constraints.get(name) for name in ("category", "max_cost", "solo_friendly", "date", "after_time", "hours_free")}
    rows = candidates
    start = F.col("start_at")
    condition = start >= clock.now_local()
    if constraints.get("mode", "specific") == "specific" and given["category"]:
        condition = condition & (F.lower("activity_category") == given["category"].lower())
    if given["max_cost"] is not None:
        condition = condition & (F.col("price_amount").cast("double") <= float(given["max_cost"]))
    if given["solo_friendly"] is True:
        condition = condition & F.col("solo_friendly")
    if given["date"] is not None:
        condition = condition & (F.to_date(start) == F.lit(str(given["date"])).cast("date"))
    if given["after_time"] is not None:
        condition = condition & (F.date_format(start, "HH:mm:ss") >= str(given["after_time"]))
    if given["hours_free"] is not None:
        hours = F.timestamp_diff("MICROSECOND", start, F.col("end_at")) / F.lit(3.6e9)
        condition = condition & (hours.isNull() | (hours <= float(given["hours_free"])))
    return rows.filter(condition)


def _in_scope(events: DataFrame, scopes: DataFrame) -> DataFrame:
    """Candidates with every scope that allows them.

    A candidate offers four routes (its category or any, its date or any) and a scope takes exactly one of them, so
    the join is an equality join and yields feasible pairs only.
    """
    category, date = _exact(F.col("category_key")), _exact(F.col("start_date"))
    routes = [
        F.struct(c.alias("route_category"), d.alias("route_date"))
        for c in (category, F.lit(ANY))
        for d in (date, F.lit(ANY))
    ]
    offered = events.select("*", F.inline(F.array(*routes))).drop("category_key", "start_date")
    taken = scopes.select(
        F.coalesce(_exact(F.col("category_key")), F.lit(ANY)).alias("route_category"),
        F.coalesce(_exact(F.col("date")), F.lit(ANY)).alias("route_date"),
        "scope_key",
        "origin_known",
        "max_cost",
        "solo_required",
        "after_seconds",
        "hours_free",
    )
    pairs = lookup_join(offered, taken, ["route_category", "route_date"], spread_by="event_id", how="inner")
    return pairs.filter(satisfies())


#: The thresholds that wishes set, by the measure of an event that they bound.
THRESHOLDS = {"cost": "max_cost", "start_seconds": "after_seconds", "duration_hours": "hours_free"}
ROUTE = ["route_category", "route_date"]


def _shifted(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def _below(values: Column, levels: Column, wanted: Column) -> Column:
    """How many of the sorted ``values`` are below ``wanted``: a binary search in steps of halving size."""
    steps = F.transform(F.sequence(levels, F.lit(0), F.lit(-1)), lambda level: F.call_function("shiftleft", F.lit(1).cast("bigint"), level))
    reaches = lambda n: (n <= F.size(values)) & (F.get(values, (n - 1).cast("int")) < wanted)
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda found, step: F.when(reaches(found + step), found + step).otherwise(found))


def _even_blocks(levels: Column, number: Callable[[Column], Column]) -> Column:
    """The blocks of doubling size with an even number, by level. Blocks of a prefix are always such."""
    every = F.transform(F.sequence(F.lit(0), levels), lambda level: F.struct(level.alias("level"), number(level).alias("number")))
    return F.filter(every, lambda block: block["number"] % 2 == 0)


def _limits(scopes: DataFrame) -> DataFrame:
    """One row: the sorted thresholds of every kind, as many as wishes tell apart."""
    return F.broadcast(scopes.agg(*[F.array_sort(F.collect_set(name)).alias(f"all_{name}") for name in THRESHOLDS.values()]))


def _levels(name: str) -> Column:
    """Places run from 0 to the number of thresholds; that many levels make one block of them all."""
    return F.ceil(F.log2(F.size(f"all_{name}") + 1)).cast("int")


def _place(measure: str) -> Column:
    """The place of an event among the thresholds of a measure. Equal places satisfy the same scopes."""
    name = THRESHOLDS[measure]
    value, size = F.col(measure), F.size(f"all_{name}")
    below = _below(F.col(f"all_{name}"), _levels(name), value)
    if measure == "start_seconds":
        # A start is late enough for the thresholds up to it, so its place is counted from the end.
        below = size - below - F.array_contains(f"all_{name}", value).cast("int")
    # An unknown end is short enough for all, an unknown price or start never good enough.
    return F.when(value.isNull(), F.lit(0) if measure == "duration_hours" else size).otherwise(below).cast("bigint")


def _first_of_class(events: DataFrame, scopes: DataFrame, size: int) -> DataFrame:
    """The first ``size`` events by id of those that satisfy the same scopes and are alike in rank and place.

    No others of a class can be chosen, so what meets the scopes grows with the classes and not with the events.
    """
    places = [f"_{name}_place" for name in THRESHOLDS]
    alike = ["category_key", "start_date", "solo_ok", *places, "confidence_text", "tags_text", "spot"]
    first = W.partitionBy(*alike).orderBy("event_id")
    placed = events.join(_limits(scopes)).select(*events.columns, *[_place(name).alias(f"_{name}_place") for name in THRESHOLDS])
    return placed.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= size).select(*events.columns)


def feasible_counts(wishes: DataFrame, events: DataFrame) -> DataFrame:
    """``(request_id, feasible_events)``, without pairing any scope with any event.

    Every bound of a scope is a prefix of the sorted thresholds of its kind, so an event is only known by its place among
    them: events fold into classes, and there are no more classes than combinations of thresholds. A prefix is made of
    blocks of doubling size, at most one of each size. Classes are counted per block of each measure, and a scope adds the
    counts of its blocks, which it finds by equality.
    """
    scopes = wishes.select("scope_key", *CONSTRAINTS, "origin_known").distinct()
    limits = _limits(scopes)

    def scopes_length(name: str) -> Column:
        """How many places a scope's bound takes in, from the first on."""
        given = F.array_position(f"all_{name}", F.col(name)).cast("bigint")
        if name == "after_seconds":
            given = F.size(f"all_{name}") - given + 1
        return F.when(F.col(name).isNull(), F.call_function("shiftleft", F.lit(1).cast("bigint"), _levels(name))).otherwise(given)

    names = list(THRESHOLDS.values())
    located = events.join(limits).select(
        _exact(F.col("category_key")).alias("category"),
        _exact(F.col("start_date")).alias("date"),
        "solo_ok",
        *[_place(measure).alias(name) for measure, name in THRESHOLDS.items()],
        *[_levels(name).alias(f"levels_{name}") for name in names],
    )
    level_columns = [f"levels_{name}" for name in names]
    classes = located.groupBy("category", "date", "solo_ok", *names, *level_columns).agg(F.count(F.lit(1)).alias("n"))
    routes = [
        F.struct(c.alias("route_category"), d.alias("route_date"))
        for c in (F.col("category"), F.lit(ANY))
        for d in (F.col("date"), F.lit(ANY))
    ]
    offered = classes.select("solo_ok", *names, *level_columns, "n", F.inline(F.array(*routes)))
    offered = offered.withColumn("solo_required", F.explode(F.when(F.col("solo_ok"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    for name in names:
        place = F.col(name)
        offered = offered.withColumn(name, F.explode(_even_blocks(F.col(f"levels_{name}"), lambda level: _shifted(place, level))))
    blocks = [*ROUTE, "solo_required", *names]
    counted = offered.groupBy(*blocks).agg(F.sum("n").alias("n"))

    taken = scopes.join(limits).select(
        "scope_key",
        F.coalesce(_exact(F.col("category_key")), F.lit(ANY)).alias("route_category"),
        F.coalesce(_exact(F.col("date")), F.lit(ANY)).alias("route_date"),
        "solo_required",
        *[scopes_length(name).alias(name) for name in names],
        *[_levels(name).alias(f"levels_{name}") for name in names],
    )
    for name in names:
        # The bits of a length are the sizes of its blocks.
        length = F.col(name)
        taken = taken.withColumn(name, F.explode(_even_blocks(F.col(f"levels_{name}"), lambda level: _shifted(length, level) - 1)))
    per_scope = taken.join(counted, blocks).groupBy("scope_key").agg(F.sum("n").alias("feasible_events"))
    counts = _by_request(wishes.select("request_id", "scope_key"), per_scope, "scope_key", is_small(scopes), "left")
    return counts.select("request_id", F.coalesce("feasible_events", F.lit(0)).cast("bigint").alias("feasible_events"))


def _by_request(requests: DataFrame, grouped: DataFrame, key: str, small: bool, how: str) -> DataFrame:
    """Requests with a row of ``grouped``, whose number of rows is that of a side already proven small, or not."""
    if small:
        return requests.join(F.broadcast(grouped), key, how)
    return salted_join(requests, grouped, [key], spread_by="request_id", how=how)


@dataclass(frozen=True)
class Ranking:
    """``ranked`` has a row per profile with an array ``pool`` of at most ``POOL_SIZE`` entries, best first."""

    ranked: DataFrame
    few_profiles: bool

    def settled(self) -> Ranking:
        """The same, computed once for a plan that uses it several times."""
        return Ranking(settle(self.ranked), self.few_profiles)


def _cells(events: DataFrame, scopes: DataFrame, size: int) -> DataFrame:
    """What the profiles of a scope can tell apart, with the first ``size`` events of each by id.

    An event with a place is in the cell of its place, and in the far cell, which ignores the place. Keeping the first
    ids happens in every map task before the shuffle. Cells are then dealt out evenly.
    """
    partitions = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def area(name: Column, spot: Column) -> Column:
        return F.struct(name.alias("area"), spot.alias("cell_spot"))

    here = area(F.col("tile"), F.col("spot"))
    far, anywhere = area(F.lit(ANY), F.lit(FAR)), area(F.lit(ANY), F.lit(NOWHERE))
    placed = F.col("origin_known") & (F.col("spot") != NOWHERE)
    # The hash comes first only because it settles most comparisons of the sort; the full key decides.
    cell = ["_hash", *CELL]
    in_cell = W.partitionBy(*cell).orderBy("event_id")
    place = F.split("cell_spot", ",")
    return (
        _in_scope(_first_of_class(events, scopes, size).repartition(partitions, "event_id"), scopes)
        .select("*", F.inline(F.when(placed, F.array(here, far)).otherwise(F.array(anywhere))))
        .select("event_id", "spot", *CELL, F.xxhash64(*CELL).alias("_hash"))
        .withColumn("_n", F.row_number().over(in_cell))
        .filter(F.col("_n") <= size)
        .repartition(partitions, *cell)
        .groupBy(*cell)
        .agg(F.collect_list(F.struct("event_id", "spot")).alias("members"))
        .select(
            "scope_key",
            "area",
            F.col("confidence_text").try_cast("double").alias("confidence"),
            F.split("tags_text", r"\|").alias("tags"),
            (F.col("area") != ANY).alias("near"),
            (F.col("cell_spot") == FAR).alias("far"),
            F.get(place, 0).try_cast("double").alias("lat"),
            F.get(place, 1).try_cast("double").alias("lon"),
            "members",
        )
    )


def rank(wishes: DataFrame, events: DataFrame, pool_size: int = POOL_SIZE) -> Ranking:
    """The best candidates of every profile: by total, then by event id."""
    scopes = wishes.select("scope_key", *CONSTRAINTS, "origin_known").distinct()
    profiles = wishes.select(
        "profile_key", "scope_key", "wanted_vibe", "origin_known", "origin_lat", "origin_lon"
    ).distinct()
    around = tiles_within(F.col("origin_lat"), F.col("origin_lon"), scoring.MAX_PROXIMITY_MILES)
    areas = F.when(F.col("origin_known"), F.array_append(around, F.lit(ANY))).otherwise(F.array(F.lit(ANY)))
    few = is_small(profiles.select(F.explode(areas)))
    cells = _cells(events, scopes, pool_size)
    if not few:
        # Finding the hot scopes takes a pass of its own over the cells.
        cells = settle(cells)

    # The cells that each profile meets, with the components of the score. A far cell has no proximity.
    keys = ["scope_key", "area"]
    seeking = profiles.withColumn("area", F.explode(areas))
    if few:
        pairs = cells.join(F.broadcast(seeking), keys)
    else:
        pairs = salted_join(cells, seeking, keys, spread_by=["lat", "lon", "confidence", "tags"], how="inner")
    parts = [F.col("confidence"), F.col("proximity"), F.col("vibe")]
    reach = haversine_miles(F.col("origin_lat"), F.col("origin_lon"), F.col("lat"), F.col("lon"))
    closeness = scoring.proximity(F.col("distance"), F.col("origin_known"))
    scored = (
        pairs.withColumn("distance", reach)
        .withColumns(
            {
                "proximity": F.when(F.col("far"), F.lit(0.0)).otherwise(closeness),
                "vibe": scoring.vibe_match(F.col("tags"), F.col("wanted_vibe")),
            }
        )
        .withColumn("_weight", scoring.known_weight(*parts))
        .withColumn("_percent", scoring.weighted_percent(*parts, F.col("_weight")))
        .withColumn("total", round_tenth(F.col("_percent")))
        # A place in a tile around the origin may still be out of reach; then the far cell speaks for it.
        .withColumn("_counts", ~F.col("near") | (F.col("proximity") > 0))
    )

    # An event in reach is in the cell of its place and in a far cell, whose total is no higher. Cells of one kind hold
    # different events, so one that ten cells of its kind beat is never chosen. Each map task keeps the best of a profile.
    # A place in a tile around the origin that is out of reach takes no part; its total is left out of the order instead
    # of being filtered: a filter would move below the columns of the score and compute each of them many times over.
    best_first = W.partitionBy("profile_key", "near").orderBy(F.when(F.col("_counts"), F.col("total")).desc_nulls_last())
    entry = F.struct(
        F.row_number().over(W.partitionBy("profile_key").orderBy(F.desc("total"), F.asc("event_id"))).alias("position"),
        "event_id",
        "total",
        percent(F.col("confidence")).alias("confidence_score"),
        scoring.confidence_label(F.col("confidence")).alias("confidence_label"),
        percent(F.col("proximity")).alias("proximity_score"),
        round_tenth(F.col("miles")).alias("distance_miles"),
        percent(F.col("vibe")).alias("vibe_score"),
    )
    chosen = F.when(F.col("_counts"), F.col("members"))
    place = F.split("member.spot", ",")
    miles = haversine_miles(
        F.col("origin_lat"),
        F.col("origin_lon"),
        F.get(place, 0).try_cast("double"),
        F.get(place, 1).try_cast("double"),
    )
    ranked = (
        scored
        .withColumn("_beaten_by", F.rank().over(best_first))
        .filter(F.col("_beaten_by") <= pool_size)
        .withColumn("member", F.explode_outer(chosen))
        .filter("member is not null")
        .withColumns({"event_id": F.col("member.event_id"), "miles": miles})
        # In reach, the cell of its place speaks for an event.
        .filter(~F.col("far") | (F.col("miles") / scoring.MAX_PROXIMITY_MILES >= 1))
        .select("profile_key", entry.alias("entry"))
        .filter(F.col("entry.position") <= pool_size)
        .groupBy("profile_key")
        .agg(F.array_sort(F.collect_list("entry")).alias("pool"))
    )
    return Ranking(ranked, few)


def percent(part: Column) -> Column:
    return scoring.percent_tenth(part)


def pools(wishes: DataFrame, ranking: Ranking) -> DataFrame:
    """One row per request and pool entry. A request without any feasible candidate has no row."""
    joined = _by_request(wishes, ranking.ranked, "profile_key", ranking.few_profiles, "inner")
    return joined.select(*wishes.columns, F.inline("pool"))


def draw_key(seed: int, weight: Column, event_id: Column) -> Column:
    """Weighted sampling without replacement: the smallest keys are the draw (Efraimidis and Spirakis, 2006).

    The random number is a function of seed, request and event, so a repeated run draws the same.
    """
    text = F.concat_ws("|", F.lit(str(seed)), F.col("request_id"), event_id)
    number = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    uniform = (number.cast("double") + 1) / F.lit(float(2**52))
    return -F.ln(uniform) / weight


def _order(seed: int, total: Column, position: Column, event_id: Column) -> Column:
    """The order of a pool's entries: by position, in drawing order for a surprise."""
    drawn = draw_key(seed, F.greatest(total, F.lit(1.0)), event_id)
    return F.when(F.col("mode") == "surprise", drawn).otherwise(position.cast("double"))


def chosen_results(wishes: DataFrame, ranking: Ranking, seed: int = 0, results: int = MAX_RESULTS) -> DataFrame:
    """The results of ``select_results`` over the pools of ``ranking``, each chosen within its request's array.

    A request's row has its whole pool, so its results are in order before they are rows: no rows are sorted for them, and
    a task holds one pool at a time, however many requests it reads.
    """
    if ranking.few_profiles:
        # The ranking is broadcast, and few files may hold many requests: those are dealt out before they multiply.
        wishes = wishes.repartition(int(wishes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "request_id")
    joined = _by_request(wishes, ranking.ranked, "profile_key", ranking.few_profiles, "inner")
    ordered = F.transform(
        "pool",
        lambda e: F.struct(
            _order(seed, e["total"], e["position"], e["event_id"]).alias("order"),
            e["event_id"].alias("event_id"),
            e.alias("entry"),
        ),
    )
    best = F.transform(F.slice(F.array_sort(ordered), 1, results), lambda e, n: F.struct(e["entry"].alias("entry"), (n + 1).alias("rank")))
    return joined.select(*wishes.columns, F.inline(best)).select(*wishes.columns, "entry.*", "rank")


def select_results(pool: DataFrame, seed: int = 0, results: int = MAX_RESULTS) -> DataFrame:
    """The best entries, or for a surprise a draw from the pool with chances proportional to the total.

    For pools that are a row per entry. ``rank`` numbers the results, in drawing order for a surprise.
    """
    order = _order(seed, F.col("total"), F.col("position"), F.col("event_id"))
    per_request = W.partitionBy("request_id").orderBy("_order", "event_id")
    return (
        pool.withColumn("_order", order)
        .withColumn("rank", F.row_number().over(per_request))
        .filter(F.col("rank") <= results)
        .drop("_order")
    )
