"""Every query of the library over the test tables, by name."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from outpulse import schemas
from outpulse.functions import presentation, text
from outpulse.operators import favorites, history, matching, upsert, validate
from outpulse.plans import enrich, marts, quality, recommendations, refresh, reliability, staging
from outpulse.session import settle, work_dir
from outpulse.sources import adapters as data
from outpulse.sources import curated, landed, tables
from outpulse.sources.adapters import CLOCK

Query = Callable[[SparkSession, str], DataFrame]


@functools.cache
def _own_folder() -> str:
    """Where stored tables go when no shared folder is set, as in a run on one machine."""
    return tempfile.mkdtemp(prefix="outpulse-")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.all_events(data.curated_events(spark, sf_dir), data.feed_now(spark, sf_dir))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.all_sources(data.sources(spark, sf_dir), data.feed_captures(spark, sf_dir))


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich(
        _events(spark, sf_dir), _sources(spark, sf_dir), data.zip_centroids(spark, sf_dir), CLOCK
    )


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.organizations(_events(spark, sf_dir), _sources(spark, sf_dir), CLOCK)


def candidate_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.candidates(_enriched(spark, sf_dir), CLOCK)


def enriched_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    sourced = enrich.with_source(_events(spark, sf_dir), _sources(spark, sf_dir), CLOCK)
    return enrich.with_borough(sourced, data.zip_centroids(spark, sf_dir)).select(
        "event_id", "source_id", "cadence_days", "days_since_checked", "freshness_status", "borough"
    )


def enriched_audience_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).select(
        "event_id",
        "activity_family",
        "secondary_badge",
        "solo_private_score",
        "solo_social_score",
        "couple_score",
        "small_group_score",
        "audience_data_available",
        "group_suitability",
        "social_structure",
        "beginner_friendly",
        "discovery_score",
        "actionability_score",
    )


def feed_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stage_feed(data.feed_now(spark, sf_dir))


def synthetic_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.feed_source(data.feed_captures(spark, sf_dir))


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.category_counts(candidate_mart(spark, sf_dir))


def feed_parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = landed.parse_records(data.landed_records(spark, sf_dir), CLOCK.now_utc())
    return rows


def feed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of records whose id is any JSON value, or why there is none."""
    rows, rejects = landed.parse_records(data.records_of_any_id(spark, sf_dir), CLOCK.now_utc())
    known = rows.select("title", "source_record_id", F.lit("taken").alias("reason"))
    return known.unionByName(rejects.select(F.get_json_object("raw_payload", "$.title").alias("title"), F.lit(None).cast("string").alias("source_record_id"), "reason"))


def feed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = landed.parse_records(data.landed_records(spark, sf_dir), CLOCK.now_utc())
    return landed.reject_counts(rejects)


#: The records that a paged fetch takes.
FIRST_RECORDS = 200


def feed_first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default record limit of one load, lowest ids first."""
    rows, _ = landed.parse_records(
        landed.first_records(data.landed_records(spark, sf_dir), FIRST_RECORDS), CLOCK.now_utc()
    )
    return rows.select("source_record_id", "title", "startdate")


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validation_report(
        data.raw_event_text(spark, sf_dir),
        schemas.REQUIRED_EVENT_COLUMNS,
        ["start_time", "end_time", "last_checked"],
    )


def lookup_evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ZIP lookup read into a wider declared schema: columns that the file lacks are added as NULL."""
    wider = f"{schemas.ZIP_CENTROIDS}, image_url string, is_active boolean"
    return curated.conform(data.zip_centroids(spark, sf_dir), wider, {"is_active": True})


def _last_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All feed batches but the last, and the last."""
    batches = data.feed_batches(spark, sf_dir)
    last = data.feed_captures(spark, sf_dir).agg(F.max("ingested_at").alias("last")).scalar()
    return batches.filter(F.col("ingested_at") < last), batches.filter(F.col("ingested_at") == last)


def upsert_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that the earlier batches left, after the last batch."""
    earlier, last = _last_batch(spark, sf_dir)
    table = settle(upsert.last_per_key(earlier, schemas.KEYS["feed"], ["ingested_at"]))
    return upsert.upsert(table, last, schemas.KEYS["feed"], ["ingested_at"]).withColumnRenamed(upsert.STATUS, "status")


def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.counts_by_batch(data.feed_batches(spark, sf_dir), schemas.KEYS["feed"], "ingested_at")


def scd2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history_from_batches(data.feed_batches(spark, sf_dir))


def scd2_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of the earlier batches, carried on by the last one. Equals the one-pass history."""
    earlier, last = _last_batch(spark, sf_dir)
    return history.snapshot_history(settle(history.history_from_batches(earlier)), last)


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    earlier, last = _last_batch(spark, sf_dir)
    return history.record_observations(settle(history.observe(earlier)), last)


#: Days of the feed that one load takes in.
DAYS_PER_LOAD = 8


def _stored_feed(spark: SparkSession, sf_dir: str, merge: bool = False) -> tuple[str, int]:
    """The feed's batches taken into stored tables, some days a load. Returns their folder and the last batch.

    With ``merge``, a last batch brings nothing and merges every bucket of the feed table.
    """
    root = f"{work_dir(spark, _own_folder)}/stored-feed-{uuid.uuid4().hex}"
    batches = data.feed_batches(spark, sf_dir)
    captured = F.to_date("ingested_at")
    first, last = data.feed_captures(spark, sf_dir).agg(F.min(captured), F.max(captured)).first()
    loads = (last - first).days // DAYS_PER_LOAD + 1 if first else 0
    # The batches are made once and dealt to the loads, each of which reads its own folder several times.
    landed_at = f"{root}/landed"
    load = F.floor(F.datediff(captured, F.lit(first)) / DAYS_PER_LOAD).cast("int")
    batches.withColumn("load", load).write.partitionBy("load").parquet(landed_at)
    for batch in range(loads):
        refresh.load_feed_batch(spark, root, batch, tables.read_if_written(spark, f"{landed_at}/load={batch}", batches.schema))
    if merge:
        pending = tables.Batch(spark, root, "feed", loads)
        pending.merge("feed")
        pending.commit()
    return root, loads - 1 + merge


def _state(spark: SparkSession, root: str, batch: int) -> DataFrame:
    return tables.state(spark, root, "feed", batch)


def stored_feed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed table after all loads, merged as it is read."""
    return _state(spark, *_stored_feed(spark, sf_dir))


def stored_feed_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table after all its buckets were merged into bases."""
    return _state(spark, *_stored_feed(spark, sf_dir, merge=True))


def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions that the loads left, open and closed."""
    return tables.whole_history(spark, *_stored_feed(spark, sf_dir))


def stored_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation fact after all loads, from the day folders that the last commit names."""
    return tables.observations(spark, *_stored_feed(spark, sf_dir))


def event_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.event_lifecycle(scd2_history(spark, sf_dir), feed_staging(spark, sf_dir))


def event_lifecycle_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead times as the difference of UTC capture and local start, without converting either."""
    lifecycle = reliability.event_lifecycle(
        scd2_history(spark, sf_dir), feed_staging(spark, sf_dir), compat_utc_skew=True
    )
    return lifecycle.select("event_id", "cancellation_observed", "cancellation_lead_hours")


def source_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability.source_reliability(
        event_lifecycle(spark, sf_dir),
        history.observe(data.feed_batches(spark, sf_dir)),
        synthetic_source(spark, sf_dir),
    )


def request_feasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    wishes = matching.asked(data.requests(spark, sf_dir), data.zip_centroids(spark, sf_dir))
    return matching.feasible_counts(wishes, matching.rankable(candidate_mart(spark, sf_dir), CLOCK))


def request_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates of every request with all score components."""
    pool = recommendations.score_pools(
        data.requests(spark, sf_dir), candidate_mart(spark, sf_dir), data.zip_centroids(spark, sf_dir), CLOCK
    )
    return pool.select(
        "request_id",
        "position",
        "event_id",
        "total",
        "confidence_score",
        "confidence_label",
        "proximity_score",
        "distance_miles",
        "vibe_score",
    )


def _results(spark: SparkSession, sf_dir: str, mart: DataFrame | None = None) -> DataFrame:
    """The results over a mart; over one that is given, for a plan that reads them repeatedly."""
    return recommendations.top_results(
        data.requests(spark, sf_dir),
        candidate_mart(spark, sf_dir) if mart is None else mart,
        data.zip_centroids(spark, sf_dir),
        CLOCK,
        reused=mart is not None,
    )


def request_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict top five of requests that are no surprise."""
    return _results(spark, sf_dir).filter("mode <> 'surprise'").select("request_id", "rank", "event_id", "total")


def request_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted draws of surprise requests."""
    return _results(spark, sf_dir).filter("mode = 'surprise'").select("request_id", "rank", "event_id", "total")


def request_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field that is shown for a result; the two lists as text."""
    mart = settle(candidate_mart(spark, sf_dir))
    shown = recommendations.explained(_results(spark, sf_dir, mart), mart, data.favorites(spark, sf_dir), CLOCK)
    return shown.withColumns({"badges": F.array_join("badges", "|"), "tags": F.array_join("tags", "|")})


def favorites_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each device of the requests has each curated event of its own urgent orders; unknown without a device."""
    rows = data.device_events(spark, sf_dir)
    return favorites.flag_favorites(rows, data.favorites(spark, sf_dir), spread_by="event_id")


def favorites_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return favorites.favorite_counts(data.favorites(spark, sf_dir))


def favorites_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The favourites after a batch of additions and a batch of removals."""
    added, removed = data.favorite_changes(spark, sf_dir)
    return favorites.remove_favorites(favorites.add_favorites(data.favorites(spark, sf_dir), added), removed)


def organization_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.organization_list(organizations(spark, sf_dir))


def cost_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_mart(spark, sf_dir).select(
        "event_id",
        presentation.cost_label(F.col("price_amount")).alias("cost_label"),
        text.category_label(F.col("activity_category")).alias("category_label"),
    )


def display_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginner tag of events with and without a stored value, and amounts of very different size as text."""
    rows = data.display_rows(spark, sf_dir)
    return rows.select(
        "event_id",
        presentation.for_beginners(F.col("source_notes")).alias("for_beginners"),
        text.plain_number(F.col("amount")).alias("amount_text"),
    )


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assertion of the pipeline over the tables that the test data gives.

    What a run would have written before it checks is computed once: the versions, the lifecycles, the candidates.
    """
    versions = settle(scd2_history(spark, sf_dir))
    lifecycle = settle(reliability.event_lifecycle(versions, feed_staging(spark, sf_dir)))
    observed = settle(history.observe(data.feed_batches(spark, sf_dir)))
    enriched = settle(_enriched(spark, sf_dir))
    checked = quality.Tables(
        sources=data.sources(spark, sf_dir),
        curated=data.curated_events(spark, sf_dir),
        feed=data.feed_now(spark, sf_dir),
        zips=data.zip_centroids(spark, sf_dir),
        history=versions,
        lifecycle=lifecycle,
        observations=observed,
        enriched=enriched,
        candidates=marts.candidates(enriched, CLOCK),
        organizations=organizations(spark, sf_dir),
        reliability=reliability.source_reliability(lifecycle, observed, synthetic_source(spark, sf_dir)),
    )
    return quality.quality_report(checked, CLOCK)


QUERIES: dict[str, Query] = {
    "organizations": organizations,
    "candidate_mart": candidate_mart,
    "enriched_freshness": enriched_freshness,
    "enriched_audience_fit": enriched_audience_fit,
    "feed_staging": feed_staging,
    "synthetic_source": synthetic_source,
    "category_counts": category_counts,
    "feed_parse_json": feed_parse_json,
    "feed_rejects": feed_rejects,
    "feed_ids": feed_ids,
    "feed_first_records": feed_first_records,
    "validation_report": validation_report,
    "lookup_evolved": lookup_evolved,
    "upsert_final_state": upsert_final_state,
    "upsert_counts": upsert_counts,
    "scd2_history": scd2_history,
    "scd2_incremental": scd2_incremental,
    "event_observations": event_observations,
    "stored_feed_state": stored_feed_state,
    "stored_feed_merged": stored_feed_merged,
    "stored_history": stored_history,
    "stored_observations": stored_observations,
    "event_lifecycle": event_lifecycle,
    "event_lifecycle_utc": event_lifecycle_utc,
    "source_reliability": source_reliability,
    "request_feasible": request_feasible,
    "request_scores": request_scores,
    "request_top5": request_top5,
    "request_surprise": request_surprise,
    "request_explained": request_explained,
    "favorites_flag": favorites_flag,
    "favorites_count": favorites_count,
    "favorites_apply": favorites_apply,
    "organization_list": organization_list,
    "cost_labels": cost_labels,
    "display_details": display_details,
    "quality_report": quality_report,
}
