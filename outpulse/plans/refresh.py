"""One run of the pipeline, in the only order that keeps the history: load, snapshot, observe, then build."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outpulse import schemas
from outpulse.clock import Clock
from outpulse.operators import history
from outpulse.operators.upsert import last_per_key
from outpulse.plans import enrich, marts, quality, reliability, staging
from outpulse.plans.staging import DEFAULT_FEED, FeedProfile
from outpulse.sources import commits, curated, landed, tables


@dataclass(frozen=True)
class Inputs:
    """The curated tables and the lookup of a run."""

    sources: DataFrame
    events: DataFrame
    zips: DataFrame


def load_curated(
    spark: SparkSession, root: str, batch: int, sources_csv: str, events_csv: str, policy: str = "fail"
) -> dict[str, DataFrame]:
    """Take the curated files into their raw tables, sources first. Returns the rejects of both by table name.

    Under the strict policy a bad file stops the load, and nothing of the batch becomes live.
    """
    rejects = {}
    pending = tables.Batch(spark, root, "curated", batch)
    for name, path, load in (
        ("sources", sources_csv, curated.load_sources),
        ("events", events_csv, curated.load_events),
    ):
        rows, rejects[name] = load(curated.read_text_table(spark, path), path, policy)
        pending.upsert(name, last_per_key(rows, schemas.KEYS[name], [curated.ROW]).drop(curated.ROW))
    pending.commit()
    return rejects


def _take_feed(pending: tables.Batch, rows: DataFrame, profile: FeedProfile) -> None:
    """Feed rows into the feed table, its change history and the observation fact of a batch."""
    key = schemas.KEYS["feed"]
    # All three tables take the last arrival of a key, by one order.
    order = history.arrival_order(rows)
    pending.upsert("feed", last_per_key(rows, key, order).drop(landed.ARRIVAL))
    pending.snapshot(last_per_key(rows, [*key, history.CAPTURED_AT], order).drop(landed.ARRIVAL))
    pending.observe(rows, profile)


def load_feed_batch(
    spark: SparkSession, root: str, batch: int, rows: DataFrame, profile: FeedProfile = DEFAULT_FEED
) -> DataFrame:
    """Take a batch of feed rows in: state, history and observations become live together. Returns the feed table.

    Each step starts from the commit of the batch before and writes folders of its own, so a batch can be run again.
    """
    pending = tables.Batch(spark, root, "feed", batch)
    _take_feed(pending, rows, profile)
    pending.commit()
    return tables.state(spark, root, "feed", batch)


def load_pages(
    spark: SparkSession, root: str, batch: int, pages: DataFrame, captured_at: Column, profile: FeedProfile = DEFAULT_FEED
) -> DataFrame:
    """A batch from pages (file, value) on. Rejected records and unreadable pages become live with what was loaded."""
    records, bad_pages = landed.split_pages(pages)
    rows, rejects = landed.parse_records(records, captured_at)
    pending = tables.Batch(spark, root, "feed", batch)
    # Parsed once: everything else reads the rows from their folder.
    rows = pending.folder("feed_rows", rows, **staging.bad_time_counts())
    pending.folder("feed_rejects", rejects, failed=F.count("*"))
    pending.folder("feed_bad_pages", bad_pages, bad_pages=F.count("*"))
    _take_feed(pending, rows, profile)
    pending.commit()
    return tables.state(spark, root, "feed", batch)


def load_landed_batch(
    spark: SparkSession, root: str, batch: int, path: str, captured_at: Column, profile: FeedProfile = DEFAULT_FEED
) -> DataFrame:
    """A batch from its landed pages on."""
    return load_pages(spark, root, batch, landed.pages(spark, path), captured_at, profile)


def landed_counts(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """One row with ``inserted``, ``updated``, ``failed`` (records set aside) and ``bad_pages`` of a landed batch.

    Its commit states them, and under ``feed_rows`` how many time texts were of the right form but no time.
    """
    counts = tables.batch_counts(spark, root, "feed", batch)
    told = {**counts["feed"], **counts["feed_rejects"], **counts["feed_bad_pages"]}
    return spark.createDataFrame([tuple(told.values())], ", ".join(f"{name} bigint" for name in told))


def build_marts(
    spark: SparkSession, root: str, batch: int, inputs: Inputs, clock: Clock, profile: FeedProfile = DEFAULT_FEED
) -> quality.Tables:
    """All marts after a batch, each written once and read by what follows. They become live together."""
    feed = tables.state(spark, root, "feed", batch)
    events = staging.all_events(inputs.events, feed, profile)
    sources = staging.all_sources(inputs.sources, feed, profile)
    pending = tables.Batch(spark, root, "marts", batch, carries_on=False)

    enriched = enrich.enrich(events, sources, inputs.zips, clock)
    versions = tables.whole_history(spark, root, batch)
    observed = tables.observations(spark, root, batch)
    lifecycle = reliability.event_lifecycle(versions, staging.stage_feed(feed, profile), profile)
    feeds = staging.feed_source(feed, profile)
    built = quality.Tables(
        sources=inputs.sources,
        curated=inputs.events,
        feed=feed,
        zips=inputs.zips,
        history=versions,
        lifecycle=lifecycle,
        observations=observed,
        enriched=enriched,
        candidates=pending.folder("candidates", marts.candidates(enriched, clock)),
        organizations=pending.folder("organizations", marts.organizations(events, sources, clock)),
        reliability=pending.folder("reliability", reliability.source_reliability(lifecycle, observed, feeds, profile)),
    )
    pending.commit()
    return built


def mart(spark: SparkSession, root: str, name: str, batch: int | None = None) -> DataFrame:
    """A mart as the last build, or that of a batch, published it."""
    return tables.batch_folder(spark, root, "marts", name, commits.last_batch(spark, root, "marts") if batch is None else batch)


def refresh(
    spark: SparkSession,
    root: str,
    batch: int,
    rows: DataFrame,
    inputs: Inputs,
    clock: Clock,
    profile: FeedProfile = DEFAULT_FEED,
) -> tuple[quality.Tables, DataFrame]:
    """Load, build, check. Returns the tables and the quality report."""
    load_feed_batch(spark, root, batch, rows, profile)
    built = build_marts(spark, root, batch, inputs, clock, profile)
    return built, quality.quality_report(built, clock)


def refresh_landed(
    spark: SparkSession,
    root: str,
    batch: int,
    path: str,
    captured_at: Column,
    inputs: Inputs,
    clock: Clock,
    profile: FeedProfile = DEFAULT_FEED,
) -> tuple[quality.Tables, DataFrame]:
    """A whole run from landed pages to the quality report."""
    load_landed_batch(spark, root, batch, path, captured_at, profile)
    built = build_marts(spark, root, batch, inputs, clock, profile)
    return built, quality.quality_report(built, clock)
