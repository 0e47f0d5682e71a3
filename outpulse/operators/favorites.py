"""Favourites of anonymous devices: a set of (device, event) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outpulse.operators.joins import lookup_join

KEY = ["device_id", "event_id"]


def flag_favorites(rows: DataFrame, favorites: DataFrame, spread_by: str = "request_id") -> DataFrame:
    """``rows`` (with ``device_id`` and ``event_id``) and ``is_favorited``; NULL where no device is known."""
    marked = lookup_join(rows, favorites.select(*KEY, F.lit(True).alias("_hit")), KEY, spread_by=spread_by)
    has_device: Column = F.coalesce(F.col("device_id"), F.lit("")) != ""
    return marked.withColumn("is_favorited", F.when(has_device, F.coalesce("_hit", F.lit(False)))).drop("_hit")


def add_favorites(favorites: DataFrame, added: DataFrame) -> DataFrame:
    """Pairs that exist already stay as they are, with their own other columns."""
    new = added.dropDuplicates(KEY).join(favorites.select(*KEY), KEY, "left_anti")
    return favorites.unionByName(new, allowMissingColumns=True)


def remove_favorites(favorites: DataFrame, removed: DataFrame) -> DataFrame:
    """Removing what is not there is no error."""
    return favorites.join(removed.select(*KEY), KEY, "left_anti")


def favorite_counts(favorites: DataFrame) -> DataFrame:
    return favorites.groupBy("device_id").agg(F.count(F.lit(1)).alias("favorites"))


def favorites_of(favorites: DataFrame, device_id: str) -> DataFrame:
    return favorites.filter(F.col("device_id") == device_id).select("event_id")
