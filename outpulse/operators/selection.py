"""The exact median of every group, found in a range instead of held in a buffer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outpulse.session import settle

#: Ranges that the values of a group are dealt into.
RANGES = 4096


def exact_median(df: DataFrame, group: str, value: str, ranges: int = RANGES) -> DataFrame:
    """``(group, median)`` of the known values: the middle one, or the mean of the two middle ones.

    Values are counted, then the ranges of equal width that they fall into. A group's histogram has at most ``ranges`` rows
    and tells which ranges hold its middle; only the distinct values of these are put in order.
    """
    counted = settle(df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n")))
    spans = counted.groupBy(group).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.sum("_n").alias("_total"))
    width = F.col("_high") - F.col("_low")
    place = F.floor((F.col(value) - F.col("_low")) / F.nullif(width, F.lit(0)) * ranges)
    # The highest value ends the last range, and a group of one value has one range.
    placed = counted.join(spans, group).withColumn("_range", F.coalesce(F.least(place, F.lit(ranges - 1)), F.lit(0)))

    total = F.col("_total")
    first, second = F.floor((total + 1) / 2), F.floor(total / 2) + 1

    def before(order: str, *within: str) -> Column:
        window = W.partitionBy(group, *within).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(window), F.lit(0))

    histogram = placed.groupBy(group, "_range", "_total").agg(F.sum("_n").alias("_n")).withColumn("_before", before("_range"))
    holding = histogram.filter((F.col("_before") < second) & (F.col("_before") + F.col("_n") >= first))
    middle = placed.join(holding.select(group, "_range", "_before"), [group, "_range"])
    upto = F.col("_before") + before(value, "_range")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") < rank) & (F.col("_upto") + F.col("_n") >= rank), F.col(value)))

    ordered = middle.withColumn("_upto", upto)
    found = ordered.groupBy(group).agg(at(first).alias("_first"), at(second).alias("_second"))
    return found.select(group, (F.lit(0.5) * F.col("_first") + F.lit(0.5) * F.col("_second")).alias("median"))
