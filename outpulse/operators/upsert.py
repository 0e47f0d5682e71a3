"""Upsert on a natural key: a batch updates and inserts, and never deletes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outpulse.operators.joins import MAX_BROADCAST_ROWS, is_small

STATUS = "_status"


def last_per_key(batch: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """The row that arrived last for every key, by the ``order`` columns.

    Filtering on ``row_number() = 1`` lets each map task keep one row per key before the shuffle, so many copies of
    one key stay cheap. Without an order the batch must be unique already, or which copy stays is open.
    """
    if not order:
        return batch.dropDuplicates(list(keys))
    newest_first = W.partitionBy(*keys).orderBy(*[F.desc(name) for name in order])
    return batch.withColumn("_rn", F.row_number().over(newest_first)).filter("_rn = 1").drop("_rn")


def _same_key(keys: Sequence[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{key}") == F.col(f"{right}.{key}") for key in keys])


def upsert(
    table: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] | None = None,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``table`` after the batch, with ``_status`` (inserted, updated, kept) on every row.

    Only the columns that the batch has are updated; columns new to the table are added. A proven small batch is
    broadcast, so the table is read once and not shuffled; otherwise both sides are shuffled on their unique key.
    """
    last = last_per_key(batch, keys, order)
    columns = [*table.columns, *[name for name in batch.columns if name not in table.columns]]

    def merged(status: Column) -> list[Column]:
        picked = []
        for name in columns:
            if name in keys:
                picked.append(F.coalesce(f"n.{name}", f"o.{name}").alias(name))
            elif name not in batch.columns:
                picked.append(F.col(f"o.{name}").alias(name))
            elif name not in table.columns:
                picked.append(F.col(f"n.{name}").alias(name))
            else:
                taken = F.when(F.col("n._in_batch"), F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))
                picked.append(taken.alias(name))
        return [*picked, status.alias(STATUS)]

    status = (
        F.when(F.col("o._in_table").isNull(), "inserted").when(F.col("n._in_batch").isNull(), "kept").otherwise("updated")
    )
    old = table.withColumn("_in_table", F.lit(True)).alias("o")
    new = last.withColumn("_in_batch", F.lit(True)).alias("n")
    on = _same_key(keys, "o", "n")
    if not is_small(batch.select(*keys), max_broadcast_rows):
        return old.join(new, on, "full_outer").select(*merged(status))

    changed = old.join(F.broadcast(new), on, "left").select(*merged(status))
    known = table.join(F.broadcast(last.select(*keys)), list(keys), "left_semi").select(*keys)
    added = last.join(F.broadcast(known), list(keys), "left_anti").withColumn(STATUS, F.lit("inserted"))
    return changed.unionByName(added, allowMissingColumns=True)


def upsert_counts(result: DataFrame) -> DataFrame:
    """One row with ``inserted`` and ``updated``."""
    return result.agg(
        F.count_if(F.col(STATUS) == "inserted").alias("inserted"),
        F.count_if(F.col(STATUS) == "updated").alias("updated"),
    )


def counts_by_batch(batches: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """``(at, inserted, updated)`` of loading dated batches one after the other, without loading them.

    A row inserts when its key appears for the first time, which is one minimum per key.
    """
    per_batch = batches.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("_rows"))
    first = batches.groupBy(*keys).agg(F.min(at).alias(at)).groupBy(at).agg(F.count(F.lit(1)).alias("inserted"))
    present = per_batch.groupBy(at).agg(F.count(F.lit(1)).alias("_present"))
    inserted = F.coalesce("inserted", F.lit(0))
    return present.join(first, at, "left").select(
        at, inserted.alias("inserted"), (F.col("_present") - inserted).alias("updated")
    )
