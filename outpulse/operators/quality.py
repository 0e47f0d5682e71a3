"""Data-quality assertions as one table of results: ``(table_name, check_name, column_name, failing_rows)``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outpulse.operators.joins import lookup_join

REPORT_COLUMNS = ["table_name", "check_name", "column_name", "failing_rows"]


@dataclass(frozen=True)
class Expectations:
    """What a table promises. ``rules`` are conditions that no row may meet, by name."""

    unique: Sequence[Sequence[str]] = ()
    not_null: Sequence[str] = ()
    accepted: dict[str, Sequence[str]] = field(default_factory=dict)
    rules: dict[str, Column] = field(default_factory=dict)


def _row_checks(expected: Expectations) -> list[tuple[str, str, Column]]:
    checks = [("not_null", name, F.col(name).isNull()) for name in expected.not_null]
    # An unknown value is accepted: only a known value can be a wrong one.
    checks += [("accepted_values", name, ~F.col(name).isin(*values)) for name, values in expected.accepted.items()]
    return checks + [(name, "", condition) for name, condition in expected.rules.items()]


def _report(counts: DataFrame, table: str, checks: Sequence[tuple[str, str]]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(table).alias("table_name"),
            F.lit(check).alias("check_name"),
            F.lit(column).alias("column_name"),
            F.coalesce(f"c{i}", F.lit(0)).cast("bigint").alias("failing_rows"),
        )
        for i, (check, column) in enumerate(checks)
    ]
    return counts.select(F.inline(F.array(*rows)))


def _key_text(key: Sequence[str]) -> Column:
    """A key as one text, NULL when a part of it is unknown."""
    if len(key) == 1:
        return F.col(key[0]).cast("string")
    known = reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in key])
    return F.when(known, F.to_json(F.struct(*key)))


def check_tables(tables: dict[str, tuple[DataFrame, Expectations]]) -> DataFrame:
    """All checks of all tables, every table read once and all of them shuffled together, once.

    A row becomes one tagged row per unique key of its table, the first with the row's failures beside it. Rows are
    counted per table and key, failures with them, and then summed per table. Both steps combine before they shuffle,
    so repeated keys cost nothing extra. A uniqueness failure is a repeated key, and unknown keys do not count.
    """
    checks = {name: _row_checks(expected) for name, (_, expected) in tables.items()}
    width = max(map(len, checks.values()), default=0)
    slots = [f"f{i}" for i in range(width)]
    parts, asked = [], []
    for number, (name, (df, expected)) in enumerate(tables.items()):
        conditions = [condition for *_, condition in checks[name]]
        flags = [F.when(condition, 1).otherwise(0) for condition in conditions]
        flags += [F.lit(0)] * (width - len(flags))
        tagged = []
        for place, key in enumerate(expected.unique or [()]):
            counted = flags if place == 0 else [F.lit(0)] * width
            tagged.append(
                F.struct(
                    F.lit(number).alias("table_no"),
                    F.lit(place).alias("key_no"),
                    (_key_text(key) if key else F.lit(None).cast("string")).alias("key"),
                    *[flag.alias(slot) for flag, slot in zip(counted, slots)],
                )
            )
        parts.append(df.select(F.inline(F.array(*tagged))))
        asked += [(number, 0, slots[i], name, check, column) for i, (check, column, _) in enumerate(checks[name])]
        asked += [(number, place, "repeated", name, "unique", ",".join(key)) for place, key in enumerate(expected.unique)]
    rows = reduce(DataFrame.unionByName, parts)
    per_key = rows.groupBy("table_no", "key_no", "key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in slots])
    repeated = F.count_if((F.col("n") > 1) & F.col("key").isNotNull()).alias("repeated")
    summed = per_key.groupBy("table_no", "key_no").agg(repeated, *[F.sum(s).alias(s) for s in slots])
    told = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).alias("failing_rows")) for s in [*slots, "repeated"]])
    found = summed.select("table_no", "key_no", F.inline(told))
    spark = rows.sparkSession
    listed = spark.createDataFrame(asked, "table_no int, key_no int, slot string, table_name string, check_name string, column_name string")
    # One row per table, key and check on either side. A table without rows has nothing that fails.
    joined = listed.join(F.broadcast(found), ["table_no", "key_no", "slot"], "left")
    return joined.select("table_name", "check_name", "column_name", F.coalesce("failing_rows", F.lit(0)).cast("bigint").alias("failing_rows"))


def check_table(df: DataFrame, table: str, expected: Expectations) -> DataFrame:
    """All checks of one table."""
    return check_tables({table: (df, expected)})


def check_reference(child: DataFrame, table: str, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose reference has no parent. Counted per reference first, so a hot reference is one row in the join."""
    orphans = (
        child.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("_ref"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(parent.select(F.col(parent_column).alias("_ref")), "_ref", "left_anti")
    )
    return _report(orphans.agg(F.sum("_n").alias("c0")), table, [("relationships", column)])


def check_against_feed(mart: DataFrame, table: str, events: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows that contradict the staged event they come from: an inactive source, or a price that was unknown."""
    staged = events.select("event_id", F.col("source_id").alias("_source"), F.col("price_amount").alias("_price"))
    joined = mart.select("event_id", "price_amount").join(staged, "event_id")
    active = sources.select(F.col("source_id").alias("_source"), F.col("is_active").alias("_active"))
    checked = lookup_join(joined, active, "_source", spread_by="event_id")
    counts = checked.agg(
        F.count_if(~F.col("_active")).alias("c0"),
        F.count_if(F.col("_price").isNull() & F.col("price_amount").isNotNull()).alias("c1"),
    )
    return _report(counts, table, [("no_inactive_source", ""), ("unknown_price_stays_unknown", "")])


def union_reports(reports: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports).select(*REPORT_COLUMNS)
