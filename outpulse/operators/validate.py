"""Checks on incoming tables: the strict policy stops a load, the tolerant one sets bad rows aside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# An error message names at most this many offending rows; the count it gives is complete.
SHOWN_ROWS = 20


class ValidationError(Exception):
    """The input breaks a rule of its table; the message names the input, the column and the first rows.

    ``offenders`` is a frame of all rows that fail any check: ``check_name, column_name, id, value``.
    """

    def __init__(self, message: str, offenders: DataFrame | None = None) -> None:
        super().__init__(message)
        self.offenders = offenders


def require_columns(df: DataFrame, required: Sequence[str], label: str) -> None:
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValidationError(f"{label}: missing required column(s): {', '.join(missing)}")


def parsed_time(raw: Column, as_type: str = "timestamp_ntz") -> Column:
    """The date or time in a text, NULL for blank and for unreadable text."""
    return F.trim(raw.cast("string")).try_cast("timestamp_ntz").cast(as_type)


def is_missing(name: str) -> Column:
    return F.col(name).isNull()


def is_bad_time(name: str) -> Column:
    """Not blank, and still no date or time."""
    return (F.trim(F.col(name).cast("string")) != "") & parsed_time(F.col(name)).isNull()


def is_bad_value(name: str, as_type: str) -> Column:
    """Not blank and no NaN, and still no value of the type."""
    text = F.trim(F.col(name).cast("string"))
    return ~F.lower(text).isin("", "nan") & F.col(name).try_cast(as_type).isNull()


Checks = list[tuple[str, str, Column]]


def checks_of(df: DataFrame, required: Sequence[str], times: Sequence[str], typed: dict[str, str] | None = None) -> Checks:
    """``(check_name, column_name, condition of a failing row)`` of every check. ``typed`` has columns with their types."""
    checks = [("required_value", name, is_missing(name)) for name in required]
    checks += [("time_format", name, is_bad_time(name)) for name in times if name in df.columns]
    return checks + [("value_format", name, is_bad_value(name, kind)) for name, kind in (typed or {}).items()]


def offenders_of(df: DataFrame, checks: Checks, id_column: str) -> DataFrame:
    """A row for every row of ``df`` and check that it fails."""
    failed = [
        F.when(condition, F.struct(F.lit(check).alias("check_name"), F.lit(name).alias("column_name"), F.col(name).cast("string").alias("value")))
        for check, name, condition in checks
    ]
    rows = df.select(F.col(id_column).alias("id"), F.explode(F.array_compact(F.array(*failed))).alias("f"))
    return rows.select("f.check_name", "f.column_name", "id", "f.value")


def validation_report(
    df: DataFrame, required: Sequence[str], times: Sequence[str], typed: dict[str, str] | None = None
) -> DataFrame:
    """``(check_name, column_name, failing_rows)`` for every check, from one pass over the rows."""
    checks = checks_of(df, required, times, typed)
    counted = df.agg(*[F.count_if(condition).alias(f"c{i}") for i, (_, _, condition) in enumerate(checks)])
    rows = [
        F.struct(F.lit(check).alias("check_name"), F.lit(name).alias("column_name"), F.col(f"c{i}").alias("failing_rows"))
        for i, (check, name, _) in enumerate(checks)
    ]
    return counted.select(F.inline(F.array(*rows)))


def require_clean(
    df: DataFrame, required: Sequence[str], times: Sequence[str], id_column: str, label: str, typed: dict[str, str] | None = None
) -> None:
    """Raise on the first failing check. The rows are read once; only a failure reads them again, up to a limit."""
    require_columns(df, required, label)
    failing = [row for row in validation_report(df, required, times, typed).collect() if row["failing_rows"]]
    if not failing:
        return
    first = failing[0]
    name, count = first["column_name"], first["failing_rows"]
    checks = checks_of(df, required, times, typed)
    broken = next(condition for check, column, condition in checks if (check, column) == (first["check_name"], name))
    offenders = offenders_of(df, checks, id_column)
    shown = df.filter(broken).select(id_column, F.col(name).cast("string").alias("value")).limit(SHOWN_ROWS).collect()
    ids = [row[id_column] for row in shown]
    if first["check_name"] == "required_value":
        raise ValidationError(f"{label}: required column '{name}' is missing a value in {count} row(s): {ids}", offenders)
    values = [row["value"] for row in shown]
    raise ValidationError(f"{label}: column '{name}' has malformed value(s) {values} in {count} row(s): {ids}", offenders)


def split_bad(df: DataFrame, problems: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)``; a reject carries the first problem it has as ``reason``."""
    reason = F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in problems.items()])
    marked = df.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")
