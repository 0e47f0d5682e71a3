"""The curated directory: two CSV files kept by people, loaded under the strict policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outpulse import schemas
from outpulse.operators.validate import parsed_time, require_clean, require_columns, split_bad
from outpulse.operators.validate import is_bad_time, is_bad_value, is_missing


# The position of a row in its file, so that the last of several rows with one key is known.
ROW = "_row"


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column as text, blank cells as NULL."""
    cells = spark.read.options(header=True, multiLine=True, escape='"', mode="PERMISSIVE").csv(path)
    return cells.withColumn(ROW, F.monotonically_increasing_id())


def conform(raw: DataFrame, schema: str, defaults: dict | None = None) -> DataFrame:
    """``raw`` with exactly the declared columns and types. An absent column is NULL, or its default."""
    fields = T.StructType.fromDDL(schema).fields
    columns = []
    for field in fields:
        if field.name not in raw.columns:
            value = F.lit((defaults or {}).get(field.name)).cast(field.dataType)
        elif isinstance(field.dataType, (T.DateType, T.TimestampNTZType)):
            value = parsed_time(F.col(field.name), field.dataType.simpleString())
        elif isinstance(field.dataType, T.DoubleType):
            # A NaN from a pandas-born file is an unknown value as well.
            number = F.col(field.name).try_cast("double")
            value = F.when(~F.isnan(number), number)
        else:
            value = F.col(field.name).try_cast(field.dataType.simpleString())
        columns.append(value.alias(field.name))
    return raw.select(*columns, *[name for name in raw.columns if name == ROW])


def _load(
    raw: DataFrame, schema: str, required: list[str], times: list[str], key: str, label: str, defaults: dict, policy: str
) -> tuple[DataFrame, DataFrame]:
    require_columns(raw, required, label)
    present = [name for name in times if name in raw.columns]
    # A column with a default may be absent; where it is present, each row has a value.
    required = [*required, *[name for name in defaults if name in raw.columns]]
    kinds = (T.NumericType, T.BooleanType)
    fields = [f for f in T.StructType.fromDDL(schema).fields if isinstance(f.dataType, kinds) and f.name in raw.columns]
    typed = {f.name: f.dataType.simpleString() for f in fields}
    if policy == "fail":
        require_clean(raw, required, present, key, label, typed)
        return conform(raw, schema, defaults), raw.limit(0)
    if policy != "quarantine":
        raise ValueError(f"unknown policy: {policy}")
    problems = {f"missing_{name}": is_missing(name) for name in required}
    problems |= {f"malformed_{name}": is_bad_time(name) for name in present}
    problems |= {f"malformed_{name}": is_bad_value(name, kind) for name, kind in typed.items()}
    good, rejects = split_bad(raw, problems)
    return conform(good, schema, defaults), rejects


def load_sources(raw: DataFrame, label: str = "sources", policy: str = "fail") -> tuple[DataFrame, DataFrame]:
    """``(sources, rejects)``. A file without ``is_active`` describes active sources only."""
    return _load(
        raw,
        schemas.SOURCES,
        schemas.REQUIRED_SOURCE_COLUMNS,
        ["last_checked"],
        "source_id",
        label,
        {"is_active": True},
        policy,
    )


def load_events(raw: DataFrame, label: str = "events", policy: str = "fail") -> tuple[DataFrame, DataFrame]:
    return _load(
        raw,
        schemas.EVENTS,
        schemas.REQUIRED_EVENT_COLUMNS,
        ["start_time", "end_time", "last_checked"],
        "event_id",
        label,
        {},
        policy,
    )


def read_zip_centroids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ZIP_CENTROIDS).option("header", True).csv(path)
