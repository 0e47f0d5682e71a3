"""The machine feed: landed JSON pages, parsed record by record under the tolerant policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outpulse.functions.geo import parse_position
from outpulse.operators.validate import split_bad

# The fields of a record that are used. An id comes as any JSON value, links as an object with a url or a bare string.
RECORD = """guid variant, title string, startdate string, enddate string, starttime string, endtime string,
 location string, parknames string, categories string, link variant, registration_url variant, coordinates string,
 description string"""

# Where a record stood in what has landed: files in the order of their paths, then the place in the file.
ARRIVAL = "arrival"

ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ].+)?$"


def _arrival(file: Column, split: Column, place: Column) -> Column:
    return F.struct(file.alias("file"), split.cast("long").alias("split"), place.cast("long").alias("place")).alias(ARRIVAL)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """``(file, value)`` of files that each hold one page. A page is as large as the API's page size, so one file is one row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def split_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(records, bad_pages)`` of pages that are JSON lists of records. ``records`` has ``raw_payload`` and ``arrival``."""
    read = pages.select("file", F.from_json("value", "array<string>").alias("records"), "value")
    is_list = F.trim("value").startswith("[") & F.col("records").isNotNull()
    records = read.filter(is_list).select("file", F.posexplode("records").alias("place", "raw_payload"))
    records = records.select("raw_payload", _arrival(F.col("file"), F.lit(0), F.col("place")))
    return records, read.filter(~is_list).select("file", F.lit("not_a_json_list").alias("reason"))


def read_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(records, bad_pages)`` of files that each hold one page, a JSON list of records."""
    return split_pages(pages(spark, path))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of files with one JSON object per line."""
    split = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return spark.read.text(path).select(F.col("value").alias("raw_payload"), _arrival(*split, F.monotonically_increasing_id()))


def first_records(records: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` records by id, as a paged fetch with an upper bound gives them. The limit is the feature."""
    guid = F.nullif(F.get_json_object("raw_payload", "$.guid"), F.lit(""))
    return records.orderBy(guid.asc_nulls_last(), "raw_payload").limit(limit)


def link_url(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(
        kind.startswith("OBJECT"), F.try_variant_get(value, "$.url", "string")
    )


def iso_date(text: Column) -> Column:
    """The date of an ISO date or timestamp, or of the basic form without hyphens; NULL for anything else."""
    basic = F.when(text.rlike(r"^\d{8}$"), F.concat_ws("-", text.substr(1, 4), text.substr(5, 2), text.substr(7, 2)))
    return F.coalesce(F.when(text.rlike(ISO_DATE), text), basic).try_cast("timestamp_ntz").cast("date")


def record_id(value: Column) -> Column:
    """The id as text; NULL where there is none: null, an empty text or container, zero, or false."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(kind == "STRING", F.nullif(text, F.lit("")))
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(value, "$", "boolean"), "True"))
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.when(~F.to_json(value).isin("{}", "[]"), F.to_json(value)))
        .when(F.try_variant_get(value, "$", "double") != 0, text)
    )


def parse_records(records: DataFrame, ingested_at: Column) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``: a record without an id or with an unreadable date is set aside, the rest goes on.

    The original text stays with its row, and so does its place of arrival. Missing coordinates are no defect.
    """
    arrival = [ARRIVAL] if ARRIVAL in records.columns else []
    # Unfolding the one parsed record keeps the parsing in a step of its own. As a plain column it would be repeated
    # inside every filter on one of its fields. The same goes for ids and dates, which rows and rejects both need.
    texts = records.select(
        "raw_payload",
        *arrival,
        ingested_at.cast("timestamp_ntz").alias("ingested_at"),
        F.inline(F.array(F.from_json("raw_payload", RECORD))),
    )
    dates = ["startdate", "enddate"]
    read = F.struct(record_id(F.col("guid")).alias("id"), *[iso_date(F.col(name)).alias(f"{name}_read") for name in dates])
    parsed = texts.select("*", F.inline(F.array(read))).withColumn("guid", F.col("id"))

    def unreadable(name: str) -> Column:
        return (F.trim(name) != "") & F.col(f"{name}_read").isNull()

    problems = {"missing_id": F.col("id").isNull(), **{f"bad_{name}": unreadable(name) for name in dates}}
    good, rejects = split_bad(parsed, problems)
    lat, lon = parse_position(F.col("coordinates"))
    rows = good.select(
        F.col("id").alias("source_record_id"),
        "title",
        *[F.col(f"{name}_read").alias(name) for name in dates],
        "starttime",
        "endtime",
        "location",
        "parknames",
        "categories",
        link_url(F.col("link")).alias("link_url"),
        link_url(F.col("registration_url")).alias("registration_url"),
        lat.alias("lat"),
        lon.alias("lon"),
        "description",
        "raw_payload",
        "ingested_at",
        *arrival,
    )
    return rows, rejects.select("guid", "reason", "raw_payload")


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("records"))
