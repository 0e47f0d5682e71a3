"""Display columns: labels, badges, tags, estimates and the explanation. Nothing is shown that is not in the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from outpulse.functions.rounding import round_whole
from outpulse.functions.text import category_label, plain_number, tag_set

# Fixed value: an assumed speed over walking, waiting and riding, in miles per hour.
TRANSIT_MPH = 12.0


def _has(tag: str) -> Column:
    return F.array_contains(tag_set(F.col("vibe_tags")), tag)


def badges() -> Column:
    """The category, and at most one badge from the tags: the one that suits the category, else the first that is there."""
    category = F.lower("category")
    second = (
        F.when((category == "outdoors") & _has("chill"), "Chill")
        .when((category == "culture") & _has("creative"), "Creative")
        .when(_has("social"), "Social")
        .when(_has("chill"), "Chill")
    )
    return F.array_compact(F.array(category_label(F.col("category")), second))


def for_beginners(source_notes: Column | None = None) -> Column:
    """The stored value, else a look at the notes of the source, where the row has them, and at the title."""
    said = F.concat_ws(" ", F.lit(None) if source_notes is None else source_notes, "title")
    return F.coalesce(F.col("beginner_friendly"), F.lower(said).contains("beginner"))


def tags(source_notes: Column | None = None) -> Column:
    return F.array_compact(
        F.array(
            F.when(for_beginners(source_notes), "Beginner friendly"),
            F.when(F.col("solo_friendly") & _has("solo_focus"), "Great for solo"),
            F.when(_has("social"), "Meet people"),
            F.when(_has("chill"), "Casual"),
            F.when(F.lower("category") == "outdoors", "Outdoor"),
        )
    )


def transit_minutes(distance_miles: Column) -> Column:
    return round_whole(distance_miles / TRANSIT_MPH * 60)


def duration_minutes(start: Column, end: Column) -> Column:
    return round_whole(F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6) / 60)


def cost_label(cost: Column) -> Column:
    return F.when(cost.isNull(), "Cost unknown").when(cost == 0, "Free").otherwise(F.format_string("$%.0f", cost.cast("double")))


def confidence_reason(channel: Column, cadence: Column, days: Column) -> Column:
    return F.concat(
        F.coalesce(channel, F.lit("None")),
        F.lit(" source, last verified "),
        days.cast("string"),
        F.lit(" day(s) ago (usually updated "),
        F.coalesce(cadence, F.lit("None")),
        F.lit(")"),
    )


def explanation() -> Column:
    """Why a result fits its request, from columns of both. The wording is fixed text."""
    mode, start_day = F.col("mode"), F.to_date("start_time").cast("string")
    vibe = F.nullif(F.col("vibe"), F.lit(""))
    specific = (mode == "specific") & (F.coalesce("asked_category", F.lit("")) != "")
    vibe_text = F.when(
        F.col("vibe_score") == 100.0, F.concat(F.lit("matches the '"), vibe, F.lit("' vibe you asked for"))
    ).otherwise(F.concat(F.lit("was the closest available match for a '"), vibe, F.lit("' vibe")))
    reasons = F.array_compact(
        F.array(
            F.when(specific, F.concat(F.lit("matches your interest in "), "category")),
            F.when(
                F.col("max_cost").isNotNull(),
                F.concat(
                    F.lit("costs $"),
                    plain_number(F.col("cost")),
                    F.lit(", within your $"),
                    plain_number(F.col("max_cost")),
                    F.lit(" budget"),
                ),
            ),
            F.when(F.col("asked_solo"), "welcomes solo attendees"),
            F.when(F.col("date").isNotNull(), F.concat(F.lit("is happening on "), start_day)),
            F.when(
                F.col("hours_free").isNotNull(),
                F.concat(F.lit("fits within the "), plain_number(F.col("hours_free")), F.lit(" hour(s) you have free")),
            ),
            F.when(F.col("intent") == "meet_people", "is a good fit for meeting people").when(
                F.col("intent") == "solo_time", "works well for solo time"
            ),
            F.when((mode == "mood") & vibe.isNotNull(), vibe_text),
            F.when(mode == "surprise", "was picked as a surprise from your top-ranked feasible options"),
            F.when(
                F.col("distance_miles").isNotNull(),
                F.concat(
                    F.lit("is about "), plain_number(F.col("distance_miles")), F.lit(" miles from ZIP "), "asked_zip"
                ),
            ),
        )
    )
    default = F.array(F.concat(F.lit("is a "), "category", F.lit(" activity happening "), start_day))
    fit = F.array_join(F.when(F.size(reasons) > 0, reasons).otherwise(default), ", ")
    return F.concat(
        F.lit("Fits because it "),
        fit,
        F.lit(". Score: "),
        plain_number(F.col("score")),
        F.lit("/100 (confidence: "),
        "confidence_label",
        F.lit(" -- "),
        "confidence_reason",
        F.lit("). Source: "),
        F.coalesce("source_name", F.lit("None")),
        F.lit(" -- last checked "),
        F.coalesce(F.col("source_verified_date").cast("string"), F.lit("None")),
        F.lit("."),
    )
