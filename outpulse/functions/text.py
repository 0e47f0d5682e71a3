"""Text rules shared by staging, history and presentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The event taxonomy, and for each category the words that select it in the feed's category text.
# The first category with a hit wins; words are plain substrings, compared without case.
FEED_CATEGORY_WORDS: list[tuple[str, list[str]]] = [
    ("volunteer", ["Volunteer"]),
    ("food_drink", ["Food"]),
    (
        "outdoors",
        ["Nature", "Wildlife", "Gardening", "Waterfront", "Fishing", "Birding", "Urban Park Rangers"],
    ),
    ("learn", ["Education", "STEM", "Talk", "Tour"]),
    ("social", ["Games"]),
    ("culture", ["Art", "Film", "Concert", "Movie", "History", "Theater", "Literary"]),
    (
        "active",
        [
            "Fitness",
            "Exercise",
            "Dance",
            "Running",
            "Jogging",
            "Yoga",
            "Pilates",
            "Sports",
            "Recreation Center",
        ],
    ),
]

# Display names of the taxonomy.
CATEGORY_LABELS = {
    "active": "Active",
    "outdoors": "Outdoors",
    "social": "Social",
    "culture": "Culture",
    "food_drink": "Food & Drink",
    "learn": "Learn",
    "volunteer": "Volunteer",
}


def _any_word(column: str, words: Sequence[str]) -> str:
    return " or ".join(f"contains(lower({column}), '{word.lower()}')" for word in words)


def mentions_any(column: str, words: Sequence[str]) -> Column:
    """True when the column's text contains one of ``words``, without case; NULL for a NULL text."""
    return F.expr(_any_word(column, words))


def feed_category(column: str) -> Column:
    """The taxonomy value for a column of multi-valued category texts, NULL when no word matches."""
    branches = " ".join(f"when {_any_word(column, words)} then '{name}'" for name, words in FEED_CATEGORY_WORDS)
    return F.expr(f"case {branches} end")


def is_cancelled_title(title: Column) -> Column:
    """Both spellings of the cancellation prefix; NULL for a NULL title."""
    lowered = F.lower(title)
    return lowered.startswith("canceled") | lowered.startswith("cancelled")


def blank_to(text: Column, fallback: Column) -> Column:
    """``fallback`` when ``text`` is NULL or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), fallback)


def tag_set(tags: Column) -> Column:
    """The ``|``-separated tags, trimmed and lower-cased, without blanks; NULL tags give an empty array."""
    parts = F.transform(F.split(F.coalesce(tags, F.lit("")), r"\|"), lambda tag: F.lower(F.trim(tag)))
    return F.filter(parts, lambda tag: tag != "")


def plain_number(value: Column) -> Column:
    """A number as text with six significant digits at most and no trailing zeros (``10.5``, ``100``); from a million up
    and below a ten-thousandth with an exponent (``1.5e+06``)."""
    value = value.cast("double")
    with_exponent = F.format_string("%.5e", value)
    # The exponent of the rounded number: 999999.9 is a million.
    exponent = F.regexp_extract(with_exponent, r"e([+-]\d+)$", 1).try_cast("int")
    # Neither infinite nor unknown values have an exponent.
    text = F.when((exponent < -4) | (exponent > 5), F.regexp_replace(with_exponent, r"\.?0*e", "e"))
    for places in range(10):
        text = text.when(exponent == 5 - places, F.format_string(f"%.{places}f", value))
    return F.when(text.contains(".") & ~text.contains("e"), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def category_label(category: Column) -> Column:
    """The display name, or the category itself with every word capitalised; any non-letter separates words."""
    lowered = F.lower(category)
    label: Column | None = None
    for value, name in CATEGORY_LABELS.items():
        label = F.when(lowered == value, name) if label is None else label.when(lowered == value, name)
    pieces = F.regexp_extract_all(category, F.lit(r"[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return label.otherwise(F.array_join(F.transform(pieces, F.initcap), ""))
