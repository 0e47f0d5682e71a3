"""The one place that decides what "now" is.

Events happen in one city, so "upcoming" is judged in that city's wall-clock time and never in the session's zone.
The instant is a parameter, so a run can be repeated and tested.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "America/New_York"


def to_local(utc: Column, zone: str = LOCAL_ZONE) -> Column:
    """UTC wall-clock to local wall-clock, both without a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc.cast("timestamp_ntz"))


@dataclass(frozen=True)
class Clock:
    """``as_of_utc`` is text such as ``2024-01-15 17:00:00``; the columns fold to literals at planning time."""

    as_of_utc: str
    zone: str = LOCAL_ZONE

    def now_utc(self) -> Column:
        return F.lit(self.as_of_utc).cast("timestamp_ntz")

    def now_local(self) -> Column:
        return to_local(self.now_utc(), self.zone)

    def today_local(self) -> Column:
        return F.to_date(self.now_local())
