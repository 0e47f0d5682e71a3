"""Positions and distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean radius of the earth in miles, and the box outside which a coordinate is taken for garbage.
EARTH_RADIUS_MILES = 3958.8
LAT_RANGE = (40.0, 41.2)
LON_RANGE = (-74.5, -73.4)


def parse_position(text: Column) -> tuple[Column, Column]:
    """``"lat, lon"`` as two columns; both NULL unless there are exactly two numbers inside the box."""
    parts = F.split(text, ",")
    lat = F.trim(F.try_element_at(parts, F.lit(1))).try_cast("double")
    lon = F.trim(F.try_element_at(parts, F.lit(2))).try_cast("double")
    usable = (F.size(parts) == 2) & lat.between(*LAT_RANGE) & lon.between(*LON_RANGE)
    return F.when(usable, lat), F.when(usable, lon)


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; NULL when any coordinate is."""
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((phi2 - phi1) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    chord = half_lat * half_lat + F.cos(phi1) * F.cos(phi2) * (half_lon * half_lon)
    return F.lit(2 * EARTH_RADIUS_MILES) * F.asin(F.sqrt(chord))


# A grid over the globe, in degrees; both sizes divide their range, so the last column of tiles meets the first.
TILE_LAT = 0.12
TILE_LON = 0.16
TILE_COLUMNS = 2250
# Covers the rounding of tile borders, in degrees.
SLACK = 1e-6


def tile(lat: Column, lon: Column) -> Column:
    """The tile of a point as text; NULL without a position."""
    row = F.floor((lat + 90) / TILE_LAT)
    column = F.pmod(F.floor((lon + 180) / TILE_LON), F.lit(TILE_COLUMNS))
    return F.concat_ws(":", row, column)


def tiles_within(lat: Column, lon: Column, miles: float) -> Column:
    """All tiles that hold a point less than ``miles`` away. A handful in any inhabited latitude."""
    angle = miles / EARTH_RADIUS_MILES
    reach = math.degrees(angle) + SLACK
    cosine = F.cos(F.radians(lat))
    widest = F.degrees(F.asin(F.lit(math.sin(angle)) / cosine)) + SLACK
    width = F.when(cosine > math.sin(angle), widest).otherwise(F.lit(180.0))

    def steps(low: Column, high: Column, size: float) -> Column:
        return F.sequence(F.floor(low / size), F.floor(high / size))

    rows = steps(lat + 90 - reach, lat + 90 + reach, TILE_LAT)
    columns = F.array_distinct(
        F.transform(
            steps(lon + 180 - width, lon + 180 + width, TILE_LON), lambda x: F.pmod(x, F.lit(TILE_COLUMNS))
        )
    )
    return F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: F.concat_ws(":", y, x))))
