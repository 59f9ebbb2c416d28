"""Scalar normalisation: units, coordinates, cell areas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def to_mm_per_day(value: Column, units: Column) -> Column:
    """kg m-2 s-1 becomes mm/day; values in any other unit are unchanged."""
    flux = F.lower(F.regexp_replace(units, r"\s+", " ")).isin("kg m-2 s-1", "kg m^-2 s^-1", "kg/m2/s", "mm s-1")
    return F.when(flux, value * 86400.0).otherwise(value)


def to_celsius(value: Column, units: Column) -> Column:
    return F.when(F.upper(F.trim(units)).isin("K", "KELVIN"), value - 273.15).otherwise(value)


def wrap_longitude(lon: Column, largest: Column | None = None) -> Column:
    """Longitudes of 0..360 as -180..180; only if the largest of all exceeds 180, where that is given."""
    wrapped = F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    return wrapped if largest is None else F.when(largest > 180, wrapped).otherwise(lon)


def cell_area(lat: Column, dlat: float, dlon: float) -> Column:
    """The area in m2 of a cell centred at lat, dlat by dlon degrees, on a sphere."""
    band = F.sin(F.radians(lat + dlat / 2)) - F.sin(F.radians(lat - dlat / 2))
    return F.lit(EARTH_RADIUS_M * EARTH_RADIUS_M * math.radians(dlon)) * band
