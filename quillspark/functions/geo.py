"""Distances and encodings on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, METRES_A_DEGREE = 6_371_000.0, 111_320.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points in degrees."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2))
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def encode(degrees: Column, most: float) -> Column:
    """Degrees in [-most, most] as a 32-bit integer."""
    return F.least(F.floor((degrees + most) / (2 * most) * float(1 << 32)), F.lit((1 << 32) - 1)).cast("bigint") - F.lit(1 << 31)


def decode(code: Column, most: float) -> Column:
    return (code + F.lit(1 << 31)).cast("double") / float(1 << 32) * (2 * most) - most
