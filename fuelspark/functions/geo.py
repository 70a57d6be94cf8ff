"""Coordinates, distances and grid cells as native column expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fuelspark.functions.lookups import BOUNDS

EARTH_KM = 6371.0
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column, cosines: tuple[Column, Column] | None = None) -> Column:
    cos1, cos2 = cosines or (F.cos(F.radians(lat1)), F.cos(F.radians(lat2)))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + cos1 * cos2 * half_lng * half_lng
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def manhattan_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column, km_per_degree: float = 111.32) -> Column:
    k = F.lit(km_per_degree)
    return F.abs(lat1 - lat2) * k + F.abs(lng1 - lng2) * (k * F.cos(F.radians((lat1 + lat2) / 2)))


def valid_latitude(lat: Column) -> Column:
    """The value when it is inside the country and not 0, else null."""
    return F.when((lat != 0.0) & lat.between(BOUNDS[0], BOUNDS[1]), lat)


def valid_longitude(lng: Column) -> Column:
    return F.when((lng != 0.0) & lng.between(BOUNDS[2], BOUNDS[3]), lng)


def has_valid_point(lat: Column, lng: Column) -> Column:
    inside = lat.between(BOUNDS[0], BOUNDS[1]) & lng.between(BOUNDS[2], BOUNDS[3])
    return F.coalesce(inside, F.lit(False))


def geohash_cell(lat: Column, lng: Column, precision: int) -> tuple[Column, Column]:
    """Integer column and row of the geohash cell; neighbours are plus or minus one."""
    lng_bits, lat_bits = (5 * precision + 1) // 2, 5 * precision // 2
    ix = F.floor((lng + 180.0) / 360.0 * F.lit(float(1 << lng_bits)))
    iy = F.floor((lat + 90.0) / 180.0 * F.lit(float(1 << lat_bits)))
    return ix, iy


def geohash(lat: Column, lng: Column, precision: int = 7) -> Column:
    """Geohash text of a valid point, else null, by interleaving the cell bits."""
    lng_bits, lat_bits = (5 * precision + 1) // 2, 5 * precision // 2
    ix, iy = geohash_cell(lat, lng, precision)
    chars = []
    for start in range(0, 5 * precision, 5):
        index = None
        for bit in range(start, start + 5):
            axis, width = (ix, lng_bits) if bit % 2 == 0 else (iy, lat_bits)
            value = F.shiftleft(
                F.shiftright(axis, width - 1 - bit // 2).bitwiseAND(F.lit(1)).cast("int"), 4 - (bit - start)
            )
            index = value if index is None else index + value
        chars.append(F.substring(F.lit(GEOHASH_ALPHABET), index + 1, F.lit(1)))
    return F.when(has_valid_point(lat, lng), F.concat(*chars))


def decimal_places(col: Column) -> Column:
    """Digits after the point when the value is written with up to 10 decimals."""
    text = F.round(col, 10).cast("decimal(14,10)").cast("string")
    return F.length(F.regexp_replace(F.substring_index(text, ".", -1), "0+$", ""))


def coordinate_precision(lat: Column, lng: Column) -> Column:
    places = F.least(decimal_places(lat), decimal_places(lng))
    return (
        F.when(lat.isNull() | lng.isNull(), F.lit("none"))
        .when(places <= 2, F.lit("low"))
        .when(places == 3, F.lit("medium"))
        .otherwise(F.lit("high"))
    )


def cell_degrees(radius_km: float, max_abs_lat: float = BOUNDS[1]) -> tuple[float, float]:
    """Cell height and width in degrees so that any two points within the radius, even after the
    distance is rounded to 2 decimals, are at most one cell apart on either axis."""
    reach = radius_km + 0.01
    km_per_degree = math.pi * EARTH_KM / 180.0
    half_chord = math.sin(reach / (2 * EARTH_KM))
    width = 2 * math.degrees(math.asin(min(1.0, half_chord / math.cos(math.radians(max_abs_lat)))))
    return reach / km_per_degree * 1.0001, width * 1.0001
