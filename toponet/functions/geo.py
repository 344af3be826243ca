"""Distances, cells, tiles and coordinate checks as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radius, metres and kilometres per degree, tile latitude limit.
EARTH_RADIUS_M = 6371000.0
METRES_PER_DEGREE = 111320.0
KM_PER_DEGREE = 111.32
TILE_LAT_LIMIT = 85.05112878


def half_up(value: Column, digits: int = 0) -> Column:
    """Round half up, also below zero (``round`` goes away from zero instead)."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5).cast("double") / scale


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lng = F.radians(lng2 - lng1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.sin(half_lng) * F.sin(half_lng)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def flat_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Flat-earth kilometres, longitude scaled at the first point."""
    dy = (lat1 - lat2) * KM_PER_DEGREE
    dx = (lng1 - lng2) * KM_PER_DEGREE * F.cos(F.radians(lat1))
    return F.sqrt(dx * dx + dy * dy)


def flat_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Flat-earth metres, longitude scaled at the first point."""
    dy = (lat1 - lat2) * METRES_PER_DEGREE
    dx = (lng1 - lng2) * METRES_PER_DEGREE * F.cos(F.radians(lat1))
    return F.sqrt(dx * dx + dy * dy)


def valid_coordinate(lat: Column, lng: Column) -> Column:
    """Both present, finite and in range."""
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180), F.lit(False)) & ~(
        F.isnan(lat) | F.isnan(lng)
    )


def has_point(lat: Column, lng: Column) -> Column:
    """Both present and not the (0, 0) that stands for "no coordinate"."""
    return lat.isNotNull() & lng.isNotNull() & ~((lat == 0) & (lng == 0))


def finite_or_null(text: Column) -> Column:
    """Number in ``text``, NULL for blank, unreadable or non-finite."""
    number = F.trim(text).try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def cluster_cell(zoom: int) -> float:
    """Grid step in degrees at a zoom level."""
    return max(0.0005, 360.0 / 2 ** (zoom + 5))


def grid_id(value: Column, step: float) -> Column:
    """Number of the grid line at or below ``value``."""
    return F.floor(value / F.lit(step)).cast("long")


def tile_x(lng: Column, zoom: int) -> Column:
    """Slippy-map column."""
    return F.floor((lng + 180) / 360 * float(2**zoom)).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    """Slippy-map row, latitude limited to the square map."""
    rad = F.radians(F.greatest(F.lit(-TILE_LAT_LIMIT), F.least(F.lit(TILE_LAT_LIMIT), lat)))
    turned = (1 - F.ln(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2
    return F.when(lat.isNotNull(), F.floor(turned * float(2**zoom)).cast("long"))


def in_viewport(
    lat: Column, lng: Column, west: float, south: float, east: float, north: float
) -> Column:
    """Box test; flipped latitudes are swapped, west > east wraps the date line."""
    low, high = min(south, north), max(south, north)
    columns = lng.between(west, east) if west <= east else (lng >= west) | (lng <= east)
    return lat.between(low, high) & columns


def walking_minutes(metres: Column, kmh: float = 4.2) -> Column:
    """Whole minutes on foot, at least one for any positive distance."""
    minutes = half_up(metres / 1000 / kmh * 60)
    return F.when(metres.isNull() | (metres <= 0), 0.0).otherwise(F.greatest(F.lit(1.0), minutes))


def walk_distance_label(metres: Column) -> Column:
    """Distance as shown on a walk: tens of metres, then kilometres."""
    tens = F.concat((half_up(metres / 10) * 10).cast("long").cast("string"), F.lit(" m"))
    one = F.concat(F.format_string("%.1f", metres / 1000), F.lit(" km"))
    none = F.concat(half_up(metres / 1000).cast("long").cast("string"), F.lit(" km"))
    return F.when(metres < 1000, tens).when(metres < 10000, one).otherwise(none)


def nearby_distance_label(metres: Column) -> Column:
    """Distance as shown in a nearby list."""
    km = half_up(metres / 100) / 10
    return F.when(
        metres < 1000, F.concat(half_up(metres).cast("long").cast("string"), F.lit(" m"))
    ).otherwise(F.concat(F.format_string("%.1f", km), F.lit(" km")))


def trigger_radius(metres: Column) -> Column:
    """Geofence radius: 45 m unless stated, never over 250 m."""
    return F.when(metres.isNull() | (metres <= 0), 45.0).otherwise(
        F.least(half_up(metres), F.lit(250.0))
    )


def search_radius_km(corner_m: Column) -> Column:
    """Map search radius from the distance to the viewport's corner."""
    return F.least(F.lit(500.0), F.greatest(F.lit(0.5), F.ceil(corner_m / 100) / 10))


def bearing_difference(a: Column, b: Column) -> Column:
    """Smallest angle between two bearings in degrees."""
    turn = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(turn, 360 - turn)


def wkt_point(text: Column) -> dict[str, Column]:
    """Longitude and latitude of a ``Point(x y)`` literal."""
    number = r"(-?\d+(?:\.\d+)?)"
    pattern = rf"^Point\({number} {number}\)$"
    return {
        "lng": F.regexp_extract(text, pattern, 1).try_cast("double"),
        "lat": F.regexp_extract(text, pattern, 2).try_cast("double"),
    }
