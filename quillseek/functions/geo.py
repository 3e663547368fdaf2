"""Geographic points, distances, boxes and geohashes as native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6_371_008.8
#: Metres of each unit, and the geohash alphabet.
METRES = {"mm": 0.001, "cm": 0.01, "m": 1.0, "km": 1000.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344, "nmi": 1852.0, "nm": 1852.0}
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
DEFAULT_DISTANCE = "10mi"
_distance = re.compile(r"\s*(\d+(?:\.\d+)?)\s*([a-z]*)\s*$", re.I)


def distance_metres(text: str | None) -> float:
    m = _distance.match(text or DEFAULT_DISTANCE)
    if not m or (m[2].lower() or "m") not in METRES:
        raise ValueError(f"not a distance: {text}")
    return float(m[1]) * METRES[m[2].lower() or "m"]


def geohash_box(code: str) -> tuple[float, float, float, float]:
    """(south, north, west, east)"""
    bounds, even = [[-180.0, 180.0], [-90.0, 90.0]], 0
    for c in code.lower():
        value = ALPHABET.index(c)
        for bit in (16, 8, 4, 2, 1):
            axis = bounds[even]
            axis[0 if value & bit else 1] = (axis[0] + axis[1]) / 2
            even ^= 1
    return *bounds[1], *bounds[0]


def location(text: str) -> tuple[float, float]:
    """(lat, lon) of `lat,lon` or of a geohash's centre."""
    lat, comma, lon = text.partition(",")
    try:
        if comma:
            return float(lat), float(lon)
        s, n, w, e = geohash_box(text)
        return (s + n) / 2, (w + e) / 2
    except ValueError:
        raise ValueError(f"not a location: {text}") from None


def haversine(lat: Column, lon: Column, to: tuple[float, float]) -> Column:
    """Metres to a fixed point."""
    a, b = F.radians(lat), F.radians(F.lit(to[0]))
    x = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon) - F.radians(F.lit(to[1]))) / 2), 2)
    return F.lit(2 * EARTH_METRES) * F.asin(F.sqrt(F.least(x, F.lit(1.0))))


def within(lat: Column, lon: Column, to: tuple[float, float], metres: float) -> Column:
    """A band of latitudes, which scans can use, and the exact distance."""
    degrees = metres / 111_000.0
    return lat.between(to[0] - degrees, to[0] + degrees) & (haversine(lat, lon, to) <= metres)


def in_box(lat: Column, lon: Column, top_left: tuple[float, float], bottom_right: tuple[float, float]) -> Column:
    west, east = top_left[1], bottom_right[1]
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(bottom_right[0], top_left[0]) & across


def geohash(lat: Column, lon: Column, precision: int) -> Column:
    """The geohash of `precision` characters, by interleaving the bits of both scaled coordinates."""
    n = precision * 5
    lon_bits, lat_bits = (n + 1) // 2, n // 2

    def scaled(c: Column, low: float, width: float, bits: int) -> Column:
        return F.least(F.floor((c - low) / width * float(1 << bits)).cast("long"), F.lit((1 << bits) - 1).cast("long"))

    x, y = scaled(lon, -180.0, 360.0, lon_bits), scaled(lat, -90.0, 180.0, lat_bits)
    chars = []
    for k in range(precision):
        value = F.lit(0).cast("long")
        for j in range(5):
            i = k * 5 + j
            source, at = (x, lon_bits - 1 - i // 2) if i % 2 == 0 else (y, lat_bits - 1 - i // 2)
            value = value * 2 + F.shiftright(source, at).bitwiseAND(F.lit(1).cast("long"))
        chars.append(F.substring(F.lit(ALPHABET), value.cast("int") + 1, F.lit(1)))
    return F.concat(*chars)
