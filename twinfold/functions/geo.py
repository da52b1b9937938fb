"""Places on the earth: distances, and cells in which near places meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088  # mean radius
DEGREE_KM = 111.195  # a degree of latitude, or of longitude on the equator
# A grid is laid four times, shifted by half a cell in either direction.
SHIFTS = ((0.0, 0.0), (0.5, 0.0), (0.0, 0.5), (0.5, 0.5))


def great_circle_km(lat_l: Column, lon_l: Column, lat_r: Column, lon_r: Column) -> Column:
    """Distance in kilometres on a sphere, by the haversine."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = half(lat_l, lat_r) ** 2 + F.cos(F.radians(lat_l)) * F.cos(F.radians(lat_r)) * half(lon_l, lon_r) ** 2
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def geo_point(lat: Column, lon: Column) -> Column:
    """A place as text, ``lat,lon``; null where a side is missing or no place of the earth."""
    lat, lon = (x.try_cast("double") for x in (lat.cast("string"), lon.cast("string")))
    there = (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.when(there, F.concat_ws(",", lat.cast("string"), lon.cast("string")))


def point_part(point: Column, part: int, lenient: bool = False) -> Column:
    """One of the numbers of a text between commas, without a pattern and an array of all parts. ``lenient``: null
    where there is none."""
    text = F.substring_index(point, ",", part + 1)
    if part:
        text = F.when(F.substring_index(point, ",", part) != text, F.substring_index(text, ",", -1))
    return text.try_cast("double") if lenient else text.cast("double")


def point_distance_km(left: Column, right: Column) -> Column:
    """Distance of two places as texts."""
    return great_circle_km(point_part(left, 0), point_part(left, 1), point_part(right, 0), point_part(right, 1))


def geo_cells(lat: Column, lon: Column, near_km: float) -> list[Column]:
    """The cell of a place in each of four grids. Two places within ``near_km`` of each other share a
    cell in one of them at least.

    A cell is twice as high as ``near_km``, so one of two grids that are shifted by half a cell holds both
    latitudes between two lines. Its width in degrees is made for the border of its row that is nearer
    to a pole, and a twentieth more, so the same holds for longitudes. A row with under eight cells
    around the earth is one cell; around the date line cells are counted modulo their number.
    """
    high = 2 * near_km / DEGREE_KM
    found = []
    for up, along in SHIFTS:
        row = F.floor(lat / high + up)
        # the border of the row nearest to a pole, where a degree of longitude is shortest
        edge = F.greatest(F.abs((row - up) * high), F.abs((row + 1 - up) * high))
        narrow = F.cos(F.radians(F.least(edge, F.lit(90.0))))
        count = F.floor(F.lit(360.0 / 1.05) * narrow / high)  # cells around, each at least as wide as it must be
        column = F.when(count >= 8, F.pmod(F.floor((lon + 180.0) / 360.0 * count + along), count)).otherwise(0)
        found.append(F.when(lat.isNotNull() & lon.isNotNull(), F.concat_ws(
            ":", F.lit(f"{up}/{along}"), row.cast("bigint"), column.cast("bigint"))))
    return found
