"""Distances and cells on the sphere, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180.0


def haversine_km(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Great-circle distance in km."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity (latitudes here are negative)."""
    return F.floor(x + 0.5)


def grid_cell(x: Column, tol: float) -> Column:
    """Index of the nearest lattice line at spacing ``tol``."""
    return round_half_up(x / F.lit(float(tol)))


def format_latlng(lng: Column, lat: Column) -> Column:
    from sightline.functions.text import to_fixed

    return F.when(lng.isNull() | lat.isNull(), F.lit("")).otherwise(
        F.concat(to_fixed(lat, 4), F.lit(", "), to_fixed(lng, 4))
    )


class SphereGrid:
    """Latitude bands cut into columns, cells of at most ``side_km`` each way.

    By default the side is such that two points in one cell are at most ``km`` apart, anywhere on
    the sphere. ``cover`` lists the cells that a circle of ``km`` around a point can touch, with
    the antimeridian wrapped and polar circles widened to whole bands; the list has a fixed bound.
    """

    def __init__(self, km: float, side_km: float | None = None):
        if not km > 0:
            raise ValueError("km must be positive")
        self.km = float(km)
        self.side_km = float(side_km) if side_km else km / math.sqrt(2.0) * 0.999
        self.band_deg = self.side_km / KM_PER_DEGREE
        self.last_band = int(math.floor(180.0 / self.band_deg))

    def _band(self, lat: Column) -> Column:
        return F.least(F.greatest(F.floor((lat + 90.0) / self.band_deg), F.lit(0)), F.lit(self.last_band))

    def _columns(self, band: Column) -> Column:
        low = band * self.band_deg - 90.0
        high = low + self.band_deg
        nearest = F.when((low <= 0) & (high >= 0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(high)))
        widest = F.cos(F.radians(nearest)) * (360.0 * KM_PER_DEGREE)
        return F.greatest(F.ceil(widest / self.side_km), F.lit(1))

    @staticmethod
    def _id(band: Column, col: Column) -> Column:
        return F.shiftleft(band.cast("long"), 32) + col.cast("long")

    def cell(self, lng: Column, lat: Column) -> Column:
        band = self._band(lat)
        n = self._columns(band)
        col = F.pmod(F.floor((lng + 180.0) / (F.lit(360.0) / n)), n)
        return self._id(band, col)

    def cover(self, lng: Column, lat: Column) -> Column:
        reach = self.km / KM_PER_DEGREE * 1.0001
        to_pole = F.abs(lat) + reach >= 90.0
        ratio = F.sin(F.radians(F.lit(reach))) / F.cos(F.radians(lat))
        half = F.when(to_pole, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 1.0001)

        def columns_of(band: Column) -> Column:
            n = self._columns(band)
            step = F.lit(360.0) / n
            first = F.floor((lng - half + 180.0) / step)
            last = F.floor((lng + half + 180.0) / step)
            every = (last - first + 1) >= n
            cols = F.sequence(F.when(every, F.lit(0)).otherwise(first), F.when(every, n - 1).otherwise(last))
            return F.transform(cols, lambda c: self._id(band, F.pmod(c, n)))

        bands = F.sequence(self._band(lat - reach), self._band(lat + reach))
        return F.array_distinct(F.flatten(F.transform(bands, columns_of)))
