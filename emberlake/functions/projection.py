"""Albers equal-area conic on the GRS80 ellipsoid, as expressions; by default the California Albers (EPSG:3310)."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import GridSpec

# Semi-major axis and flattening of GRS80.
A, FLATTENING = 6378137.0, 1 / 298.257222101


@dataclass(frozen=True)
class Albers:
    lon0: float = -120.0
    lat0: float = 0.0
    lat1: float = 34.0
    lat2: float = 40.5
    east: float = 0.0
    north: float = -4_000_000.0

    @property
    def e2(self) -> float:
        return FLATTENING * (2 - FLATTENING)

    def _q(self, lat: float) -> float:
        e, s = math.sqrt(self.e2), math.sin(math.radians(lat))
        return (1 - self.e2) * (s / (1 - self.e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def _constants(self) -> tuple[float, float, float]:
        m = lambda lat: math.cos(math.radians(lat)) / math.sqrt(1 - self.e2 * math.sin(math.radians(lat)) ** 2)
        m1, m2, q1, q2 = m(self.lat1), m(self.lat2), self._q(self.lat1), self._q(self.lat2)
        n = (m1 * m1 - m2 * m2) / (q2 - q1)
        c = m1 * m1 + n * q1
        return n, c, A * math.sqrt(c - n * self._q(self.lat0)) / n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, c, rho0 = self._constants()
        e, s = math.sqrt(self.e2), F.sin(F.radians(lat))
        q = (1 - self.e2) * (s / (1 - self.e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
        rho, theta = A * F.sqrt(c - n * q) / n, n * F.radians(lon - self.lon0)
        return self.east + rho * F.sin(theta), self.north + rho0 - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude and latitude; the latitude by the series in the authalic latitude."""
        n, c, rho0 = self._constants()
        dx, dy = x - self.east, rho0 - (y - self.north)
        rho, theta = F.sqrt(dx * dx + dy * dy), F.atan2(dx, dy)
        q = (c - rho * rho * n * n / (A * A)) / n
        b = F.asin(F.greatest(F.least(q / self._q(90.0), F.lit(1.0)), F.lit(-1.0)))
        e2, e4, e6 = self.e2, self.e2**2, self.e2**3
        lat = b + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * b) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * b) + (761 * e6 / 45360) * F.sin(6 * b)
        return F.degrees(theta) / n + self.lon0, F.degrees(lat)


def reproject(cells: DataFrame, value: str, source: GridSpec, target: GridSpec, projection: Albers = Albers()) -> DataFrame:
    """target's cells (projected) with the value of the source cell (in degrees) that holds their centre; null outside. Each target cell asks for one source cell by key."""
    lon, lat = projection.inverse(F.col("x"), F.col("y"))
    t = target.cells(cells.sparkSession).withColumn("__r", source.row_of(lat)).withColumn("__c", source.col_of(lon))
    v = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value))
    return t.join(v, ["__r", "__c"], "left").select("row", "col", value)
