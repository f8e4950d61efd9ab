"""The grid a raster is on, and cells as rows."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """Row 0 is north; x grows to the east, y to the north."""

    minx: float
    miny: float
    maxx: float
    maxy: float
    resolution: float

    @property
    def ncols(self) -> int:
        return int((self.maxx - self.minx) / self.resolution)

    @property
    def nrows(self) -> int:
        return int((self.maxy - self.miny) / self.resolution)

    @property
    def dx(self) -> float:
        return (self.maxx - self.minx) / self.ncols

    @property
    def dy(self) -> float:
        return (self.maxy - self.miny) / self.nrows

    def col_of(self, x: Column) -> Column:
        return F.floor((x - F.lit(self.minx)) / F.lit(self.dx)).cast("int")

    def row_of(self, y: Column) -> Column:
        return F.floor((F.lit(self.maxy) - y) / F.lit(self.dy)).cast("int")

    def x_of(self, col: Column) -> Column:
        return F.lit(self.minx) + (col + F.lit(0.5)) * F.lit(self.dx)

    def y_of(self, row: Column) -> Column:
        return F.lit(self.maxy) - (row + F.lit(0.5)) * F.lit(self.dy)

    def inside(self, row: Column, col: Column) -> Column:
        return row.between(0, self.nrows - 1) & col.between(0, self.ncols - 1)

    def cells(self, spark: SparkSession) -> DataFrame:
        """A reference grid: every cell with its centre, made from one range."""
        n = F.lit(self.ncols)
        cells = spark.range(self.nrows * self.ncols).select(F.floor(F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"))
        return cells.withColumn("x", self.x_of(F.col("col"))).withColumn("y", self.y_of(F.col("row")))


def tile_bounds(tile_id: int, across: int = 8, size: float = 100_000.0, buffer: float = 10_000.0, origin: tuple[float, float] = (0.0, 0.0)) -> tuple[float, float, float, float]:
    """Bounds of a 1-based tile, with its halo."""
    row, col = divmod(tile_id - 1, across)
    x, y = origin[0] + col * size, origin[1] + row * size
    return x - buffer, y - buffer, x + size + buffer, y + size + buffer
