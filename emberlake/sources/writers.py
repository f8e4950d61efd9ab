"""Files for the fire model: landscape, weather, wind and moisture."""
from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYERS = ("elevation", "slope", "aspect", "fuel_model", "canopy_cover", "canopy_height", "canopy_base_height", "canopy_bulk_density")
REQUIRED = LAYERS[:4]
MAX_CELLS = 50_000_000


def landscape_bytes(cells: DataFrame, bounds: tuple[float, float, float, float], cell: float, latitude: int = 38) -> bytes:
    """A landscape file: a header of little-endian integers and doubles with each layer's range, then its 16-bit planes, south row first. The grid is one file, so its size is checked before it is gathered."""
    layers = [c for c in LAYERS if c in cells.columns]
    if missing := [c for c in REQUIRED if c not in layers]:
        raise ValueError(f"missing layers: {missing}")
    n = cells.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    rows, cols = n.r + 1, n.c + 1
    if rows * cols > MAX_CELLS:
        raise ValueError(f"a landscape file holds at most {MAX_CELLS} cells")
    t = cells.select("row", "col", *[F.col(c).cast("smallint").alias(c) for c in layers]).toPandas()
    planes = []
    for name in layers:
        plane = np.full((rows, cols), -9999, "<i2")
        plane[t["row"], t["col"]] = t[name].fillna(-9999)
        planes.append(plane[::-1])
    crown = 21 if len(layers) > 4 else 20
    head = struct.pack("<iii", crown, 20, latitude) + struct.pack("<4d", bounds[0], bounds[2], bounds[1], bounds[3])
    for p in planes:
        values = np.unique(p[p != -9999])
        head += struct.pack("<iii", int(values.min(initial=0)), int(values.max(initial=0)), len(values) if len(values) <= 100 else -1)
    head += struct.pack("<ii4d", cols, rows, bounds[2], bounds[0], bounds[3], bounds[1]) + struct.pack("<idd", 0, cell, cell)
    return head + b"".join(p.tobytes() for p in planes)


def weather_lines(stream: DataFrame) -> DataFrame:
    """month day precipitation tmin tmax rhmin rhmax and the hours, a line for each day, in order of day."""
    return stream.orderBy("day").select(F.format_string("%d %d %.2f %.0f %.0f %.0f %.0f 1000 1400 1900", F.month("day"), F.dayofmonth("day"), "precip_in", "temp_min_f", "temp_max_f", "rh_min", "rh_max").alias("value"))


def wind_line(speed: float, direction: float) -> str:
    return f"{speed * 2.237:.1f} {direction:.0f}"


def moisture_lines(spark, fm1: float, fm10: float, fm100: float, herb: float, woody: float) -> DataFrame:
    return spark.range(1, 14).orderBy("id").select(F.concat_ws(" ", "id", *[F.lit(f"{v:.0f}") for v in (fm1, fm10, fm100, herb, woody)]).alias("value"))


def probability(cells: DataFrame, path: str) -> None:
    cells.select("row", "col", F.col("burn_probability").cast("float").alias("burn_probability")).write.mode("overwrite").parquet(path)


def parcels(table: DataFrame, path: str) -> None:
    writer = table.write.mode("overwrite")
    writer.option("header", True).csv(path) if path.endswith(".csv") else writer.parquet(path)
