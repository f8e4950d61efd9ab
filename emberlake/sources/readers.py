"""Readers of the files the engine works on."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

YEAR_COLUMNS = ("year_", "year", "YEAR_", "fire_year")


def first_present(columns: list[str], candidates: tuple[str, ...]) -> str | None:
    return next((c for c in candidates if c in columns), None)


def first_date(df: DataFrame, candidates: tuple[str, ...]) -> Column:
    """The first of several columns that holds a date."""
    found = [F.to_date(F.try_to_timestamp(F.col(c).cast("string"))) for c in candidates if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("date")


def fire_perimeters(spark: SparkSession, path: str, years: tuple[int, int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.toDF(*[c.lower() for c in df.columns])
    year = first_present(df.columns, YEAR_COLUMNS)
    if years and year:
        df = df.where(F.col(year).between(*years))
    return df


def building_footprints(spark: SparkSession, path: str) -> DataFrame:
    """Centres of polygons in newline-delimited JSON, one feature a line; broken lines are dropped."""
    schema = "geometry struct<type: string, coordinates: array<array<array<double>>>>, properties string, _bad string"
    df = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)
    df = df.select("geometry", "_bad").where("_bad IS NULL AND geometry IS NOT NULL")
    ring = F.col("geometry.coordinates")[0]
    x, y = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return df.select(F.array_min(x).alias("minx"), F.array_min(y).alias("miny"), F.array_max(x).alias("maxx"), F.array_max(y).alias("maxy"))


def merged_weather(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One table for each variable (day, lat, lon, value), joined to a wide one; a cell that a variable lacks is null."""
    out = None
    for name, path in paths.items():
        one = spark.read.parquet(path).withColumn("lon", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon"))).withColumnRenamed("value", name)
        out = one if out is None else out.join(one, ["day", "lat", "lon"], "full")
    return out


def within(df: DataFrame, bounds: tuple[float, float, float, float], buffer: float = 0.1) -> DataFrame:
    w, s, e, n = bounds
    return df.where(F.col("lon").between(w - buffer, e + buffer) & F.col("lat").between(s - buffer, n + buffer))


#: What each table that the engine loads must hold; names are compared without case.
CONTRACTS = {
    "parcels": {"apn": "string", "minx": "double", "miny": "double", "maxx": "double", "maxy": "double"},
    "roads": {"road_id": "string", "x0": "double", "y0": "double", "x1": "double", "y1": "double"},
    "power_lines": {"line_id": "string", "x0": "double", "y0": "double", "x1": "double", "y1": "double"},
    "ignitions": {"fire_id": "string", "x": "double", "y": "double", "date": "date"},
    "boundary": {"county": "string", "minx": "double", "miny": "double", "maxx": "double", "maxy": "double"},
    "elevation": {"row": "int", "col": "int", "elevation": "double"},
    "fuels": {"row": "int", "col": "int", "fuel_model": "int"},
    "weather": {"day": "date", "lat": "double", "lon": "double"},
}
#: Names that other sources use for a column.
KNOWN_AS = {"apn": ("parcel_id", "parcelid", "pin"), "road_id": ("id", "osm_id", "linearid"), "line_id": ("id", "osm_id"), "fire_id": ("fire_name", "id"), "date": ("alarm_date", "discovery_date"), "county": ("name", "county_name"), "fuel_model": ("fuel", "fbfm40", "value"), "elevation": ("dem", "value")}


def load(spark: SparkSession, name: str, path: str, county: str | None = None, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A table by its contract, from Parquet, CSV (with a header) or JSON lines, as the path ends.

    Columns are found by name or by another name for it, and cast; others stay. A missing one is an error that
    names all that are missing. county keeps that county's rows; bounds (minx, miny, maxx, maxy) those that
    meet it; both reach the scan as filters.
    """
    contract = CONTRACTS[name]
    if path.rstrip("/").endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
    elif path.rstrip("/").endswith((".json", ".jsonl")):
        df = spark.read.json(path)
    else:
        df = spark.read.parquet(path)
    df = df.toDF(*[c.lower() for c in df.columns])
    found = {c: first_present(df.columns, (c, *KNOWN_AS.get(c, ()))) for c in contract}
    if missing := [c for c, f in found.items() if f is None]:
        raise KeyError(f"{name}: missing columns: {missing}")
    df = df.withColumnsRenamed({f: c for c, f in found.items() if f != c}).withColumns({c: F.col(c).cast(kind) for c, kind in contract.items()})
    if county is not None and "county" in df.columns:
        df = df.where(F.col("county") == county)
    if bounds is not None:
        w, s, e, n = bounds
        if {"minx", "maxx"} <= set(df.columns):
            df = df.where((F.col("minx") <= e) & (F.col("maxx") >= w) & (F.col("miny") <= n) & (F.col("maxy") >= s))
        elif {"x0", "x1"} <= set(df.columns):
            df = df.where((F.least("x0", "x1") <= e) & (F.greatest("x0", "x1") >= w) & (F.least("y0", "y1") <= n) & (F.greatest("y0", "y1") >= s))
        elif {"x", "y"} <= set(df.columns):
            df = df.where(F.col("x").between(w, e) & F.col("y").between(s, n))
        elif {"lat", "lon"} <= set(df.columns):
            df = within(df, bounds, 0.0)
    return df
