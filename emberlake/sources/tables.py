"""Domain tables over the given star schema, each as a DataFrame and as SQL.

Each is derived by key from one table, so that both sides agree row for row. Fires, parcels and zones
need one figure besides: how many rows of cells the parts make.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from ..functions.hashing import uniform, uniform_sql

COLS, CELL = 50, 270.0
PERIMETER = 32.0
LEAST_ROWS = 40  # the rows that 2000 parts make
# Fuel codes that the synthetic grid goes through, the last two not burnable.
FUELS = (101, 102, 103, 104, 105, 106, 107, 108, 109, 121, 122, 123, 124, 141, 142, 143, 144, 145, 146, 147, 148, 149, 161, 162, 163, 164, 165, 181, 182, 183, 184, 185, 186, 187, 188, 189, 201, 202, 203, 204, 98, 99)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def world(spark: SparkSession, sf_dir: str) -> GridSpec:
    """Bounds of the cells that the parts make, LEAST_ROWS rows at least; fires, parcels and zones lie in them at any scale."""
    last = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    rows = max(LEAST_ROWS, (-1 if last is None else last) // COLS + 1)
    return GridSpec(0.0, -rows * CELL, COLS * CELL, 0.0, CELL)


#: The rows of the world, and its southern bound.
ROWS_SQL = f"(SELECT greatest({LEAST_ROWS}, coalesce(max(p_partkey), -1) // {COLS} + 1) FROM part)"
SOUTH_SQL = f"(SELECT greatest({LEAST_ROWS}, coalesce(max(p_partkey), -1) // {COLS} + 1) * -{CELL}::DOUBLE FROM part)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.floor(k / COLS).cast("int").alias("row"),
        (k % COLS).cast("int").alias("col"),
        ((F.col("p_retailprice") - 900.0) * 10.0).alias("elevation"),
        F.element_at(F.array(*map(F.lit, FUELS)), (k % len(FUELS) + 1).cast("int")).alias("fuel_model"),
        F.least(F.col("p_size") * 2, F.lit(100)).alias("canopy_cover"),
        (F.col("p_size") * 0.5).alias("canopy_height"),
        (F.col("p_size") * 0.125).alias("canopy_base_height"),
        (F.col("p_size") / 128.0).alias("canopy_bulk_density"),
    )


GRID_SQL = f"""grid AS (SELECT CAST(p_partkey // {COLS} AS INTEGER) AS "row", CAST(p_partkey % {COLS} AS INTEGER) AS col,
 (p_retailprice - 900.0::DOUBLE) * 10.0::DOUBLE AS elevation, ([{', '.join(map(str, FUELS))}])[CAST(p_partkey % {len(FUELS)} + 1 AS INTEGER)] AS fuel_model,
 least(p_size * 2, 100) AS canopy_cover, p_size * 0.5::DOUBLE AS canopy_height, p_size * 0.125::DOUBLE AS canopy_base_height, p_size / 128.0::DOUBLE AS canopy_bulk_density FROM part)"""


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each day that has an order: its first order's amount is the wind, the rest is drawn by day. Temperatures in kelvin."""
    day = F.to_date("o_orderdate")
    first = table(spark, sf_dir, "orders").groupBy(day.alias("day")).agg(F.min_by("o_totalprice", "o_orderkey").alias("v"))
    u = lambda s: uniform(s, F.date_format("day", "yyyy-MM-dd"))
    return first.select(
        "day",
        (F.lit(285.0) + 30.0 * u("tmmx")).alias("tmmx"),
        (F.lit(275.0) + 10.0 * u("tmmn")).alias("tmmn"),
        (F.lit(40.0) + 60.0 * u("rmax")).alias("rmax"),
        (F.lit(5.0) + 60.0 * u("rmin")).alias("rmin"),
        (F.col("v") / 500000.0 * 16.0).alias("vs"),
        (360.0 * u("th")).alias("th"),
        F.when(u("wet") < 0.1, 10.0 * u("pr")).otherwise(0.0).alias("pr"),
        (100.0 * u("erc")).alias("erc"),
        (F.lit(3.0) + 20.0 * u("fm100")).alias("fm100"),
    )


def _u(stream: str) -> str:
    return uniform_sql(stream, "strftime(day, '%Y-%m-%d')")


WEATHER_SQL = f"""first_order AS (SELECT CAST(o_orderdate AS DATE) AS day, min_by(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1),
weather AS (SELECT day, 285.0::DOUBLE + 30.0::DOUBLE * {_u('tmmx')} AS tmmx, 275.0::DOUBLE + 10.0::DOUBLE * {_u('tmmn')} AS tmmn,
 40.0::DOUBLE + 60.0::DOUBLE * {_u('rmax')} AS rmax, 5.0::DOUBLE + 60.0::DOUBLE * {_u('rmin')} AS rmin, v / 500000.0::DOUBLE * 16.0::DOUBLE AS vs,
 360.0::DOUBLE * {_u('th')} AS th, CASE WHEN {_u('wet')} < 0.1::DOUBLE THEN 10.0::DOUBLE * {_u('pr')} ELSE 0.0::DOUBLE END AS pr,
 100.0::DOUBLE * {_u('erc')} AS erc, 3.0::DOUBLE + 20.0::DOUBLE * {_u('fm100')} AS fm100 FROM first_order)"""


def fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square perimeters; of the acreage, a core of one part in PERIMETER * PERIMETER, so that a year's fires leave some of the world unburned at any scale."""
    v, k = F.col("o_totalprice") / 500000.0, F.col("o_orderkey")
    df = table(spark, sf_dir, "orders").select(
        k.alias("fire_id"), F.year("o_orderdate").alias("year_"), (v * v * v * 20000.0).alias("gis_acres"), F.to_date("o_orderdate").alias("alarm_date"), (13500.0 * uniform("fx", k)).alias("cx"), (world(spark, sf_dir).miny * uniform("fy", k)).alias("cy")
    )
    half = F.sqrt(F.col("gis_acres") * 4046.86) / (2.0 * PERIMETER)
    return df.select("fire_id", "year_", "gis_acres", "alarm_date", (F.col("cx") - half).alias("minx"), (F.col("cy") - half).alias("miny"), (F.col("cx") + half).alias("maxx"), (F.col("cy") + half).alias("maxy"))


FIRES_SQL = f"""fires0 AS (SELECT o_orderkey AS fire_id, CAST(year(o_orderdate) AS INTEGER) AS year_, (o_totalprice / 500000.0::DOUBLE) * (o_totalprice / 500000.0::DOUBLE) * (o_totalprice / 500000.0::DOUBLE) * 20000.0::DOUBLE AS gis_acres,
 CAST(o_orderdate AS DATE) AS alarm_date, 13500.0::DOUBLE * {uniform_sql('fx', 'o_orderkey')} AS cx, {SOUTH_SQL} * {uniform_sql('fy', 'o_orderkey')} AS cy FROM orders),
fires AS (SELECT fire_id, year_, gis_acres, alarm_date, cx - sqrt(gis_acres * 4046.86::DOUBLE) / {2 * PERIMETER}::DOUBLE AS minx, cy - sqrt(gis_acres * 4046.86::DOUBLE) / {2 * PERIMETER}::DOUBLE AS miny,
 cx + sqrt(gis_acres * 4046.86::DOUBLE) / {2 * PERIMETER}::DOUBLE AS maxx, cy + sqrt(gis_acres * 4046.86::DOUBLE) / {2 * PERIMETER}::DOUBLE AS maxy FROM fires0)"""


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    df = df.select(k.cast("string").alias("apn"), F.col("n_name").alias("county"), (13000.0 * uniform("px", k)).alias("minx"), ((world(spark, sf_dir).miny + 300.0) * uniform("py", k) - 300.0).alias("miny"), (F.lit(100.0) + 400.0 * uniform("ps", k)).alias("side"))
    return df.select("apn", "county", "minx", "miny", (F.col("minx") + F.col("side")).alias("maxx"), (F.col("miny") + F.col("side")).alias("maxy"))


PARCELS_SQL = f"""parcels0 AS (SELECT CAST(c_custkey AS VARCHAR) AS apn, n_name AS county, 13000.0::DOUBLE * {uniform_sql('px', 'c_custkey')} AS minx,
 ({SOUTH_SQL} + 300.0::DOUBLE) * {uniform_sql('py', 'c_custkey')} - 300.0::DOUBLE AS miny, 100.0::DOUBLE + 400.0::DOUBLE * {uniform_sql('ps', 'c_custkey')} AS side FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
parcels AS (SELECT apn, county, minx, miny, minx + side AS maxx, miny + side AS maxy FROM parcels0)"""


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    name = F.element_at(F.array(*map(F.lit, ("Very High", "High", "Moderate", "Other", "High"))), F.col("n_regionkey") + 1)
    df = table(spark, sf_dir, "nation").select(k.alias("zone_id"), name.alias("haz_class"), (11000.0 * uniform("zx", k)).alias("minx"), ((world(spark, sf_dir).miny + 1800.0) * uniform("zy", k) - 1800.0).alias("miny"))
    return df.withColumn("maxx", F.col("minx") + 2500.0).withColumn("maxy", F.col("miny") + 1800.0)


ZONES_SQL = f"""zones AS (SELECT n_nationkey AS zone_id, (['Very High', 'High', 'Moderate', 'Other', 'High'])[n_regionkey + 1] AS haz_class, 11000.0::DOUBLE * {uniform_sql('zx', 'n_nationkey')} AS minx,
 ({SOUTH_SQL} + 1800.0::DOUBLE) * {uniform_sql('zy', 'n_nationkey')} - 1800.0::DOUBLE AS miny, 11000.0::DOUBLE * {uniform_sql('zx', 'n_nationkey')} + 2500.0::DOUBLE AS maxx, ({SOUTH_SQL} + 1800.0::DOUBLE) * {uniform_sql('zy', 'n_nationkey')} - 1800.0::DOUBLE + 1800.0::DOUBLE AS maxy FROM nation)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and probabilities with heavy ties and values on bin edges."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_discount") * 10.0).alias("prob"))


SCORED_SQL = "scored AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, l_discount * 10.0::DOUBLE AS prob FROM lineitem)"


def scored_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("grp"), (F.col("event_type") == "error").cast("int").alias("label"), F.least(F.col("value") / 500.0, F.lit(1.0)).alias("prob"))


SCORED_BY_DAY_SQL = "scored AS (SELECT CAST(day(ts) AS INTEGER) AS grp, CAST(event_type = 'error' AS INTEGER) AS label, least(value / 500.0::DOUBLE, 1.0::DOUBLE) AS prob FROM events)"


LATS, LONS = (38.0, 38.5, 39.0), (-123.0, -122.5, -122.0)


def weather_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days' weather on a small regular grid of places; wind and temperature differ by place."""
    places = F.explode(F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon"), F.lit(float(i * len(LONS) + j)).alias("k")) for i, a in enumerate(LATS) for j, b in enumerate(LONS)]))
    w = weather(spark, sf_dir).withColumn("place", places)
    return w.select("day", "place.lat", "place.lon", (F.col("tmmx") + F.col("place.k")).alias("tmmx"), (F.col("vs") + F.col("place.k") / 8.0).alias("vs"), "rmin", "th", "pr", "erc")


WEATHER_CELLS_SQL = f"""places AS (SELECT lat, lon, (i * {len(LONS)} + j)::DOUBLE AS k FROM (SELECT unnest([{', '.join(map(str, LATS))}])::DOUBLE AS lat, unnest(range({len(LATS)})) AS i), (SELECT unnest([{', '.join(map(str, LONS))}])::DOUBLE AS lon, unnest(range({len(LONS)})) AS j)),
weather_cells AS (SELECT day, lat, lon, tmmx + k AS tmmx, vs + k / 8.0::DOUBLE AS vs, rmin, th, pr, erc FROM weather, places)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place and a day for each customer, some outside the grid of places."""
    k = F.col("c_custkey")
    day = F.date_add(F.lit("1996-01-01").cast("date"), (k % 365).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), (F.lit(37.8) + 1.4 * uniform("lat", k)).alias("lat"), (F.lit(-123.2) + 1.4 * uniform("lon", k)).alias("lon"), day.alias("day"))


PLACES_SQL = f"pts AS (SELECT c_custkey AS id, 37.8::DOUBLE + 1.4::DOUBLE * {uniform_sql('lat', 'c_custkey')} AS lat, -123.2::DOUBLE + 1.4::DOUBLE * {uniform_sql('lon', 'c_custkey')} AS lon, CAST(DATE '1996-01-01' + CAST(c_custkey % 365 AS INTEGER) AS DATE) AS day FROM customer)"

VIEWS = {"grid": grid, "weather_daily": weather, "weather_cells": weather_cells, "fires": fires, "parcels": parcels, "zones": zones, "scored": scored}


def register(spark: SparkSession, sf_dir: str) -> list[str]:
    """Makes the domain tables temporary views, for Spark SQL; returns their names."""
    for name, make in VIEWS.items():
        make(spark, sf_dir).createOrReplaceTempView(name)
    return [*VIEWS]
