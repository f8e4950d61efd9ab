"""Synthetic inputs, each row from its number alone."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from ..functions.hashing import uniform


def dem(spark: SparkSession, spec: GridSpec) -> DataFrame:
    """Rolling terrain: two waves and a little noise."""
    c = spec.cells(spark)
    wave = 300.0 + 200.0 * F.sin(F.col("x") / 9000.0) * F.cos(F.col("y") / 7000.0) + 80.0 * F.sin((F.col("x") + F.col("y")) / 2500.0)
    return c.withColumn("elevation", wave + 5.0 * uniform("dem", F.col("row"), F.col("col")))


def fuels(spark: SparkSession, spec: GridSpec) -> DataFrame:
    """Three bands of fuels from low to high rows, a twentieth of the cells not burnable, and canopy cover."""
    c = spec.cells(spark)
    u, v = uniform("fuel", F.col("row"), F.col("col")), uniform("open", F.col("row"), F.col("col"))
    band = lambda codes: F.element_at(F.array(*map(F.lit, codes)), (F.floor(u * len(codes)) + 1).cast("int"))
    part = F.col("row") / float(spec.nrows)
    code = F.when(part < 1 / 3, band((1, 3))).when(part < 2 / 3, band((4, 5, 6))).otherwise(band((8, 9, 10)))
    code = F.when(v < 0.025, 91).when(v < 0.05, 98).otherwise(code)
    return c.withColumn("fuel_model", code).withColumn("canopy_cover", F.when(F.col("fuel_model") >= 8, (30 + 50 * u).cast("int")).otherwise((20 * u).cast("int")))


def fires(spark: SparkSession, spec: GridSpec, years: tuple[int, int] = (2010, 2023), corners: int = 12) -> DataFrame:
    """Five to fourteen irregular rings a year, exponential in size."""
    y = spark.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias("year_"))
    n = (5 + F.floor(10 * uniform("n", F.col("year_")))).cast("int")
    f = y.select("year_", F.explode(F.sequence(F.lit(1), n)).alias("k"))
    u = lambda s: uniform(s, F.col("year_"), F.col("k"))
    f = f.withColumn("gis_acres", -500.0 * F.log(1.0 - u("size"))).withColumn("cx", spec.minx + (spec.maxx - spec.minx) * u("cx")).withColumn("cy", spec.miny + (spec.maxy - spec.miny) * u("cy"))
    r = F.sqrt(F.col("gis_acres") * 4046.86 / 3.141592653589793)
    point = lambda i: F.struct((F.col("cx") + r * (0.7 + 0.6 * uniform("r", F.col("year_"), F.col("k"), i)) * F.cos(i * (6.283185307179586 / corners))).alias("x"), (F.col("cy") + r * (0.7 + 0.6 * uniform("r", F.col("year_"), F.col("k"), i)) * F.sin(i * (6.283185307179586 / corners))).alias("y"))
    ring = F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), point)
    return f.select(F.format_string("%d-%02d", "year_", "k").alias("fire_id"), "year_", "gis_acres", F.date_add(F.make_date("year_", F.lit(6), F.lit(1)), F.floor(150 * u("day")).cast("int")).alias("alarm_date"), ring.alias("ring"))


def parcels(spark: SparkSession, spec: GridSpec, side: float = 500.0) -> DataFrame:
    """Boxes of about `side` metres on a jittered grid."""
    n, m = int((spec.maxx - spec.minx) / side), int((spec.maxy - spec.miny) / side)
    k = spark.range(n * m).select(F.floor(F.col("id") / m).cast("int").alias("i"), (F.col("id") % m).cast("int").alias("j"))
    jitter = lambda s: 0.1 * side * uniform(s, F.col("i"), F.col("j"))
    k = k.withColumn("minx", spec.minx + F.col("i") * side + jitter("jx")).withColumn("miny", spec.miny + F.col("j") * side + jitter("jy"))
    return k.select(F.format_string("097-%03d-%03d", "i", "j").alias("apn"), "minx", "miny", (F.col("minx") + 0.8 * side).alias("maxx"), (F.col("miny") + 0.8 * side).alias("maxy"))


def roads(spark: SparkSession, spec: GridSpec, spacing: float = 5000.0) -> DataFrame:
    """The cells of a square network of roads."""
    every = max(1, int(spacing / spec.resolution))
    return spec.cells(spark).where((F.col("row") % every == 0) | (F.col("col") % every == 0)).select("row", "col")
