"""Cells, boxes and polygons: rasterising, binned spatial joins, zonal statistics, hazard zones, output."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from ..functions.hashing import uniform
from ..functions.order import positions

BIN = 2000.0


def cells_touched(boxes: DataFrame, spec: GridSpec) -> DataFrame:
    """boxes with a row for each cell they touch."""
    cols = F.sequence(F.greatest(spec.col_of(F.col("minx")), F.lit(0)), F.least(spec.col_of(F.col("maxx")), F.lit(spec.ncols - 1)))
    rows = F.sequence(F.greatest(spec.row_of(F.col("maxy")), F.lit(0)), F.least(spec.row_of(F.col("miny")), F.lit(spec.nrows - 1)))
    meets = (F.col("maxx") >= spec.minx) & (F.col("minx") < spec.maxx) & (F.col("maxy") > spec.miny) & (F.col("miny") <= spec.maxy)
    return boxes.where(meets).withColumn("row", F.explode(rows)).withColumn("col", F.explode(cols))


def cells_inside(boxes: DataFrame, spec: GridSpec) -> DataFrame:
    """The cells whose centre is in a box."""
    x, y = spec.x_of(F.col("col")), spec.y_of(F.col("row"))
    return cells_touched(boxes, spec).where((x >= F.col("minx")) & (x <= F.col("maxx")) & (y >= F.col("miny")) & (y <= F.col("maxy")))


def burned_mask(fires: DataFrame, spec: GridSpec) -> DataFrame:
    return cells_inside(fires, spec).select("row", "col").distinct()


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over an open or closed ring of points {x, y}."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.element_at(ring, F.when(i == 0, n).otherwise(i))
        between = (p["y"] > y) != (q["y"] > y)
        return F.when(between, x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]).otherwise(False)

    return F.aggregate(F.transform(ring, crosses), F.lit(False), lambda a, b: a != b)


def ring_centroid(ring: Column) -> Column:
    """Area centroid of a ring; the mean of its points where the area is 0."""
    n = F.size(ring)
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    parts = F.transform(ring, lambda p, i: F.struct(p.alias("p"), F.element_at(ring, F.when(i + 1 == n, 1).otherwise(i + 2)).alias("q")))

    def add(s, e):
        c = e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]
        return F.struct((s["a"] + c).alias("a"), (s["x"] + (e["p"]["x"] + e["q"]["x"]) * c).alias("x"), (s["y"] + (e["p"]["y"] + e["q"]["y"]) * c).alias("y"))

    s = F.aggregate(parts, zero, add)
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda t, p: t + p[k]) / n
    return F.struct(F.when(s["a"] != 0, s["x"] / (3.0 * s["a"])).otherwise(mean("x")).alias("x"), F.when(s["a"] != 0, s["y"] / (3.0 * s["a"])).otherwise(mean("y")).alias("y"))


def _binned(df: DataFrame) -> DataFrame:
    r = lambda a, b: F.sequence(F.floor(F.col(a) / BIN), F.floor(F.col(b) / BIN))
    return df.withColumn("__bx", F.explode(r("minx", "maxx"))).withColumn("__by", F.explode(r("miny", "maxy")))


def box_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of boxes that intersect, once each: an equi-join on the bins both cover, kept only in the pair's first common bin, so no distinct is needed."""
    a = _binned(left)
    b = _binned(right).withColumnsRenamed({c: f"__{c}" for c in ("minx", "miny", "maxx", "maxy")})
    j = a.join(b, ["__bx", "__by"])
    meets = (F.col("minx") <= F.col("__maxx")) & (F.col("maxx") >= F.col("__minx")) & (F.col("miny") <= F.col("__maxy")) & (F.col("maxy") >= F.col("__miny"))
    first = (F.floor(F.greatest("minx", "__minx") / BIN) == F.col("__bx")) & (F.floor(F.greatest("miny", "__miny") / BIN) == F.col("__by"))
    return j.where(meets & first).drop("__bx", "__by", "__minx", "__miny", "__maxx", "__maxy")


def zonal_statistics(parcels: DataFrame, cells: DataFrame, value: str, spec: GridSpec) -> DataFrame:
    """All-touched statistics of each parcel. Parcels without cells have mean and maximum 0, the rest null."""
    j = cells_touched(parcels.select("apn", "minx", "miny", "maxx", "maxy"), spec).join(cells.select("row", "col", F.col(value).alias("v")), ["row", "col"])
    s = j.groupBy("apn").agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.min("v").alias("min"), F.stddev_pop("v").alias("std"), F.percentile("v", 0.5).alias("median"), F.count("v").alias("n_cells"))
    r = lambda c: F.round(c, 6)
    return parcels.join(s, "apn", "left").select(*parcels.columns, r(F.coalesce("mean", F.lit(0.0))).alias("burn_prob_mean"), r(F.coalesce("max", F.lit(0.0))).alias("burn_prob_max"), r(F.col("min")).alias("burn_prob_min"), r(F.col("std")).alias("burn_prob_std"), r(F.col("median")).alias("burn_prob_median"), F.coalesce("n_cells", F.lit(0)).alias("n_cells"))


def multi_raster_statistics(parcels: DataFrame, cells: DataFrame, layers: list[str], spec: GridSpec) -> DataFrame:
    j = cells_touched(parcels.select("apn", "minx", "miny", "maxx", "maxy"), spec).join(cells.select("row", "col", *layers), ["row", "col"])
    s = j.groupBy("apn").agg(*[F.round(f(c), 6).alias(f"{c}_{n}") for c in layers for f, n in ((F.avg, "mean"), (F.max, "max"))])
    return parcels.select("apn").join(s, "apn", "left")


def hazard_rank(name: Column) -> Column:
    return F.when(name == "Very High", 3).when(name == "High", 2).when(name == "Moderate", 1).otherwise(0)


def hazard_zones(parcels: DataFrame, zones: DataFrame) -> DataFrame:
    """Each parcel's highest hazard; the smallest zone_id of equals; null where no zone meets it."""
    hit = box_join(parcels.select("apn", "minx", "miny", "maxx", "maxy"), zones).withColumn("rank", hazard_rank(F.col("haz_class")))
    best = hit.groupBy("apn").agg(F.max_by(F.struct("haz_class", "zone_id", "rank"), F.struct("rank", -F.col("zone_id"))).alias("b"))
    return parcels.join(best, "apn", "left").select(*parcels.columns, F.col("b.haz_class").alias("fhsz"), F.col("b.zone_id").alias("zone_id"), F.coalesce("b.rank", F.lit(0)).alias("hazard_rank"))


def burned_flag(parcels: DataFrame, fires: DataFrame, year: int | None = None) -> DataFrame:
    if year is not None and "year_" in fires.columns:
        fires = fires.where(F.col("year_") == year)
    hit = box_join(parcels.select("apn", "minx", "miny", "maxx", "maxy"), fires.select("minx", "miny", "maxx", "maxy")).select("apn").distinct().withColumn("__b", F.lit(True))
    return parcels.join(hit, "apn", "left").withColumn("actually_burned", F.coalesce("__b", F.lit(False))).drop("__b")


REQUIRED = ["apn", "year", "burn_prob_mean", "burn_prob_max", "burn_prob_std"]
OPTIONAL = ["fhsz", "actually_burned", "county", "address", "acres", "dominant_fuel", "wui_class"]


def output_table(parcels: DataFrame, year: int) -> DataFrame:
    df = parcels.withColumn("year", F.lit(year))
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise KeyError(f"missing columns: {missing}")
    return df.select(*REQUIRED, *[c for c in OPTIONAL if c in df.columns])


def count_by_county(parcels: DataFrame) -> DataFrame:
    return parcels.groupBy("county").agg(F.count(F.lit(1)).alias("n_parcels"))


def county_summary(parcels: DataFrame) -> DataFrame:
    return parcels.groupBy("county").agg(F.count(F.lit(1)).alias("n_parcels"), F.round(F.avg("burn_prob_mean"), 6).alias("mean"), F.round(F.max("burn_prob_max"), 6).alias("max"), F.count_if(F.col("burn_prob_mean") > 0).alias("n_exposed"))


def standardised(parcels: DataFrame, names: tuple[str, ...] = ("apn", "APN", "parcel_id", "PARCEL_ID", "ParcelID", "pin")) -> DataFrame:
    """The first column of `names` becomes apn; without one a row number does."""
    found = next((c for c in names if c in parcels.columns), None)
    if found:
        return parcels.withColumnRenamed(found, "apn").withColumn("apn", F.col("apn").cast("string"))
    return parcels.withColumn("apn", F.monotonically_increasing_id().cast("string"))


def value_at(points: DataFrame, cells: DataFrame, value: str, spec: GridSpec, default=None) -> DataFrame:
    """points (x, y) with the value of their cell; `default` outside."""
    p = points.withColumn("row", spec.row_of(F.col("y"))).withColumn("col", spec.col_of(F.col("x")))
    return p.join(cells.select("row", "col", F.col(value).alias("value")), ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(default)))


def first_tile_wins(tiles: DataFrame, order: str) -> DataFrame:
    others = [c for c in tiles.columns if c not in ("row", "col")]
    best = tiles.groupBy("row", "col").agg(F.min_by(F.struct(*others), order).alias("b"))
    return best.select("row", "col", "b.*")


def stack(layers: list[DataFrame]) -> DataFrame:
    out = layers[0]
    for layer in layers[1:]:
        out = out.join(layer, ["row", "col"])
    return out


def resample(cells: DataFrame, value: str, source: GridSpec, target: GridSpec, method: str = "bilinear") -> DataFrame:
    """target's cells with the value of the nearest source cell, or of the four around them, weighted; each target cell asks for its few source cells by key."""
    t = target.cells(cells.sparkSession)
    v = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value).cast("double").alias("__v"))
    if method == "nearest":
        t = t.withColumn("__r", source.row_of(F.col("y"))).withColumn("__c", source.col_of(F.col("x")))
        return t.join(v, ["__r", "__c"], "left").select("row", "col", F.col("__v").alias(value))
    fx, fy = (F.col("x") - source.minx) / source.dx - 0.5, (F.lit(source.maxy) - F.col("y")) / source.dy - 0.5
    clamp = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)).cast("int")
    t = t.withColumn("fx", fx).withColumn("fy", fy).withColumn("wx", F.col("fx") - F.floor("fx")).withColumn("wy", F.col("fy") - F.floor("fy"))
    corner = lambda a, b: F.struct(clamp(F.floor("fy") + a, source.nrows).alias("__r"), clamp(F.floor("fx") + b, source.ncols).alias("__c"), ((F.col("wy") if a else 1 - F.col("wy")) * (F.col("wx") if b else 1 - F.col("wx"))).alias("w"))
    t = t.select("row", "col", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("s")).select("row", "col", "s.*")
    return t.join(v, ["__r", "__c"]).groupBy("row", "col").agg((F.sum(F.col("w") * F.col("__v")) / F.sum("w")).alias(value))


def quadkey_bounds(key: Column) -> Column:
    """West, south, east, north of a Web Mercator tile."""
    digits = F.transform(F.split(key, ""), lambda d: d.cast("int"))
    digits = F.filter(digits, lambda d: d.isNotNull())
    n = F.pow(F.lit(2.0), F.length(key))
    x = F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: a * 2 + d % 2)
    y = F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: a * 2 + F.floor(d / 2))
    lon = lambda t: t / n * 360.0 - 180.0
    lat = lambda t: F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1.0 - 2.0 * t / n))))
    return F.struct(lon(x).alias("west"), lat(y + 1).alias("south"), lon(x + 1).alias("east"), lat(y).alias("north"))


def numbered_apart(df: DataFrame, by: str, prefix: str = "MS-") -> DataFrame:
    """df with building_id, numbered in the order of a hash of `by`, then `by`: no task sees all rows."""
    numbered = positions(df, uniform("number", F.col(by)), by, name="__i")
    return numbered.withColumn("building_id", F.concat(F.lit(prefix), F.lpad(F.col("__i").cast("string"), 8, "0"))).drop("__i")


def common_bounds(rasters: DataFrame) -> DataFrame:
    """One row: where all rasters (minx, miny, maxx, maxy) overlap."""
    return rasters.agg(F.max("minx").alias("minx"), F.max("miny").alias("miny"), F.min("maxx").alias("maxx"), F.min("maxy").alias("maxy"))


def clip(cells: DataFrame, boxes: DataFrame, spec: GridSpec, all_touched: bool = False) -> DataFrame:
    """The cells inside any of the boxes."""
    inside = (cells_touched if all_touched else cells_inside)(boxes, spec).select("row", "col").distinct()
    return cells.join(inside, ["row", "col"], "left_semi")
