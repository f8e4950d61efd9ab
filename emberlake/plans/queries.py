"""Each operator as a query over the given tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import pilot, production
from ..functions.grid import GridSpec, tile_bounds
from ..functions.hashing import uniform
from ..operators import fuel, holdout, metrics, ml, montecarlo, parcels, spread, terrain, weather
from ..sources import tables
from ..streaming.daily import daily_summary

QUERIES: dict = {}
CELL = tables.CELL


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _simple(name: str, source, operator):
    QUERIES[name] = lambda spark, sf_dir: operator(source(spark, sf_dir))


# verification
for _name, _operator in {
    "calibration_curve": metrics.calibration_curve,
    "reliability_diagram": metrics.reliability_diagram,
    "calibration_error": metrics.calibration_error,
    "discrimination": metrics.discrimination,
    "skill_scores": metrics.skill,
    "skill_against_climatology": lambda s: metrics.skill(s, 0.3),
    "roc_curve": metrics.roc_curve,
    "best_f1": metrics.best_f1,
    "confusion": metrics.confusion,
    "precision_recall_at": lambda s: metrics.precision_recall_at(s, [0.01, 0.05, 0.1, 0.2]),
}.items():
    _simple(_name, tables.scored, _operator)
_simple("hindcast", tables.scored_by_day, metrics.hindcast)
_simple("hindcast_summary", tables.scored_by_day, metrics.hindcast_summary)


@query
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.pr_curve(tables.scored(spark, sf_dir)), "prob", "precision", "recall")


# terrain and fuel
def _terrain(spark, sf_dir):
    return terrain.derivatives(tables.grid(spark, sf_dir), CELL)


@query
def terrain_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_terrain(spark, sf_dir).select("row", "col", "slope", "aspect", "tpi"), "slope", "aspect", "tpi")


@query
def landscape_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rounded(_terrain(spark, sf_dir), "slope", "aspect")
    return terrain.landscape_terrain(t).select("row", "col", F.col("slope_i").cast("int").alias("slope_i"), F.col("aspect_i").cast("int").alias("aspect_i"))


@query
def fuel_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuel.with_fuel(tables.grid(spark, sf_dir)).select("row", "col", "fuel_model", "ros", "older_model", "burnable")


@query
def simple_spread_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _terrain(spark, sf_dir)
    return t.select("row", "col", F.round(fuel.simple_spread_rate(F.col("fuel_model"), F.col("slope"), F.lit(5.0)), 6).alias("rate"))


@query
def landscape_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fuel.scaled_layers(tables.grid(spark, sf_dir))
    return g.select("row", "col", F.col("elevation").cast("smallint").cast("int").alias("elevation_i"), F.col("cover_i").cast("int").alias("cover_i"), F.col("height_dm").cast("int").alias("height_dm"))


@query
def canopy_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fuel.canopy_layers(tables.grid(spark, sf_dir))
    return g.select("row", "col", F.col("base_height_dm").cast("int").alias("base_height_dm"), F.col("bulk_density_i").cast("int").alias("bulk_density_i"))


@query
def raster_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.grid(spark, sf_dir)
    return g.agg(F.count(F.lit(1)).alias("n_cells"), (F.max("row") + 1).alias("nrows"), (F.max("col") + 1).alias("ncols"), F.round(F.min("elevation") + 0.0, 6).alias("min_elevation"), F.round(F.max("elevation"), 6).alias("max_elevation"))


@query
def reference_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(GridSpec(-200000.0, 0.0, -100000.0, 100000.0, 2700.0).cells(spark), "x", "y")


@query
def distance_to_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.grid(spark, sf_dir).select("row", "col")
    roads = g.where((F.col("row") % 17 == 3) & (F.col("col") % 11 == 5))
    return rounded(terrain.distance(g, roads, CELL), "distance")


@query
def resample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    world = tables.world(spark, sf_dir)
    g = tables.grid(spark, sf_dir)
    out = parcels.resample(g, "elevation", world, GridSpec(world.minx, world.miny, world.maxx, world.maxy, 540.0))
    return rounded(out, "elevation")


@query
def resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    world = tables.world(spark, sf_dir)
    g = tables.grid(spark, sf_dir)
    return rounded(parcels.resample(g, "elevation", world, GridSpec(world.minx, world.miny, world.maxx, world.maxy, 540.0), "nearest"), "elevation")


@query
def fuel_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.grid(spark, sf_dir)
    a = g.where("col < 30").select("row", "col", "fuel_model", F.lit(1).alias("tile"))
    b = g.where("col >= 20").select("row", "col", (F.col("fuel_model") + 1000).alias("fuel_model"), F.lit(2).alias("tile"))
    return parcels.first_tile_wins(a.unionByName(b), "tile").select("row", "col", "fuel_model", "tile")


# weather
def _weather(spark, sf_dir):
    return tables.weather(spark, sf_dir)


@query
def fire_weather_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _weather(spark, sf_dir)
    return w.select("day", F.round(weather.fire_weather_index(weather.celsius(F.col("tmmx")), F.col("rmin"), F.col("vs"), F.col("pr")), 6).alias("fwi"))


@query
def weather_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weather.derived_features(weather.temporal_features(_weather(spark, sf_dir)))
    return rounded(w.select("day", "day_of_year", "day_of_week", "month", "season", "is_weekend", "vpd", "fwi"), "vpd", "fwi")


@query
def extreme_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weather(spark, sf_dir).select("day", weather.is_extreme_stream().alias("stream"), weather.is_extreme_generator().alias("generator"), weather.is_high_wind().alias("high_wind"))


@query
def extreme_by_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(weather.extreme_quantile(_weather(spark, sf_dir).withColumn("rmin", F.col("rmin") * 0.2 + F.col("vs") * -1.0), "fire").select("day", "vs", "tmmx"), "vs", "tmmx")


@query
def santa_ana_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(weather.santa_ana_days(_weather(spark, sf_dir)), "vs", "rmin", "th")


@query
def days_since_rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather.days_since_rain(_weather(spark, sf_dir)).select("day", "days_since_rain")


_simple("weather_distribution", _weather, weather.distribution)
_simple("extreme_summary", _weather, weather.extreme_summary)
_simple("percentile_scenario", _weather, lambda w: weather.percentile_scenario(w, 95.0))
_simple("weather_stream", _weather, lambda w: weather.stream(w, "1996-07-01", 14))


@query
def fuel_moisture(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weather.fuel_moisture(_weather(spark, sf_dir), weather.is_extreme_stream())
    return rounded(w.select("day", "fm1", "fm10", "fm100", "live_herb", "live_woody"), "fm1", "fm10", "fm100")


@query
def sampled_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather.scenarios(_weather(spark, sf_dir), 1000).select("scenario_id", "day", "is_extreme")


@query
def weather_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(weather.nearest_cell(tables.weather_cells(spark, sf_dir), tables.places(spark, sf_dir)).select("id", "day", "tmmx", "vs", "rmin"), "tmmx", "vs", "rmin")


# holding out
@query
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = ml.temporal_split(tables.fires(spark, sf_dir), (1995, 1997), (1998, 1999), "alarm_date")
    return train.select("fire_id", F.lit("train").alias("part")).unionByName(test.select("fire_id", F.lit("test").alias("part")))


@query
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.split_by_year(tables.fires(spark, sf_dir)).select("fire_id", "year_", "holdout")


@query
def holdout_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.split_by_year(tables.fires(spark, sf_dir), stratify=False).select("fire_id", "year_", "holdout")


@query
def holdout_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.holdout_set(tables.fires(spark, sf_dir), (1998, 2000)).select("fire_id", "year_", "part")


@query
def holdout_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.statistics(holdout.split_by_year(tables.fires(spark, sf_dir)))


@query
def holdout_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.balanced(holdout.split_by_year(tables.fires(spark, sf_dir)))


# parcels
def burn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probability for each cell of the world, drawn by place."""
    world = tables.world(spark, sf_dir)
    cells = world.cells(spark)
    return cells.select("row", "col", (0.3 * uniform("burn", F.col("row"), F.col("col"))).alias("burn_probability"), F.col("y").alias("northing"))


@query
def zonal_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    world = tables.world(spark, sf_dir)
    out = parcels.zonal_statistics(tables.parcels(spark, sf_dir), burn_cells(spark, sf_dir), "burn_probability", world)
    return out.drop("minx", "miny", "maxx", "maxy")


@query
def multi_raster_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    world = tables.world(spark, sf_dir)
    return parcels.multi_raster_statistics(tables.parcels(spark, sf_dir), burn_cells(spark, sf_dir), ["burn_probability", "northing"], world)


@query
def hazard_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parcels.hazard_zones(tables.parcels(spark, sf_dir), tables.zones(spark, sf_dir)).select("apn", "fhsz", "zone_id", "hazard_rank")


@query
def burned_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parcels.burned_flag(tables.parcels(spark, sf_dir), tables.fires(spark, sf_dir), 1997).select("apn", "actually_burned")


@query
def parcel_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    world = tables.world(spark, sf_dir)
    p = tables.parcels(spark, sf_dir)
    z = parcels.zonal_statistics(p, burn_cells(spark, sf_dir), "burn_probability", world)
    h = parcels.hazard_zones(p, tables.zones(spark, sf_dir)).select("apn", "fhsz")
    return parcels.output_table(z.join(h, "apn"), 2020)


@query
def parcels_by_county(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parcels.count_by_county(tables.parcels(spark, sf_dir))


@query
def county_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    world = tables.world(spark, sf_dir)
    return parcels.county_summary(parcels.zonal_statistics(tables.parcels(spark, sf_dir), burn_cells(spark, sf_dir), "burn_probability", world))


@query
def burned_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    world = tables.world(spark, sf_dir)
    return parcels.burned_mask(tables.fires(spark, sf_dir), world)


@query
def calibration_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    world = tables.world(spark, sf_dir)
    mask = parcels.burned_mask(tables.fires(spark, sf_dir).where("year_ = 1997"), world)
    return montecarlo.calibration(mask, burn_cells(spark, sf_dir), world.nrows * world.ncols, 8)


@query
def year_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels' mean probability against the fires of a year, and whether the settings' targets are met."""
    world, p, goal = tables.world(spark, sf_dir), tables.parcels(spark, sf_dir), production().validation
    z = parcels.zonal_statistics(p, burn_cells(spark, sf_dir), "burn_probability", world)
    return metrics.targets(metrics.validate_year(parcels.burned_flag(z, tables.fires(spark, sf_dir), 1997), 1997), goal.burn_auc, goal.ece)


@query
def tile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = burn_cells(spark, sf_dir)
    both = c.where("col < 30").unionByName(c.where("col >= 20").withColumn("burn_probability", F.col("burn_probability") / 2))
    return rounded(montecarlo.tile_merge(both), "burn_probability")


@query
def fuel_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    world = tables.world(spark, sf_dir)
    f = tables.fires(spark, sf_dir).select("fire_id", ((F.col("minx") + F.col("maxx")) / 2).alias("x"), ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    return parcels.value_at(f, tables.grid(spark, sf_dir), "fuel_model", world, -1).select("fire_id", "value")


@query
def quadkey_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = tables.table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("0230"), F.conv(F.col("n_nationkey").cast("string"), 10, 4)).alias("quadkey"))
    return rounded(k.select("n_nationkey", parcels.quadkey_bounds(F.col("quadkey")).alias("b")).select("n_nationkey", "b.*"), "west", "south", "east", "north")


# simulation
@query
def poisson_ignitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", montecarlo.poisson(uniform("count", F.col("o_orderkey")), F.lit(2.5)).cast("int").alias("k"))


@query
def weighted_ignitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four cells for each row of cells, likelier by rate of spread."""
    g = fuel.with_fuel(tables.grid(spark, sf_dir))
    return montecarlo.weighted_pick(g, "row", "col", "ros", F.lit(4)).select("row", "col")


def _landscape(spark, sf_dir):
    return spread.landscape(_terrain(spark, sf_dir), CELL)


@query
def conditional_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    world = tables.world(spark, sf_dir)
    points = tables.fires(spark, sf_dir).select("fire_id", ((F.col("minx") + F.col("maxx")) / 2).alias("x"), ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    return rounded(montecarlo.run_conditional(points, weather.scenarios(_weather(spark, sf_dir), 100), _landscape(spark, sf_dir), world), "raw_probability", "burn_probability")


@query
def monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    world = tables.world(spark, sf_dir)
    return rounded(montecarlo.run(spark, _landscape(spark, sf_dir), world, production().monte_carlo), "raw_probability", "burn_probability")


@query
def tiled_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pilot's settings, tile by tile with halos."""
    world, config = tables.world(spark, sf_dir), pilot().monte_carlo
    iterations = spark.range(config.n_iterations).withColumnRenamed("id", "iteration")
    fires = montecarlo.ignitions(montecarlo.default_weather(iterations, config), world, config)
    return rounded(montecarlo.run_tiles(_terrain(spark, sf_dir), CELL, montecarlo.Tiling(40, 8), fires, config.n_iterations), "burn_probability")


@query
def burn_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    world = tables.world(spark, sf_dir)
    counts = world.cells(spark).select("row", "col", F.floor(20 * uniform("n", F.col("row"), F.col("col"))).alias("burn_count"))
    return rounded(montecarlo.percentiles(counts, 100), "p05", "p50", "p95")


@query
def ignition_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    world = tables.world(spark, sf_dir)
    f = tables.fires(spark, sf_dir)
    return rounded(montecarlo.ignition_points(f, tables.grid(spark, sf_dir), world), "x", "y")


@query
def clipped_fuels(spark: SparkSession, sf_dir: str) -> DataFrame:
    world = tables.world(spark, sf_dir)
    return parcels.clip(tables.grid(spark, sf_dir), tables.zones(spark, sf_dir), world).select("row", "col", "fuel_model")


@query
def common_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(parcels.common_bounds(tables.fires(spark, sf_dir)), "minx", "miny", "maxx", "maxy")


@query
def synthetic_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import synthetic

    spec = GridSpec(0.0, 0.0, 64800.0, 64800.0, 270.0)
    return parcels.stack([synthetic.dem(spark, spec).select("row", "col", F.round("elevation", 3).alias("elevation")), synthetic.fuels(spark, spec).select("row", "col", "fuel_model", "canopy_cover")])


# learning
def _training(spark, sf_dir):
    world = tables.world(spark, sf_dir)
    w = _weather(spark, sf_dir)
    cells = fuel.with_fuel(_terrain(spark, sf_dir)).select("row", "col", "elevation", "slope", "tpi", "ros", "canopy_cover")
    f = tables.fires(spark, sf_dir)
    x, y = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    positive = f.select(world.row_of(y).alias("row"), world.col_of(x).alias("col"), F.col("alarm_date").alias("day"))
    negative = ml.negative_samples(cells.select("row", "col"), positive.select("row", "col").distinct(), w.select("day"), 2)
    t = ml.training_set(positive, negative, cells, w)
    return t.withColumn("key", F.xxhash64("row", "col", "day", "label"))


FEATURES = ["elevation", "slope", "tpi", "ros", "canopy_cover", "tmmx", "rmin", "vs", "erc", "pr"]


@query
def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table, its features rounded."""
    exact = ("ros", "canopy_cover")
    return rounded(_training(spark, sf_dir).select("row", "col", "day", "label", *FEATURES), *[c for c in FEATURES if c not in exact])


@query
def ignition_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the split and the fit count and place its rows first, so the table is made once
    train, test = ml.split(_training(spark, sf_dir).persist(), "key")
    model = ml.IgnitionModel("random_forest").fit(train, FEATURES)
    # several measures read each row's probability, which takes a pass through every tree
    return metrics.discrimination(model.predict_proba(test).select("label", "prob").persist())


@query
def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_summary(tables.table(spark, sf_dir, "events"))


@query
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, *tile_bounds(k)) for k in range(1, 57)]  # the plan of tiles is fixed
    return spark.createDataFrame(rows, "tile_id int, minx double, miny double, maxx double, maxy double")
