"""Daily weather: indices, seasons, the five meanings of extreme, look-backs and scenarios. Temperatures in kelvin, wind in m/s, rain in mm."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform

KELVIN, MPH, RAIN, LOOK_BACK = 273.15, 2.237, 2.54, 90


def celsius(k: Column) -> Column:
    return k - KELVIN


def fahrenheit(k: Column) -> Column:
    return celsius(k) * 9.0 / 5.0 + 32.0


def _unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def fire_weather_index(t: Column, rh: Column, wind: Column, rain: Column) -> Column:
    """0 to 100 from degrees Celsius, per cent, m/s and mm."""
    damp = F.when(rain < 1, 1.0).when(rain < 5, 0.5).otherwise(0.2)
    return 100.0 * (0.3 * _unit((t - 10.0) / 30.0) + 0.4 * (1.0 - _unit(rh / 100.0)) + 0.3 * F.least(wind / 15.0, F.lit(1.0))) * damp


def season(month: Column) -> Column:
    """0 winter to 3 autumn."""
    return F.floor((month % 12) / 3).cast("int")


def temporal_features(df: DataFrame, day: str = "day") -> DataFrame:
    d = F.col(day)
    return df.withColumns({"day_of_year": F.dayofyear(d), "day_of_week": F.weekday(d), "month": F.month(d), "season": season(F.month(d)), "is_weekend": (F.weekday(d) >= 5).cast("int")})


def derived_features(df: DataFrame) -> DataFrame:
    """vpd, simple fire-weather index, and the aspect's sine and cosine where it is given; null where an input is null."""
    t = F.when(F.col("tmmx") > 100, celsius(F.col("tmmx"))).otherwise(F.col("tmmx"))
    vpd = 6.112 * F.exp(17.67 * t / (t + 243.5)) * (1.0 - F.col("rmin") / 100.0)
    fwi = F.greatest(t - 10.0, F.lit(0.0)) * (100.0 - F.col("rmin")) * (1.0 + F.col("vs") / 10.0) / 1000.0
    out = df.withColumns({"vpd": vpd, "fwi": fwi})
    if "aspect" in df.columns:
        out = out.withColumns({"aspect_sin": F.sin(F.radians("aspect")), "aspect_cos": F.cos(F.radians("aspect"))})
    return out


def fuel_moisture(df: DataFrame, extreme: Column) -> DataFrame:
    """1-, 10- and 100-hour moisture, live herbaceous and woody."""
    f = F.col("fm100")
    return df.withColumns({"fm1": F.greatest(f - 4.0, F.lit(2.0)), "fm10": F.greatest(f - 2.0, F.lit(3.0)), "live_herb": F.when(extreme, 60).otherwise(80), "live_woody": F.when(extreme, 80).otherwise(100)})


def is_extreme_stream() -> Column:
    return (F.col("vs") * MPH > 25.0) & (F.col("rmin") < 15.0) & (fahrenheit(F.col("tmmx")) > 85.0)


def in_season(name: str | None) -> Column:
    m = F.month("day")
    return {"fire": m.between(6, 10), "santa_ana": (m >= 9) | (m <= 1), None: F.lit(True)}[name]


def is_extreme_generator() -> Column:
    return ((F.col("vs") > 10.0) | (F.col("rmin") < 15.0) | (celsius(F.col("tmmx")) > 35.0)) & F.month("day").between(9, 12)


def is_high_wind() -> Column:
    return (F.col("vs") > 15.0) & F.month("day").between(9, 12)


def is_santa_ana(wind_over: float = 10.0, rh_under: float = 20.0) -> Column:
    return (F.col("vs") > wind_over) & (F.col("rmin") < rh_under) & (F.col("th") > 45.0) & (F.col("th") < 135.0)


def extreme_quantile(weather: DataFrame, season_name: str | None = None) -> DataFrame:
    """Days beyond the season's own quantiles; one row of thresholds is joined to all days."""
    s = weather.where(in_season(season_name))
    q = s.agg(F.percentile("vs", 0.95).alias("qv"), F.percentile("rmin", 0.05).alias("qr"), F.percentile("tmmx", 0.90).alias("qt"))
    return s.crossJoin(F.broadcast(q)).where("vs > qv AND rmin < qr AND tmmx > qt").drop("qv", "qr", "qt")


def santa_ana_days(weather: DataFrame) -> DataFrame:
    """weather with lat, lon, many cells a day: the regional means decide."""
    region = weather.where(F.col("lat").between(32, 35) & F.col("lon").between(-120, -114)) if "lat" in weather.columns else weather
    daily = region.groupBy("day").agg(*[F.avg(c).alias(c) for c in ("vs", "rmin", "th")])
    return daily.where(is_santa_ana())


def days_since_rain(weather: DataFrame, threshold: float = RAIN, look_back: int = LOOK_BACK) -> DataFrame:
    """Days since the last rain of at least `threshold` within the look-back, the look-back if there was none. Years are windows of their own plus the year before, so no task sees all days. Rows that repeat a day each get theirs."""
    n = F.unix_date("day")
    rows = weather.withColumn("__n", n)
    twice = rows.withColumn("__y", F.explode(F.array_distinct(F.array(F.year("day"), F.year(F.date_add("day", look_back))))))
    by = [c for c in ("lat", "lon") if c in weather.columns]
    w = Window.partitionBy(*by, "__y").orderBy("__n").rangeBetween(-look_back, 0)
    last = F.max(F.when(F.col("pr") >= threshold, F.col("__n"))).over(w)
    out = twice.withColumn("days_since_rain", F.coalesce(F.col("__n") - last, F.lit(look_back)).cast("int"))
    return out.where(F.col("__y") == F.year("day")).drop("__n", "__y")


def distribution(weather: DataFrame) -> DataFrame:
    """Fire-season mean, population deviation and quantiles of four variables."""
    s = weather.where(in_season("fire")).select(F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), (celsius(F.col(v)) if v == "tmmx" else F.col(v)).alias("x")) for v in ("vs", "rmin", "tmmx", "erc")])).alias("s")).select("s.*")
    return s.where("x IS NOT NULL AND NOT isnan(x)").groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"), *[F.round(F.percentile("x", p / 100), 6).alias(f"p{p}") for p in (50, 90, 95, 99)])


def extreme_summary(weather: DataFrame) -> DataFrame:
    return weather.agg(F.count_if(in_season("fire")).alias("fire_season_days"), F.count_if(is_extreme_generator()).alias("extreme_days"), F.count_if(is_high_wind()).alias("high_wind_days"), F.count_if(is_extreme_stream()).alias("stream_days"))


def percentile_scenario(weather: DataFrame, percentile: float, variable: str = "erc") -> DataFrame:
    """The fire-season day nearest to the variable's percentile; the first of equals."""
    if variable not in weather.columns:
        raise ValueError(f"unknown variable: {variable}")
    s = weather.where(in_season("fire"))
    q = s.agg(F.percentile(variable, percentile / 100).alias("q"))
    d = s.crossJoin(F.broadcast(q))
    best = d.agg(F.min_by(F.struct("day", F.col(variable).alias("v"), "q"), F.struct(F.abs(F.col(variable) - F.col("q")), F.col("day"))).alias("b"))
    return best.select("b.day", F.round("b.v", 6).alias("value"), F.round("b.q", 6).alias("threshold"), F.lit(percentile > 90).alias("is_extreme"))


def stream(weather: DataFrame, start: str, n_days: int) -> DataFrame:
    """Consecutive days in imperial units; a fixed scenario for days without weather."""
    days = weather.sparkSession.range(n_days).select(F.col("id").cast("int").alias("day_offset"), F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("day"))
    j = days.join(weather, "day", "left")
    c = lambda x, default: F.round(F.coalesce(x, F.lit(default)), 6)
    return j.select(
        "day_offset",
        "day",
        c(fahrenheit(F.col("tmmx")), 90.0).alias("temp_max_f"),
        c(fahrenheit(F.col("tmmn")), 60.0).alias("temp_min_f"),
        c(F.col("rmax"), 50.0).alias("rh_max"),
        c(F.col("rmin"), 15.0).alias("rh_min"),
        c(F.col("vs") * MPH, 15.0).alias("wind_mph"),
        c(F.col("th"), 270.0).alias("wind_direction"),
        c(F.col("pr") / 25.4, 0.0).alias("precip_in"),
        c(F.col("erc"), 70.0).alias("erc"),
        F.coalesce(is_extreme_stream(), F.lit(False)).alias("is_extreme"),
    )


def scenarios(weather: DataFrame, n: int, extreme_fraction: float = 0.15, seed: int = 42) -> DataFrame:
    """n draws of days: the first floor(n * fraction) from extreme days, the rest from the fire season, each by a hash of its number. Pools are numbered by day."""
    day = F.col("day")
    pools = weather.where(is_extreme_generator()).withColumn("pool", F.lit(1)).unionByName(weather.where(in_season("fire")).withColumn("pool", F.lit(0)))
    w = Window.partitionBy("pool", F.year("day")).orderBy("day")
    by_year = pools.groupBy("pool", F.year("day").alias("y")).count()
    before = by_year.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("pool").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("count").over(Window.partitionBy("pool")))
    pools = pools.withColumn("y", F.year("day")).withColumn("k", F.row_number().over(w) - 1).join(before, ["pool", "y"])
    pools = pools.withColumn("k", F.col("k") + F.col("before")).drop("before", "count", "y")
    draws = weather.sparkSession.range(n).select(F.col("id").alias("scenario_id"), F.when(F.col("id") < int(n * extreme_fraction), 1).otherwise(0).alias("pool"), uniform("scenario", F.col("id"), seed=seed).alias("u"))
    sizes = pools.groupBy("pool").agg(F.max("size").alias("size"))
    draws = draws.join(sizes, "pool").withColumn("k", F.floor(F.col("u") * F.col("size"))).drop("u", "size")
    out = draws.join(pools.drop("size"), ["pool", "k"])
    return out.select("scenario_id", day, (F.col("pool") == 1).alias("is_extreme"), *[c for c in weather.columns if c != "day"])


def nearest_cell(weather: DataFrame, points: DataFrame) -> DataFrame:
    """points (id, lat, lon, day) with the weather of the nearest cell and that day; an equi-join on the snapped cell where the grid is regular."""
    lats = weather.select("lat").distinct().agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.count(F.lit(1)).alias("n"))
    lons = weather.select("lon").distinct().agg(F.min("lon").alias("c"), F.max("lon").alias("d"), F.count(F.lit(1)).alias("m"))
    p = points.crossJoin(F.broadcast(lats.crossJoin(lons)))
    snap = lambda x, a, b, n: F.least(F.greatest(F.round((x - a) / F.nullif(b - a, F.lit(0.0)) * (n - 1)), F.lit(0.0)), (n - 1).cast("double"))
    i = F.coalesce(snap(F.col("lat"), F.col("a"), F.col("b"), F.col("n")), F.lit(0.0)).cast("int")
    j = F.coalesce(snap(F.col("lon"), F.col("c"), F.col("d"), F.col("m")), F.lit(0.0)).cast("int")
    p = p.select(points["id"], points["day"], i.alias("i"), j.alias("j"))
    w = weather.crossJoin(F.broadcast(lats.crossJoin(lons)))
    i = F.coalesce(snap(F.col("lat"), F.col("a"), F.col("b"), F.col("n")), F.lit(0.0)).cast("int")
    j = F.coalesce(snap(F.col("lon"), F.col("c"), F.col("d"), F.col("m")), F.lit(0.0)).cast("int")
    w = w.withColumn("i", i).withColumn("j", j).drop("a", "b", "n", "c", "d", "m", "lat", "lon")
    return p.join(w, ["day", "i", "j"], "left").drop("i", "j")
