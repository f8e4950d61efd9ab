"""Properties and hand-checked values of the engine's operators."""
import datetime as dt
import math
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlake.functions.grid import GridSpec, tile_bounds
from emberlake.functions.hashing import uniform
from emberlake.operators import fuel, holdout, metrics, ml, montecarlo, parcels, spread, terrain, weather
from emberlake.sources import readers, writers

from .conftest import DATA


def scored(spark, y, p):
    return spark.createDataFrame(list(zip(y, p, strict=True)), "label int, prob double")


def test_perfect_separation(spark):
    r = metrics.discrimination(scored(spark, [0, 0, 0, 0, 1, 1, 1, 1], [0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9])).first()
    assert (r.auc, r.recall, r.precision) == (1.0, 1.0, 1.0)


def test_degenerate_labels(spark):
    assert metrics.discrimination(scored(spark, [0] * 10, [0.1 * k for k in range(10)])).first().auc == 0.5
    assert metrics.discrimination(scored(spark, [1] * 10, [0.1 * k for k in range(10)])).first().n == 10
    r = metrics.discrimination(scored(spark, [0, 1, 0, 1, 0, 1], [0.1, 0.9, float("nan"), 0.8, None, 0.7])).first()
    assert r.n == 4 and r.auc == 1.0


def test_auc_equals_pair_counts(spark):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 2, 300), rng.integers(0, 12, 300) / 11
    want = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    assert math.isclose(metrics.discrimination(scored(spark, y.tolist(), p.tolist())).first().auc, want, abs_tol=1e-6)


def test_bins_by_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.3, 0.6, 0.7, 1.0, 0.0, 0.55)], "p double")
    assert [r[0] for r in df.select(metrics.left_closed_bin(F.col("p"))).collect()] == [2, 5, 6, 9, 0, 5]


def test_calibration_and_skill(spark):
    rng = np.random.default_rng(42)
    y = (rng.random(1000) < 0.2).astype(int)
    p = np.clip(np.where(y == 1, 0.6, 0.15) + rng.uniform(-0.1, 0.1, 1000), 0, 1)
    s = scored(spark, y.tolist(), p.tolist())
    assert 0 <= metrics.calibration_error(s).first().ece < 0.5
    assert metrics.skill(s).first().bss > 0
    assert metrics.skill(s.limit(0)).count() == 0
    curve = metrics.roc_curve(s).orderBy(F.desc("threshold"), "tp", "fp").collect()  # rounded thresholds may tie
    falling = np.argsort(-p)
    assert [(r.tp, r.fp) for r in curve] == sorted(zip(np.cumsum(y[falling]).tolist(), np.cumsum(1 - y[falling]).tolist()))
    assert all(a.tpr <= b.tpr and a.fpr <= b.fpr for a, b in zip(curve, curve[1:], strict=False)) and curve[-1].tpr == 1.0


def plane(spark, fx, n=30, cell=30.0):
    return spark.createDataFrame([(r, c, fx(r * cell, c * cell)) for r in range(n) for c in range(n)], "row int, col int, elevation double")


def test_slope_of_a_plane(spark):
    t = terrain.derivatives(plane(spark, lambda y, x: 0.1 * x), 30.0).collect()
    assert all(abs(r.slope - 5.710593) < 1e-4 for r in t)
    # sixteen cells reach half a cell further to the west: half of 3 m
    inner = [r for r in t if 8 <= r.col < 22]
    assert all(abs(r.tpi - 1.5) < 1e-9 for r in inner)
    assert all(abs(r.tpi) < 1e-9 for r in terrain.tpi(plane(spark, lambda y, x: 0.1 * x), 100.0).collect() if 2 <= r.col < 28)


def test_aspect_of_a_plane(spark):
    t = terrain.derivatives(plane(spark, lambda y, x: -0.1 * x), 30.0).collect()
    assert all(abs(r.aspect - 90) < 1e-6 for r in t)
    flat = terrain.landscape_terrain(terrain.derivatives(plane(spark, lambda y, x: 7.0, 5), 30.0)).collect()
    assert all(r.slope_i == 0 and r.aspect_i == -1 for r in flat)


def test_single_cell_terrain(spark):
    r = terrain.derivatives(plane(spark, lambda y, x: 1.0, 1), 30.0).first()
    assert r.slope is None and r.tpi == 0


def test_distance_is_exact(spark):
    g = spark.createDataFrame([(r, c) for r in range(12) for c in range(15)], "row int, col int")
    f = [(2, 3), (9, 14), (11, 0)]
    got = terrain.distance(g, spark.createDataFrame(f, "row int, col int"), 10.0).collect()
    assert len(got) == 180 and all(math.isclose(r.distance, 10 * min(math.hypot(r.row - a, r.col - b) for a, b in f)) for r in got)
    assert {r.distance for r in terrain.distance(g, spark.createDataFrame([], "row int, col int"), 10.0).collect()} == {50_000.0}


def test_grid_shape():
    s = GridSpec(-200000, 0, -100000, 100000, 270)
    assert (s.nrows, s.ncols) == (370, 370)
    assert tile_bounds(9) == (-10_000.0, 90_000.0, 110_000.0, 210_000.0)


def test_crosswalk(spark):
    df = spark.createDataFrame([(c,) for c in (91, 98, 99, 93, 101, 204, 5, 300)], "fuel_model int")
    got = [r.older_model for r in fuel.with_fuel(df).collect()]
    assert got == [91, 98, 99, 93, 1, 13, 8, 0]


def test_temporal_features(spark):
    df = spark.createDataFrame([(dt.date(2020, 7, 15),), (dt.date(2020, 7, 18),)], "day date")
    a, b = weather.temporal_features(df).orderBy("day").collect()
    assert (a.day_of_year, a.month, a.season, a.is_weekend, b.is_weekend) == (197, 7, 2, 0, 1)


def test_derived_features(spark):
    df = spark.createDataFrame([(90.0, 35.0, 15.0, 10.0), (90.0, None, 15.0, 10.0)], "aspect double, tmmx double, rmin double, vs double")
    a, b = weather.derived_features(df).collect()
    assert math.isclose(a.aspect_sin, 1) and abs(a.aspect_cos) < 1e-9 and a.vpd > 0 and a.fwi > 0 and b.vpd is None


def test_days_since_rain_crosses_new_year(spark):
    days = [dt.date(2019, 12, 1) + dt.timedelta(k) for k in range(140)]
    df = spark.createDataFrame([(d, 5.0 if d == dt.date(2019, 12, 20) else 1.0) for d in days], "day date, pr double")
    got = {r.day: r.days_since_rain for r in weather.days_since_rain(df).collect()}
    assert len(got) == 140
    assert all(n == ((d - dt.date(2019, 12, 20)).days if 0 <= (d - dt.date(2019, 12, 20)).days <= 90 else 90) for d, n in got.items())


def test_holdout(spark):
    f = spark.range(400).select(F.col("id").alias("fire_id"), (F.lit(2015) + F.col("id") % 8).cast("int").alias("year_"), (F.lit(1000.0) * -F.log(F.lit(1.0) - uniform("a", F.col("id")))).alias("gis_acres"))
    rows = holdout.split_by_year(f).collect()
    share = sum(r.holdout for r in rows) / len(rows)
    assert len(rows) == 400 and 0.2 < share < 0.4 and {r.year_ for r in rows if r.holdout} == set(range(2015, 2023))
    parts = {r.part for r in holdout.holdout_set(f, (2018, 2020)).collect()}
    assert parts == {"train", "holdout", "neither"}
    with pytest.raises(ValueError):
        holdout.split_by_year(f.drop("year_"))


def brute_spread(fuel_codes, slope, aspect, cell, row, col, wind, from_, duration):
    """Visits in order, cell by cell."""
    h, w = fuel_codes.shape
    ros = np.vectorize(lambda c: fuel.ROS.get(int(c), 0.0))(fuel_codes)
    ok = ((fuel_codes >= 1) & (fuel_codes <= 13)) | ((fuel_codes >= 101) & (fuel_codes <= 204))
    arrival = np.full((h, w), np.inf)
    arrival[row, col] = 0
    ratio = min(1 + 0.25 * wind, 8.0)
    e = math.sqrt(1 - 1 / ratio**2)
    for k in range(int(duration / 5)):
        before = np.isfinite(arrival)
        for r in range(h):
            for c in range(w):
                near = [(r + a, c + b, a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and 0 <= r + a < h and 0 <= c + b < w]
                if before[r, c] or not ok[r, c] or ros[r, c] <= 0 or not any(before[x, y] for x, y, _, _ in near):
                    continue
                best = math.inf
                for x, y, a, b in near:
                    if np.isfinite(arrival[x, y]):
                        bearing = math.degrees(math.atan2(-b, a)) % 360
                        along = max((1 + e * math.cos(math.radians(bearing - (from_ + 180)))) / (1 - e * e), 0.1) if e else 1.0
                        align = math.cos(math.radians(bearing - (aspect[r, c] + 180) % 360))
                        s = math.tan(math.radians(min(max(slope[r, c], 0), 60))) ** 2
                        f = min(max(1 + 5 * s * align if align > 0 else 1 + 0.5 * align, 0.2), 10)
                        best = min(best, arrival[x, y] + cell * math.hypot(a, b) / (ros[r, c] * along * (1 + 0.15 * wind) * f))
                if best <= (k + 1) * 5:
                    arrival[r, c] = best
    return arrival


@pytest.mark.parametrize("wind,cell", [(0.0, 270.0), (4.47, 270.0), (15.6, 270.0), (15.6, 30.0)])
def test_spread_equals_visiting_in_order(wind, cell):
    rng = np.random.default_rng(7)
    shape = (24, 27)
    codes, slope, aspect = rng.choice([1, 4, 5, 6, 98, 101, 115], shape), rng.uniform(0, 40, shape), rng.uniform(0, 360, shape)
    land = spread.Landscape.of(codes, slope, aspect, cell)
    r, c, a = spread.spread(land, 11, 13, wind, 200.0, 120.0)
    got = np.full(shape, np.inf)
    got[r, c] = a
    want = brute_spread(codes, slope, aspect, cell, 11, 13, wind, 200.0, 120)
    assert (np.isfinite(got) == np.isfinite(want)).all() and np.allclose(got[np.isfinite(got)], want[np.isfinite(want)])


def test_many_fires_at_once_are_each_by_itself():
    rng = np.random.default_rng(8)
    land = spread.Landscape.of(rng.choice([101, 104, 98, 165], (13, 9)), rng.uniform(0, 30, (13, 9)), rng.uniform(0, 360, (13, 9)), 90.0)
    rows, cols = rng.integers(-1, 14, 40), rng.integers(-1, 10, 40)
    sim, r, c, a = spread.spread_many(land, rows, cols, 6.0, 200.0, 240.0)
    for k in range(40):
        y, x, t = spread.spread(land, int(rows[k]), int(cols[k]), 6.0, 200.0, 240.0)
        mine = sim == k
        assert sorted(zip(r[mine], c[mine], a[mine])) == sorted(zip(y, x, t))


def test_fires_take_the_rows_that_they_can_reach():
    """Many short fires on a tall landscape: memory for the rows they can reach, and the same fires as on a low one."""
    import tracemalloc

    rng = np.random.default_rng(12)
    shape = (100_000, 3)
    land = spread.Landscape.of(rng.choice([1, 4, 104, 98], shape), rng.uniform(0, 30, shape), rng.uniform(0, 360, shape), 90.0)
    minutes, rows, cols = land.minutes(6.0, 200.0), np.array([0, 5, 50_000, 99_999] * 10), rng.integers(0, 3, 40)
    tracemalloc.start()
    n, r, c, a = spread.spread_many(land, rows, cols, 6.0, 200.0, 60.0, minutes=minutes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20
    part = slice(49_900, 50_100)
    low = spread.Landscape(200, 3, 90.0, *(np.pad(x.reshape(*x.shape[:-1], -1, 5)[..., 49_901:50_101, :], [(0, 0)] * (x.ndim - 1) + [(1, 1), (0, 0)]).reshape(*x.shape[:-1], -1) for x in (land.ros, land.burnable, land.slope_factor)))
    for k in np.flatnonzero(rows == 50_000):
        y, x, t = spread.spread(low, 50_000 - part.start, int(cols[k]), 6.0, 200.0, 60.0)
        assert sorted(zip(r[n == k] - part.start, c[n == k], a[n == k])) == sorted(zip(y, x, t))


def test_spread_edges():
    land = spread.Landscape.of(np.full((3, 3), 98), np.zeros((3, 3)), np.zeros((3, 3)), 270.0)
    assert len(spread.spread(land, 1, 1, 0.0, 0.0, 480.0)[0]) == 1
    assert len(spread.spread(land, 5, 1, 0.0, 0.0, 480.0)[0]) == 0


def test_spread_on_a_strip():
    """Rate 8 m/min on flat ground, no wind: against the aspect 33.75 minutes a cell, along it 67.5."""
    land = spread.Landscape.of(np.full((9, 1), 4), np.zeros((9, 1)), np.full((9, 1), 180.0), 270.0)
    r, _, a = spread.spread(land, 4, 0, 0.0, 0.0, 240.0)
    at = dict(zip(r.tolist(), a.tolist(), strict=True))
    assert math.isclose(at[3], 33.75) and math.isclose(at[5], 67.5)


def test_simulations_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    land = spread.Landscape.of(rng.choice([1, 4, 5], (20, 20)), np.zeros((20, 20)), np.zeros((20, 20)), 270.0)
    s = spark.range(6).select(F.col("id").alias("scenario_id"), F.lit(10).alias("ignition_row"), F.col("id").cast("int").alias("ignition_col"), F.lit(5.0).alias("wind_speed"), F.lit(90.0).alias("wind_direction"), F.lit(60).alias("duration_min"))
    key = lambda df: sorted(map(tuple, spread.simulate(df, land).collect()))
    assert key(s.repartition(1)) == key(s.repartition(5))


def test_calibration_factor(spark):
    mask = spark.range(19).select(F.col("id").cast("int").alias("row"), F.lit(0).alias("col"))
    pred = spark.range(100).select(F.lit(0.2).alias("burn_probability"))
    r = montecarlo.calibration(mask, pred, 100, 2).first()
    assert (r.annual, r.predicted, r.factor) == (0.1, 0.2, 0.5)
    assert montecarlo.calibration(mask.limit(0), pred, 100, 2).first().factor == 1.0


def test_beta_quantiles():
    for p in (0.05, 0.5, 0.95):
        assert math.isclose(montecarlo.beta_quantile(np.array([0.5]), np.array([0.5]), p)[0], math.sin(math.pi * p / 2) ** 2, abs_tol=1e-9)
        assert math.isclose(montecarlo.beta_quantile(np.array([3.0]), np.array([1.0]), p)[0], p ** (1 / 3), abs_tol=1e-9)


def test_percentiles_above_the_trials(spark):
    r = montecarlo.percentiles(spark.createDataFrame([(0, 0, 11), (0, 1, 0)], "row int, col int, burn_count long"), 10).collect()
    assert {x.burn_count: x.p50 for x in r}[11] is None


def test_poisson(spark):
    got = spark.range(4000).select(montecarlo.poisson(uniform("t", F.col("id")), F.lit(2.5)).alias("k")).agg(F.avg("k"), F.max("k")).first()
    assert abs(got[0] - 2.5) < 0.1 and got[1] <= 10


def test_ring(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))])
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (-1.0, 0.5)], "x double, y double").withColumn("ring", ring)
    got = df.select(parcels.ring_contains(F.col("ring"), F.col("x"), F.col("y")).alias("i"), parcels.ring_centroid(F.col("ring")).alias("c")).collect()
    assert [r.i for r in got] == [True, False, False] and (got[0].c.x, got[0].c.y) == (2.0, 1.0)


def test_output_table_needs_its_columns(spark):
    with pytest.raises(KeyError):
        parcels.output_table(spark.createDataFrame([("a",)], "apn string"), 2020)


def training(spark, n=300):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, (n, 3))
    rows = [(k, *map(float, v), int(v[0] + v[1] > 1)) for k, v in enumerate(x)]
    rows[0] = (0, None, float("nan"), 0.5, rows[0][4])
    return spark.createDataFrame(rows, "key long, a double, b double, c double, label int")


def test_model(spark, tmp_path):
    df = training(spark)
    train, test = ml.split(df, "key")
    assert train.count() + test.count() == 300 and test.count() == sum(int(0.2 * r[1]) for r in df.groupBy("label").count().collect())
    m = ml.IgnitionModel("random_forest", numTrees=10, maxDepth=5).fit(train, ["a", "b", "c"])
    rows = m.predict(test).collect()
    assert all(0 <= r.prob <= 1 and r.predicted in (0, 1) for r in rows)
    importance = m.importance()
    assert len(importance) == 3 and abs(sum(importance.values()) - 1) < 0.01
    m.save(str(tmp_path / "m"))
    again = ml.IgnitionModel.load(str(tmp_path / "m")).predict_proba(test).collect()
    assert sorted((r.key, r.prob) for r in again) == sorted((r.key, r.prob) for r in rows)
    with pytest.raises(ValueError):
        ml.IgnitionModel("svm")
    with pytest.raises(ValueError):
        ml.IgnitionModel().predict(test)


def test_folds(spark):
    n = ml.folds(training(spark), "key").groupBy("fold").count().collect()
    assert len(n) == 5 and max(r["count"] for r in n) - min(r["count"] for r in n) <= 2


def test_landscape_file(spark):
    cells = spark.createDataFrame([(r, c, 10.0 + r, 1.0, 2.0, 4) for r in range(3) for c in range(2)], "row int, col int, elevation double, slope double, aspect double, fuel_model int")
    blob = writers.landscape_bytes(cells, (0.0, 0.0, 540.0, 810.0), 270.0)
    assert np.frombuffer(blob[-48:-36], "<i2").tolist() == [12, 12, 11, 11, 10, 10]
    with pytest.raises(ValueError):
        writers.landscape_bytes(cells.drop("slope"), (0.0, 0.0, 1.0, 1.0), 270.0)


def test_readers(spark, tmp_path):
    lines = ['{"geometry": {"type": "Polygon", "coordinates": [[[1.0, 2.0], [3.0, 2.5], [2.0, 4.0]]]}, "properties": "{}"}', "{broken", ""]
    (tmp_path / "b.json").write_text("\n".join(lines))
    assert [tuple(r) for r in readers.building_footprints(spark, str(tmp_path / "b.json")).collect()] == [(1.0, 2.0, 3.0, 4.0)]
    spark.createDataFrame([(2015, 5.0), (2020, 6.0)], "YEAR_ int, GIS_ACRES double").write.parquet(str(tmp_path / "f"))
    assert readers.fire_perimeters(spark, str(tmp_path / "f"), (2014, 2016)).count() == 1


def test_the_world_grows_with_the_parts(spark, tmp_path):
    from emberlake.plans import queries
    from emberlake.sources import tables

    small = f"{DATA}/sf0.001"
    for name in ("orders", "customer", "nation"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{small}/{name}.parquet")
    part = spark.read.parquet(f"{small}/part.parquet")
    n = part.count()
    spark.range(5000).join(part, F.col("id") % n == F.col("p_partkey")).drop("p_partkey").withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    world, at = tables.world(spark, str(tmp_path)), str(tmp_path)
    assert (world.nrows, world.ncols, tables.world(spark, small).nrows) == (100, 50, 40)
    for name in ("resample_bilinear", "resample_nearest"):
        assert queries.QUERIES[name](spark, at).where("elevation IS NOT NULL").count() == 50 * 25
    assert queries._landscape(spark, at).nrows == 100
    assert queries.clipped_fuels(spark, at).agg(F.max("row")).first()[0] >= 40
    assert queries.ignition_points(spark, at).agg(F.min("y")).first()[0] < -10800
    assert queries.burn_cells(spark, at).count() == 5000


def test_counts_are_those_of_every_simulation(spark):
    rng = np.random.default_rng(3)
    land = spread.Landscape.of(rng.choice([101, 104, 121, 98], (12, 15)), rng.uniform(0, 30, (12, 15)), rng.uniform(0, 360, (12, 15)), 270.0)
    rows = [(k, int(rng.integers(-1, 13)), int(rng.integers(0, 4)), float(k % 2), 270.0, 480) for k in range(60)]
    scenarios = spark.createDataFrame(rows, "scenario_id long, ignition_row int, ignition_col int, wind_speed double, wind_direction double, duration_min int")
    want = montecarlo.burn_counts(spread.simulate(scenarios, land))
    got = spread.simulate_counts(scenarios, land)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_counts_are_made_where_the_rows_are(spark):
    """Fires are burned in the JVM, each once, as the Python kernel burns them: several bands of rows, winds and durations, ignitions of any fuel, outside, or without a wind."""
    rng = np.random.default_rng(6)
    shape = (90, 17)
    land = spread.Landscape.of(rng.choice([1, 8, 104, 121, 185, 98], shape), rng.uniform(0, 60, shape), rng.uniform(0, 360, shape), 90.0)
    winds = [(0.0, 270.0), (6.25, 200.0), (15.5, 33.0)]
    rows = [(int(rng.integers(-2, 92)), int(rng.integers(-1, 18)), *winds[k % 3], (60, 240, 0)[k // 3 % 3], k % 4 + 1) for k in range(400)]
    scenarios = spark.createDataFrame([*rows, (5, 5, None, 270.0, 60, 1), (None, 5, 0.0, 270.0, 60, 1)], "ignition_row int, ignition_col int, wind_speed double, wind_direction double, duration_min int, times long")
    want = np.zeros(shape, np.int64)
    for some, (n, r, c, _) in spread._together(land, scenarios.dropna().toPandas()):
        np.add.at(want, (r, c), some["times"].to_numpy()[n])
    counts = spread.simulate_counts(scenarios, land)
    got = np.zeros(shape, np.int64)
    for r in counts.collect():
        got[r.row, r.col] = r.burn_count
    assert (got == want).all() and want.any()
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and plan.count("burn_fires(") == 1


def test_trees_read_rows_that_are_made_once(spark, monkeypatch):
    df = spark.range(40).select((F.col("id") % 2).cast("int").alias("label"), F.col("id").cast("double").alias("a"))
    seen, fit = [], ml.Pipeline.fit
    monkeypatch.setattr(ml.Pipeline, "fit", lambda self, rows: seen.append((rows, rows.storageLevel.useMemory)) or fit(self, rows))
    model = ml.IgnitionModel("random_forest", numTrees=2, maxDepth=2).fit(df, ["a"])
    assert [x for _, x in seen] == [True] and not seen[0][0].storageLevel.useMemory
    assert model.predict_proba(df).count() == 40


def test_trees_read_rows_on_all_cores(spark, monkeypatch):
    """Rows that lie in one part are dealt to all cores, in more parts if there are many, and all are learned from."""
    from emberlake.plans import queries

    seen, fit = [], ml.Pipeline.fit
    monkeypatch.setattr(ml.Pipeline, "fit", lambda self, rows: seen.append((self.getStages()[-1], [r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()])) or fit(self, rows))
    df = spark.range(4000).coalesce(1).select((F.col("id") % 2).cast("int").alias("label"), F.col("id").cast("double").alias("a"))
    cores = spark.sparkContext.defaultParallelism
    for each, parts in ((50_000, cores), (4000 // (3 * cores), 4 * cores)):
        monkeypatch.setattr(ml, "EACH", each)
        ml.IgnitionModel("random_forest", numTrees=2, maxDepth=2).fit(df, ["a"])
        model, sizes = seen[-1]
        assert len(sizes) == parts and sum(sizes) == 4000 and max(sizes) < 2 * min(sizes) and model.getCacheNodeIds()
    kept, split = [], ml.split
    monkeypatch.setattr(ml, "split", lambda t, key: kept.append(t.storageLevel.useMemory) or split(t, key))
    kind = ml.IgnitionModel
    monkeypatch.setattr(ml, "IgnitionModel", lambda name: kind(name, numTrees=1, maxDepth=2))
    queries.QUERIES["ignition_model"](spark, f"{DATA}/sf0.001")
    assert kept == [True]


def test_fires_of_one_cell_meet_each_scenario_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    land = spread.Landscape.of(rng.choice([101, 104, 121, 98], (6, 5)), rng.uniform(0, 30, (6, 5)), rng.uniform(0, 360, (6, 5)), 270.0)
    spec = GridSpec(0.0, -6 * 270.0, 5 * 270.0, 0.0, 270.0)
    points = spark.createDataFrame([(k, 270.0 * (k % 2) + 100 + k, -300.0 - k) for k in range(40)] + [(90, -5000.0, 10.0)], "fire_id long, x double, y double")
    weather = spark.createDataFrame([(0, 2.0, 10.0), (1, 6.0, 200.0)], "scenario_id long, vs double, th double")
    sims = [(f.fire_id * 2 + w.scenario_id, 1, int(f.x // 270), w.vs, w.th, 60) for f in points.collect() if f.x > 0 for w in weather.collect()]
    every = spark.createDataFrame(sims, "scenario_id long, ignition_row int, ignition_col int, wind_speed double, wind_direction double, duration_min int")
    want = montecarlo.burn_probability(montecarlo.burn_counts(spread.simulate(every, land)), 82)
    given, counts = [], montecarlo.simulate_counts
    monkeypatch.setattr(montecarlo, "simulate_counts", lambda s, land: given.append(s.count()) or counts(s, land))
    got = montecarlo.run_conditional(points, weather, land, spec, 60)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    assert given == [6]  # two cells and one outside, two scenarios


def test_queries_have_production_settings(spark, monkeypatch):
    from emberlake.plans import queries

    small, seen = f"{DATA}/sf0.001", {}
    run, conditional, model = montecarlo.run, montecarlo.run_conditional, ml.IgnitionModel
    monkeypatch.setattr(montecarlo, "run", lambda spark, land, spec, config: seen.update(config=config) or run(spark, land, spec, montecarlo.MonteCarloConfig(10)))
    monkeypatch.setattr(montecarlo, "run_conditional", lambda points, weather, land, spec, duration=480: seen.update(scenarios=weather.count(), duration=duration) or conditional(points.limit(1), weather.limit(1), land, spec))
    monkeypatch.setattr(ml, "IgnitionModel", lambda kind, **params: seen.update(params=params) or model(kind, numTrees=1, maxDepth=2))
    for name in ("monte_carlo", "conditional_monte_carlo", "ignition_model"):
        queries.QUERIES[name](spark, small)
    assert seen == {"config": montecarlo.MonteCarloConfig(n_iterations=10_000), "scenarios": 100, "duration": 480, "params": {}}
    assert seen["config"].duration_min == 480 and ml.MODELS["random_forest"]().getNumTrees() == 500
    assert queries.QUERIES["synthetic_landscape"](spark, small).count() == 240 * 240
    assert {"row", "col", "day", "label", *queries.FEATURES} <= set(queries.QUERIES["training_set"](spark, small).columns)


def test_all_fires_and_days_are_used(spark, monkeypatch):
    from emberlake.plans import queries
    from emberlake.sources import tables

    small, seen = f"{DATA}/sf0.001", {}
    monkeypatch.setattr(montecarlo, "run_conditional", lambda points, weather, land, spec: seen.update(points=points.count()) or montecarlo.burn_probability(spark.createDataFrame([(0, 0, 1)], "row int, col int, burn_count long"), 1))
    queries.QUERIES["conditional_monte_carlo"](spark, small)
    fires, cells = tables.fires(spark, small), tables.grid(spark, small)
    assert seen == {"points": fires.count()}
    t = queries.QUERIES["training_set"](spark, small).persist()
    world = tables.world(spark, small)
    x, y = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    lit = fires.select(world.row_of(y).alias("row"), world.col_of(x).alias("col")).join(cells, ["row", "col"])
    assert t.where("label = 1").count() == lit.count() > 0
    assert t.where("label = 0 AND erc >= 50").count() > 0


def test_positions_are_those_of_the_order(spark, monkeypatch):
    from emberlake.functions import order
    from emberlake.functions.hashing import uniform

    monkeypatch.setattr(order, "EACH", 16)
    df = spark.range(300).select((F.col("id") % 100).alias("id"), (F.col("id") % 3).alias("g"))
    got = order.positions(df.distinct(), uniform("p", F.col("id")), "id", by=("g",)).withColumn("u", uniform("p", F.col("id"))).collect()
    for g in range(3):
        rows = sorted((r for r in got if r.g == g), key=lambda r: (r.u, r.id))
        assert [r.position for r in rows] == list(range(len(rows))) and len(rows) == 100


def test_split_and_folds(spark):
    from emberlake.operators import ml

    df = spark.range(500).select(F.col("id").alias("key"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    train, test = ml.split(df, "key")
    assert sorted((r.label, r["count"]) for r in test.groupBy("label").count().collect()) == [(0, 80), (1, 20)]
    assert train.count() == 400 and train.join(test, "key").count() == 0
    sizes = ml.folds(df, "key").groupBy("fold", "label").count().collect()
    assert len(sizes) == 10 and {r["count"] for r in sizes if r.label} == {20}


def test_cross_validation(spark):
    from emberlake.operators import ml

    df = spark.range(200).select(F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("label"), ((F.col("id") % 2) * 2 + F.rand(1)).alias("x"))
    got = ml.cross_validate(df, "key", ["x"], k=2, numTrees=5, maxDepth=3).first()
    assert got.auc_mean == 1.0 and got.auc_std == 0.0


def test_distance_in_wide_grids(spark):
    g = spark.range(3 * 90).select((F.col("id") % 3).cast("int").alias("row"), F.floor(F.col("id") / 3).cast("int").alias("col"))
    feature = [(0, 2), (2, 40), (1, 41)]
    f = spark.createDataFrame(feature, "row int, col int")
    for cap in (5.0, 20.0, 1000.0):
        got = terrain.distance(g, f, 1.0, cap).collect()
        assert len(got) == 270
        for r in got:
            assert math.isclose(r.distance, min(cap, min(math.hypot(r.row - a, r.col - b) for a, b in feature)), abs_tol=1e-9)


def test_tiles_of_a_landscape(spark):
    from emberlake.operators import montecarlo, spread

    rng = np.random.default_rng(3)
    n = 24
    rows = [(r, c, int(rng.choice([101, 102, 98])), float(rng.uniform(0, 20)), float(rng.uniform(0, 360))) for r in range(n) for c in range(n)]
    cells = spark.createDataFrame(rows, "row int, col int, fuel_model int, slope double, aspect double")
    fires = spark.createDataFrame([(k, int(rng.integers(n)), int(rng.integers(n)), 5.0 + k % 2, 270.0, 240) for k in range(12)], "scenario_id long, ignition_row int, ignition_col int, wind_speed double, wind_direction double, duration_min int")
    whole = spread.simulate_counts(fires, spread.landscape(cells, 270.0))
    one = {(r.row, r.col): r.burn_probability * 12 for r in montecarlo.run_tiles(cells, 270.0, montecarlo.Tiling(100, 5), fires, 12).collect()}
    assert len(one) == n * n
    want = {(r.row, r.col): r.burn_count for r in whole.collect()}
    assert all(math.isclose(x, want.get(k, 0), abs_tol=1e-9) for k, x in one.items()) and want
    several = montecarlo.run_tiles(cells, 270.0, montecarlo.Tiling(8, 3), fires, 12).collect()
    assert len(several) == n * n and max(r.n_tiles for r in several) == 4 and 0 < max(r.burn_probability for r in several) <= 1


def test_few_cells_take_all_the_ignitions_wanted(spark):
    from emberlake.functions.grid import GridSpec
    from emberlake.operators import montecarlo

    config = montecarlo.MonteCarloConfig(n_iterations=20, ignition_rate=1e6)
    w = montecarlo.default_weather(spark.range(20).withColumnRenamed("id", "iteration"), config)
    got = montecarlo.ignitions(w, GridSpec(0.0, 0.0, 810.0, 1080.0, 270.0), config).groupBy("iteration").agg(F.countDistinct("ignition_row", "ignition_col").alias("n"), F.count(F.lit(1)).alias("m")).collect()
    assert len(got) == 20 and all(r.n == r.m == 10 for r in got)


def test_albers(spark):
    from emberlake.functions.grid import GridSpec
    from emberlake.functions.projection import Albers, reproject

    a = Albers()
    p = spark.createDataFrame([(-120.0, 38.0), (-123.4, 41.9), (-114.2, 32.6), (-122.45, 38.3)], "lon double, lat double")
    x, y = a.forward(F.col("lon"), F.col("lat"))
    p = p.withColumn("x", x).withColumn("y", y)
    lon, lat = a.inverse(F.col("x"), F.col("y"))
    for r in p.withColumn("lon2", lon).withColumn("lat2", lat).collect():
        assert abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-7
        assert (r.x > 0) == (r.lon > -120) or r.lon == -120
    # a metre on the ground is a metre on the map, near a standard parallel: a minute of latitude at 34 degrees is 1848.9 m
    q = spark.createDataFrame([(34.0,), (34.0 + 1 / 60,)], "lat double")
    north = [r.y for r in q.select(a.forward(F.lit(-120.0), F.col("lat"))[1].alias("y")).collect()]
    assert abs(north[1] - north[0] - 1848.9) < 1.0
    source = GridSpec(-123.0, 38.0, -122.0, 39.0, 0.1)
    cells = source.cells(spark).select("row", "col", (F.col("row") * 100 + F.col("col")).alias("v"))
    x0, y0 = p.select(*[c.alias(n) for c, n in zip(a.forward(F.lit(-122.5), F.lit(38.5)), "xy")]).first()
    got = reproject(cells, "v", source, GridSpec(x0 - 500, y0 - 500, x0 + 500, y0 + 500, 500.0), a).collect()
    assert len(got) == 4 and {r.v for r in got} <= {404, 405, 504, 505}


def test_tables_are_loaded_by_contract(spark, tmp_path):
    from emberlake.sources import readers, tables

    path = str(tmp_path / "p.csv")
    with open(path, "w") as f:
        f.write("PARCELID,County,minx,miny,maxx,maxy,extra\n1,Sonoma,0,0,1,1,a\n2,Napa,5,5,6,6,b\n3,Sonoma,9,9,10,10,c\n")
    df = readers.load(spark, "parcels", path)
    assert dict(df.dtypes)["apn"] == "string" and dict(df.dtypes)["minx"] == "double" and "extra" in df.columns
    assert [r.apn for r in readers.load(spark, "parcels", path, county="Sonoma").orderBy("apn").collect()] == ["1", "3"]
    assert [r.apn for r in readers.load(spark, "parcels", path, bounds=(0.5, 0.5, 5.5, 5.5)).orderBy("apn").collect()] == ["1", "2"]
    with pytest.raises(KeyError, match="x0"):
        readers.load(spark, "roads", path)
    lines = spark.createDataFrame([(7, 0.0, 0.0, 4.0, 4.0), (8, 9.0, 9.0, 8.0, 8.0)], "osm_id long, x0 double, y0 double, x1 double, y1 double")
    lines.write.parquet(str(tmp_path / "roads"))
    assert [r.road_id for r in readers.load(spark, "roads", str(tmp_path / "roads"), bounds=(8.5, 8.5, 9.5, 9.5)).collect()] == ["8"]
    assert "fires" in tables.register(spark, f"{DATA}/sf0.001")
    assert spark.sql("SELECT year_, count(*) AS n FROM fires GROUP BY year_").agg(F.sum("n")).first()[0] == 1500


def test_targets_and_report(spark):
    from emberlake.operators import metrics

    p = spark.createDataFrame([(k, (k % 10) / 10.0, k % 10 > 6) for k in range(100)], "apn int, burn_prob_mean double, actually_burned boolean")
    out = metrics.targets(metrics.validate_year(p, 2020), 0.8, 0.05)
    got = out.first()
    assert (got.year, got.n, got.n_positive, got.auc, got.burn_auc_met, got.ece_met) == (2020, 100, 30, 1.0, True, False)
    lines = {r.measure: r.value for r in metrics.report(out).collect()}
    assert lines["auc"] == "1.0" and lines["burn_auc_met"] == "true"


def test_canopy_layers(spark):
    from emberlake.operators import fuel

    g = spark.createDataFrame([(2.55, 0.129), (-1.0, 0.0), (None, 0.4)], "canopy_base_height double, canopy_bulk_density double")
    assert [(r.base_height_dm, r.bulk_density_i) for r in fuel.canopy_layers(g).collect()] == [(25, 12), (0, 0), (0, 40)]


def test_daily_summary_of_a_stream(spark, tmp_path):
    from emberlake.streaming.daily import daily_summary

    schema = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").schema
    (tmp_path / "in").mkdir()
    shutil.copy(f"{DATA}/sf0.001/events.parquet", tmp_path / "in")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = daily_summary(stream).writeStream.format("memory").queryName("daily").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination(60)
    want = {r.day: r.n for r in daily_summary(spark.read.parquet(f"{DATA}/sf0.001/events.parquet")).collect()}
    assert {r.day: r.n for r in spark.sql("SELECT day, max(n) AS n FROM daily GROUP BY day").collect()} == want
