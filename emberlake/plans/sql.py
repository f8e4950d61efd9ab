"""The same queries in SQL, over the same tables."""
from __future__ import annotations

from ..functions.hashing import uniform_sql
from ..operators.fuel import CROSSWALK, ROS
from ..sources.tables import CELL, FIRES_SQL, GRID_SQL, PARCELS_SQL, PLACES_SQL, ROWS_SQL, SCORED_BY_DAY_SQL, SCORED_SQL, WEATHER_CELLS_SQL, WEATHER_SQL, ZONES_SQL


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def _edges(op: str) -> str:
    return "(" + " + ".join(f"CAST(prob {op} {i} * 0.1::DOUBLE AS INTEGER)" for i in range(1, 10)) + ")"


V = "v AS (SELECT * FROM scored WHERE label IS NOT NULL AND prob IS NOT NULL AND NOT isnan(prob))"
BINS = f"b AS (SELECT {_edges('>=')} AS bin, count(*) AS n, avg(prob) AS p, avg(label::DOUBLE) AS y, sum(prob) AS sp, sum(label) AS sy, sum((prob - label) * (prob - label)) AS se FROM v GROUP BY 1)"
CURVE = """d AS (SELECT prob, count(*) AS n, sum(label)::BIGINT AS n1 FROM v GROUP BY prob),
c AS (SELECT prob, n, n1, sum(n1) OVER w AS tp, sum(n - n1) OVER w AS fp, sum(n) OVER () AS total, sum(n1) OVER () AS pos FROM d WINDOW w AS (ORDER BY prob DESC ROWS UNBOUNDED PRECEDING))"""


def _ratio(a: str, b: str, default: str = "0.0") -> str:
    return f"round(coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), {default}::DOUBLE), 6)"


def _discrimination(by: str = "") -> str:
    g, on, part = (f"{by}, ", f"GROUP BY {by}", f"PARTITION BY {by} ") if by else ("", "", "")
    return f"""d AS (SELECT {g}prob, count(*) AS n, sum(label)::BIGINT AS n1 FROM v GROUP BY {g}prob),
c AS (SELECT {g}prob, n, n1, sum(n1) OVER w AS tp, sum(n - n1) OVER w AS fp, sum(n) OVER ({part}) AS total, sum(n1) OVER ({part}) AS pos FROM d WINDOW w AS ({part}ORDER BY prob DESC ROWS UNBOUNDED PRECEDING)),
s AS (SELECT {g}max(total) AS n, max(pos) AS p, sum(n1 * (2 * (total - pos - fp) + n - n1)) AS pairs, sum(n1 * tp / (tp + fp)::DOUBLE) AS ap, sum(n1 * (1 - prob) * (1 - prob) + (n - n1) * prob * prob) AS br,
 coalesce(sum(n1) FILTER (prob >= 0.5), 0) AS tp, coalesce(sum(n - n1) FILTER (prob >= 0.5), 0) AS fp FROM c {on}),
m AS (SELECT {g}n::BIGINT AS n, p::BIGINT AS n_positive, {_ratio('pairs', '2 * p * (n - p)', '0.5')} AS auc, {_ratio('ap', 'p')} AS average_precision, round(br / n, 8) AS brier, {_ratio('tp', 'p')} AS recall, {_ratio('tp', 'tp + fp')} AS precision,
 {_ratio('n - p - fp', 'n - p')} AS specificity, {_ratio('tp + n - p - fp', 'n')} AS accuracy, {_ratio('2 * tp', '2 * tp + fp + p - tp')} AS f1 FROM s)"""


DAY_BINS = f"b AS (SELECT grp, {_edges('>=')} AS bin, count(*) AS n, avg(prob) AS p, avg(label::DOUBLE) AS y FROM v GROUP BY 1, 2), e AS (SELECT grp, round(sum(n * abs(p - y)) / sum(n), 6) AS ece, round(max(abs(p - y)), 6) AS mce FROM b GROUP BY 1)"

TERRAIN = f"""z AS (SELECT *, lag(elevation) OVER r AS zl, lead(elevation) OVER r AS zr, lag(elevation) OVER c AS zu, lead(elevation) OVER c AS zd FROM grid WINDOW r AS (PARTITION BY "row" ORDER BY col), c AS (PARTITION BY col ORDER BY "row")),
g AS (SELECT *, CASE WHEN zl IS NULL THEN zr - elevation WHEN zr IS NULL THEN elevation - zl ELSE (zr - zl) / 2.0::DOUBLE END / {CELL}::DOUBLE AS dx, CASE WHEN zu IS NULL THEN zd - elevation WHEN zd IS NULL THEN elevation - zu ELSE (zd - zu) / 2.0::DOUBLE END / {CELL}::DOUBLE AS dy,
 (coalesce(zl, elevation) + elevation + coalesce(zr, elevation)) / 3.0::DOUBLE AS m FROM z),
h AS (SELECT *, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope, degrees(atan2(-dx, dy)) AS a0, elevation - (coalesce(lag(m) OVER c, m) + m + coalesce(lead(m) OVER c, m)) / 3.0::DOUBLE AS tpi FROM g WINDOW c AS (PARTITION BY col ORDER BY "row")),
terrain AS (SELECT *, CASE WHEN a0 < 0 THEN a0 + 360.0::DOUBLE ELSE a0 END AS aspect FROM h)"""


def _case(values: dict, code: str, default: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


ROS_OF = "CAST(" + _case(ROS, "fuel_model", "0.0") + " AS DOUBLE)"
TMAX_C, TMAX_F = "(tmmx - 273.15::DOUBLE)", "((tmmx - 273.15::DOUBLE) * 9.0::DOUBLE / 5.0::DOUBLE + 32.0::DOUBLE)"
STREAM = f"(vs * 2.237::DOUBLE > 25.0 AND rmin < 15.0 AND {TMAX_F} > 85.0)"
GENERATOR = f"((vs > 10.0 OR rmin < 15.0 OR {TMAX_C} > 35.0::DOUBLE) AND month(day) BETWEEN 9 AND 12)"
HIGH = "(vs > 15.0 AND month(day) BETWEEN 9 AND 12)"
FIRE = "month(day) BETWEEN 6 AND 10"
CLAMP = "least(greatest({}, 0.0::DOUBLE), 1.0::DOUBLE)"
SIZE = "(CAST(gis_acres > 100 AS INTEGER) + CAST(gis_acres > 1000 AS INTEGER) + CAST(gis_acres > 10000 AS INTEGER))"


def _split(source: str, stratify: bool = True) -> str:
    c = SIZE if stratify else "0"
    q = "greatest(1, floor(greatest(1, floor(t * 0.3::DOUBLE)) * n / t))" if stratify else "greatest(1, floor(t * 0.3::DOUBLE))"
    return f"""f0 AS (SELECT *, {c} AS c, {uniform_sql('holdout', 'fire_id')} AS u FROM {source}),
f1 AS (SELECT *, count(*) OVER (PARTITION BY year_, c) AS n, count(*) OVER (PARTITION BY year_) AS t, row_number() OVER (PARTITION BY year_, c ORDER BY u, fire_id) AS k FROM f0),
split AS (SELECT *, k <= {q} AS holdout FROM f1)"""


WORLD_CELLS = f"""cells AS (SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, 0.3::DOUBLE * {uniform_sql('burn', 'r', 'c')} AS burn_probability, 0.0::DOUBLE - (r + 0.5::DOUBLE) * 270.0::DOUBLE AS northing FROM (SELECT unnest(range(CAST({ROWS_SQL} AS BIGINT))) AS r) AS a, range(50) AS b(c))"""
TOUCH = """touch AS (SELECT p.*, k."row", k.col, k.burn_probability, k.northing FROM parcels p JOIN cells k ON k.col BETWEEN CAST(floor(minx / 270.0::DOUBLE) AS INTEGER) AND CAST(floor(maxx / 270.0::DOUBLE) AS INTEGER)
 AND k."row" BETWEEN CAST(floor((0.0::DOUBLE - maxy) / 270.0::DOUBLE) AS INTEGER) AND CAST(floor((0.0::DOUBLE - miny) / 270.0::DOUBLE) AS INTEGER))"""
ZONAL = """zs AS (SELECT apn, avg(burn_probability) AS mean, max(burn_probability) AS mx, min(burn_probability) AS mn, stddev_pop(burn_probability) AS sd, quantile_cont(burn_probability, 0.5) AS med, count(*) AS n FROM touch GROUP BY 1),
zonal AS (SELECT apn, county, round(coalesce(mean, 0.0::DOUBLE), 6) AS burn_prob_mean, round(coalesce(mx, 0.0::DOUBLE), 6) AS burn_prob_max, round(mn, 6) AS burn_prob_min, round(sd, 6) AS burn_prob_std, round(med, 6) AS burn_prob_median, coalesce(n, 0) AS n_cells FROM parcels LEFT JOIN zs USING (apn))"""
RANK = "CASE haz_class WHEN 'Very High' THEN 3 WHEN 'High' THEN 2 WHEN 'Moderate' THEN 1 ELSE 0 END"
MEETS = "a.minx <= b.maxx AND a.maxx >= b.minx AND a.miny <= b.maxy AND a.maxy >= b.miny"
HAZARD = f"""hz AS (SELECT a.apn, b.haz_class, b.zone_id, {RANK} AS r, row_number() OVER (PARTITION BY a.apn ORDER BY {RANK} DESC, b.zone_id) AS k FROM parcels a JOIN zones b ON {MEETS}),
hazard AS (SELECT apn, haz_class AS fhsz, zone_id, coalesce(r, 0) AS hazard_rank FROM parcels LEFT JOIN (SELECT * FROM hz WHERE k = 1) USING (apn))"""
INSIDE = """mask AS (SELECT DISTINCT k."row", k.col FROM fires f JOIN cells k ON (k.col + 0.5::DOUBLE) * 270.0::DOUBLE BETWEEN f.minx AND f.maxx AND 0.0::DOUBLE - (k."row" + 0.5::DOUBLE) * 270.0::DOUBLE BETWEEN f.miny AND f.maxy WHERE {})"""


def _bilinear() -> str:
    corners = "\nUNION ALL ".join(f'SELECT r, c, least(greatest(CAST(floor(fy) AS INTEGER) + {a}, 0), {ROWS_SQL} - 1) AS sr, least(greatest(CAST(floor(fx) AS INTEGER) + {b}, 0), 49) AS sc, ({"fy - floor(fy)" if a else "1 - (fy - floor(fy))"}) * ({"fx - floor(fx)" if b else "1 - (fx - floor(fx))"}) AS w FROM t' for a in (0, 1) for b in (0, 1))
    return _with(GRID_SQL, f"t AS (SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, ((c + 0.5::DOUBLE) * 540.0::DOUBLE) / 270.0::DOUBLE - 0.5::DOUBLE AS fx, ((r + 0.5::DOUBLE) * 540.0::DOUBLE) / 270.0::DOUBLE - 0.5::DOUBLE AS fy FROM (SELECT unnest(range(CAST({ROWS_SQL} // 2 AS BIGINT))) AS r) AS a, range(25) AS b(c))", f"s AS ({corners})", select='SELECT r AS "row", c AS col, round(sum(w * elevation) / sum(w), 6) AS elevation FROM s JOIN grid g ON g."row" = sr AND g.col = sc GROUP BY 1, 2')


def _poisson() -> str:
    terms = [f"exp(-2.5::DOUBLE) * pow(2.5::DOUBLE, {k}) / {f}" for k, f in zip(range(10), (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880), strict=True)]
    u = uniform_sql("count", "o_orderkey")
    sums = " ".join(f"WHEN {' + '.join(terms[: k + 1])} >= u THEN {k}" for k in range(10))
    return f"WITH d AS (SELECT o_orderkey, {u} AS u FROM orders) SELECT o_orderkey, CASE {sums} ELSE 10 END AS k FROM d"


def _draw(stream: str) -> str:
    return uniform_sql(stream, "strftime(day, '%Y-%m-%d')", "k")


ORACLE_SQL = {
    "calibration_curve": _with(SCORED_SQL, V, BINS, select="SELECT bin, n, round(p, 6) AS mean_prob, round(y, 6) AS mean_label, round(abs(p - y), 6) AS gap FROM b"),
    "reliability_diagram": _with(SCORED_SQL, V, select=f"SELECT {_edges('>')} AS bin, count(*) AS n, round(avg(prob), 6) AS prob_pred, round(avg(label::DOUBLE), 6) AS prob_true FROM v GROUP BY 1"),
    "calibration_error": _with(SCORED_SQL, V, BINS, select="SELECT sum(n)::BIGINT AS n, round(sum(n * abs(p - y)) / sum(n), 6) AS ece, round(max(abs(p - y)), 6) AS mce FROM b"),
    "discrimination": _with(SCORED_SQL, V, _discrimination(), select="SELECT * FROM m"),
    **{
        name: _with(SCORED_SQL, V, BINS, "t AS (SELECT sum(n) AS tn, sum(sy) AS ty, sum(se) AS te, sum(sy) / sum(n)::DOUBLE AS o FROM b)", f"s AS (SELECT max(tn) AS n, max(o) AS o, max(te / tn) AS brier, sum(n * (sp / n - sy / n::DOUBLE) * (sp / n - sy / n::DOUBLE) / tn) AS rel, sum(n * (sy / n::DOUBLE - o) * (sy / n::DOUBLE - o) / tn) AS res FROM b, t)",
            select=f"SELECT n::BIGINT AS n, round(brier, 8) AS brier, round(1 - brier / (o * (1 - {c}) * (1 - {c}) + (1 - o) * {c} * {c}), 6) AS bss, round(rel, 6) AS reliability, round(res, 6) AS resolution, round(o * (1 - o), 6) AS uncertainty FROM s")
        for name, c in (("skill_scores", "o"), ("skill_against_climatology", "0.3::DOUBLE"))
    },
    "roc_curve": _with(SCORED_SQL, V, CURVE, select="SELECT round(prob, 6) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / nullif(pos, 0)::DOUBLE, 6) AS tpr, round(fp / nullif(total - pos, 0)::DOUBLE, 6) AS fpr FROM c"),
    "pr_curve": _with(SCORED_SQL, V, CURVE, select="SELECT round(prob, 6) AS prob, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / nullif(pos, 0)::DOUBLE, 6) AS recall FROM c"),
    "best_f1": _with(SCORED_SQL, V, CURVE, "f AS (SELECT prob, tp / (tp + fp)::DOUBLE AS p, tp / nullif(pos, 0)::DOUBLE AS r FROM c)", "x AS (SELECT prob, round(2 * p * r / (p + r + 1e-10::DOUBLE), 9) AS f1 FROM f)", select="SELECT round(prob, 6) AS threshold, round(f1, 6) AS f1 FROM x ORDER BY x.f1 DESC, prob LIMIT 1"),
    "confusion": _with(SCORED_SQL, V, select="SELECT count_if(prob >= 0.5 AND label = 1)::BIGINT AS tp, count_if(prob >= 0.5 AND label = 0)::BIGINT AS fp, count_if(prob < 0.5 AND label = 1)::BIGINT AS fn, count_if(prob < 0.5 AND label = 0)::BIGINT AS tn FROM v"),
    "precision_recall_at": _with(SCORED_SQL, V, select=f"SELECT threshold, {_ratio('count_if(prob >= threshold AND label = 1)', 'count_if(prob >= threshold)')} AS precision, {_ratio('count_if(prob >= threshold AND label = 1)', 'count_if(label = 1)')} AS recall FROM v, (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) AS t(threshold) GROUP BY 1"),
    "hindcast": _with(SCORED_BY_DAY_SQL, V, _discrimination("grp"), DAY_BINS, select="SELECT grp, n, n_positive, auc, brier, ece, mce FROM m JOIN e USING (grp)"),
    "hindcast_summary": _with(SCORED_BY_DAY_SQL, V, _discrimination("grp"), DAY_BINS, select="SELECT count(*) AS n_groups, round(avg(auc), 6) AS auc_mean, round(stddev_samp(auc), 6) AS auc_std, round(avg(brier), 6) AS brier_mean, round(stddev_samp(brier), 6) AS brier_std, round(avg(ece), 6) AS ece_mean, round(stddev_samp(ece), 6) AS ece_std FROM m JOIN e USING (grp)"),
    "terrain_derivatives": _with(GRID_SQL, TERRAIN, select='SELECT "row", col, round(slope, 6) AS slope, round(aspect, 6) AS aspect, round(tpi, 6) AS tpi FROM terrain'),
    "landscape_terrain": _with(GRID_SQL, TERRAIN, "x AS (SELECT *, round(slope, 6) AS s, round(aspect, 6) AS a FROM terrain)", select='SELECT "row", col, CAST(trunc(least(greatest(s, 0.0::DOUBLE), 89.0::DOUBLE)) AS INTEGER) AS slope_i, CASE WHEN s < 0.5 THEN -1 ELSE CAST(trunc(a) AS INTEGER) END AS aspect_i FROM x'),
    "fuel_rates": _with(GRID_SQL, select=f'SELECT "row", col, fuel_model, {ROS_OF} AS ros, {_case(CROSSWALK, "fuel_model", "CASE WHEN fuel_model > 0 AND fuel_model < 90 THEN 8 ELSE 0 END")} AS older_model, (fuel_model BETWEEN 1 AND 13 OR fuel_model BETWEEN 101 AND 204) AS burnable FROM grid'),
    "simple_spread_rate": _with(GRID_SQL, TERRAIN, select=f'SELECT "row", col, round({ROS_OF} * 1.5::DOUBLE * least(greatest(1.0::DOUBLE + 2.0::DOUBLE * tan(radians(slope)), 1.0::DOUBLE), 10.0::DOUBLE) / 60.0::DOUBLE, 6) AS rate FROM terrain'),
    "landscape_layers": _with(GRID_SQL, select='SELECT "row", col, CAST(trunc(elevation) AS INTEGER) AS elevation_i, CAST(canopy_cover AS INTEGER) AS cover_i, CAST(trunc(canopy_height * 10.0::DOUBLE) AS INTEGER) AS height_dm FROM grid'),
    "raster_info": _with(GRID_SQL, select='SELECT count(*) AS n_cells, max("row") + 1 AS nrows, max(col) + 1 AS ncols, round(min(elevation) + 0.0, 6) AS min_elevation, round(max(elevation), 6) AS max_elevation FROM grid'),
    "reference_grid": 'SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, round(-200000.0::DOUBLE + (c + 0.5::DOUBLE) * (100000.0::DOUBLE / 37), 6) AS x, round(100000.0::DOUBLE - (r + 0.5::DOUBLE) * (100000.0::DOUBLE / 37), 6) AS y FROM range(37) AS a(r), range(37) AS b(c)',
    "distance_to_roads": _with(GRID_SQL, 'f AS (SELECT "row" AS fr, col AS fc FROM grid WHERE "row" % 17 = 3 AND col % 11 = 5)', select='SELECT "row", col, round(least(sqrt(min(("row" - fr) * ("row" - fr) + (col - fc) * (col - fc))::DOUBLE) * 270.0::DOUBLE, 50000.0::DOUBLE), 6) AS distance FROM grid, f GROUP BY 1, 2'),
    "resample_bilinear": _bilinear(),
    "resample_nearest": _with(GRID_SQL, select=f'SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, round(elevation, 6) AS elevation FROM (SELECT unnest(range(CAST({ROWS_SQL} // 2 AS BIGINT))) AS r) AS a, range(25) AS b(c) LEFT JOIN grid g ON g."row" = CAST(floor((r + 0.5::DOUBLE) * 2) AS INTEGER) AND g.col = CAST(floor((c + 0.5::DOUBLE) * 2) AS INTEGER)'),
    "fuel_mosaic": _with(GRID_SQL, select='SELECT "row", col, CASE WHEN col < 30 THEN fuel_model ELSE fuel_model + 1000 END AS fuel_model, CASE WHEN col < 30 THEN 1 ELSE 2 END AS tile FROM grid'),
    "canopy_layers": _with(GRID_SQL, select='SELECT "row", col, CAST(trunc(canopy_base_height * 10.0::DOUBLE) AS INTEGER) AS base_height_dm, CAST(trunc(canopy_bulk_density * 100.0::DOUBLE) AS INTEGER) AS bulk_density_i FROM grid'),
    "weather_at_points": _with(WEATHER_SQL, WEATHER_CELLS_SQL, PLACES_SQL, "n AS (SELECT id, w.lat, w.lon, row_number() OVER (PARTITION BY id ORDER BY (w.lat - p.lat) * (w.lat - p.lat) + (w.lon - p.lon) * (w.lon - p.lon)) AS k FROM pts p, places w)", select="SELECT p.id, p.day, round(tmmx, 6) AS tmmx, round(vs, 6) AS vs, round(rmin, 6) AS rmin FROM pts p JOIN n ON n.id = p.id AND n.k = 1 LEFT JOIN weather_cells w ON w.day = p.day AND w.lat = n.lat AND w.lon = n.lon"),
    "temporal_split": _with(FIRES_SQL, select="SELECT fire_id, CASE WHEN year(alarm_date) BETWEEN 1995 AND 1997 THEN 'train' ELSE 'test' END AS part FROM fires WHERE year(alarm_date) BETWEEN 1995 AND 1999"),
    "fire_weather_index": _with(WEATHER_SQL, select=f"SELECT day, round(100.0::DOUBLE * (0.3::DOUBLE * {CLAMP.format(f'({TMAX_C} - 10.0::DOUBLE) / 30.0::DOUBLE')} + 0.4::DOUBLE * (1.0::DOUBLE - {CLAMP.format('rmin / 100.0::DOUBLE')}) + 0.3::DOUBLE * least(vs / 15.0::DOUBLE, 1.0::DOUBLE)) * CASE WHEN pr < 1 THEN 1.0::DOUBLE WHEN pr < 5 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END, 6) AS fwi FROM weather"),
    "weather_features": _with(WEATHER_SQL, f"x AS (SELECT *, CASE WHEN tmmx > 100 THEN {TMAX_C} ELSE tmmx END AS t FROM weather)", select="SELECT day, CAST(dayofyear(day) AS INTEGER) AS day_of_year, CAST(isodow(day) - 1 AS INTEGER) AS day_of_week, CAST(month(day) AS INTEGER) AS month, CAST((month(day) % 12) // 3 AS INTEGER) AS season, CAST(isodow(day) >= 6 AS INTEGER) AS is_weekend, round(6.112::DOUBLE * exp(17.67::DOUBLE * t / (t + 243.5::DOUBLE)) * (1.0::DOUBLE - rmin / 100.0::DOUBLE), 6) AS vpd, round(greatest(t - 10.0::DOUBLE, 0.0::DOUBLE) * (100.0::DOUBLE - rmin) * (1.0::DOUBLE + vs / 10.0::DOUBLE) / 1000.0::DOUBLE, 6) AS fwi FROM x"),
    "extreme_days": _with(WEATHER_SQL, select=f"SELECT day, {STREAM} AS stream, {GENERATOR} AS generator, {HIGH} AS high_wind FROM weather"),
    "extreme_by_quantile": _with(WEATHER_SQL, f"x AS (SELECT day, vs, tmmx, rmin * 0.2::DOUBLE + vs * -1.0::DOUBLE AS rmin FROM weather WHERE {FIRE})", "q AS (SELECT quantile_cont(vs, 0.95) AS qv, quantile_cont(rmin, 0.05) AS qr, quantile_cont(tmmx, 0.90) AS qt FROM x)", select="SELECT day, round(vs, 6) AS vs, round(tmmx, 6) AS tmmx FROM x, q WHERE vs > qv AND rmin < qr AND tmmx > qt"),
    "santa_ana_days": _with(WEATHER_SQL, select="SELECT day, round(vs, 6) AS vs, round(rmin, 6) AS rmin, round(th, 6) AS th FROM weather WHERE vs > 10 AND rmin < 20 AND th > 45 AND th < 135"),
    "days_since_rain": _with(WEATHER_SQL, select="SELECT w.day, CAST(coalesce(w.day - max(p.day), 90) AS INTEGER) AS days_since_rain FROM weather w LEFT JOIN weather p ON p.pr >= 2.54 AND p.day <= w.day AND w.day - p.day <= 90 GROUP BY w.day"),
    "weather_distribution": _with(WEATHER_SQL, f"x AS (SELECT unnest([{{'variable': 'vs', 'x': vs}}, {{'variable': 'rmin', 'x': rmin}}, {{'variable': 'tmmx', 'x': {TMAX_C}}}, {{'variable': 'erc', 'x': erc}}]) AS s FROM weather WHERE {FIRE})", select="SELECT s.variable, count(*) AS n, round(avg(s.x), 6) AS mean, round(stddev_pop(s.x), 6) AS std, round(quantile_cont(s.x, 0.5), 6) AS p50, round(quantile_cont(s.x, 0.9), 6) AS p90, round(quantile_cont(s.x, 0.95), 6) AS p95, round(quantile_cont(s.x, 0.99), 6) AS p99 FROM x GROUP BY 1"),
    "extreme_summary": _with(WEATHER_SQL, select=f"SELECT count_if({FIRE})::BIGINT AS fire_season_days, count_if({GENERATOR})::BIGINT AS extreme_days, count_if({HIGH})::BIGINT AS high_wind_days, count_if({STREAM})::BIGINT AS stream_days FROM weather"),
    "percentile_scenario": _with(WEATHER_SQL, f"x AS (SELECT * FROM weather WHERE {FIRE})", "q AS (SELECT quantile_cont(erc, 0.95) AS q FROM x)", select="SELECT day, round(erc, 6) AS value, round(q, 6) AS threshold, true AS is_extreme FROM x, q ORDER BY abs(erc - q), day LIMIT 1"),
    "weather_stream": _with(WEATHER_SQL, "d AS (SELECT CAST(i AS INTEGER) AS day_offset, CAST(DATE '1996-07-01' + CAST(i AS INTEGER) AS DATE) AS day FROM range(14) AS t(i))",
        select=f"SELECT day_offset, d.day, round(coalesce({TMAX_F}, 90.0::DOUBLE), 6) AS temp_max_f, round(coalesce((tmmn - 273.15::DOUBLE) * 9.0::DOUBLE / 5.0::DOUBLE + 32.0::DOUBLE, 60.0::DOUBLE), 6) AS temp_min_f, round(coalesce(rmax, 50.0::DOUBLE), 6) AS rh_max, round(coalesce(rmin, 15.0::DOUBLE), 6) AS rh_min, round(coalesce(vs * 2.237::DOUBLE, 15.0::DOUBLE), 6) AS wind_mph, round(coalesce(th, 270.0::DOUBLE), 6) AS wind_direction, round(coalesce(pr / 25.4::DOUBLE, 0.0::DOUBLE), 6) AS precip_in, round(coalesce(erc, 70.0::DOUBLE), 6) AS erc, coalesce({STREAM}, false) AS is_extreme FROM d LEFT JOIN weather w ON w.day = d.day"),
    "fuel_moisture": _with(WEATHER_SQL, select=f"SELECT day, round(greatest(fm100 - 4.0::DOUBLE, 2.0::DOUBLE), 6) AS fm1, round(greatest(fm100 - 2.0::DOUBLE, 3.0::DOUBLE), 6) AS fm10, round(fm100, 6) AS fm100, CASE WHEN {STREAM} THEN 60 ELSE 80 END AS live_herb, CASE WHEN {STREAM} THEN 80 ELSE 100 END AS live_woody FROM weather"),
    "sampled_scenarios": _with(WEATHER_SQL, f"pools AS (SELECT 1 AS pool, day, row_number() OVER (ORDER BY day) - 1 AS k, count(*) OVER () AS size FROM weather WHERE {GENERATOR} UNION ALL SELECT 0, day, row_number() OVER (ORDER BY day) - 1, count(*) OVER () FROM weather WHERE {FIRE})", f"draws AS (SELECT i AS scenario_id, CASE WHEN i < 150 THEN 1 ELSE 0 END AS pool, {uniform_sql('scenario', 'i')} AS u FROM range(1000) AS t(i))",
        select="SELECT scenario_id, day, p.pool = 1 AS is_extreme FROM draws d JOIN pools p ON p.pool = d.pool AND p.k = floor(u * size)"),
    "holdout_split": _with(FIRES_SQL, _split("fires"), select="SELECT fire_id, year_, holdout FROM split"),
    "holdout_plain": _with(FIRES_SQL, _split("fires", False), select="SELECT fire_id, year_, holdout FROM split"),
    "holdout_set": _with(FIRES_SQL, "near AS (SELECT * FROM fires WHERE year_ BETWEEN 1998 AND 2000)", _split("near"), select="SELECT fire_id, year_, CASE WHEN holdout THEN 'holdout' ELSE 'neither' END AS part FROM split UNION ALL SELECT fire_id, year_, 'train' FROM fires WHERE NOT year_ BETWEEN 1998 AND 2000"),
    "holdout_statistics": _with(FIRES_SQL, _split("fires"), select="SELECT count_if(NOT holdout)::BIGINT AS n_train, count_if(holdout)::BIGINT AS n_holdout, round(count_if(holdout) / count(*)::DOUBLE, 6) AS fraction, round(avg(gis_acres) FILTER (NOT holdout), 3) AS train_mean_acres, round(avg(gis_acres) FILTER (holdout), 3) AS holdout_mean_acres, round(sum(gis_acres) FILTER (holdout), 1) AS holdout_acres, array_to_string(list_sort(list(DISTINCT year_) FILTER (holdout)), ',') AS holdout_years FROM split"),
    "holdout_balance": _with(FIRES_SQL, _split("fires"), "m AS (SELECT quantile_cont(gis_acres, 0.5) FILTER (NOT holdout) AS a, quantile_cont(gis_acres, 0.5) FILTER (holdout) AS b, (SELECT count(*) FROM (SELECT DISTINCT year_ FROM split WHERE holdout EXCEPT SELECT DISTINCT year_ FROM split WHERE NOT holdout)) AS x FROM split)", select="SELECT round(a, 6) AS train_median, round(b, 6) AS holdout_median, CAST(x AS INTEGER) AS missing_years, abs(b - a) <= 0.5::DOUBLE * a AND x = 0 AS balanced FROM m"),
    "zonal_statistics": _with(PARCELS_SQL, WORLD_CELLS, TOUCH, ZONAL, select="SELECT * FROM zonal"),
    "multi_raster_statistics": _with(PARCELS_SQL, WORLD_CELLS, TOUCH, select="SELECT p.apn, round(avg(burn_probability), 6) AS burn_probability_mean, round(max(burn_probability), 6) AS burn_probability_max, round(avg(northing), 6) AS northing_mean, round(max(northing), 6) AS northing_max FROM parcels p LEFT JOIN touch t ON t.apn = p.apn GROUP BY 1"),
    "hazard_zones": _with(PARCELS_SQL, ZONES_SQL, HAZARD, select="SELECT apn, fhsz, zone_id, hazard_rank FROM hazard"),
    "burned_parcels": _with(PARCELS_SQL, FIRES_SQL, select=f"SELECT a.apn, EXISTS (SELECT 1 FROM fires b WHERE b.year_ = 1997 AND {MEETS}) AS actually_burned FROM parcels a"),
    "parcel_output": _with(PARCELS_SQL, ZONES_SQL, WORLD_CELLS, TOUCH, ZONAL, HAZARD, select="SELECT apn, 2020 AS year, burn_prob_mean, burn_prob_max, burn_prob_std, fhsz, county FROM zonal JOIN hazard USING (apn)"),
    "parcels_by_county": _with(PARCELS_SQL, select="SELECT county, count(*) AS n_parcels FROM parcels GROUP BY 1"),
    "county_summary": _with(PARCELS_SQL, WORLD_CELLS, TOUCH, ZONAL, select="SELECT county, count(*) AS n_parcels, round(avg(burn_prob_mean), 6) AS mean, round(max(burn_prob_max), 6) AS max, count_if(burn_prob_mean > 0)::BIGINT AS n_exposed FROM zonal GROUP BY 1"),
    "burned_mask": _with(FIRES_SQL, WORLD_CELLS, INSIDE.format("true"), select='SELECT "row", col FROM mask'),
    "calibration_factor": _with(FIRES_SQL, WORLD_CELLS, INSIDE.format("f.year_ = 1997"), "o AS (SELECT count(*) / (SELECT count(*) FROM cells)::DOUBLE AS o FROM mask)", "p AS (SELECT sum(burn_probability) / (SELECT count(*) FROM cells)::DOUBLE AS p FROM cells)", "r AS (SELECT o, p, CASE WHEN o > 0 AND o < 1 THEN 1.0::DOUBLE - pow(1.0::DOUBLE - o, 0.125::DOUBLE) ELSE o / 8 END AS a FROM o, p)", select="SELECT round(o, 6) AS observed, round(a, 6) AS annual, round(p, 6) AS predicted, round(CASE WHEN a > 0 AND p > 0 THEN a / p ELSE 1.0::DOUBLE END, 6) AS factor FROM r"),
    "year_validation": _with(PARCELS_SQL, FIRES_SQL, WORLD_CELLS, TOUCH, ZONAL, f"scored AS (SELECT burn_prob_mean AS prob, CAST(EXISTS (SELECT 1 FROM fires b WHERE b.year_ = 1997 AND {MEETS}) AS INTEGER) AS label FROM zonal z JOIN parcels a USING (apn))", V, BINS, _discrimination(), "e AS (SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM b)",
        select="SELECT 1997 AS year, n, n_positive, auc, brier, ece, auc >= 0.8 AS burn_auc_met, ece < 0.05 AS ece_met FROM m, e"),
    "tile_merge": _with(WORLD_CELLS, select='SELECT "row", col, round(CASE WHEN col < 20 THEN burn_probability WHEN col < 30 THEN (burn_probability + burn_probability / 2) / 2 ELSE burn_probability / 2 END, 6) AS burn_probability, CAST(CASE WHEN col BETWEEN 20 AND 29 THEN 2 ELSE 1 END AS BIGINT) AS n_tiles FROM cells'),
    "fuel_at_points": _with(FIRES_SQL, GRID_SQL, select='SELECT fire_id, coalesce(fuel_model, -1) AS value FROM fires LEFT JOIN grid g ON g."row" = CAST(floor((0.0::DOUBLE - (miny + maxy) / 2) / 270.0::DOUBLE) AS INTEGER) AND g.col = CAST(floor(((minx + maxx) / 2) / 270.0::DOUBLE) AS INTEGER)'),
    "ignition_points": _with(FIRES_SQL, GRID_SQL, f"t0 AS (SELECT fire_id, k, CASE WHEN k = 0 THEN (minx + maxx) / 2 ELSE minx + (maxx - minx) * {uniform_sql('ix', 'fire_id', 'k')} END AS x, CASE WHEN k = 0 THEN (miny + maxy) / 2 ELSE miny + (maxy - miny) * {uniform_sql('iy', 'fire_id', 'k')} END AS y FROM fires, range(51) AS r(k))",
        """t AS (SELECT t0.*, row_number() OVER (PARTITION BY fire_id ORDER BY k) AS n FROM t0 JOIN grid g ON g."row" = CAST(floor((0.0::DOUBLE - y) / 270.0::DOUBLE) AS INTEGER) AND g.col = CAST(floor(x / 270.0::DOUBLE) AS INTEGER) WHERE fuel_model BETWEEN 101 AND 204)""", select="SELECT fire_id, round(x, 6) AS x, round(y, 6) AS y FROM t WHERE n = 1"),
    "clipped_fuels": _with(GRID_SQL, ZONES_SQL, select='SELECT "row", col, fuel_model FROM grid k WHERE EXISTS (SELECT 1 FROM zones f WHERE (k.col + 0.5::DOUBLE) * 270.0::DOUBLE BETWEEN f.minx AND f.maxx AND 0.0::DOUBLE - (k."row" + 0.5::DOUBLE) * 270.0::DOUBLE BETWEEN f.miny AND f.maxy)'),
    "common_bounds": _with(FIRES_SQL, select="SELECT round(max(minx), 6) AS minx, round(max(miny), 6) AS miny, round(min(maxx), 6) AS maxx, round(min(maxy), 6) AS maxy FROM fires"),
    "quadkey_bounds": """WITH k AS (SELECT n_nationkey, '0230' || CASE WHEN n_nationkey >= 16 THEN CAST(n_nationkey // 16 AS VARCHAR) ELSE '' END || CASE WHEN n_nationkey >= 4 THEN CAST((n_nationkey // 4) % 4 AS VARCHAR) ELSE '' END || CAST(n_nationkey % 4 AS VARCHAR) AS q FROM nation),
d AS (SELECT n_nationkey, length(q) AS l, unnest(range(length(q))) AS i, CAST(unnest(string_split(q, '')) AS INTEGER) AS v FROM k),
t AS (SELECT n_nationkey, pow(2.0::DOUBLE, max(l)) AS n, sum((v % 2) * pow(2.0::DOUBLE, l - 1 - i)) AS x, sum((v // 2) * pow(2.0::DOUBLE, l - 1 - i)) AS y FROM d GROUP BY 1),
a AS (SELECT *, 3.141592653589793::DOUBLE * (1.0::DOUBLE - 2.0::DOUBLE * y / n) AS up, 3.141592653589793::DOUBLE * (1.0::DOUBLE - 2.0::DOUBLE * (y + 1) / n) AS low FROM t)
SELECT n_nationkey, round(x / n * 360.0::DOUBLE - 180.0::DOUBLE, 6) AS west, round(degrees(atan((exp(low) - exp(-low)) / 2)), 6) AS south, round((x + 1) / n * 360.0::DOUBLE - 180.0::DOUBLE, 6) AS east, round(degrees(atan((exp(up) - exp(-up)) / 2)), 6) AS north FROM a""",
    "training_set": _with(GRID_SQL, TERRAIN, WEATHER_SQL, FIRES_SQL, 'pos AS (SELECT CAST(floor((0.0::DOUBLE - (miny + maxy) / 2) / 270.0::DOUBLE) AS INTEGER) AS "row", CAST(floor(((minx + maxx) / 2) / 270.0::DOUBLE) AS INTEGER) AS col, alarm_date AS day FROM fires)',
        'size AS (SELECT max("row") + 1 AS nr, max(col) + 1 AS nc FROM grid)', f"tries AS (SELECT day, k, CAST(floor({_draw('row')} * nr) AS INTEGER) AS \"row\", CAST(floor({_draw('col')} * nc) AS INTEGER) AS col FROM weather, range(1, 21) AS r(k), size)",
        'hits AS (SELECT day, t."row", t.col, min(k) AS k FROM tries t JOIN grid g ON g."row" = t."row" AND g.col = t.col WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p."row" = t."row" AND p.col = t.col) GROUP BY 1, 2, 3)', 'neg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY k) AS n FROM hits) WHERE n <= 2)',
        'both_ AS (SELECT "row", col, day, 1 AS label FROM pos UNION ALL SELECT "row", col, day, 0 FROM neg)',
        select=f'SELECT b."row", b.col, b.day, label, round(elevation, 6) AS elevation, round(slope, 6) AS slope, round(tpi, 6) AS tpi, {ROS_OF} AS ros, canopy_cover, round(tmmx, 6) AS tmmx, round(rmin, 6) AS rmin, round(vs, 6) AS vs, round(erc, 6) AS erc, round(pr, 6) AS pr FROM both_ b JOIN terrain t ON t."row" = b."row" AND t.col = b.col JOIN weather w ON w.day = b.day'),
    "poisson_ignitions": _poisson(),
    "weighted_ignitions": _with(GRID_SQL, f'w AS (SELECT "row", col, ln({uniform_sql("pick", chr(34) + "row" + chr(34), "col")} + 1.1102230246251565e-16::DOUBLE) / {ROS_OF} AS k FROM grid WHERE {ROS_OF} > 0)', 'n AS (SELECT *, row_number() OVER (PARTITION BY "row" ORDER BY k DESC, col) AS i FROM w)', select='SELECT "row", col FROM n WHERE i <= 4'),
    "daily_events": "SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM events GROUP BY 1",
    "tiles": "SELECT CAST(t AS INTEGER) AS tile_id, ((t - 1) % 8) * 100000.0::DOUBLE - 10000.0::DOUBLE AS minx, ((t - 1) // 8) * 100000.0::DOUBLE - 10000.0::DOUBLE AS miny, ((t - 1) % 8) * 100000.0::DOUBLE + 110000.0::DOUBLE AS maxx, ((t - 1) // 8) * 100000.0::DOUBLE + 110000.0::DOUBLE AS maxy FROM range(1, 57) AS r(t)",
}
