"""Queries over the driver's tables, by name, with SQL that DuckDB can run where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..operators import invert as V
from ..operators import network as N
from ..operators import optimise as O
from ..operators import outliers as X
from ..operators import quality as Q
from ..operators import seasonality as S
from ..operators import select as P
from ..operators import series as R
from ..sources import loaders as L
from ..streaming import acquisitions as A
from . import bridge
from .bridge import SQL as OBS

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
DIGITS = 4


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to a few digits and without negative zero, so that two engines agree."""
    return df.select(*[(F.round(F.col(f"`{f.name}`"), DIGITS) + 0.0).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def add(name: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None, source=bridge.obs, ctes: str = OBS) -> None:
    """A query on the observations; sql: a SELECT over obs (r(x) rounds), or None."""
    _queries[name] = lambda spark, sf_dir: rounded(run(source(spark, sf_dir)))
    if sql is not None:
        _sql[name] = f"WITH {ctes} {expand(sql)}" if not sql.lstrip().startswith(",") else f"WITH {ctes}{expand(sql)}"


def expand(sql: str) -> str:
    """r(e) in the texts below is a rounded expression."""
    out, i = "", 0
    while (at := sql.find("r(", i)) >= 0:
        if at and (sql[at - 1].isalnum() or sql[at - 1] == "_"):
            out, i = out + sql[i : at + 2], at + 2
            continue
        depth, j = 1, at + 2
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out, i = out + sql[i:at] + f"(round({expand(sql[at + 2 : j - 1])}, {DIGITS}) + 0.0)", j
    return out + sql[i:]


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


KEYS = "x, y, date1, date2"
ROW = f"{KEYS}, sensor, r(vx) AS vx, r(vy) AS vy"
rows = lambda df, *more: df.select("x", "y", "date1", "date2", "sensor", "vx", "vy", *more)

# ---- standardisation -----------------------------------------------------------------------------------------------------
add("std_generic", lambda d: rows(d, "errorx", "errory", "source", "temporal_baseline", "mid_date"), f"SELECT {ROW}, r(errorx) AS errorx, r(errory) AS errory, source, temporal_baseline, mid_date FROM obs")
add("std_sensor_names", lambda d: d.groupBy("sensor_raw").agg(F.first(L.sensor_name("sensor_raw")).alias("sensor"), F.count("*").alias("n")), "SELECT sensor_raw, CASE trim(sensor_raw) WHEN 'L8' THEN 'Landsat-8' WHEN 'S2A' THEN 'Sentinel-2' ELSE 'Sentinel-1' END AS sensor, count(*) AS n FROM raw GROUP BY 1, 2", source=bridge.raw)
add("std_confidence", lambda d: L.error_to_confidence(d, "errorx", "confidence").select("x", "y", "date1", "date2", "errorx", "confidence"), f"SELECT {KEYS}, r(errorx) AS errorx, r(1 - (errorx - (SELECT min(errorx) FROM obs)) / ((SELECT max(errorx) FROM obs) - (SELECT min(errorx) FROM obs))) AS confidence FROM obs")
add(
    "std_itslive",
    lambda d: L.load(d.select("x", "y", F.lit(" L").alias("mission_img1"), F.lit("8 ").alias("satellite_img1"), F.col("errorx").alias("vx_error"), F.col("errory").alias("vy_error"), F.col("date1").cast("timestamp_ntz").alias("acquisition_date_img1"), F.col("date2").cast("timestamp_ntz").alias("acquisition_date_img2"), "vx", "vy"), "ITS_LIVE").select("x", "y", "date1", "date2", "sensor", "source", "errorx", "vx"),
    f"SELECT {KEYS}, 'Landsat-8' AS sensor, 'ITS_LIVE' AS source, r(errorx) AS errorx, r(vx) AS vx FROM obs",
    source=bridge.raw,
)
add("std_mjd_dates", lambda d: L.load(d.withColumns({"date1": L.date_to_mjd("date1"), "date2": L.date_to_mjd("date2"), "error_vx": F.col("errorx"), "error_vy": F.col("errory"), "sensor": F.col("sensor_raw")}), "IGE_MJD").select("x", "y", "date1", "date2", L.date_to_mjd("date1").alias("mjd1"), "mid_date"), f"SELECT {KEYS}, date_diff('day', DATE '1858-11-17', date1) AS mjd1, mid_date FROM obs", source=bridge.raw)
add("std_split_dates_flip_vy", lambda d: L.load(d.select("x", "y", F.concat_ws(" ", "date1", "date2").alias("time"), "vx", "vy"), "IGE_TEXT").select("x", "y", "date1", "date2", "vy", "sensor", "errorx"), f"SELECT {KEYS}, r(-vy) AS vy, 'Pleiades' AS sensor, 1.0::DOUBLE AS errorx FROM obs", source=bridge.raw)
add("std_regular_result", lambda d: L.load(d.select("x", "y", "date1", "date2", "vx", "vy"), "IGE").select("x", "y", "date1", "date2", "vx", "errorx", "sensor", "source"), f"SELECT {KEYS}, r(vx) AS vx, 1.0::DOUBLE AS errorx, 'Unknown' AS sensor, 'Unknown' AS source FROM obs", source=bridge.raw)
add("temporal_baseline", lambda d: d.select("x", "y", "date1", "date2", F.datediff("date2", "date1").alias("days")), f"SELECT {KEYS}, date_diff('day', date1, date2) AS days FROM obs")
add("central_date", lambda d: d.select("x", "y", "date1", "date2", L.central_date().alias("datec")), f"SELECT {KEYS}, CAST(date1 + (date_diff('day', date1, date2) // 2)::INTEGER AS DATE) AS datec FROM obs")
add("magnitude", lambda d: d.select("x", "y", "date1", "date2", X.speed().alias("vv")), f"SELECT {KEYS}, r(sqrt(vx*vx + vy*vy)) AS vv FROM obs")
add("displacement", lambda d: d.select("x", "y", "date1", "date2", *[(F.col(f"v{c}") * F.col("temporal_baseline") / 365).alias(f"d{c}") for c in "xy"]), f"SELECT {KEYS}, r(vx*temporal_baseline/365) AS dx, r(vy*temporal_baseline/365) AS dy FROM obs")
add("unit_conversion", lambda d: d.select("x", "y", "date1", "date2", (F.col("vx") / 365).alias("vx_day")), f"SELECT {KEYS}, r(vx/365) AS vx_day FROM obs")
add("direction", lambda d: d.select("x", "y", "date1", "date2", F.pmod(F.degrees(F.atan2("vy", "vx")) + 360, F.lit(360.0)).alias("direction")), f"SELECT {KEYS}, r((degrees(atan2(vy, vx)) + 360) % 360) AS direction FROM obs")
add("azimuth", lambda d: d.select("x", "y", "date1", "date2", X.azimuth().alias("azimuth")), f"SELECT {KEYS}, r((degrees(atan2(vx, vy)) + 360) % 360) AS azimuth FROM obs")
add("axis_limits", lambda d: d.agg(*[f(c).cast("int").alias(f"{n}_{c}") for c in ("vx", "vy") for n, f in (("min", F.min), ("max", F.max))]), "SELECT trunc(min(vx))::INTEGER AS min_vx, trunc(max(vx))::INTEGER AS max_vx, trunc(min(vy))::INTEGER AS min_vy, trunc(max(vy))::INTEGER AS max_vy FROM obs")
add("dimensions", lambda d: d.agg(F.count_distinct("x").alias("nx"), F.count_distinct("y").alias("ny"), F.count_distinct("mid_date").alias("nz")), "SELECT count(DISTINCT x) AS nx, count(DISTINCT y) AS ny, count(DISTINCT mid_date) AS nz FROM obs")
add("provenance", L.provenance, "SELECT (SELECT string_agg(s, ', ' ORDER BY s) FROM (SELECT DISTINCT sensor AS s FROM obs)) AS sensors, (SELECT string_agg(s, ', ' ORDER BY s) FROM (SELECT DISTINCT source AS s FROM obs)) AS sources, count(*) AS n_obs FROM obs")
add("vector_error", lambda d: Q.vector_error(d).select("x", "y", "date1", "date2", "error_v"), f"SELECT {KEYS}, r(sqrt(pow(vx/sqrt(vx*vx+vy*vy)*errorx, 2) + pow(vy/sqrt(vx*vx+vy*vy)*errory, 2))) AS error_v FROM obs")

# ---- selection -------------------------------------------------------------------------------------------------------------
add("subset_bbox", lambda d: rows(P.subset(d, 500100, 500400, 4999700, 4999900)), f"SELECT {ROW} FROM obs WHERE x BETWEEN 500100 AND 500400 AND y BETWEEN 4999700 AND 4999900")
add("buffer_pixels", lambda d: rows(P.buffer_pixels(d, 3, 2, 2)), f"SELECT {ROW} FROM obs WHERE xi >= 1 AND xi < 5 AND yi >= 0 AND yi < 4")
add("buffer_point", lambda d: rows(P.buffer_point(d, 500300, 4999800, 150)), f"SELECT {ROW} FROM obs WHERE x BETWEEN 500150 AND 500450 AND y BETWEEN 4999650 AND 4999950")
add("pick_date", lambda d: rows(P.pick_date(d, "1996-01-01", "1998-12-31")), f"SELECT {ROW} FROM obs WHERE date1 >= DATE '1996-01-01' AND date2 <= DATE '1998-12-31'")
add("pick_sensor", lambda d: rows(P.pick_sensor(d, ["Landsat-8", "Sentinel-1"])), f"SELECT {ROW} FROM obs WHERE sensor IN ('Landsat-8', 'Sentinel-1')")
add("pick_baseline", lambda d: rows(P.pick_baseline(d, 24, 96)), f"SELECT {ROW} FROM obs WHERE temporal_baseline BETWEEN 24 AND 96")
add("mask_rectangle", lambda d: rows(P.mask_polygon(d, [(500050, 4999550), (500350, 4999550), (500350, 4999950), (500050, 4999950)])), f"SELECT {ROW} FROM obs WHERE x > 500050 AND x < 500350 AND y > 4999550 AND y < 4999950")
add("mask_polygon", lambda d: rows(P.mask_polygon(d, [(499950, 4999550), (500750, 4999550), (499950, 5000050)], invert=True)), f"SELECT {ROW} FROM obs WHERE NOT (x > 499950 AND y > 4999550 AND (x - 499950) / 800.0 + (y - 4999550) / 500.0 < 1)")
add("zero_mask", lambda d: rows(L.mask_zero(d.withColumn("vx", F.when(F.col("temporal_baseline") == 24, 0.0).otherwise(F.col("vx"))))), f"SELECT {KEYS}, sensor, r(CASE WHEN temporal_baseline = 24 OR vx = 0 OR vy = 0 THEN NULL ELSE vx END) AS vx, r(CASE WHEN temporal_baseline = 24 OR vx = 0 OR vy = 0 THEN NULL ELSE vy END) AS vy FROM obs")
add("dropna_rows", lambda d: rows(P.drop_missing(d)), f"SELECT {ROW} FROM obs WHERE vx IS NOT NULL AND vy IS NOT NULL")
add("nearest_pixel", lambda d: rows(P.nearest_pixel(d, 500234.0, 4999812.0)), f"SELECT {ROW} FROM obs WHERE x = 500200 AND y = 4999800")
add("bilinear_pixel", lambda d: P.bilinear_pixel(d.where("vx is not null").groupBy("x", "y", "date1").agg(F.avg("vx").alias("vx")), 500230.0, 4999840.0, 100.0, ["date1"], ["vx"]), ", c AS (SELECT x, y, date1, avg(vx) AS vx FROM obs WHERE vx IS NOT NULL GROUP BY ALL), w AS (SELECT *, (1 - abs(x - 500230)/100) * (1 - abs(y - 4999840)/100) AS w FROM c WHERE abs(x - 500230) < 100 AND abs(y - 4999840) < 100) SELECT date1, count(*) AS corners, r(sum(vx*w)/sum(w)) AS vx FROM w GROUP BY date1")

# ---- outliers ---------------------------------------------------------------------------------------------------------------
VV = "sqrt(vx*vx + vy*vy)"
WIN = "OVER (PARTITION BY x, y)"
flags = lambda d: d.select("x", "y", "date1", "date2", "sensor", "vx", "inlier")
STATS = f""", a AS (SELECT *, {VV} AS vv, median(vx) {WIN} AS mx, median(vy) {WIN} AS my FROM obs),
s AS (SELECT *, median(abs(vx - mx)) {WIN} AS dx, median(abs(vy - my)) {WIN} AS dy, median(vv) {WIN} AS mv, avg(vv) {WIN} AS av, stddev_pop(vv) {WIN} AS sv,
  avg(vx) {WIN} AS ax, stddev_pop(vx) {WIN} AS sx, avg(vy) {WIN} AS ay, stddev_pop(vy) {WIN} AS sy,
  sqrt(pow(coalesce(sum(vx/nullif(vv,0)) {WIN}, 0), 2) + pow(coalesce(sum(vy/nullif(vv,0)) {WIN}, 0), 2)) / count(*) {WIN} AS vvc FROM a),
t AS (SELECT *, median(abs(vv - mv)) {WIN} AS dv, (mx*vx + my*vy) / nullif(sqrt(mx*mx + my*my) * vv, 0) > cos(radians(45)) AS near FROM s) SELECT {KEYS}, sensor, r(vx) AS vx, coalesce(COND, false) AS inlier FROM t"""
for _name, _run, _cond in (
    ("filt_z_score", X.z_score, "abs((vx-ax)/nullif(sx,0)) < 2 AND abs((vy-ay)/nullif(sy,0)) < 2"),
    ("filt_mz_score", X.mz_score, "abs(0.6745*(vx-mx)/nullif(dx,0)) < 3.5 AND abs(0.6745*(vy-my)/nullif(dy,0)) < 3.5"),
    ("filt_magnitude", lambda d: X.magnitude(d, 800.0), "vv < 800"),
    ("filt_median_magnitude", X.median_magnitude, "vv > mv/3 AND vv < mv*3"),
    ("filt_median_angle", X.median_angle, "CASE WHEN sqrt(mx*mx + my*my) > 10 THEN near ELSE abs((vv-av)/nullif(sv,0)) < 3 END"),
    ("filt_vvc_angle", X.vvc_angle, "CASE WHEN vvc > 0.3 THEN near ELSE abs((vv-av)/nullif(sv,0)) < 2 END"),
    ("filt_vvc_angle_mzscore", lambda d: X.vvc_angle_mz(d, vvc=0.99), "CASE WHEN vvc > 0.99 THEN near ELSE abs(0.6745*(vv-mv)/nullif(dv,0)) < 3.5 END"),
    ("filt_error", lambda d: X.error(d, 8.5), "errorx < 8.5 AND errory < 8.5"),
):
    add(_name, lambda d, f=_run: flags(f(d)), STATS.replace("COND", _cond))
add("filt_flow_angle", lambda d: flags(X.flow_angle(d, Q.flow_direction(d))), f", m AS (SELECT x, y, sum(vx*temporal_baseline)/sum(temporal_baseline) AS fx, sum(vy*temporal_baseline)/sum(temporal_baseline) AS fy FROM obs GROUP BY x, y), d AS (SELECT x, y, (degrees(atan2(fx, fy)) + 360) % 360 AS direction FROM m WHERE sqrt(fx*fx+fy*fy) >= 1) SELECT x, y, date1, date2, sensor, r(vx) AS vx, coalesce(abs((((degrees(atan2(vx, vy)) + 360) % 360 - direction + 180) % 360 + 360) % 360 - 180) < 45, false) AS inlier FROM obs JOIN d USING (x, y)")
add("filt_chain", lambda d: rows(X.delete_outliers(d, {"magnitude": 800.0, "mz_score": 3.0})), f", a AS (SELECT * REPLACE (CASE WHEN {VV} < 800 THEN vx END AS vx, CASE WHEN {VV} < 800 THEN vy END AS vy) FROM obs), b AS (SELECT *, median(vx) {WIN} AS mx, median(vy) {WIN} AS my FROM a), c AS (SELECT *, abs(0.6745*(vx-mx)/nullif(median(abs(vx-mx)) {WIN}, 0)) < 3 AND abs(0.6745*(vy-my)/nullif(median(abs(vy-my)) {WIN}, 0)) < 3 AS ok FROM b) SELECT {KEYS}, sensor, r(CASE WHEN ok THEN vx END) AS vx, r(CASE WHEN ok THEN vy END) AS vy FROM c")
add("baseline_widening", lambda d: X.widen_baseline(d, start=60, step=12, most=300), ", e AS (SELECT x, y, count(DISTINCT d) - 1 AS k FROM (SELECT x, y, date1 AS d FROM obs UNION ALL SELECT x, y, date2 FROM obs) GROUP BY x, y), c AS (SELECT o.x, o.y, b.baseline, count(*) AS n FROM obs o, (SELECT unnest(generate_series(60, 300, 12)) AS baseline) b WHERE o.vx IS NOT NULL AND o.temporal_baseline < b.baseline GROUP BY ALL) SELECT e.x, e.y, coalesce(min(c.baseline), 300)::INTEGER AS baseline FROM e LEFT JOIN c ON e.x = c.x AND e.y = c.y AND c.n >= 3 * e.k GROUP BY e.x, e.y")

# ---- network ------------------------------------------------------------------------------------------------------------------
EPOCHS = ", dd AS (SELECT DISTINCT x, y, d FROM (SELECT x, y, date1 AS d FROM obs UNION ALL SELECT x, y, date2 FROM obs)), ee AS (SELECT x, y, row_number() OVER w - 1 AS k, d AS e_start, lead(d) OVER w AS e_end FROM dd WINDOW w AS (PARTITION BY x, y ORDER BY d)), epochs AS (SELECT *, date_diff('day', e_start, e_end) AS delta FROM ee WHERE e_end IS NOT NULL)"
add("epochs", N.epochs, EPOCHS + " SELECT x, y, k::INTEGER AS k, e_start, e_end, delta FROM epochs")
add("obs_rank_range", lambda d: N.rank_ranges(d).select("x", "y", "date1", "date2", "lo", "hi"), EPOCHS + ", rk AS (SELECT x, y, d, row_number() OVER (PARTITION BY x, y ORDER BY d) - 1 AS r FROM dd) SELECT o.x, o.y, o.date1, o.date2, a.r::INTEGER AS lo, b.r::INTEGER AS hi FROM obs o JOIN rk a ON o.x = a.x AND o.y = a.y AND o.date1 = a.d JOIN rk b ON o.x = b.x AND o.y = b.y AND o.date2 = b.d")
add("design_matrix", lambda d: N.design_matrix(d).groupBy("x", "y", "k").agg(F.count("*").alias("n_obs"), F.sum("temporal_baseline").alias("days")), EPOCHS + " SELECT e.x, e.y, e.k::INTEGER AS k, count(*) AS n_obs, sum(temporal_baseline)::BIGINT AS days FROM obs o JOIN epochs e ON o.x = e.x AND o.y = e.y AND e.e_start >= o.date1 AND e.e_end <= o.date2 GROUP BY e.x, e.y, e.k")
W0 = f", w AS (SELECT *, CASE WHEN temporal_baseline > 180 THEN 0 ELSE 1 END * CASE WHEN max(errorx) {WIN} = min(errorx) {WIN} THEN 1 ELSE 1 - (errorx - min(errorx) {WIN}) / nullif(max(errorx) {WIN} - min(errorx) {WIN}, 0) END AS w FROM obs)"
add("weights_initial", lambda d: N.initial_weights(d).select("x", "y", "date1", "date2", "errorx", "w"), W0 + f" SELECT {KEYS}, r(errorx) AS errorx, r(w) AS w FROM w")
add("tukey_weights", lambda d: N.tukey_weights(d.where("vx is not null").withColumn("r", F.col("vx") - 120)).select("x", "y", "date1", "date2", "vx", "w"), f", a AS (SELECT *, vx - 120 AS q, median(vx - 120) {WIN} AS m FROM obs WHERE vx IS NOT NULL), b AS (SELECT *, median(abs(q - m)) {WIN} / 0.6745 AS s FROM a) SELECT {KEYS}, r(vx) AS vx, r(CASE WHEN s = 0 THEN 1 WHEN abs(q/s) <= 4.685 THEN pow(1 - pow(q/s/4.685, 2), 2) ELSE 0 END) AS w FROM b")
add("x_contribution", lambda d: N.contributions(N.initial_weights(d)), EPOCHS + W0 + " SELECT e.x, e.y, e.k::INTEGER AS k, r(coalesce(sum(w.w), 0)) AS xcount FROM epochs e LEFT JOIN w ON w.x = e.x AND w.y = e.y AND e.e_start >= w.date1 AND e.e_end <= w.date2 GROUP BY e.x, e.y, e.k")
RATES = EPOCHS.replace("FROM obs", "FROM obs WHERE vx IS NOT NULL AND vy IS NOT NULL") + ", ilf AS (SELECT e.x, e.y, e.k::INTEGER AS k, e.e_start AS date1, e.e_end AS date2, e.delta, avg(vx)*e.delta/365 AS result_dx, avg(vy)*e.delta/365 AS result_dy FROM epochs e JOIN obs o ON o.vx IS NOT NULL AND o.vy IS NOT NULL AND o.x = e.x AND o.y = e.y AND e.e_start >= o.date1 AND e.e_end <= o.date2 GROUP BY e.x, e.y, e.k, e.e_start, e.e_end, e.delta)"


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quick estimate of the inverted series that SQL can make as well."""
    return N.mean_rates(bridge.obs(spark, sf_dir))


def add_rates(name: str, run, sql: str | None) -> None:
    add(name, run, sql and RATES + sql, source=rates)


add_rates("mean_rates", lambda d: d.select("x", "y", "k", "date1", "date2", "result_dx", "result_dy"), " SELECT x, y, k, date1, date2, r(result_dx) AS result_dx, r(result_dy) AS result_dy FROM ilf")
add_rates("reg_first_order_rows", lambda d: N.first_order(d, "result_dx"), ", q AS (SELECT x, y, k, lead(result_dx/delta) OVER w - result_dx/delta AS v FROM ilf WINDOW w AS (PARTITION BY x, y ORDER BY k)) SELECT x, y, k, r(v) AS row FROM q WHERE v IS NOT NULL")
add_rates("reg_second_order_rows", lambda d: N.second_order(d, "result_dx"), ", q AS (SELECT x, y, k, lag(result_dx/delta) OVER w - 2*result_dx/delta + lead(result_dx/delta) OVER w AS v FROM ilf WINDOW w AS (PARTITION BY x, y ORDER BY k)) SELECT x, y, k, r(v) AS row FROM q WHERE v IS NOT NULL")
add_rates("acceleration_prior", lambda d: N.acceleration(d.withColumn("v", F.col("result_dx") / F.col("delta")), "v"), ", q AS (SELECT x, y, k, lead(result_dx/delta) OVER w - result_dx/delta AS v FROM ilf WINDOW w AS (PARTITION BY x, y ORDER BY k)) SELECT x, y, k, r(v) AS accel FROM q WHERE v IS NOT NULL")
add_rates("moving_average_dates", lambda d: d.select("x", "y", "k", *[(F.col(f"result_d{c}") * 365 / F.col("delta")).alias(f"v{c}") for c in "xy"]), " SELECT x, y, k, r(result_dx*365/delta) AS vx, r(result_dy*365/delta) AS vy FROM ilf")

# ---- cumulative and regular series ------------------------------------------------------------------------------------------------
CUM = ", cum AS (SELECT x, y, date1, date2, min(date1) OVER (PARTITION BY x, y) AS ref_date, sum(result_dx) OVER (PARTITION BY x, y ORDER BY date2) AS dx, sum(result_dy) OVER (PARTITION BY x, y ORDER BY date2) AS dy FROM ilf)"
add_rates("cumulative", R.cumulative, CUM + " SELECT x, y, ref_date, date2, r(dx) AS dx, r(dy) AS dy FROM cum")
add_rates("cumulative_global_axis", lambda d: R.on_global_axis(R.cumulative(d)), CUM + " SELECT p.x, p.y, a.date2, r(dx) AS dx, r(dy) AS dy FROM (SELECT DISTINCT x, y FROM cum) p CROSS JOIN (SELECT DISTINCT date2 FROM cum) a LEFT JOIN cum c ON c.x = p.x AND c.y = p.y AND c.date2 = a.date2")
add_rates("reference_dates", R.reference_dates, " SELECT x, y, min(date1) AS ref_date FROM ilf GROUP BY x, y")
GRID = ", en AS (SELECT x, y, min(date2) AS a, date_diff('day', min(date2), max(date2)) AS b FROM ilf GROUP BY x, y), gr AS (SELECT x, y, CAST(a + g::INTEGER AS DATE) AS date1, CAST(a + (g + 30)::INTEGER AS DATE) AS date2 FROM (SELECT x, y, a, unnest(generate_series(5, b - 31, 5)) AS g FROM en))"
add_rates("rlf_grid", R.grid_starts, GRID + " SELECT x, y, date1, date2 FROM gr")
add_rates("rlf_nearest", R.resample_nearest, CUM + GRID + ", pts AS (SELECT x, y, date1 AS d FROM gr UNION SELECT x, y, date2 FROM gr), b AS (SELECT p.x, p.y, p.d, c.date2 AS bd, c.dx AS b1, c.dy AS b2 FROM pts p ASOF LEFT JOIN cum c ON p.x = c.x AND p.y = c.y AND p.d >= c.date2), a AS (SELECT p.x, p.y, p.d, c.date2 AS ad, c.dx AS a1, c.dy AS a2 FROM pts p ASOF LEFT JOIN cum c ON p.x = c.x AND p.y = c.y AND p.d <= c.date2), n AS (SELECT x, y, d, CASE WHEN ad IS NULL OR date_diff('day', bd, d) <= date_diff('day', d, ad) THEN b1 ELSE a1 END AS dx, CASE WHEN ad IS NULL OR date_diff('day', bd, d) <= date_diff('day', d, ad) THEN b2 ELSE a2 END AS dy FROM b JOIN a USING (x, y, d)) SELECT g.x, g.y, g.date1, g.date2, r((n2.dx - n1.dx)*365/30) AS vx, r((n2.dy - n1.dy)*365/30) AS vy FROM gr g JOIN n n1 ON n1.x = g.x AND n1.y = g.y AND n1.d = g.date1 JOIN n n2 ON n2.x = g.x AND n2.y = g.y AND n2.d = g.date2")
add("interp_bounds", R.bounds, ", d AS (SELECT date1 AS d FROM obs UNION ALL SELECT date2 FROM obs) SELECT (SELECT d FROM d ORDER BY d LIMIT 1 OFFSET 1) AS first_date, (SELECT max(d) FROM d) AS last_date")

# ---- merging -----------------------------------------------------------------------------------------------------------------------------
add("merge_cubes", lambda d: L.merge([d.where("source = 'IGE'").drop("errory"), d.where("source <> 'IGE'")]).select("x", "y", "date1", "date2", "source", "vx", "errory"), f"SELECT {KEYS}, source, r(vx) AS vx, r(CASE WHEN source = 'IGE' THEN NULL ELSE errory END) AS errory FROM obs")
add("dedup_coords", lambda d: L.first_of_repeated(d.select("x", "y", "date1", "date2"), ["x", "y"], ["date1", "date2"]), f"SELECT {KEYS} FROM (SELECT x, y, date1, date2, row_number() OVER (PARTITION BY x, y ORDER BY date1, date2) AS n FROM obs) WHERE n = 1")
add("align_nearest", lambda d: P.align_nearest(d.select("x", "y", "date1", "date2"), d.select((F.floor(F.col("x") / 300) * 300).alias("x"), (F.floor(F.col("y") / 200) * 200).alias("y")).distinct().select(F.col("x").cast("double"), F.col("y").cast("double"))).groupBy("x", "y").agg(F.count("*").alias("n")), ", gx AS (SELECT DISTINCT floor(x/300)*300 AS g FROM obs), gy AS (SELECT DISTINCT floor(y/200)*200 AS g FROM obs), mx AS (SELECT o.x, arg_min(g, abs(o.x - g)*1e6 + (g - 4e5)/1e3) AS nx FROM (SELECT DISTINCT x FROM obs) o, gx GROUP BY o.x), my AS (SELECT o.y, arg_min(g, abs(o.y - g)*1e6 + (g - 4e6)/1e3) AS ny FROM (SELECT DISTINCT y FROM obs) o, gy GROUP BY o.y) SELECT nx AS x, ny AS y, count(*) AS n FROM obs JOIN mx USING (x) JOIN my USING (y) GROUP BY nx, ny")
add("split_cube", lambda d: d.select("x").distinct().select("x", F.ntile(2).over(X.W.orderBy("x")).alias("part")), "SELECT x, ntile(2) OVER (ORDER BY x) AS part FROM (SELECT DISTINCT x FROM obs)")

# ---- quality -----------------------------------------------------------------------------------------------------------------------------
STATIC = "WHERE xi <= 2"
area = lambda d: d.where("xi <= 2").select("x", "y").distinct()
profile = lambda d: d.where("xi = yi").select((100 * F.col("xi")).cast("double").alias("distance"), "x", "y").distinct()
add("mean_velocity", Q.mean_velocity, "SELECT x, y, r(avg(vx)) AS vx, r(avg(vy)) AS vy, r(sqrt(pow(avg(vx), 2) + pow(avg(vy), 2))) AS vv FROM obs GROUP BY x, y")
add("vvc", Q.coherence, f"SELECT x, y, r(sqrt(pow(sum(vx/{VV}), 2) + pow(sum(vy/{VV}), 2)) / count(*)) AS vvc FROM obs GROUP BY x, y")
add("flow_direction", Q.flow_direction, "SELECT x, y, r((degrees(atan2(sum(vx*temporal_baseline), sum(vy*temporal_baseline))) + 360) % 360) AS direction FROM obs GROUP BY x, y")
add("med_static", lambda d: Q.static_median(d, area(d)), f"SELECT mid_date, r(median(vx)) AS vx, r(median(vy)) AS vy FROM obs {STATIC} GROUP BY mid_date")
add("nmad_static", lambda d: Q.static_nmad(d, area(d)), f", m AS (SELECT *, median(vx) OVER (PARTITION BY mid_date) AS mx, median(vy) OVER (PARTITION BY mid_date) AS my FROM obs {STATIC}) SELECT mid_date, r(1.483*median(abs(vx-mx))) AS vx, r(1.483*median(abs(vy-my))) AS vy FROM m GROUP BY mid_date")
# points and pixels, layers and months are compared directly here
HEAT = f""", pt AS (SELECT DISTINCT 100.0*xi AS distance, x AS px, y AS py FROM obs WHERE xi = yi),
ly AS (SELECT p.distance, o.date1, o.date2, o.sensor, o.source, avg({VV}) AS v
  FROM pt p JOIN obs o ON abs(o.x - p.px) <= 100 AND abs(o.y - p.py) <= 100 AND o.vx IS NOT NULL AND o.vy IS NOT NULL GROUP BY ALL),
mo AS (SELECT CAST(m AS DATE) AS month, CAST(m + INTERVAL 1 MONTH AS DATE) AS after
  FROM (SELECT unnest(generate_series(TIMESTAMP '1900-01-01', TIMESTAMP '2100-01-01', INTERVAL 1 MONTH)) AS m)),
b AS (SELECT * FROM mo WHERE month >= (SELECT min(date1) FROM obs) AND after <= (SELECT max(date2) FROM obs))
SELECT distance::DOUBLE AS distance, month, CAST(after - (date_diff('day', month, after) // 2)::INTEGER AS DATE) AS date, r(HOW(v)) AS vv
FROM ly JOIN b ON after >= date1 AND month <= date2 GROUP BY distance, month, after"""
for _how in ("mean", "median"):
    add(f"heatmap_{_how}", lambda d, h=_how: Q.heatmap(d, profile(d), 100.0, method=h), HEAT.replace("HOW", "avg" if _how == "mean" else "median"))
add("rmse_stable", Q.rmse, "SELECT x, y, r(sqrt(avg((vx*vx + vy*vy)/2))) AS rmse FROM obs GROUP BY x, y")
add("group_mean_std", Q.pair_spread, ", p AS (SELECT date1, date2, avg(vx) AS mx, stddev_pop(vx) AS sx, avg(vy) AS my, stddev_pop(vy) AS sy FROM obs GROUP BY date1, date2) SELECT r(avg(mx)) AS mean_vx, r(avg(sx)) AS std_vx, r(avg(my)) AS mean_vy, r(avg(sy)) AS std_vy FROM p")
add("sensor_residual_stats", lambda d: Q.residual_groups(d.withColumn("r", F.col("vx") - 120)), "SELECT sensor, source, count(vx) AS n, r(quantile_cont(vx - 120, 0.25)) AS q25, r(quantile_cont(vx - 120, 0.5)) AS q50, r(quantile_cont(vx - 120, 0.75)) AS q75 FROM obs GROUP BY sensor, source")
add("spatial_mean_3x3", lambda d: V.spatial_mean(d.groupBy("xi", "yi").agg(F.avg("vx").alias("vx")), ["vx"], []), ", m AS (SELECT xi, yi, avg(vx) AS vx FROM obs GROUP BY xi, yi) SELECT c.xi, c.yi, r(avg(m.vx)) AS vx FROM m c, (SELECT unnest([-1,0,1]) AS dx) a, (SELECT unnest([-1,0,1]) AS dy) b, m WHERE m.xi = least(greatest(c.xi + dx, 0), 7) AND m.yi = least(greatest(c.yi + dy, 0), 4) GROUP BY c.xi, c.yi")

# ---- seasonality ----------------------------------------------------------------------------------------------------------------------------
MID = "(date_diff('day', DATE '1970-01-01', date1) + temporal_baseline / 2.0)"
at_mid = lambda d: d.withColumn("day", F.unix_date("date1") + F.col("temporal_baseline") / 2)
_A = "2*pi()/365.25*"
add("sine_fixed_frequency", lambda d: S.sine_fixed(at_mid(d), "day", "vx"), f", q AS (SELECT x, y, sin({_A}{MID}) AS s, cos({_A}{MID}) AS c, vx AS v FROM obs WHERE vx IS NOT NULL), m AS (SELECT x, y, avg(s) AS ms, avg(c) AS mc, avg(v) AS mv, var_pop(s) AS ss, var_pop(c) AS cc, covar_pop(s, c) AS sc, covar_pop(s, v) AS sv, covar_pop(c, v) AS cv FROM q GROUP BY x, y), f AS (SELECT *, (sv*cc - cv*sc)/(ss*cc - sc*sc) AS a, (cv*ss - sv*sc)/(ss*cc - sc*sc) AS b FROM m) SELECT x, y, r(sqrt(a*a + b*b)) AS amplitude, r(atan2(b, a)) AS phase, r(mv - a*ms - b*mc) AS \"offset\" FROM f")
add_rates("annual_stats", lambda d: S.annual(d.withColumn("v", F.round(F.col("result_dx") * 365 / F.col("delta"), 9)), "date2", "v"), ", v AS (SELECT x, y, date2, round(result_dx*365/delta, 9) AS v FROM ilf), p AS (SELECT *, CASE WHEN v > lag(v) OVER w AND v > lead(v) OVER w THEN 1 ELSE 0 END AS peak FROM v WINDOW w AS (PARTITION BY x, y ORDER BY date2)), f AS (SELECT *, first_value(date2) OVER (PARTITION BY x, y, year(date2) ORDER BY v DESC, date2) AS top FROM p) SELECT x, y, year(date2)::INTEGER AS year, r(min(v)) AS min, r(max(v)) AS max, r(avg(v)) AS mean, r(median(v)) AS median, r(stddev_pop(v)) AS std, r((max(v) - min(v))/2) AS amplitude, dayofyear(min(top))::INTEGER AS max_day, sum(peak)::BIGINT AS nb_peaks FROM f GROUP BY x, y, year(date2)")
DAILY = ", n AS (SELECT x, y, date_diff('day', DATE '1970-01-01', date1)::INTEGER AS day, avg(vx) AS v FROM obs WHERE vx IS NOT NULL GROUP BY x, y, date1)"
daily = lambda d: d.where("vx is not null").groupBy("x", "y", F.unix_date("date1").alias("day")).agg(F.avg("vx").alias("v"))
add("rolling_std_7d", lambda d: S.rolling_std(daily(d), "day", "v", 36).select("x", "y", "day", "std"), DAILY + " SELECT x, y, day, r(stddev_samp(v) OVER (PARTITION BY x, y ORDER BY day RANGE BETWEEN 36 PRECEDING AND 36 FOLLOWING)) AS std FROM n")
add("local_std_uniform", lambda d: S.local_std(daily(d), daily(d).select("x", "y", "day"), 30), DAILY + " SELECT a.x, a.y, a.day, r(stddev_pop(b.v)) AS std FROM n a JOIN n b ON a.x = b.x AND a.y = b.y AND abs(a.day - b.day) < 30 GROUP BY a.x, a.y, a.day")
add("local_std_containing", lambda d: S.containing_std(d, daily(d).select("x", "y", "day")), DAILY + " SELECT n.x, n.y, n.day, r(stddev_pop(o.vx)) AS std FROM n JOIN obs o ON n.x = o.x AND n.y = o.y AND o.vx IS NOT NULL AND date_diff('day', DATE '1970-01-01', o.date1) < n.day AND n.day < date_diff('day', DATE '1970-01-01', o.date2) GROUP BY n.x, n.y, n.day")
add("amplitude_to_variability", lambda d: S.amplitude_to_variability(daily(d).groupBy("x", "y").agg(((F.max("v") - F.min("v")) / 2).alias("amplitude")), S.local_std(daily(d), daily(d).select("x", "y", "day"), 30)), DAILY + ", s AS (SELECT a.x, a.y, a.day, stddev_pop(b.v) AS std FROM n a JOIN n b ON a.x = b.x AND a.y = b.y AND abs(a.day - b.day) < 30 GROUP BY a.x, a.y, a.day), m AS (SELECT x, y, median(std) AS s FROM s GROUP BY x, y), amp AS (SELECT x, y, (max(v) - min(v))/2 AS amp FROM n GROUP BY x, y) SELECT x, y, r(greatest(0, 1 - s/nullif(abs(amp), 0))) AS a_to_var FROM m JOIN amp USING (x, y)")
add("interpolated_residual", lambda d: S.interpolated_residual(daily(d), daily(d).where("day % 36 = 0")), DAILY + ", k AS (SELECT * FROM n WHERE day % 36 = 0), b AS (SELECT n.x, n.y, n.day, n.v, k.day AS bd, k.v AS bv FROM n ASOF JOIN k ON n.x = k.x AND n.y = k.y AND n.day >= k.day), a AS (SELECT n.x, n.y, n.day, k.day AS ad, k.v AS av FROM n ASOF JOIN k ON n.x = k.x AND n.y = k.y AND n.day <= k.day) SELECT x, y, day, r(v - bv - CASE WHEN ad = bd THEN 0 ELSE (day - bd)::DOUBLE / nullif(ad - bd, 0) * (av - bv) END) AS r FROM b JOIN a USING (x, y, day)")

# ---- choice of coefficients --------------------------------------------------------------------------------------------------------------------
MEAS = ", ms AS (SELECT x, y, (10 * row_number() OVER (PARTITION BY x, y ORDER BY m))::DOUBLE AS coef, q AS measure FROM (SELECT x, y, month(date1) AS m, round(avg(vx), 6) AS q FROM obs WHERE vx IS NOT NULL GROUP BY x, y, month(date1)))"
measures = lambda d: d.where("vx is not null").groupBy("x", "y", F.month("date1").alias("m")).agg(F.round(F.avg("vx"), 6).alias("measure")).select("x", "y", (10 * F.row_number().over(X.W.partitionBy("x", "y").orderBy("m"))).cast("double").alias("coef"), "measure")
flat = lambda d: d.withColumn("good_coefs", F.array_join(F.transform("good_coefs", lambda c: c.cast("int").cast("string")), ","))
CHOICE = ", en AS (SELECT x, y, max(measure) AS best_measure, min(measure) AS worst, arg_max(coef, measure*1e6 - coef/1e4) AS best_coef FROM ms GROUP BY x, y), gd AS (SELECT *, GOOD AS good_measure FROM en) SELECT g.x, g.y, r(best_measure) AS best_measure, best_coef, r(good_measure) AS good_measure, coalesce(string_agg(CASE WHEN m.measure > g.good_measure THEN m.coef::INTEGER::VARCHAR END, ',' ORDER BY m.coef), '') AS good_coefs FROM gd g JOIN ms m ON m.x = g.x AND m.y = g.y GROUP BY g.x, g.y, best_measure, best_coef, good_measure"
for _name, _how, _thr, _good in (("minmax", "min-max relative", 95.0, "best_measure - 0.05*(best_measure - worst)"), ("max_relative", "max relative", 2.0, "0.98*best_measure"), ("absolute", "absolute", 3.0, "best_measure - 3")):
    add(f"coef_select_{_name}", lambda d, h=_how, t=_thr: flat(O.select_coefs(measures(d), "vvc", h, t)), MEAS + CHOICE.replace("GOOD", _good))
add("coef_select_curvature", lambda d: O.select_coefs(measures(d), "vvc", "curvature").select("x", "y", "best_coef", "good_measure"), MEAS + ", s AS (SELECT *, lag(measure) OVER w/4 + measure/2 + lead(measure) OVER w/4 AS s FROM ms WINDOW w AS (PARTITION BY x, y ORDER BY coef)), b AS (SELECT *, (lead(s) OVER w - 2*s + lag(s) OVER w)/100 AS bend FROM s WINDOW w AS (PARTITION BY x, y ORDER BY coef)) SELECT b.x, b.y, e.best_coef, r(arg_max(b.measure, b.bend*1e6 - b.coef/1e4)) AS good_measure FROM b JOIN (SELECT x, y, arg_max(coef, measure*1e6 - coef/1e4) AS best_coef FROM ms GROUP BY x, y) e ON b.x = e.x AND b.y = e.y WHERE b.bend IS NOT NULL GROUP BY b.x, b.y, e.best_coef")

# ---- places and catalogues -----------------------------------------------------------------------------------------------------------------------
add("lonlat_grid", lambda d: geo.lonlat_grid(d, 32632))
add("reproject_velocity", lambda d: geo.reproject_velocity(d.where("temporal_baseline > 0"), 32632, 3413).select("x", "y", "date1", "date2", "vx", "vy"))

# ---- kernels: rows only ------------------------------------------------------------------------------------------------------------------------------
prepared = lambda d: X.delete_outliers(d, "mz_score")
EXACT = V.Inversion(regu="1", solver="LS")
add("invert_l2_reg1", lambda d: V.invert(prepared(d), EXACT))
add("invert_reg2", lambda d: V.invert(prepared(d), V.Inversion(regu="2", solver="LS")))
add("invert_accel_prior", lambda d: V.invert(prepared(d), V.Inversion()))
add("invert_directionxy", lambda d: V.invert(prepared(d), V.Inversion(regu="directionxy", solver="LS")))
add("invert_l1", lambda d: V.invert(prepared(d), V.Inversion(regu="1", solver="L1")))
add("invert_error_propagation", lambda d: V.invert(prepared(d), V.Inversion(regu="1", solver="LS", errors=True)))
add("invert_residual_norms", lambda d: V.quality(prepared(d), V.Inversion(regu="1", solver="LS", errors=True)))
add("invert_diagnosis", lambda d: V.diagnosis(prepared(d), EXACT))
add("invert_by_flag", lambda d: V.invert(prepared(d), V.Inversion(regu="1", solver="LS", by_flag={0: {"coef": 500.0}, 2: {"coef": 50.0, "regu": "2"}}), d.select("x", "y", ((F.col("xi") + F.col("yi")) % 3).alias("flag")).distinct()))
add("invert_smoothed_field", lambda d: V.invert_with_prior(prepared(d), V.smooth_pixels(prepared(d), "gaussian")))
for _method in ("gaussian", "median", "savgol", "lowess", "ica"):
    add(f"smooth_{_method}", lambda d, m=_method: V.smooth_pixels(prepared(d), m))
add("rlf_spline", lambda d: R.resample(V.invert(prepared(d), EXACT)))
add("rlf_spline_smooth", lambda d: R.resample(V.invert(prepared(d), EXACT), option="spline_smooth"))
add("interp_to_ground_truth", lambda d: R.at_dates(V.invert(prepared(d), EXACT), d.where("temporal_baseline = 24 and source = 'IGE'").select("x", "y", "date1", "date2").distinct()))
add("fft_peak", lambda d: S.spectrum_peak(daily(d)))
add("butter_bandpass", lambda d: S.filtered(daily(d)))
add("sine_free_frequency", lambda d: S.sine_free(daily(d)))
add("coef_sweep_vvc", lambda d: O.sweep(prepared(d), [10, 100, 500], "vvc", EXACT))
add("coef_sweep_stable", lambda d: O.sweep(prepared(d), [10, 100, 500], "stable_ground", EXACT))
add("coef_saturation", lambda d: O.saturation_coef(O.sweep(prepared(d), [1, 5, 10, 50, 100, 500], "vvc", EXACT)))

# ---- streams: the same windows over all events, from a stream; SQL counts them in one go ----------------------------------------------------------------


def _stream(window, sql: str | None, mode: str = "complete"):
    return (lambda spark, sf_dir: rounded(A.drain(window(A.read_events(spark, sf_dir)), mode))), sql


_EV = "ev AS (SELECT ts, user_id % 40 AS pixel, value AS vx FROM events)"
for _name, (_run, _text) in {
    "stream_tumbling_30d": _stream(A.tumbling, f"WITH {_EV} SELECT time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01') AS start, pixel, count(*) AS n, r(avg(vx)) AS vx FROM ev GROUP BY 1, 2"),
    "stream_sliding_30d_5d": _stream(A.sliding, f"WITH {_EV}, w AS (SELECT time_bucket(INTERVAL 5 DAY, ts, TIMESTAMP '1970-01-01') - INTERVAL (5 * k) DAY AS start, pixel, vx FROM ev, (SELECT unnest(generate_series(0, 5)) AS k)) SELECT start, pixel, count(*) AS n, r(avg(vx)) AS vx FROM w GROUP BY 1, 2"),
    "stream_running_state": _stream(A.running_state, None, "update"),
}.items():
    _queries[_name] = _run
    if _text:
        _sql[_name] = expand(_text)
_queries["stream_session"] = lambda spark, sf_dir: rounded(A.drain(A.sessions(A.read_events(spark, sf_dir)), "complete"))
_sql["stream_session"] = expand(f"WITH {_EV}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY pixel ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY pixel ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, pixel, count(*) AS n, r(avg(vx)) AS vx FROM s GROUP BY pixel, k")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers, inversion, regular series, mean speed of each pixel."""
    obs = prepared(bridge.obs(spark, sf_dir))
    rlf = R.resample(V.invert(obs, EXACT))
    return rlf.groupBy("x", "y").agg(F.count("*").alias("n"), F.avg(X.speed()).alias("speed")).orderBy("x", "y")


_queries["flagship"] = lambda spark, sf_dir: rounded(flagship(spark, sf_dir))
