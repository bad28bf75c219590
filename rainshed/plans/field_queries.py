"""Gridded field, corridor and terrain queries.

The ``embeddings`` table is read as a field: the vector index is the time, the element position a cell of an
8 x 8 grid; negative elements are missing, as over land.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rainshed import policy
from rainshed.functions import geo
from rainshed.functions.clock import wall_micros
from rainshed.operators import corridor as C
from rainshed.operators import joins as J
from rainshed.operators import quality as Q
from rainshed.operators import regrid as R
from rainshed.plans import bindings as B
from rainshed.plans.registry import query


# ---- bindings ----------------------------------------------------------------------------------------------------
def elements(spark, sf):
    """(vec_id, pos, v) for every element."""
    e = B.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return e.select("vec_id", "pos", F.col("x").cast("double").alias("v"))


def field(spark, sf):
    e = elements(spark, sf)
    pos, t = F.col("pos"), F.col("vec_id")
    return e.select(
        "vec_id",
        pos.alias("cell_id"),
        F.floor(pos / 8).cast("int").alias("lat_idx"),
        (pos % 8).cast("int").alias("lon_idx"),
        (40 + 0.5 * F.floor(pos / 8)).alias("lat"),
        (5 + 0.5 * (pos % 8)).alias("lon"),
        F.date_add(F.lit("1996-09-01").cast("date"), F.floor(t / 8).cast("int")).alias("date"),
        (t % 8).cast("int").alias("step"),
        F.col("v").alias("raw"),
        F.when(F.col("v") >= 0, F.col("v")).alias("value"),
    )


def grid(spark, sf):
    """The cells as a dimension, from the longest vector's length: the field itself is not exploded for it."""
    cells = B.table(spark, sf, "embeddings").agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("n"))
    pos = F.col("cell_id")
    return cells.where("n > 0").select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("cell_id")).select(
        "cell_id", F.floor(pos / 8).cast("int").alias("lat_idx"), (pos % 8).cast("int").alias("lon_idx"), (40 + 0.5 * F.floor(pos / 8)).alias("lat"), (5 + 0.5 * (pos % 8)).alias("lon")
    )


def weights(spark, sf):
    r = B.regions(spark, sf).withColumn("cell_id", F.explode(F.sequence(F.lit(0), F.lit(63))))
    w = (1 + (F.col("cell_id") * 7 + F.col("receptor_id") * 3) % 5).cast("double")
    return R.normalise_weights(
        r.where((F.col("cell_id") + F.col("receptor_id")) % 3 == 0).select("receptor_id", "cell_id", w.alias("w"))
    )


def receptors(spark, sf):
    return B.regions(spark, sf).select(
        "receptor_id", (41 + 0.7 * F.col("receptor_id")).alias("lat0"), (6 + 0.6 * F.col("receptor_id")).alias("lon0")
    )


SQL_EL = """el AS (SELECT vec_id, i - 1 AS pos, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""
SQL_FIELD = f"""{SQL_EL}, field AS (SELECT vec_id, pos AS cell_id, pos // 8 AS lat_idx, pos % 8 AS lon_idx, 40 + 0.5 * (pos // 8)::DOUBLE AS lat, 5 + 0.5 * (pos % 8)::DOUBLE AS lon,
  (DATE '1996-09-01' + CAST(vec_id // 8 AS INT)) AS date, vec_id % 8 AS step, v AS raw, CASE WHEN v >= 0 THEN v END AS value FROM el)"""
SQL_WEIGHTS = """w0 AS (SELECT r_regionkey AS receptor_id, c AS cell_id, CAST(1 + (c * 7 + r_regionkey * 3) % 5 AS DOUBLE) AS w
  FROM region CROSS JOIN range(64) t(c) WHERE (c + r_regionkey) % 3 = 0),
  weights AS (SELECT receptor_id, cell_id, w / sum(w) OVER (PARTITION BY receptor_id) AS w FROM w0)"""


# ---- regridding --------------------------------------------------------------------------------------------------
@query(
    "D-01 D-03 J-05 A-01",
    "receptor_id:i vec_id:i mean_value:f",
    f"""WITH {SQL_FIELD}, {SQL_WEIGHTS} SELECT receptor_id, vec_id, sum(value * w) / nullif(sum(CASE WHEN value IS NOT NULL THEN w END), 0) AS mean_value
        FROM field JOIN weights USING (cell_id) GROUP BY 1, 2""",
)
def weighted_regrid(spark, sf):
    r = R.regrid(field(spark, sf), weights(spark, sf), ["vec_id"], ["value"])
    return r.withColumnRenamed("value", "mean_value")


@query(
    "D-03 Q-01",
    "receptor_id:i cells:i weight_sum:f9 normalised:b",
    f"WITH {SQL_WEIGHTS} SELECT receptor_id, count(*) AS cells, sum(w) AS weight_sum, abs(sum(w) - 1) <= 1e-10 AS normalised FROM weights GROUP BY 1",
)
def weight_normalisation(spark, sf):
    return R.weight_sums(weights(spark, sf))


def flux_steps(spark, sf):
    f = field(spark, sf)
    parts = f.select(
        "cell_id", "vec_id", "date", "step", F.col("raw").alias("e"), (F.col("raw") * F.col("raw") - 0.01).alias("n"),
        F.hypot(F.col("raw"), F.col("raw") * F.col("raw") - 0.01).alias("mag"),
    )
    return R.regrid(parts, weights(spark, sf), ["date", "step"], ["e", "n", "mag"])


SQL_STEPS = f"""{SQL_FIELD}, {SQL_WEIGHTS}, steps AS (SELECT receptor_id, date, step, sum(raw * w) / sum(w) AS e, sum((raw * raw - 0.01) * w) / sum(w) AS n,
  sum(sqrt(raw * raw + (raw * raw - 0.01) * (raw * raw - 0.01)) * w) / sum(w) AS mag FROM field JOIN weights USING (cell_id) GROUP BY 1, 2, 3)"""


@query(
    "A-04 M-01",
    "receptor_id:i date:d e_mean:f n_mean:f mag_mean:f mag_max:f dir_deg_from_north:f samples:i",
    f"""WITH {SQL_STEPS}, d AS (SELECT receptor_id, date, avg(e) AS e_mean, avg(n) AS n_mean, avg(mag) AS mag_mean, max(mag) AS mag_max, count(*) AS samples FROM steps GROUP BY 1, 2)
        SELECT *, (degrees(atan2(e_mean, n_mean)) + 360) % 360 AS dir_deg_from_north FROM d""",
)
def daily_flux_statistics(spark, sf):
    return R.daily_flux(flux_steps(spark, sf), "e", "n", "mag")


@query(
    "A-04 A-07",
    "receptor_id:i date:d mag_mean:f mag_max:f mag_min:f samples:i magnitude_mean:f",
    f"""WITH {SQL_STEPS} SELECT receptor_id, date, avg(mag) AS mag_mean, max(mag) AS mag_max, min(mag) AS mag_min, count(*) AS samples, avg(sqrt(e * e + n * n)) AS magnitude_mean
        FROM steps GROUP BY 1, 2""",
)
def daily_state_statistics(spark, sf):
    steps = R.magnitude_of_mean(flux_steps(spark, sf), "e", "n")
    return R.daily_statistics(steps, {"mag": ["mean", "max", "min"], "magnitude": ["mean"]})


@query(
    "A-05",
    "receptor_id:i date:d q925_mean:f q850_mean:f q700_mean:f wind925_mean:f wind850_mean:f wind700_mean:f wind925_max:f wind850_max:f wind700_max:f",
    f"""WITH {SQL_FIELD}, {SQL_WEIGHTS}, lv AS (SELECT *, CASE cell_id % 3 WHEN 0 THEN 925 WHEN 1 THEN 850 ELSE 700 END AS level FROM field),
        s AS (SELECT receptor_id, date, step, level, sum(abs(raw) * w) / sum(w) AS q, sum(sqrt(raw * raw + 1) * w) / sum(w) AS wind FROM lv JOIN weights USING (cell_id) GROUP BY 1, 2, 3, 4)
        SELECT receptor_id, date, {', '.join(f"avg(q) FILTER (WHERE level = {l}) AS q{l}_mean, avg(wind) FILTER (WHERE level = {l}) AS wind{l}_mean, max(wind) FILTER (WHERE level = {l}) AS wind{l}_max" for l in (925, 850, 700))}
        FROM s GROUP BY 1, 2""",
)
def daily_pressure_levels(spark, sf):
    level = F.when(F.col("cell_id") % 3 == 0, 925).when(F.col("cell_id") % 3 == 1, 850).otherwise(700)
    f = field(spark, sf).select(
        "cell_id", "date", "step", level.alias("level"), F.abs("raw").alias("q"), F.hypot(F.col("raw"), F.lit(1.0)).alias("wind")
    )
    steps = R.regrid(f, weights(spark, sf), ["date", "step", "level"], ["q", "wind"])
    return R.daily_levels(steps, (925, 850, 700), ["q", "wind"], maxima=["wind"])


@query(
    "A-06",
    "receptor_id:i date:d precip_sum_mm:f3 precip_max_step_mm:f3 samples:i",
    f"""WITH {SQL_FIELD}, {SQL_WEIGHTS}, s AS (SELECT receptor_id, date, step, sum(CASE WHEN raw > 0.05 THEN raw * w END) / sum(CASE WHEN raw > 0.05 THEN w END) AS tp FROM field JOIN weights USING (cell_id) GROUP BY 1, 2, 3)
        SELECT receptor_id, date, coalesce(sum(tp), 0) * 1000 AS precip_sum_mm, max(tp) * 1000 AS precip_max_step_mm, count(*) AS samples FROM s GROUP BY 1, 2""",
)
def daily_precipitation(spark, sf):
    f = field(spark, sf).withColumn("tp", F.when(F.col("raw") > 0.05, F.col("raw")))
    return R.daily_precipitation(R.regrid(f, weights(spark, sf), ["date", "step"], ["tp"]), "tp")


@query(
    "A-17 Q-12 J-08",
    "vec_id:i cell_id:i period:s value:f anomaly:f",
    f"""WITH {SQL_FIELD}, c AS (SELECT cell_id, strftime(date, '%m-%d') AS period, avg(value) AS cl FROM field WHERE value IS NOT NULL AND year(date) BETWEEN 1991 AND 2020 GROUP BY 1, 2)
        SELECT vec_id, cell_id, strftime(date, '%m-%d') AS period, value, value - cl AS anomaly FROM field LEFT JOIN c ON c.cell_id = field.cell_id AND c.period = strftime(date, '%m-%d')""".replace(
        "SELECT vec_id, cell_id, strftime", "SELECT vec_id, field.cell_id, strftime"
    ),
)
def calendar_day_anomaly(spark, sf):
    f = field(spark, sf)
    return R.anomaly(f, R.climatology(f, "date", "value", "day", 1991, 2020), "date", "value", "day")


@query(
    "A-18",
    "cell_id:i period:s climatology:f contributors:i",
    f"WITH {SQL_FIELD} SELECT cell_id, strftime(date, '%m') AS period, avg(value) AS climatology, count(*) AS contributors FROM field WHERE value IS NOT NULL GROUP BY 1, 2",
)
def monthly_climatology(spark, sf):
    return R.climatology(field(spark, sf), "date", "value", "month", 1991, 2020)


def ocean_levels(spark, sf):
    """Eight columns of eight levels per time: thickness, floor depth, temperature (missing where cold)."""
    e = elements(spark, sf)
    lev, col = F.col("pos") % 8, F.floor(F.col("pos") / 8)
    v = F.col("v")
    return e.select(
        "vec_id", col.cast("int").alias("col"), lev.cast("int").alias("level"), (10 + 5 * lev).cast("double").alias("thickness"),
        (40 + 12 * col).cast("double").alias("floor"), (v > -0.3).alias("wet"), F.when(v > -0.15, 15 + 10 * v).alias("temperature"),
    )


SQL_OCEAN = f"""{SQL_EL}, lv AS (SELECT vec_id, pos // 8 AS col, pos % 8 AS level, 10.0 + 5 * (pos % 8) AS thickness, 40.0 + 12 * (pos // 8) AS floor, v > -0.3 AS wet, CASE WHEN v > -0.15 THEN 15 + 10 * v END AS temperature FROM el),
  bt AS (SELECT *, sum(CASE WHEN wet THEN thickness ELSE 0 END) OVER (PARTITION BY vec_id, col ORDER BY level) AS bottom FROM lv),
  ef AS (SELECT *, CASE WHEN wet THEN greatest(least(bottom, least(floor, 100)) - (bottom - thickness), 0) ELSE 0 END AS dz FROM bt)"""


@query(
    "A-20",
    "vec_id:i col:i level:i dz:f",
    f"WITH {SQL_OCEAN} SELECT vec_id, col, level, dz FROM ef",
)
def effective_layer_thickness(spark, sf):
    return R.effective_thickness(ocean_levels(spark, sf), ["vec_id", "col"], "level", "thickness", "wet", "floor", 100.0)


@query(
    "A-19 M-12",
    "vec_id:i col:i heat_content_gj_m2:f tmean_c:f covered:f",
    f"""WITH {SQL_OCEAN}, s AS (SELECT vec_id, col, sum(dz) AS total, sum(CASE WHEN temperature IS NOT NULL AND dz > 0 THEN dz ELSE 0 END) AS covered,
          sum(CASE WHEN temperature IS NOT NULL AND dz > 0 THEN temperature * dz END) AS it FROM ef GROUP BY 1, 2)
        SELECT vec_id, col, covered, CASE WHEN total > 0 AND covered >= total - 1e-3 THEN 1025.0 * 3990.0 * it / 1e9 END AS heat_content_gj_m2,
          CASE WHEN total > 0 AND covered >= total - 1e-3 THEN it / total END AS tmean_c FROM s""",
)
def ocean_heat_content(spark, sf):
    col = R.effective_thickness(ocean_levels(spark, sf), ["vec_id", "col"], "level", "thickness", "wet", "floor", 100.0)
    h = R.heat_content(col, ["vec_id", "col"], "temperature")
    return h.withColumn("heat_content_gj_m2", F.col("heat_content_j_m2") / 1e9)


@query(
    "A-23",
    "vec_id:i col:i ivt_e:f ivt_n:f ivt:f",
    f"""WITH {SQL_EL}, lv AS (SELECT vec_id, pos // 8 AS col, 30000.0 + 10000 * (pos % 8) AS p, abs(v) * v * 0.1 AS fu, CASE WHEN v > -0.25 THEN abs(v) * -0.05 * v END AS fv, 75000.0 + 4000 * (pos // 8) AS sp FROM el),
        k AS (SELECT *, fu IS NOT NULL AND fv IS NOT NULL AND p <= sp AS ok FROM lv),
        n AS (SELECT *, coalesce(lead(ok) OVER w, false) AS ok1, lead(p) OVER w AS p1, lead(fu) OVER w AS fu1, lead(fv) OVER w AS fv1 FROM k WINDOW w AS (PARTITION BY vec_id, col ORDER BY p)),
        s AS (SELECT vec_id, col, bool_or(ok) AS anyv,
          sum(CASE WHEN ok AND ok1 THEN 0.5 * (fu + fu1) * (p1 - p) ELSE 0 END + CASE WHEN ok AND NOT ok1 THEN fu * greatest(sp - p, 0) ELSE 0 END) / 9.80665 AS iu,
          sum(CASE WHEN ok AND ok1 THEN 0.5 * (fv + fv1) * (p1 - p) ELSE 0 END + CASE WHEN ok AND NOT ok1 THEN fv * greatest(sp - p, 0) ELSE 0 END) / 9.80665 AS iv FROM n GROUP BY 1, 2)
        SELECT vec_id, col, CASE WHEN anyv THEN iu END AS ivt_e, CASE WHEN anyv THEN iv END AS ivt_n, CASE WHEN anyv THEN sqrt(iu * iu + iv * iv) END AS ivt FROM s""",
)
def moisture_flux_integral(spark, sf):
    e = elements(spark, sf)
    lev, col, v = F.col("pos") % 8, F.floor(F.col("pos") / 8), F.col("v")
    lv = e.select(
        "vec_id", col.cast("int").alias("col"), (30000.0 + 10000 * lev).alias("p"), F.abs(v).alias("q"), (v * 0.1).alias("u"),
        F.when(v > -0.25, v * -0.05).alias("vv"), (75000.0 + 4000 * col).alias("sp"),
    )
    return R.column_flux(lv, ["vec_id", "col"], "p", "q", "u", "vv", "sp")


@query(
    "A-24 A-25",
    "vec_id:i max_rate_mm_h:f last_total_mm:f",
    f"""WITH {SQL_EL}, s AS (SELECT vec_id, pos % 8 AS step, avg(abs(v)) AS tp FROM el GROUP BY 1, 2),
        i AS (SELECT *, greatest(tp - lag(tp, 1, 0.0) OVER (PARTITION BY vec_id ORDER BY step), 0) AS inc FROM s)
        SELECT vec_id, max(inc) * 1000 / 3 AS max_rate_mm_h, arg_max(tp, step) * 1000 AS last_total_mm FROM i GROUP BY 1""",
)
def cumulative_precipitation_rate(spark, sf):
    steps = elements(spark, sf).groupBy("vec_id", (F.col("pos") % 8).alias("step")).agg(F.avg(F.abs("v")).alias("tp"))
    return R.cumulative_rate(steps, ["vec_id"], "step", "tp")


SQL_AREA = f"""{SQL_FIELD}, g AS (SELECT *, {policy.EARTH_RADIUS_M}::DOUBLE ** 2 * abs(sin(radians(lat + 0.25)) - sin(radians(lat - 0.25))) * abs(radians(lon + 0.25) - radians(lon - 0.25)) AS area_m2 FROM field)"""


@query(
    "M-09 D-02",
    "cell_id:i lat:f lon:f area_km2:f3",
    f"WITH {SQL_AREA} SELECT DISTINCT cell_id, lat, lon, area_m2 / 1e6 AS area_km2 FROM g",
)
def grid_cell_areas(spark, sf):
    return C.grid_with_area(grid(spark, sf)).withColumn("area_km2", F.col("area_m2") / 1e6)


def field_with_area(spark, sf):
    a = C.grid_with_area(grid(spark, sf)).select("cell_id", "area_m2")
    return field(spark, sf).join(a, "cell_id")


@query(
    "A-21",
    "vec_id:i signed_km2:f3 positive_km2:f3 negative_km2:f3 area_mean:f valid_km2:f3",
    f"""WITH {SQL_AREA} SELECT vec_id, sum(raw * area_m2) / 1e6 AS signed_km2, sum(greatest(raw, 0) * area_m2) / 1e6 AS positive_km2,
        sum(least(raw, 0) * area_m2) / 1e6 AS negative_km2, sum(raw * area_m2) / sum(area_m2) AS area_mean, sum(area_m2) / 1e6 AS valid_km2 FROM g GROUP BY 1""",
)
def area_integrals(spark, sf):
    t = R.area_totals(field_with_area(spark, sf), ["vec_id"], "raw", "area_m2")
    return t.select(
        "vec_id", (F.col("signed_total") / 1e6).alias("signed_km2"), (F.col("positive_total") / 1e6).alias("positive_km2"),
        (F.col("negative_total") / 1e6).alias("negative_km2"), "area_mean", (F.col("valid_area_m2") / 1e6).alias("valid_km2"),
    )


@query(
    "A-22",
    "vec_id:i west:f south:f mean_value:f valid_cells:i",
    f"""WITH {SQL_AREA} SELECT vec_id, floor(lon / 1.0) * 1.0 AS west, floor(lat / 1.0) * 1.0 AS south,
        sum(value * area_m2) / nullif(sum(CASE WHEN value IS NOT NULL THEN area_m2 END), 0) AS mean_value, count(value) AS valid_cells FROM g GROUP BY 1, 2, 3""",
)
def block_aggregation(spark, sf):
    return R.block_mean(field_with_area(spark, sf), ["vec_id"], "value", "area_m2", 1.0)


@query(
    "J-18",
    "step:i lat_idx:i cells:i mean_diff:f min_diff:f max_diff:f rmse:f changed_cells:i",
    f"""WITH {SQL_FIELD}, d AS (SELECT a.step, a.lat_idx, b.raw - a.raw AS d FROM field a JOIN field b ON a.date = b.date AND a.cell_id = b.cell_id AND b.step = a.step + 1)
        SELECT step, lat_idx, count(*) AS cells, avg(d) AS mean_diff, min(d) AS min_diff, max(d) AS max_diff, sqrt(avg(d * d)) AS rmse, count(*) FILTER (WHERE d <> 0) AS changed_cells FROM d GROUP BY 1, 2""",
)
def raster_difference(spark, sf):
    """Every step against the next one of its day."""
    f = field(spark, sf)
    following = f.withColumn("step", F.col("step") - 1)
    return R.compare_grids(f, following, ["date", "step", "cell_id", "lat_idx"], "raw", ["step", "lat_idx"])


@query(
    "A-39",
    "user_id:i date:d peak:f peak_us:i",
    """SELECT user_id, CAST(ts AS DATE) AS date, max(value) AS peak, min(epoch_us(ts)) FILTER (WHERE value = m) AS peak_us
       FROM (SELECT *, max(value) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS m FROM events) GROUP BY 1, 2""",
)
def daily_peak_time(spark, sf):
    p = R.daily_peak(B.table(spark, sf, "events"), ["user_id"], "ts", "value")
    return p.withColumn("peak_us", wall_micros(F.col("peak_ts")))


@query(
    "A-40",
    "o_custkey:i modal:s n:i",
    """SELECT o_custkey, o_orderpriority AS modal, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1""",
)
def modal_category(spark, sf):
    return R.modal_category(B.table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority")


def dem(spark, sf):
    return field(spark, sf).select("vec_id", "lat_idx", "lon_idx", (800 + 3000 * F.col("raw")).alias("z"))


SQL_DEM = f"""{SQL_FIELD}, dem AS (SELECT vec_id, lat_idx, lon_idx, 800 + 3000 * raw AS z FROM field),
  gr AS (SELECT *, (coalesce(lead(z) OVER c, z) - coalesce(lag(z) OVER c, z)) / ((CASE WHEN lon_idx IN (0, 7) THEN 1 ELSE 2 END) * 1000.0) AS gx,
    (coalesce(lead(z) OVER r, z) - coalesce(lag(z) OVER r, z)) / ((CASE WHEN lat_idx IN (0, 7) THEN 1 ELSE 2 END) * 1000.0) AS gy FROM dem
    WINDOW c AS (PARTITION BY vec_id, lat_idx ORDER BY lon_idx), r AS (PARTITION BY vec_id, lon_idx ORDER BY lat_idx)),
  sl AS (SELECT *, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope_deg FROM gr)"""


@query(
    "A-42",
    "vec_id:i lat_idx:i lon_idx:i slope_deg:f",
    f"WITH {SQL_DEM} SELECT vec_id, lat_idx, lon_idx, slope_deg FROM sl",
)
def dem_slope(spark, sf):
    return R.slope_degrees(dem(spark, sf), ["vec_id"], "lat_idx", "lon_idx", "z", 1000.0)


@query(
    "A-41",
    "receptor_id:i pixels:i z_min:f3 z_p10:f3 z_median:f3 z_p90:f3 z_max:f3 z_mean:f3 z_std:f3 relief:f3 hypsometric:f band_0_fraction:f band_1_fraction:f band_2_fraction:f band_3_fraction:f slope_ge15_fraction:f",
    f"""WITH {SQL_DEM}, c AS (SELECT *, vec_id % 5 AS receptor_id FROM sl)
        SELECT receptor_id, count(z) AS pixels, min(z) AS z_min, quantile_cont(z, 0.1) AS z_p10, quantile_cont(z, 0.5) AS z_median, quantile_cont(z, 0.9) AS z_p90, max(z) AS z_max,
          avg(z) AS z_mean, stddev_pop(z) AS z_std, max(z) - min(z) AS relief, (avg(z) - min(z)) / (max(z) - min(z)) AS hypsometric,
          avg(CAST(z < 500 AS INT)) AS band_0_fraction, avg(CAST(z >= 500 AND z < 1000 AS INT)) AS band_1_fraction, avg(CAST(z >= 1000 AND z < 1500 AS INT)) AS band_2_fraction,
          avg(CAST(z >= 1500 AS INT)) AS band_3_fraction, avg(CAST(slope_deg >= 15 AS INT)) AS slope_ge15_fraction FROM c GROUP BY 1""",
)
def terrain_descriptors(spark, sf):
    s = R.slope_degrees(dem(spark, sf), ["vec_id"], "lat_idx", "lon_idx", "z", 1000.0)
    return R.terrain_stats(s.withColumn("receptor_id", F.col("vec_id") % 5), "receptor_id", "z", "slope_deg")


@query(
    "A-43",
    "p_partkey:i area_km2:f perimeter_km:f equivalent_diameter_km:f circularity:f convexity:f",
    """SELECT p_partkey, a / 1e6 AS area_km2, l / 1000 AS perimeter_km, 2 * sqrt(a / pi()) / 1000 AS equivalent_diameter_km, 4 * pi() * a / (l * l) AS circularity, a / h AS convexity
       FROM (SELECT p_partkey, p_retailprice * 1e4 AS a, p_size * 1000.0 AS l, p_retailprice * 1.2e4 AS h FROM part)""",
)
def shape_descriptors(spark, sf):
    p = B.table(spark, sf, "part")
    a, l, h = F.col("p_retailprice") * 1e4, F.col("p_size") * 1000.0, F.col("p_retailprice") * 1.2e4
    return p.select("p_partkey", *R.shape_descriptors(a, l, h))


@query(
    "A-44",
    "vec_id:i block:i monotone:b",
    """WITH e AS (SELECT vec_id, embedding, unnest(range(0, (len(embedding) + 3) // 4)) AS block FROM embeddings),
       l AS (SELECT vec_id, block, list_filter(list_transform(embedding[4 * block + 1:4 * block + 4], lambda x: CAST(x AS DOUBLE)), lambda x: x >= -0.1) AS v FROM e)
       SELECT vec_id, block, v = list_sort(v) AS monotone FROM l""",
)
def threshold_monotonicity(spark, sf):
    """Levels are the elements of a vector, four at a time; low ones count as missing."""
    blocks = F.sequence(F.lit(0), F.floor((F.size("embedding") - 1) / 4).cast("int"))
    e = B.table(spark, sf, "embeddings").select("vec_id", "embedding", F.explode(blocks).alias("block"))
    level = [F.get("embedding", F.col("block") * 4 + i).cast("double") for i in range(4)]
    return e.select("vec_id", "block", R.is_monotone([F.when(x >= -0.1, x) for x in level]).alias("monotone"))


# ---- distances ---------------------------------------------------------------------------------------------------
def sql_dist(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"2 * {policy.EARTH_RADIUS_KM} * asin(sqrt(least(greatest({a}, 0), 1)))"


def sql_bear(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    dl = f"radians({lon2} - {lon1})"
    x = f"sin({dl}) * cos(radians({lat2}))"
    y = f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({dl})"
    return f"(degrees(atan2({x}, {y})) + 360) % 360"


SQL_REC = "rec AS (SELECT r_regionkey AS receptor_id, 41 + 0.7 * r_regionkey::DOUBLE AS lat0, 6 + 0.6 * r_regionkey::DOUBLE AS lon0 FROM region)"


@query(
    "M-08 J-16 D-06",
    "receptor_id:i cell_id:i distance_km:f3 bearing:f3",
    f"""WITH {SQL_AREA}, {SQL_REC}, u AS (SELECT DISTINCT cell_id, lat, lon FROM g)
        SELECT * FROM (SELECT receptor_id, cell_id, {sql_dist('lat0', 'lon0', 'lat', 'lon')} AS distance_km, {sql_bear('lat0', 'lon0', 'lat', 'lon')} AS bearing FROM rec CROSS JOIN u) WHERE distance_km <= 150""",
)
def cells_within_distance(spark, sf):
    return C.within_distance(receptors(spark, sf), grid(spark, sf), 150.0)


@query(
    "J-16",
    "c_custkey:i receptor_id:i distance_km:f3",
    f"""WITH {SQL_REC}, p AS (SELECT c_custkey, 40 + (c_custkey % 997) / 200.0::DOUBLE AS lat, 5 + (c_custkey % 499) / 100.0::DOUBLE AS lon FROM customer),
        d AS (SELECT c_custkey, receptor_id, {sql_dist('lat0', 'lon0', 'lat', 'lon')} AS distance_km FROM rec CROSS JOIN p)
        SELECT * FROM d WHERE distance_km <= 80 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY distance_km, receptor_id) = 1""",
)
def point_assignment(spark, sf):
    from rainshed.operators.windows import first_by

    k = F.col("c_custkey")
    p = B.table(spark, sf, "customer").select(
        "c_custkey", (40 + (k % 997) / 200.0).alias("lat"), (5 + (k % 499) / 100.0).alias("lon")
    )
    near = C.within_distance(receptors(spark, sf), p, 80.0).select("c_custkey", "receptor_id", "distance_km")
    return first_by(near, ["c_custkey"], [F.col("distance_km"), F.col("receptor_id")])


@query(
    "J-17",
    "p_partkey:i price:f2 vec_id:i level:f",
    """WITH l AS (SELECT vec_id, 900 + vec_id * 0.77 AS level FROM embeddings)
       SELECT p_partkey, p_retailprice AS price, vec_id, level FROM part JOIN l ON abs(p_retailprice - level) <= 0.2
       QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_retailprice - level), level) = 1""",
)
def nearest_alignment(spark, sf):
    levels = B.table(spark, sf, "embeddings").select("vec_id", (900 + F.col("vec_id") * 0.77).alias("level"))
    parts = B.table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("price"))
    return J.align_nearest(parts, levels, "price", "level", 0.2, ["p_partkey"])


@query(
    "J-19",
    "s_suppkey:i cell_id:i",
    """WITH a AS (SELECT s_suppkey, 5 + (s_suppkey % 83) / 25.0 AS west, 40 + (s_suppkey % 71) / 20.0 AS south FROM supplier),
       b AS (SELECT c AS cell_id, 5 + 0.5 * (c % 8) AS west, 40 + 0.5 * (c // 8) AS south FROM range(64) t(c))
       SELECT s_suppkey, cell_id FROM a JOIN b ON greatest(a.west, b.west) < least(a.west + 0.7, b.west + 0.5) AND greatest(a.south, b.south) < least(a.south + 0.45, b.south + 0.5)""",
)
def tile_overlap(spark, sf):
    k = F.col("s_suppkey")
    a = B.table(spark, sf, "supplier").select("s_suppkey", (5 + (k % 83) / 25.0).alias("west"), (40 + (k % 71) / 20.0).alias("south"))
    a = a.select("*", (F.col("west") + 0.7).alias("east"), (F.col("south") + 0.45).alias("north"))
    b = grid(spark, sf).select("cell_id", F.col("lon").alias("west"), F.col("lat").alias("south"))
    b = b.select("*", (F.col("west") + 0.5).alias("east"), (F.col("south") + 0.5).alias("north"))
    return J.overlapping_boxes(a, b, "s_suppkey", "cell_id")


# ---- corridor ----------------------------------------------------------------------------------------------------
def bearing_panel(spark, sf):
    """Source bearing per (receptor, time) from the sums of the vector's even and odd elements, turned by receptor."""

    def total(odd: int):
        return F.aggregate(F.filter("embedding", lambda x, i: i % 2 == odd), F.lit(0.0), lambda acc, x: acc + x.cast("double"))

    e = B.table(spark, sf, "embeddings").select("vec_id", geo.bearing_toward(total(0), total(1)).alias("b"))
    turned = e.withColumn("receptor_id", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return turned.select("receptor_id", "vec_id", F.pmod(F.col("b") + 72.0 * F.col("receptor_id"), F.lit(360.0)).alias("source_bearing"))


SQL_SIDE = "list_sum(list_transform(range({0}, len(embedding) + 1, 2), lambda i: CAST(embedding[i] AS DOUBLE)))"
SQL_BP = f"""bp AS (SELECT r AS receptor_id, vec_id, ((degrees(atan2({SQL_SIDE.format(1)}, {SQL_SIDE.format(2)})) + 360) % 360 + 72.0 * r) % 360 AS source_bearing FROM embeddings CROSS JOIN range(5) t(r))"""


def sql_kernel(scenarios) -> str:
    values = ", ".join(f"('{s[0]}', {s[1]}::DOUBLE, {s[2]}::DOUBLE, {s[3]}::DOUBLE, {s[4]}::DOUBLE)" for s in scenarios)
    return f"""{SQL_AREA}, {SQL_REC}, {SQL_BP}, sc(scenario, sigma, cutoff, scale, dmax) AS (VALUES {values}),
  pairs AS (SELECT receptor_id, cell_id, area_m2, {sql_dist('lat0', 'lon0', 'lat', 'lon')} AS dist, {sql_bear('lat0', 'lon0', 'lat', 'lon')} AS bear FROM rec CROSS JOIN (SELECT DISTINCT cell_id, lat, lon, area_m2 FROM g)),
  ang AS (SELECT *, abs((((bear - sector * 22.5 + 180) % 360) + 360) % 360 - 180) AS diff FROM pairs CROSS JOIN range(16) t(sector)),
  kw AS (SELECT scenario, receptor_id, sector, cell_id, area_m2 * exp(-dist / scale) * exp(-0.5 * pow(diff / sigma, 2)) AS w FROM ang CROSS JOIN sc WHERE dist <= dmax AND diff <= cutoff),
  sums AS (SELECT scenario, receptor_id, sector, vec_id, sum(value * w) AS num, sum(w) AS den FROM field JOIN kw USING (cell_id) WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4),
  pr AS (SELECT *, CAST(floor(source_bearing / 22.5) AS INT) % 16 AS lo, (CAST(floor(source_bearing / 22.5) AS INT) + 1) % 16 AS hi, source_bearing / 22.5 - floor(source_bearing / 22.5) AS fr FROM bp CROSS JOIN sc),
  mix AS (SELECT pr.scenario, pr.receptor_id, pr.vec_id, pr.source_bearing, (1 - fr) * coalesce(a.num, 0) + fr * coalesce(b.num, 0) AS num, (1 - fr) * coalesce(a.den, 0) + fr * coalesce(b.den, 0) AS den FROM pr
    LEFT JOIN sums a ON a.scenario = pr.scenario AND a.receptor_id = pr.receptor_id AND a.vec_id = pr.vec_id AND a.sector = lo
    LEFT JOIN sums b ON b.scenario = pr.scenario AND b.receptor_id = pr.receptor_id AND b.vec_id = pr.vec_id AND b.sector = hi),
  cor AS (SELECT scenario, receptor_id, vec_id, source_bearing, CASE WHEN den > 0 THEN num / den END AS v, CASE WHEN den > 0 THEN den ELSE 0 END AS s FROM mix)"""


def base_weights(spark, sf, scenarios=C.BASE_ONLY):
    return C.sector_weights(receptors(spark, sf), C.grid_with_area(grid(spark, sf)), scenarios)


def corridor_all(spark, sf, scenarios=C.BASE_ONLY):
    """Vectors meet their receptors' bearings before they are exploded, so only one row a time is exchanged."""
    panel = bearing_panel(spark, sf)
    pairs = C.within_distance(receptors(spark, sf), C.grid_with_area(grid(spark, sf)), max(s[4] for s in scenarios))
    seen = B.table(spark, sf, "embeddings").select("vec_id", "embedding").join(panel, "vec_id")
    observed = seen.select("receptor_id", "vec_id", "source_bearing", F.posexplode("embedding").alias("cell_id", "x"))
    value = F.when(F.col("x") >= 0, F.col("x").cast("double")).alias("value")
    observed = observed.select("receptor_id", "vec_id", "source_bearing", "cell_id", value)
    on = ["receptor_id", "vec_id", "source_bearing"]
    found = C.corridor_at_bearing(observed, pairs, on, "source_bearing", "value", scenarios)
    every = panel.withColumn("scenario", F.explode(F.array(*[F.lit(s[0]) for s in scenarios])))
    joined = every.join(found, [*on, "scenario"], "left")
    return joined.withColumn("corridor_support", F.coalesce("corridor_support", F.lit(0.0)))


BASE = policy.KERNEL_SCENARIOS[:1]


@query(
    "M-10 D-04",
    "receptor_id:i sector:i cell_id:i w_km2:f3",
    f"WITH {sql_kernel(BASE)} SELECT receptor_id, sector, cell_id, w / 1e6 AS w_km2 FROM kw",
)
def sector_kernel_weights(spark, sf):
    return base_weights(spark, sf).withColumn("w_km2", F.col("w") / 1e6)


@query(
    "A-02",
    "receptor_id:i sector:i vec_id:i num_km2:f3 den_km2:f2",
    f"WITH {sql_kernel(BASE)} SELECT receptor_id, sector, vec_id, num / 1e6 AS num_km2, den / 1e6 AS den_km2 FROM sums",
)
def sector_sums(spark, sf):
    s = C.sector_sums(field(spark, sf), base_weights(spark, sf), "vec_id", "value")
    return s.select("receptor_id", "sector", "vec_id", (F.col("num") / 1e6).alias("num_km2"), (F.col("den") / 1e6).alias("den_km2"))


@query(
    "A-03 J-07",
    "receptor_id:i vec_id:i source_bearing:f corridor_value:f support_km2:f2",
    f"WITH {sql_kernel(BASE)} SELECT receptor_id, vec_id, source_bearing, v AS corridor_value, s / 1e6 AS support_km2 FROM cor",
)
def corridor_mean(spark, sf):
    return corridor_all(spark, sf).withColumn("support_km2", F.col("corridor_support") / 1e6)


@query(
    "J-06 M-13",
    "receptor_id:i date:d value:f2 monthly_discount:f interaction:f2",
    f"""WITH {B.SQL_DENSE}, m AS (SELECT year(date) AS y, month(date) AS m, avg(discount) AS md FROM dense GROUP BY 1, 2)
        SELECT receptor_id, date, value, md AS monthly_discount, value * md AS interaction FROM dense JOIN m ON y = year(date) AND m = month(date)""",
)
def panel_with_monthly_field(spark, sf):
    p = B.dense_panel(spark, sf).withColumn("y", F.year("date")).withColumn("m", F.month("date"))
    monthly = p.groupBy("y", "m").agg(F.avg("discount").alias("monthly_discount"))
    return p.join(monthly, ["y", "m"]).withColumn("interaction", F.col("value") * F.col("monthly_discount"))


@query(
    "Q-13 A-30 A-31",
    "scenario:s receptor_id:i rows:i support_rows:i jaccard:f common_n:i pearson:f mae:f bias:f nrmse:f",
    f"""WITH {sql_kernel(policy.KERNEL_SCENARIOS)}, j AS (SELECT c.scenario, c.receptor_id, c.v AS t, b.v AS b, c.s > 0 AS ts, b.s > 0 AS bs FROM cor c JOIN cor b ON b.scenario = 'BASE' AND b.receptor_id = c.receptor_id AND b.vec_id = c.vec_id)
        SELECT scenario, receptor_id, count(*) AS rows, count(*) FILTER (WHERE ts) AS support_rows, count(*) FILTER (WHERE ts AND bs) / nullif(count(*) FILTER (WHERE ts OR bs), 0) AS jaccard,
          count(*) FILTER (WHERE t IS NOT NULL AND b IS NOT NULL) AS common_n, corr(b, t) AS pearson, avg(abs(t - b)) AS mae, avg(t - b) AS bias,
          sqrt(avg((t - b) ** 2)) / nullif(stddev_pop(b) FILTER (WHERE t IS NOT NULL), 0) AS nrmse FROM j GROUP BY 1, 2""",
)
def kernel_sensitivity(spark, sf):
    c = corridor_all(spark, sf, policy.KERNEL_SCENARIOS)
    return Q.sensitivity(c, ["scenario", "receptor_id"], ["receptor_id", "vec_id"], "corridor_value", "corridor_support")


ROBUST_SCENARIOS = tuple((n, 22.5, c, 700.0, 1600.0) for n, c in policy.SUPPORT_CUTOFFS.items())


def robustness(spark, sf):
    c = corridor_all(spark, sf, ROBUST_SCENARIOS)
    flags = c.groupBy("receptor_id", "vec_id").agg(
        *[F.bool_or((F.col("scenario") == n) & (F.col("corridor_support") > 0)).alias(n) for n in policy.SUPPORT_CUTOFFS]
    )
    return flags.withColumn("robustness", C.robustness_class(F.col("narrow"), F.col("baseline"), F.col("wide")))


SQL_ROB = f"""{sql_kernel(ROBUST_SCENARIOS)}, fl AS (SELECT receptor_id, vec_id, bool_or(scenario = 'narrow' AND s > 0) AS narrow, bool_or(scenario = 'baseline' AND s > 0) AS baseline, bool_or(scenario = 'wide' AND s > 0) AS wide FROM cor GROUP BY 1, 2),
  rb AS (SELECT *, CASE WHEN narrow AND baseline AND wide THEN 'ROBUST_MEDSEA_SUPPORT' WHEN NOT narrow AND baseline AND wide THEN 'BASELINE_ANGLE_SENSITIVE_SUPPORT'
    WHEN NOT narrow AND NOT baseline AND wide THEN 'WIDE_ONLY_MEDSEA_SUPPORT' WHEN NOT narrow AND NOT baseline AND NOT wide THEN 'NO_MEDSEA_SUPPORT_ALL' ELSE 'INCONSISTENT' END AS robustness FROM fl)"""


@query(
    "Q-14 O-04",
    "receptor_id:i vec_id:i narrow:b baseline:b wide:b robustness:s",
    f"WITH {SQL_ROB} SELECT * FROM rb",
)
def support_robustness(spark, sf):
    return robustness(spark, sf)


@query(
    "A-16",
    "receptor_id:i rows:i " + " ".join(f"{c.lower()}:i {c.lower()}_pct:f" for c in C.ROBUSTNESS_CLASSES),
    f"WITH {SQL_ROB} SELECT receptor_id, count(*) AS rows, "
    + ", ".join(
        f"count(*) FILTER (WHERE robustness = '{c}') AS {c.lower()}, 100.0 * count(*) FILTER (WHERE robustness = '{c}') / count(*) AS {c.lower()}_pct"
        for c in C.ROBUSTNESS_CLASSES
    )
    + " FROM rb GROUP BY 1",
)
def class_counts_wide(spark, sf):
    return C.class_pivot(robustness(spark, sf), ["receptor_id"], "robustness", C.ROBUSTNESS_CLASSES)


@query(
    "O-04",
    "rows:i inclusion_violations:i",
    f"WITH {SQL_ROB} SELECT count(*) AS rows, count(*) FILTER (WHERE (narrow AND NOT baseline) OR (baseline AND NOT wide)) AS inclusion_violations FROM rb",
)
def inclusion_audit(spark, sf):
    bad = (F.col("narrow") & ~F.col("baseline")) | (F.col("baseline") & ~F.col("wide"))
    return robustness(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("inclusion_violations"))


@query(
    "P-08 A-15 M-07",
    "receptor_id:i month:i sector_deg:f2 grouping_id:i rows:i supported_rows:i unsupported_rows:i inconsistent_rows:i supported_pct:f ivt_mean_supported:f ivt_mean_unsupported:f",
    f"""WITH {sql_kernel(BASE)}, x AS (SELECT receptor_id, month(DATE '1996-09-01' + CAST(vec_id // 8 AS INT)) AS month, (round_even(source_bearing / 22.5, 0) * 22.5) % 360 AS sector_deg,
          source_bearing / 10 AS ivt, v, s, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE v END AS v2 FROM cor),
        k AS (SELECT *, CASE WHEN s > 0 AND v IS NOT NULL AND v2 IS NOT NULL THEN 'MEDSEA_SUPPORTED' WHEN s <= 0 AND v IS NULL AND v2 IS NULL THEN 'NO_MEDSEA_SOURCE_SUPPORT' ELSE 'INCONSISTENT' END AS cls FROM x)
        SELECT receptor_id, month, sector_deg, grouping(receptor_id, month, sector_deg) AS grouping_id, count(*) AS rows, count(*) FILTER (WHERE cls = 'MEDSEA_SUPPORTED') AS supported_rows,
          count(*) FILTER (WHERE cls = 'NO_MEDSEA_SOURCE_SUPPORT') AS unsupported_rows, count(*) FILTER (WHERE cls = 'INCONSISTENT') AS inconsistent_rows,
          100.0 * count(*) FILTER (WHERE cls = 'MEDSEA_SUPPORTED') / count(*) AS supported_pct, avg(ivt) FILTER (WHERE cls = 'MEDSEA_SUPPORTED') AS ivt_mean_supported,
          avg(ivt) FILTER (WHERE cls = 'NO_MEDSEA_SOURCE_SUPPORT') AS ivt_mean_unsupported
        FROM k GROUP BY GROUPING SETS ((receptor_id), (month), (sector_deg), (receptor_id, month))""",
)
def corridor_support_summary(spark, sf):
    c = corridor_all(spark, sf)
    s, v = F.col("corridor_support"), F.col("corridor_value")
    other = F.when(F.col("vec_id") % 10 != 0, v)
    x = c.select(
        "receptor_id",
        F.month(F.date_add(F.lit("1996-09-01").cast("date"), F.floor(F.col("vec_id") / 8).cast("int"))).alias("month"),
        geo.sector_nearest(F.col("source_bearing")).alias("sector_deg"),
        (F.col("source_bearing") / 10).alias("ivt"),
        C.support_class(v, s, other, s).alias("cls"),
    )
    return C.support_summary(x, [["receptor_id"], ["month"], ["sector_deg"], ["receptor_id", "month"]], "cls", "ivt")
