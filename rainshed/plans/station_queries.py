"""Station series, network and audit queries (users of ``events`` as series, event types as variables)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rainshed.functions import text
from rainshed.operators import audits as A
from rainshed.operators import joins as J
from rainshed.operators import labels as L
from rainshed.operators import network as N
from rainshed.operators import panel as P
from rainshed.operators import stations as S
from rainshed.functions.text import norm_key
from rainshed.plans import bindings as B
from rainshed.plans.registry import query

POLICIES = {"purchase": "SUM", "error": "MAX", "signup": "MIN", "click": "CIRCULAR_MEAN"}
CODES = ("click", "error", "purchase", "signup", "view")
EXPECTED = 2


def events(spark, sf):
    return B.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


def daily(spark, sf):
    return S.daily_station(events(spark, sf), ["user_id"], "event_type", "ts", "value", F.lit(EXPECTED), POLICIES)


SQL_DAILY = """g AS (SELECT user_id, event_type, CAST(ts AS DATE) AS date_model, count(*) AS n, avg(value) AS m, min(value) AS lo, max(value) AS hi, sum(value) AS total,
    avg(sin(radians(value % 360))) AS s, avg(cos(radians(value % 360))) AS c FROM events GROUP BY 1, 2, 3),
  ang AS (SELECT *, CASE WHEN sqrt(s * s + c * c) >= 1e-12 THEN CASE WHEN degrees(atan2(s, c)) < 0 THEN degrees(atan2(s, c)) + 360 ELSE degrees(atan2(s, c)) END END AS angle FROM g),
  daily AS (SELECT user_id, event_type, date_model, 2 AS expected_count_per_day, n AS observed_count, n / 2 AS coverage_fraction,
    CASE WHEN n > 2 THEN 'OVERCOMPLETE' WHEN n = 2 THEN 'COMPLETE' ELSE 'PARTIAL' END AS day_completeness,
    CASE event_type WHEN 'purchase' THEN 'SUM' WHEN 'error' THEN 'MAX' WHEN 'signup' THEN 'MIN' WHEN 'click' THEN 'CIRCULAR_MEAN' ELSE 'MEAN' END AS daily_primary_statistic,
    CASE event_type WHEN 'purchase' THEN total WHEN 'error' THEN hi WHEN 'signup' THEN lo WHEN 'click' THEN angle ELSE m END AS daily_value,
    CASE WHEN event_type <> 'click' THEN m END AS daily_mean, CASE WHEN event_type <> 'click' THEN lo END AS daily_min, CASE WHEN event_type <> 'click' THEN hi END AS daily_max,
    CASE WHEN event_type <> 'click' THEN total END AS daily_sum, CASE WHEN event_type = 'click' THEN sqrt(s * s + c * c) END AS circular_resultant_strength FROM ang)"""


@query(
    "A-08 D-07 D-09",
    "user_id:i event_type:s date_model:d expected_count_per_day:i observed_count:i coverage_fraction:f day_completeness:s daily_primary_statistic:s daily_value:f daily_mean:f daily_min:f daily_max:f daily_sum:f circular_resultant_strength:f",
    f"WITH {SQL_DAILY} SELECT * FROM daily",
)
def daily_station_layer(spark, sf):
    return daily(spark, sf)


@query(
    "A-09 A-10",
    "event_type:s angle:f strength:f weighted_angle:f weighted_strength:f",
    """WITH e AS (SELECT event_type, radians(value % 360) AS r, user_id % 7 AS w FROM events),
       m AS (SELECT event_type, avg(sin(r)) AS s, avg(cos(r)) AS c, sum(sin(r) * w) FILTER (WHERE w > 0) / sum(w) FILTER (WHERE w > 0) AS ws, sum(cos(r) * w) FILTER (WHERE w > 0) / sum(w) FILTER (WHERE w > 0) AS wc FROM e GROUP BY 1)
       SELECT event_type, (degrees(atan2(s, c)) + 360) % 360 AS angle, sqrt(s * s + c * c) AS strength, (degrees(atan2(ws, wc)) + 360) % 360 AS weighted_angle, sqrt(ws * ws + wc * wc) AS weighted_strength FROM m""",
)
def circular_means(spark, sf):
    a, s = S.circular_mean(F.col("value"))
    wa, ws = S.circular_mean(F.col("value"), F.col("user_id") % 7)
    return events(spark, sf).groupBy("event_type").agg(
        a.alias("angle"), s.alias("strength"), wa.alias("weighted_angle"), ws.alias("weighted_strength")
    )


@query(
    "A-11 W-13",
    "user_id:i nominal_cadence_seconds:i expected_count_per_day:i cadence_method:s",
    """WITH d AS (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
       m AS (SELECT user_id, quantile_cont(gap, 0.5) AS med FROM d WHERE gap > 0 AND gap <= 21600 GROUP BY 1),
       i AS (SELECT user_id, quantile_cont(CAST(3600 * (1 + user_id % 2) AS DOUBLE), 0.5) AS iv FROM events WHERE user_id % 3 = 1 GROUP BY 1),
       u AS (SELECT DISTINCT user_id FROM events),
       e AS (SELECT u.user_id, iv, med, round_even(86400 / iv, 0) AS ei, round_even(86400 / med, 0) AS eg FROM u LEFT JOIN m USING (user_id) LEFT JOIN i USING (user_id)),
       k AS (SELECT *, CASE WHEN user_id % 10 = 0 THEN 'DAILY_SOURCE' WHEN ei >= 1 AND abs(ei * iv - 86400) <= greatest(1, iv * 0.01) THEN 'INTERVAL_SECONDS'
         WHEN eg >= 1 AND eg <= 288 AND abs(eg * med - 86400) <= greatest(1, med * 0.02) THEN 'MEDIAN_TIMESTAMP_DELTA' ELSE 'UNRESOLVED' END AS cadence_method FROM e)
       SELECT user_id, cadence_method, CASE cadence_method WHEN 'DAILY_SOURCE' THEN 86400 WHEN 'INTERVAL_SECONDS' THEN round_even(iv, 0) WHEN 'MEDIAN_TIMESTAMP_DELTA' THEN round_even(med, 0) END AS nominal_cadence_seconds,
         CASE cadence_method WHEN 'DAILY_SOURCE' THEN 1 WHEN 'INTERVAL_SECONDS' THEN ei WHEN 'MEDIAN_TIMESTAMP_DELTA' THEN eg END AS expected_count_per_day FROM k""",
)
def series_cadence(spark, sf):
    e = events(spark, sf).withColumn(
        "interval_seconds", F.when(F.col("user_id") % 3 == 1, 3600 * (1 + F.col("user_id") % 2))
    )
    return S.infer_cadence(e, ["user_id"], "ts", "interval_seconds", daily=F.col("user_id") % 10 == 0)


def mapped_daily(spark, sf):
    """Daily station rows with the one or two receptors of each user."""
    u = F.col("user_id")
    rel = F.when(u % 4 == 0, F.array(u % 5, (u + 1) % 5)).otherwise(F.array(u % 5))
    d = daily(spark, sf).withColumn("receptor_id", F.explode(rel))
    return d.withColumn("canonical_is_primary", F.col("receptor_id") == F.col("user_id") % 5).withColumn("station_key", F.col("user_id"))


SQL_MAPPED = f"""{SQL_DAILY}, mapped AS (SELECT *, receptor_id = user_id % 5 AS prim FROM (SELECT *, unnest(CASE WHEN user_id % 4 = 0 THEN [user_id % 5, (user_id + 1) % 5] ELSE [user_id % 5] END) AS receptor_id FROM daily)),
  wt AS (SELECT *, least(greatest(coalesce(coverage_fraction, 0), 0), 1) AS w, radians(((daily_value % 360) + 360) % 360) AS r FROM mapped),
  ns AS (SELECT receptor_id, event_type, date_model, count(DISTINCT user_id) AS station_count, count(DISTINCT user_id) FILTER (WHERE prim) AS primary_station_count,
    avg(coverage_fraction) AS coverage_mean, min(coverage_fraction) AS coverage_min, avg(CAST(day_completeness = 'COMPLETE' AS INT)) AS complete_fraction,
    avg(daily_value) AS mean, quantile_cont(daily_value, 0.5) AS median, min(daily_value) AS min, max(daily_value) AS max, quantile_cont(daily_value, 0.9) AS p90, stddev_pop(daily_value) AS std,
    sum(daily_value * w) / sum(w) AS coverage_weighted_mean, avg(sin(r)) AS s, avg(cos(r)) AS c FROM wt GROUP BY 1, 2, 3)"""


@query(
    "A-12",
    "receptor_id:i event_type:s date_model:d station_count:i primary_station_count:i coverage_mean:f coverage_min:f complete_fraction:f mean:f median:f min:f max:f p90:f std:f coverage_weighted_mean:f cmean:f2 resultant_strength:f",
    f"""WITH {SQL_MAPPED} SELECT receptor_id, event_type, date_model, station_count, primary_station_count, coverage_mean, coverage_min, complete_fraction,
        {', '.join(f"CASE WHEN event_type <> 'click' THEN {c} END AS {c}" for c in ('mean', 'median', 'min', 'max', 'p90', 'std', 'coverage_weighted_mean'))},
        CASE WHEN event_type = 'click' AND sqrt(s * s + c * c) >= 1e-12 THEN (degrees(atan2(s, c)) + 360) % 360 END AS cmean, CASE WHEN event_type = 'click' THEN sqrt(s * s + c * c) END AS resultant_strength FROM ns""",
)
def basin_network_statistics(spark, sf):
    stats = N.network_stats(mapped_daily(spark, sf), ["receptor_id", "event_type", "date_model"])
    return N.mask_by_kind(stats, F.col("event_type") == "click")


def candidates(spark, sf):
    """Activity interval of each station and variable of a receptor."""
    m = mapped_daily(spark, sf)
    return m.groupBy("receptor_id", "event_type", "station_key").agg(F.min("date_model").alias("d0"), F.max("date_model").alias("d1"))


SQL_CAND = f"""{SQL_MAPPED}, cand AS (SELECT receptor_id, event_type, user_id, min(date_model) AS d0, max(date_model) AS d1 FROM mapped GROUP BY 1, 2, 3),
  days AS (SELECT CAST(d AS DATE) AS date_model FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31', INTERVAL 1 DAY) t(d)),
  elig AS (SELECT receptor_id, event_type, date_model, count(DISTINCT user_id) AS eligible FROM cand JOIN days ON date_model BETWEEN d0 AND d1 GROUP BY 1, 2, 3)"""


@query(
    "J-09",
    "receptor_id:i event_type:s date:d active:i",
    f"WITH {SQL_CAND} SELECT receptor_id, event_type, date_model AS date, eligible AS active FROM elig",
)
def eligible_stations_per_day(spark, sf):
    return J.active_per_day(candidates(spark, sf), ["receptor_id", "event_type"], "station_key", "d0", "d1")


@query(
    "A-13",
    "receptor_id:i event_type:s date_model:d eligible_station_count:i station_count:i station_fraction:f",
    f"""WITH {SQL_CAND} SELECT receptor_id, event_type, date_model, coalesce(eligible, 0) AS eligible_station_count, station_count,
        CASE WHEN eligible > 0 THEN coalesce(station_count, 0) / eligible END AS station_fraction FROM elig FULL JOIN ns USING (receptor_id, event_type, date_model)""",
)
def station_fraction(spark, sf):
    group = ["receptor_id", "event_type"]
    m = mapped_daily(spark, sf)
    stats = m.groupBy(*group, "date_model").agg(F.countDistinct("station_key").alias("station_count"))
    return N.station_fraction(stats, candidates(spark, sf), group, "date_model", "station_key", "d0", "d1")


@query(
    "A-14",
    "receptor_id:i date_model:d " + " ".join(f"obs_{c}_station_count:i obs_{c}_coverage_mean:f" for c in CODES),
    f"WITH {SQL_MAPPED} SELECT receptor_id, date_model, "
    + ", ".join(
        f"max(station_count) FILTER (WHERE event_type = '{c}') AS obs_{c}_station_count, max(coverage_mean) FILTER (WHERE event_type = '{c}') AS obs_{c}_coverage_mean" for c in CODES
    )
    + " FROM ns GROUP BY 1, 2",
)
def wide_observation_panel(spark, sf):
    keys = ["receptor_id", "date_model"]
    stats = mapped_daily(spark, sf).groupBy(*keys, "event_type").agg(
        F.countDistinct("station_key").alias("station_count"), F.avg("coverage_fraction").alias("coverage_mean")
    )
    return N.widen(stats, keys, "event_type", CODES, ["station_count", "coverage_mean"])


@query(
    "A-32",
    "s_nationkey:i year:i rows:i unique_dates:i coverage_pct:f",
    """WITH x AS (SELECT s_nationkey, year(l_shipdate) AS year, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE month(l_shipdate) BETWEEN 9 AND 12),
       c AS (SELECT s_nationkey, year, count(*) AS rows, count(DISTINCT d) AS u FROM x GROUP BY 1, 2),
       g AS (SELECT DISTINCT s_nationkey, y AS year FROM x CROSS JOIN range(1994, 2003) t(y))
       SELECT g.s_nationkey, g.year, coalesce(rows, 0) AS rows, coalesce(u, 0) AS unique_dates, 100.0 * coalesce(u, 0) / 122 AS coverage_pct FROM g LEFT JOIN c ON c.s_nationkey = g.s_nationkey AND c.year = g.year""",
)
def station_year_coverage(spark, sf):
    s = B.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    inside = [F.col("l_shipdate").between(f"{y}-09-01", f"{y}-12-31 23:59:59.999999") for y in range(1994, 2003)]  # reaches the scan
    days = _ship_days(B.table(spark, sf, "lineitem").where(reduce(lambda a, b: a | b, inside)))
    return S.year_coverage(days.join(s, F.col("l_suppkey") == F.col("s_suppkey")), ["s_nationkey"], "day", 1994, 2002, rows=F.sum("n"))


def _ship_days(lineitem):
    """(l_suppkey, day, n) of the season's rows, counted before anything is joined."""
    li = lineitem.select("l_suppkey", F.to_date("l_shipdate").alias("day")).where(F.month("day").between(9, 12))
    return li.groupBy("l_suppkey", "day").agg(F.count(F.lit(1)).alias("n"))


SQL_BY = """cov AS (SELECT l_suppkey, year(l_shipdate) AS year, count(DISTINCT CAST(l_shipdate AS DATE)) AS days FROM lineitem WHERE month(l_shipdate) BETWEEN 9 AND 12 GROUP BY 1, 2),
  ex AS (SELECT unnest([l_suppkey % 5, 5 + l_suppkey % 3]) AS receptor_id, l_suppkey, year, days FROM cov),
  byy AS (SELECT receptor_id, year, count(DISTINCT l_suppkey) FILTER (WHERE days > 0) AS stations_with_data, sum(days) AS valid_station_days FROM ex GROUP BY 1, 2)"""


def _basin_year(spark, sf):
    k = F.col("l_suppkey")
    cov = (
        _ship_days(B.table(spark, sf, "lineitem"))
        .groupBy("l_suppkey", F.year("day").alias("year"))
        .agg(F.count(F.lit(1)).alias("days"))
        .withColumn("receptors", F.array(k % 5, 5 + k % 3))
    )
    return S.basin_year(cov, "receptors", "l_suppkey", "year", "days")


@query("A-33", "receptor_id:i year:i stations_with_data:i valid_station_days:i", f"WITH {SQL_BY} SELECT * FROM byy")
def basin_year_counts(spark, sf):
    return _basin_year(spark, sf)


@query(
    "A-33",
    "receptor_id:i years_total:i years_with_data:i median_stations:f max_stations:i",
    f"WITH {SQL_BY} SELECT receptor_id, count(*) AS years_total, count(*) FILTER (WHERE stations_with_data > 0) AS years_with_data, quantile_cont(stations_with_data, 0.5) AS median_stations, max(stations_with_data) AS max_stations FROM byy GROUP BY 1",
)
def basin_station_summary(spark, sf):
    return S.basin_summary(_basin_year(spark, sf), "year")


# ---- audits ------------------------------------------------------------------------------------------------------
@query(
    "A-34",
    "unit:i time_count:i expected_time_count:i missing_times:i extra_times:i duplicate_times:i out_of_order_times:i median_step_seconds:f3",
    """WITH e AS (SELECT user_id % 5 AS unit, event_id, CASE WHEN user_id % 11 = 0 THEN ts ELSE date_trunc('hour', ts) END AS t FROM events),
       x AS (SELECT u AS unit, d AS t FROM range(5) r(u) CROSS JOIN generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR) g(d)),
       p AS (SELECT unit, t, count(*) AS n FROM e GROUP BY 1, 2),
       b AS (SELECT coalesce(x.unit, p.unit) AS unit, x.t IS NOT NULL AS want, n FROM x FULL JOIN p ON x.unit = p.unit AND x.t = p.t),
       c AS (SELECT unit, coalesce(sum(n), 0) AS time_count, count(*) FILTER (WHERE want) AS expected_time_count, count(*) FILTER (WHERE want AND n IS NULL) AS missing_times,
         count(*) FILTER (WHERE NOT want) AS extra_times, coalesce(sum(n - 1), 0) AS duplicate_times FROM b GROUP BY 1),
       h AS (SELECT unit, epoch_us(t) / 1e6 - lag(epoch_us(t) / 1e6) OVER (PARTITION BY unit ORDER BY event_id) AS hop FROM e),
       m AS (SELECT unit, count(*) FILTER (WHERE hop < 0) AS out_of_order_times, quantile_cont(hop, 0.5) AS median_step_seconds FROM h WHERE hop IS NOT NULL GROUP BY 1)
       SELECT * FROM c JOIN m USING (unit)""",
)
def time_axis_audit(spark, sf):
    e = events(spark, sf).select(
        (F.col("user_id") % 5).alias("unit"),
        "event_id",
        F.when(F.col("user_id") % 11 == 0, F.col("ts").cast("timestamp")).otherwise(F.date_trunc("hour", "ts").cast("timestamp")).alias("t"),
    )
    start, end = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-30 23:00:00").cast("timestamp")
    return A.time_audit(e, ["unit"], "t", "event_id", F.min(start), F.min(end), "INTERVAL 1 HOUR", 4096.0)


@query(
    "A-34",
    "event_type:s rows:i out_of_month_times:i",
    "SELECT event_type, count(*) AS rows, count(*) FILTER (WHERE year(ts) <> 2024 OR month(ts) <> 1) AS out_of_month_times FROM events GROUP BY 1",
)
def out_of_month_audit(spark, sf):
    return A.out_of_month(events(spark, sf), ["event_type"], "ts", F.lit(2024), F.lit(1))


@query(
    "A-35",
    "vec_id:i cells:i lat_min:f lon_max:f lat_first:f lon_last:f grid_matches:b",
    """WITH c AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
       x AS (SELECT vec_id, i, 40 + (CASE WHEN vec_id % 50 = 9 THEN 7 - (i - 1) // 8 ELSE (i - 1) // 8 END) * CASE WHEN vec_id % 50 = 7 THEN 0.6 ELSE 0.5 END AS lat, 5 + 0.5 * ((i - 1) % 8) AS lon FROM c)
       SELECT vec_id, count(*) AS cells, min(lat) AS lat_min, max(lon) AS lon_max, arg_min(lat, i) AS lat_first, arg_max(lon, i) AS lon_last,
         count(*) = 64 AND abs(max(lat) - 43.5) <= 1e-8 AND abs(arg_min(lat, i) - 40) <= 1e-8 AS grid_matches FROM x GROUP BY 1""",
)
def grid_consistency(spark, sf):
    from rainshed.plans.field_queries import field

    stretch = F.when(F.col("vec_id") % 50 == 7, 0.6).otherwise(0.5)
    row = F.when(F.col("vec_id") % 50 == 9, 7 - F.col("lat_idx")).otherwise(F.col("lat_idx"))  # a flipped axis
    f = field(spark, sf).select("vec_id", "cell_id", (40 + row * stretch).alias("lat"), "lon")
    return A.grid_audit(f, "vec_id", "cell_id")


@query(
    "A-36",
    "label:i values_n:i finite:i missing:i negative:i min_value:f max_value:f",
    """WITH c AS (SELECT label, unnest([CAST(x AS DOUBLE) FOR x IN embedding]) AS v FROM embeddings)
       SELECT label, count(*) AS values_n, count(*) FILTER (WHERE v <= 0.2) AS finite, count(*) FILTER (WHERE v > 0.2) AS missing, count(*) FILTER (WHERE v < 0) AS negative,
         min(v) FILTER (WHERE v <= 0.2) AS min_value, max(v) FILTER (WHERE v <= 0.2) AS max_value FROM c GROUP BY 1""",
)
def value_audit(spark, sf):
    e = B.table(spark, sf, "embeddings").select("label", F.explode("embedding").alias("x"))
    v = F.col("x").cast("double")
    return A.value_audit(e.select("label", F.when(v <= 0.2, v).otherwise(float("nan")).alias("v")), ["label"], "v").withColumnRenamed("values", "values_n")


@query(
    "P-10",
    "user_id:i numeric_n:i reasons:s status:s",
    """WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS numeric_n, count(*) FILTER (WHERE value > 300) AS big, count(*) FILTER (WHERE value < 0.5) AS small FROM events GROUP BY 1)
       SELECT user_id, numeric_n, concat_ws(';', CASE WHEN big > 0 THEN 'OUT_OF_PERIOD=' || big END, CASE WHEN small > 0 THEN 'INVALID_CORE_VALUES=' || small END) AS reasons,
         CASE WHEN big > 0 OR small > 0 THEN 'REVIEW' WHEN numeric_n > 0 THEN 'DATA_OK' ELSE 'NO_DATA_SOURCE' END AS status FROM c""",
)
def series_status(spark, sf):
    v = F.col("value")
    c = events(spark, sf).groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("numeric_n"),
        F.count_if(v > 300).alias("big"),
        F.count_if(v < 0.5).alias("small"),
    )
    r = A.review_reasons({"OUT_OF_PERIOD": F.col("big"), "INVALID_CORE_VALUES": F.col("small")})
    c = c.withColumn("r", r)
    return c.select("user_id", "numeric_n", F.array_join("r", ";").alias("reasons"), A.series_status(F.col("numeric_n"), F.col("r")).alias("status"))


@query(
    "P-11",
    "p_partkey:i plausible:b sentinel:s",
    """WITH x AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'radiazione totale/W/m2' WHEN 1 THEN 'pressione/hpa' WHEN 2 THEN 'pressione/kpa' ELSE 'other' END AS k, p_size % 3 AS suspects FROM part)
       SELECT p_partkey, k IN ('radiazione totale/W/m2', 'pressione/hpa') AS plausible, CASE WHEN suspects <= 0 THEN 'NONE' WHEN k IN ('radiazione totale/W/m2', 'pressione/hpa') THEN 'FALSE_POSITIVE_999_PHYSICALLY_PLAUSIBLE' ELSE 'REVIEW' END AS sentinel FROM x""",
)
def plausible_sentinels(spark, sf):
    k = F.col("p_size") % 4
    par = F.when(k == 0, " Radiazione totale").when(k < 3, "Pressione").otherwise(F.col("p_name"))
    unit = F.when(k == 0, "W/m2").when(k == 1, "hPa").otherwise("kPa")
    ok = A.plausible_999(par, unit)
    return B.table(spark, sf, "part").select("p_partkey", ok.alias("plausible"), A.sentinel_status(F.col("p_size") % 3, ok).alias("sentinel"))


# ---- relations ---------------------------------------------------------------------------------------------------
def relations(spark, sf):
    k = F.col("o_custkey")
    return B.table(spark, sf, "orders").select(
        k.cast("string").alias("source_series_id"),
        F.concat(F.lit("R"), (F.col("o_orderkey") % 3).cast("string")).alias("receptor_id"),
        ((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")).alias("is_primary"),
        F.when(k % 4 == 3, " ").otherwise(F.concat(F.lit("R"), (k % 4).cast("string"))).alias("nearest_receptor"),
        text.split_codes(F.when(k % 5 == 0, "").when(k % 5 == 1, "R0").otherwise("R0|R1 |R2")).alias("receptor_ids_source"),
    )


SQL_RES = """rel AS (SELECT o_custkey AS k, 'R' || (o_orderkey % 3) AS receptor_id, bool_or(o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AS t FROM orders GROUP BY 1, 2),
  gg AS (SELECT k, list(receptor_id ORDER BY receptor_id) AS receptors, coalesce(list(receptor_id ORDER BY receptor_id) FILTER (WHERE t), []) AS tr FROM rel GROUP BY 1),
  nn AS (SELECT *, CASE WHEN k % 4 = 3 THEN NULL ELSE 'R' || (k % 4) END AS nearest, CASE WHEN k % 5 = 0 THEN [] WHEN k % 5 = 1 THEN ['R0'] ELSE ['R0', 'R1', 'R2'] END AS src FROM gg),
  res AS (SELECT *, CASE WHEN len(tr) > 1 THEN 'MULTIPLE_TRUE_PRIMARY' WHEN len(tr) = 1 THEN 'RELATION_TABLE' WHEN len(receptors) = 1 THEN 'SINGLE_RELATION_FALLBACK'
    WHEN nearest IS NULL THEN 'MULTI_RELATION_NEAREST_EMPTY' WHEN NOT list_contains(receptors, nearest) THEN 'NEAREST_NOT_IN_RELATIONS' WHEN len(src) = 0 THEN 'RECEPTOR_IDS_SOURCE_EMPTY'
    WHEN src <> receptors THEN 'SOURCE_RELATION_SET_MISMATCH' ELSE 'NEAREST_RECEPTOR_VALIDATED' END AS resolution FROM nn),
  prim AS (SELECT *, CASE resolution WHEN 'RELATION_TABLE' THEN tr[1] WHEN 'SINGLE_RELATION_FALLBACK' THEN receptors[1] WHEN 'NEAREST_RECEPTOR_VALIDATED' THEN nearest END AS primary_receptor FROM res)"""


@query(
    "Q-04 D-08",
    "source_series_id:s receptors:s resolution:s primary_receptor:s",
    f"WITH {SQL_RES} SELECT CAST(k AS VARCHAR) AS source_series_id, array_to_string(receptors, '|') AS receptors, resolution, primary_receptor FROM prim",
)
def primary_resolution(spark, sf):
    return N.resolve_primary(relations(spark, sf)).withColumn("receptors", F.array_join("receptors", "|"))


@query(
    "Q-04 Q-05",
    "source_series_id:s receptor_id:s canonical_is_primary:b",
    f"WITH {SQL_RES} SELECT source_series_id, receptor_id, receptor_id = primary_receptor AS canonical_is_primary FROM (SELECT CAST(k AS VARCHAR) AS source_series_id, unnest(receptors) AS receptor_id, primary_receptor FROM prim WHERE primary_receptor IS NOT NULL)",
)
def canonical_mapping(spark, sf):
    return N.canonical_relations(N.resolve_primary(relations(spark, sf)))


@query(
    "Q-05",
    "source_series_id:s relation_count:i primary_count:i",
    """WITH rel AS (SELECT o_custkey AS k, o_orderkey % 3 AS r, bool_or(o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AS t FROM orders GROUP BY 1, 2)
       SELECT CAST(k AS VARCHAR) AS source_series_id, count(*) AS relation_count, count(*) FILTER (WHERE t) AS primary_count FROM rel GROUP BY 1 HAVING count(*) FILTER (WHERE t) <> 1""",
)
def primary_count_violations(spark, sf):
    r = relations(spark, sf).groupBy("source_series_id", "receptor_id").agg(F.bool_or("is_primary").alias("canonical_is_primary"))
    return N.primary_violations(r)


@query(
    "J-04 O-01",
    "s_suppkey:i provider:s receptor_id:s",
    """WITH s AS (SELECT *, ['ARPA_PIEMONTE', 'CENTRO_FUNZIONALE_RAVDA', 'ARPAL'][1 + s_suppkey % 3] AS provider, s_suppkey % 2 AS kind FROM supplier)
       SELECT s_suppkey, provider, CASE provider WHEN 'ARPA_PIEMONTE' THEN CASE WHEN kind = 0 THEN 'A' || n_nationkey END WHEN 'CENTRO_FUNZIONALE_RAVDA' THEN 'B' || n_nationkey ELSE 'C' || n_nationkey END AS receptor_id
       FROM s LEFT JOIN nation ON n_nationkey = s_nationkey""",
)
def provider_aware_join(spark, sf):
    names = F.array(*[F.lit(x) for x in ("ARPA_PIEMONTE", "CENTRO_FUNZIONALE_RAVDA", "ARPAL")])
    s = B.table(spark, sf, "supplier").select(
        "s_suppkey",
        F.get(names, (F.col("s_suppkey") % 3).cast("int")).alias("provider"),
        F.col("s_nationkey").cast("string").alias("station_id"),
        (F.col("s_suppkey") % 2).cast("string").alias("kind_source"),
        F.concat(F.lit("t"), F.col("s_nationkey")).alias("target"),
    )
    n = B.table(spark, sf, "nation").select("n_nationkey", F.posexplode(names).alias("i", "provider"))
    k = F.col("n_nationkey").cast("string")
    rel = n.select(
        "provider",
        F.when(F.col("provider") == "ARPAL", F.concat(F.lit("t"), k)).otherwise(k).alias("station_or_target_id"),
        F.lit("0").alias("kind_source"),
        F.concat(F.get(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.col("i")), k).alias("receptor_id"),
    )
    return N.provider_join(s, rel)


@query(
    "A-37",
    "receptor_id:i variable_code:s providers:s series_count:i station_count:i primary_series_count:i daily_rows_total:i date_min:d date_max:d",
    """WITH x AS (SELECT c_nationkey AS receptor_id, o_orderpriority AS variable_code, o_custkey, max(c_mktsegment) AS provider, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS d0, max(CAST(o_orderdate AS DATE)) AS d1
         FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)
       SELECT receptor_id, variable_code, array_to_string(list_sort(list(DISTINCT provider)), '|') AS providers, count(DISTINCT o_custkey) AS series_count, count(DISTINCT o_custkey % 100) AS station_count,
         count(*) FILTER (WHERE o_custkey % 3 = 0) AS primary_series_count, sum(n) AS daily_rows_total, min(d0) AS date_min, max(d1) AS date_max FROM x GROUP BY 1, 2""",
)
def mapping_coverage(spark, sf):
    o, c = B.table(spark, sf, "orders"), B.table(spark, sf, "customer")
    day = F.to_date("o_orderdate")
    x = (
        o.join(c, o.o_custkey == c.c_custkey)
        .groupBy(F.col("c_nationkey").alias("receptor_id"), F.col("o_orderpriority").alias("variable_code"), F.col("o_custkey").alias("source_series_id"))
        .agg(F.max("c_mktsegment").alias("provider"), F.count(F.lit(1)).alias("daily_rows"), F.min(day).alias("date_min"), F.max(day).alias("date_max"))
        .withColumn("station_id", F.col("source_series_id") % 100)
        .withColumn("canonical_is_primary", F.col("source_series_id") % 3 == 0)
    )
    return N.mapping_coverage(x)


@query(
    "A-38",
    "fold_id:s receptor_id:i feature_count:i minimum_availability:f mean_availability:f eligible:b",
    f"""WITH {B.SQL_DENSE}, {B.SQL_FOLDS}, {B.sql_expand('dense')}, a AS (SELECT fold_id, receptor_id, unnest(['value', 'discount', 'lagged']) AS feature_column,
          unnest([count(value) / count(*), count(discount) / count(*), count(CASE WHEN season_day > 20 THEN value END) / count(*)]) AS availability FROM expanded WHERE partition = 'FIT' GROUP BY 1, 2)
        SELECT fold_id, receptor_id, count(DISTINCT feature_column) AS feature_count, min(availability) AS minimum_availability, avg(availability) AS mean_availability,
          count(DISTINCT feature_column) = 3 AND min(availability) >= 0.8 AS eligible FROM a GROUP BY 1, 2""",
)
def observation_eligibility(spark, sf):
    p = B.dense_panel(spark, sf).withColumn("lagged", F.when(F.col("season_day") > 20, F.col("value")))
    fit = L.expand_folds(p, B.FOLDS).where("partition = 'FIT'")
    cols = ["value", "discount", "lagged"]
    a = fit.groupBy("fold_id", "receptor_id").agg(*[(F.count(c) / F.count(F.lit(1))).alias(c) for c in cols])
    long = a.unpivot(["fold_id", "receptor_id"], cols, "feature_column", "availability_fraction")
    return N.observation_eligibility(long, len(cols))


# ---- joins -------------------------------------------------------------------------------------------------------
@query(
    "J-01",
    "o_orderkey:i c_nationkey:i price:f2",
    "SELECT o_orderkey, c_nationkey, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey",
)
def validated_join(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("price"))
    c = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), "c_nationkey")
    return P.validated_join(o, c, ["custkey"], "inner", "many_to_one")


@query(
    "J-02",
    "c_mktsegment:s rows:i match_fraction:f",
    """WITH o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
       SELECT c_mktsegment, count(*) AS rows, avg(CAST(o_custkey IS NOT NULL AS INT)) AS match_fraction FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1""",
)
def match_fraction(spark, sf):
    c = B.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    o = B.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return P.match_fraction(P.indicator_join(c, o, ["c_custkey"]), ["c_mktsegment"])


@query(
    "J-03 Q-06",
    "c_custkey:i presence:s same_nationkey:b same_acctbal:b",
    """WITH a AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'),
       b AS (SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey, c_acctbal FROM customer WHERE c_mktsegment <> 'MACHINERY')
       SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'right_only' WHEN b.c_custkey IS NULL THEN 'left_only' ELSE 'both' END AS presence,
         a.c_nationkey IS NOT DISTINCT FROM b.c_nationkey AS same_nationkey, a.c_acctbal IS NOT DISTINCT FROM b.c_acctbal AS same_acctbal FROM a FULL JOIN b ON a.c_custkey = b.c_custkey""",
)
def reconciliation(spark, sf):
    a, b = _two_versions(spark, sf)
    r = P.reconcile(a, b, ["c_custkey"], ["nationkey", "acctbal"])
    return r


def _two_versions(spark, sf):
    c = B.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"))
    a = c.where("c_mktsegment <> 'BUILDING'")
    b = c.where("c_mktsegment <> 'MACHINERY'").withColumn("nationkey", F.when(F.col("c_custkey") % 17 != 0, F.col("nationkey")))
    return a, b


@query(
    "Q-06",
    "both_rows:i left_only_rows:i right_only_rows:i diff_nationkey:i diff_acctbal:i",
    """SELECT count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS both_rows, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS left_only_rows,
       count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS right_only_rows, count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_custkey % 17 = 0) AS diff_nationkey, 0 AS diff_acctbal FROM customer""",
)
def reproduction_audit(spark, sf):
    a, b = _two_versions(spark, sf)
    cols = ["nationkey", "acctbal"]
    return P.reconcile_summary(P.reconcile(a, b, ["c_custkey"], cols), cols)


@query(
    "J-11",
    "receptor_id:i run_id:i days:i total:f2 peak:f2",
    f"""WITH {B.SQL_CAL}, {B.SQL_ORDERS_DAILY}, f AS (SELECT receptor_id, date, CASE WHEN date_diff('day', lag(date) OVER w, date) <= 2 THEN 0 ELSE 1 END AS new FROM orders_daily WINDOW w AS (PARTITION BY receptor_id ORDER BY date)),
        r AS (SELECT receptor_id, date, sum(new) OVER (PARTITION BY receptor_id ORDER BY date) - 1 AS run_id FROM f), ev AS (SELECT receptor_id, run_id, min(date) AS s, max(date) AS e FROM r GROUP BY 1, 2)
        SELECT ev.receptor_id, run_id, count(*) AS days, sum(value) AS total, max(value) AS peak FROM ev JOIN orders_daily d ON d.receptor_id = ev.receptor_id AND d.date BETWEEN s AND e GROUP BY 1, 2""",
)
def event_window_join(spark, sf):
    from rainshed.operators.windows import runs

    d = B.orders_daily(spark, sf)
    ev = runs(d, ["receptor_id"], "date", merge_gap=1).select("receptor_id", "run_id", "start_date", "end_date")
    j = J.day_in_interval(ev, d, ["receptor_id"], "start_date", "end_date", "date")
    return j.groupBy("receptor_id", "run_id").agg(F.count(F.lit(1)).alias("days"), F.sum("value").alias("total"), F.max("value").alias("peak"))


@query("J-12", "c_custkey:i", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def unmatched_keys(spark, sf):
    o = B.table(spark, sf, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return B.table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query(
    "J-13",
    "s_suppkey:i in_scope:b",
    "SELECT s_suppkey, s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) AS in_scope FROM supplier",
)
def scope_flag(spark, sf):
    known = B.table(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("s_nationkey")).distinct()
    s = B.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return P.indicator_join(s, known, ["s_nationkey"]).withColumn("in_scope", F.col("match") == "both")


@query(
    "J-13",
    "s_suppkey:i",
    "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)",
)
def known_ids_only(spark, sf):
    known = B.table(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("s_nationkey"))
    return B.table(spark, sf, "supplier").join(known, "s_nationkey", "left_semi")


@query(
    "J-15 F-09",
    "c_custkey:i position:i s_name:s score:f2",
    """WITH w AS (SELECT c_custkey, unnest([c_custkey % 211, c_custkey % 53, c_custkey % 7]) AS s_suppkey, unnest([0, 1, 2]) AS position FROM customer)
       SELECT c_custkey, position, s_name, s_acctbal AS score FROM w JOIN supplier s ON s.s_suppkey = w.s_suppkey
       QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY position, s_acctbal DESC, w.s_suppkey) = 1""",
)
def priority_station_choice(spark, sf):
    """Wanted names are written otherwise than the registry's: lower case, an accent, marks for separators."""
    s = B.table(spark, sf, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").alias("score"))
    k = F.col("c_custkey")
    keys = B.table(spark, sf, "customer").select("c_custkey", F.posexplode(F.array(k % 211, k % 53, k % 7)).alias("position", "s_suppkey"))
    odd = F.regexp_replace(F.regexp_replace(F.lower("s_name"), "u", "ù"), "[^a-zù0-9]+", "-")
    named = keys.join(s.select("s_suppkey", odd.alias("wanted")), "s_suppkey", "left")
    w = named.groupBy("c_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "wanted"))), lambda x: x["wanted"]).alias("choices"))
    return J.priority_lookup(w, "c_custkey", "choices", s.drop("s_suppkey"), "s_name", "score", norm_key)


@query(
    "F-08",
    "s_suppkey:i s_nationkey:i s_acctbal:f2",
    "SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_discount > 0.09) THEN -1.0 ELSE s_acctbal END AS s_acctbal FROM supplier",
)
def registry_patch(spark, sf):
    up = B.table(spark, sf, "lineitem").where("l_quantity >= 50 AND l_discount > 0.09").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return J.keyed_update(B.table(spark, sf, "supplier"), up.withColumn("s_acctbal", F.lit(-1.0)), ["s_suppkey"], ["s_acctbal"])


# ---- set operations ----------------------------------------------------------------------------------------------
@query(
    "O-01 S-08",
    "k:i name:s balance:f2 segment:s",
    "SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier",
)
def union_by_name(spark, sf):
    c = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query("O-02", "l_suppkey:i l_returnflag:s", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_pairs(spark, sf):
    return B.table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag").dropDuplicates()


@query(
    "O-03 P-07",
    "side:s nationkey:i",
    """SELECT 'missing' AS side, n AS nationkey FROM (SELECT c_nationkey AS n FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)
       UNION ALL SELECT 'extra', n FROM (SELECT s_nationkey AS n FROM supplier WHERE s_acctbal > 9000 EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)""",
)
def set_differences(spark, sf):
    c, s = B.table(spark, sf, "customer"), B.table(spark, sf, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("nationkey"))
    missing = c.select(F.col("c_nationkey").alias("nationkey")).subtract(s).withColumn("side", F.lit("missing"))
    extra = s.subtract(c.where("c_acctbal > 9900").select(F.col("c_nationkey").alias("nationkey"))).withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)
