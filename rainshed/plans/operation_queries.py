"""Admission, master assembly and daily operation on the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainshed.functions import text
from rainshed.operators import labels as L
from rainshed.operators import master as M
from rainshed.operators import operate as O
from rainshed.operators import panel as P
from rainshed.operators import windows as W
from rainshed.plans import bindings as B
from rainshed.plans.function_queries import sql_slug
from rainshed.plans.panel_queries import _day, _frame, _full, _sql_runs, labels
from rainshed.plans.registry import query
from rainshed.sources.integrity import written

KEY = ["receptor_id"]


# ---- admission ---------------------------------------------------------------------------------------------------
CLASSES = ("CORE_CAUSAL", "CORE_CAUSAL_STRUCTURAL_LAG_GAP", "CORE_CAUSAL_CONDITIONAL_SUPPORT", "SUPPORT_STATE_COMPANION", "DIAGNOSTIC")


@query(
    "P-04 D-13",
    "p_partkey:i include:b model_role:s reason:s missingness_semantics:s",
    f"""WITH i AS (SELECT p_partkey, p_type AS source, p_name AS f, {list(CLASSES)}[1 + p_size % 5] AS cls FROM part),
        e AS (SELECT *, CASE WHEN source = 'ECONOMY' AND f = 'small ring' THEN 'REDUNDANT' END AS ex, source = 'PROMO' AND f = 'red widget' AS cal, cls LIKE 'CORE%' AS prim, cls = 'SUPPORT_STATE_COMPANION' AND f IN ('small ring', 'red widget') AS comp FROM i),
        r AS (SELECT *, CASE WHEN ex IS NOT NULL THEN NULL WHEN cal THEN 'PRIMARY_CALENDAR_KNOWN' WHEN prim THEN 'PRIMARY_DYNAMIC_CORE' WHEN comp THEN 'PRIMARY_SUPPORT_COMPANION' END AS model_role FROM e)
        SELECT p_partkey, model_role IS NOT NULL AS include, model_role, CASE WHEN ex IS NOT NULL THEN ex WHEN cal THEN 'CANONICAL_SEASON_PROGRESS_INDEX' WHEN prim THEN cls WHEN comp THEN 'REQUIRED_TO_INTERPRET_CONDITIONAL_MEDSEA_FEATURES'
            WHEN cls = 'SUPPORT_STATE_COMPANION' THEN 'SUPPORT_COMPANION_NOT_SELECTED_FOR_PRIMARY_CORE' ELSE 'FEATURE_CLASS_' || cls END AS reason,
          CASE WHEN model_role IS NULL THEN NULL WHEN model_role = 'PRIMARY_SUPPORT_COMPANION' THEN 'SUPPORT_STATE' WHEN cls = 'CORE_CAUSAL_STRUCTURAL_LAG_GAP' THEN 'STRUCTURAL_SEASON_EDGE_NAN'
            WHEN cls = 'CORE_CAUSAL_CONDITIONAL_SUPPORT' THEN 'CONDITIONAL_MEDSEA_SUPPORT__NO_ZERO_IMPUTATION' ELSE 'STANDARD' END AS missingness_semantics FROM r""",
)
def feature_admission(spark, sf):
    cls = F.get(F.array(*[F.lit(c) for c in CLASSES]), (F.col("p_size") % 5).cast("int"))
    inv = B.table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("source"), F.col("p_name").alias("feature_column"), cls.alias("feature_class"))
    return M.admit_features(inv, {("ECONOMY", "small ring"): "REDUNDANT"}, [("PROMO", "red widget")], ["small ring", "red widget"])


@query(
    "P-05",
    "feature_column:s include:b exclusion_reason:s",
    """WITH d AS (SELECT DISTINCT p_name AS feature_column FROM part), w AS (SELECT p_name, max(p_size) AS m, min(p_retailprice) AS lo FROM part GROUP BY 1)
       SELECT feature_column, feature_column LIKE 's%' AS include, CASE WHEN feature_column LIKE 's%' THEN NULL WHEN feature_column LIKE '%ring' THEN 'REDUNDANT_' || upper(split_part(feature_column, ' ', 1)) ELSE 'NOT_SELECTED_FOR_PARSIMONIOUS_PRIMARY_STATIC_CORE' END AS exclusion_reason FROM d""",
)
def static_admission(spark, sf):
    d = B.table(spark, sf, "part").select(F.col("p_name").alias("feature_column")).distinct()
    white = d.where(F.col("feature_column").startswith("s"))
    reasons = d.where(F.col("feature_column").endswith("ring")).withColumn(
        "exclusion_reason", F.concat(F.lit("REDUNDANT_"), F.upper(F.substring_index("feature_column", " ", 1)))
    )
    return M.admit_static(d, white, reasons)


_RAW = "replace(p_name, ' ', '_')"


@query(
    "P-06",
    "canonical:s source_column:s method:s",
    f"""WITH c AS (SELECT DISTINCT {_RAW} AS raw FROM part),
        a AS (SELECT CASE length(raw) % 5 WHEN 0 THEN 'static__' || raw WHEN 1 THEN raw WHEN 2 THEN upper(raw) WHEN 3 THEN 'src_' || raw END AS col FROM c WHERE length(raw) % 5 < 4),
        sx AS (SELECT raw, count(*) AS n, min(col) AS col FROM c JOIN a ON ends_with(lower(col), lower(raw)) GROUP BY 1),
        h AS (SELECT raw, col, 0 AS rnk, 'EXACT_CANONICAL' AS method FROM c JOIN a ON col = 'static__' || raw UNION ALL SELECT raw, col, 1, 'EXACT_UNPREFIXED' FROM c JOIN a ON col = raw
          UNION ALL SELECT raw, col, 2, 'CASE_INSENSITIVE_UNPREFIXED' FROM c JOIN a ON lower(col) = lower(raw) AND col <> raw UNION ALL SELECT raw, col, 4, 'UNIQUE_SUFFIX_MATCH' FROM sx WHERE n = 1),
        b AS (SELECT raw, arg_min(col, rnk) AS col, arg_min(method, rnk) AS method, min(rnk) AS r, count(DISTINCT col) AS k FROM h GROUP BY 1)
        SELECT 'static__' || raw AS canonical, CASE WHEN r = 0 OR k = 1 THEN col END AS source_column, CASE WHEN r IS NULL THEN 'UNRESOLVED' WHEN r > 0 AND k > 1 THEN 'AMBIGUOUS' ELSE method END AS method FROM c LEFT JOIN b USING (raw)""",
)
def canonical_names(spark, sf):
    raw = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    c = B.table(spark, sf, "part").select(raw.alias("raw")).distinct()
    k, r = F.length("raw") % 5, F.col("raw")
    col = F.when(k == 0, F.concat(F.lit("static__"), r)).when(k == 1, r).when(k == 2, F.upper(r)).when(k == 3, F.concat(F.lit("src_"), r))
    available = c.select(col.alias("col")).where(F.col("col").isNotNull())
    canonical = c.select(F.concat(F.lit("static__"), r).alias("name"))
    declared = canonical.select("name", F.concat(F.lit("not_"), F.reverse("name")).alias("col"))
    return M.map_names(canonical, available, declared)


@query(
    "P-07 O-03",
    "o_custkey:i missing:s",
    """SELECT o_custkey, array_to_string(list_filter(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], lambda x: NOT list_contains(seen, x)), '|') AS missing
       FROM (SELECT o_custkey, list(DISTINCT o_orderpriority) AS seen FROM orders GROUP BY 1)""",
)
def expected_set_check(spark, sf):
    want = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    g = B.table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("seen"))
    return g.select("o_custkey", F.array_join(F.array_except(want, F.col("seen")), "|").alias("missing"))


@query(
    "P-13",
    "receptor_id:i run_id:i start_date:d end_date:d retrieval_start:d retrieval_end:d",
    f"WITH {B.SQL_CAL}, {B.SQL_ORDERS_DAILY}, r1 AS (WITH {_sql_runs(1, 'orders_daily')}) SELECT *, start_date - 3 AS retrieval_start, end_date + 3 AS retrieval_end FROM r1",
)
def padded_retrieval_windows(spark, sf):
    return O.padded_windows(W.runs(B.orders_daily(spark, sf), KEY, "date", merge_gap=1), "start_date", "end_date")


FEATURES = (
    "era5__ivt_mag_mean", "tcwv_change_24h", "cape_max", "precip_max_1h_mm", "precip_prev7d_mm", "precip_3d_incl_today_mm", "qwind850_proxy",
    "soil_water_l1_prev1d", "season_day", "visibility_change_24h", "ivt_dir_sin", "ivt_dir_veer", "sst_anom_x_ivt_proxy", "ohc_0_100m_anom_prev1d",
    "tmean_0_100m", "support_weight_sum", "medsea_support_robust_core", "sst_anom_mean", "salinity", "mslp_min", "snow_depth_mwe", "precip_max_1h_prev1d", "t700_mean", "unknown_prev3d",
)


def _sql_has(*parts: str) -> str:
    return "(" + " OR ".join(f"contains(name, '{p}')" for p in parts) + ")"


# The decision steps as text: for the atmosphere the family of the name and then its time suffix, for the sea the family.
SQL_MAPPING = f"""n AS (SELECT p_partkey, {list(FEATURES)}[1 + p_size % {len(FEATURES)}] AS name, CASE WHEN p_partkey % 2 = 0 THEN 'era5' ELSE 'medsea_ivt' END AS source FROM part),
fam AS (SELECT *, CASE WHEN source = 'era5' THEN CASE
    WHEN suffix(name, 'season_day') THEN 'day' WHEN contains(name, 'ivt_') AND NOT contains(name, 'dir_') THEN 'ivt' WHEN {_sql_has('ivt_dir_sin', 'ivt_dir_cos')} THEN 'dir'
    WHEN contains(name, 'tcwv') THEN 'tcwv' WHEN contains(name, 'cape') THEN 'cape' WHEN contains(name, 'mslp') THEN 'msl'
    WHEN {_sql_has(*[f"{x}925" for x in ("u", "v", "q", "t", "wind")])} THEN '925' WHEN {_sql_has(*[f"{x}850" for x in ("u", "v", "q", "t", "wind")])} THEN '850'
    WHEN {_sql_has(*[f"{x}700" for x in ("u", "v", "q", "t", "wind")])} THEN '700' WHEN {_sql_has('precip_max_1h', 'precip_max1h')} THEN 'rate' WHEN contains(name, 'precip') THEN 'tp'
    WHEN contains(name, 'soil_water_l1') THEN 'soil1' WHEN contains(name, 'soil_water_l2') THEN 'soil2' WHEN contains(name, 'soil_water_l3') THEN 'soil3' WHEN contains(name, 'soil_profile_mean') THEN 'soil'
    WHEN contains(name, 'snow_depth_mwe') THEN 'sd' ELSE 'none' END
  ELSE CASE WHEN {_sql_has('support_weight', 'medsea_support_baseline', 'medsea_support_angle_wide', 'medsea_support_robust_core')} THEN 'support' WHEN contains(name, 'x_ivt_proxy') THEN 'product'
    WHEN contains(name, 'sst_anom') THEN 'sst' WHEN contains(name, 'ohc') THEN 'ohc' WHEN contains(name, 'tmean') THEN 'tmean' ELSE 'none' END END AS family,
  contains(name, 'incl_today') AS today, contains(name, 'change_24h') AS change,
  {_sql_has('_prev1d', '_prev3d', '_prev7d', '_prev14d')} AND NOT contains(name, 'incl_today') AND NOT contains(name, 'change_24h') AS lag FROM n),
b AS (SELECT *, source = 'era5' AND family <> 'day' AS timed, {_sql_has('_mean', '_max', '_min', '_sum', 'soil_water', 'snow_depth', 'qwind')} AND NOT lag AND NOT contains(name, 'prev') AND NOT today AND NOT change AS full_day,
  CASE family WHEN 'none' THEN CASE source WHEN 'era5' THEN 'UNMAPPED_ERA5_FEATURE' ELSE 'UNMAPPED_MEDSEA_FEATURE' END WHEN 'ivt' THEN 'IVT_VERTICAL_LEVEL_EQUIVALENCE_NOT_YET_VALIDATED' WHEN 'dir' THEN 'IVT_DIRECTION_DEPENDS_ON_UNVALIDATED_OPERATIONAL_IVT_PROXY'
    WHEN 'cape' THEN 'CAPE_DEFINITION_AND_TEMPORAL_SAMPLING_EQUIVALENCE_NOT_YET_VALIDATED' WHEN 'rate' THEN 'PRECIP_1H_MAX_NOT_EXACTLY_REPRODUCIBLE_FROM_OPEN_IFS_CADENCE' WHEN 'support' THEN 'INHERITS_OPERATIONAL_IVT_EQUIVALENCE_GAP'
    WHEN 'product' THEN 'CMEMS_PUBLICATION_LATENCY_AND_OPERATIONAL_IVT_EQUIVALENCE_NOT_YET_VALIDATED'
    ELSE CASE WHEN family IN ('sst', 'ohc', 'tmean') THEN 'CMEMS_PUBLICATION_LATENCY_AND_PRODUCT_SHIFT_VS_HISTORICAL_SERIES' WHEN starts_with(family, 'soil') THEN 'MODEL_SYSTEM_DISTRIBUTION_SHIFT_NOT_YET_VALIDATED' ELSE '' END END AS blocker0,
  CASE WHEN family = 'none' THEN 'BLOCKED' WHEN family = 'day' THEN 'READY' WHEN family = 'rate' THEN 'PROXY_ONLY' WHEN family = 'support' THEN 'AVAILABLE_IF_OPERATIONAL_IVT_AVAILABLE' WHEN family = 'product' THEN 'LATEST_AVAILABLE_MARINE_DAY_PLUS_OPERATIONAL_IVT'
    WHEN source = 'medsea_ivt' THEN 'LATEST_PUBLISHED_DAY_NOT_GUARANTEED_CURRENT_DAY' ELSE 'AVAILABLE_AS_ANALYSIS_FORECAST_PROXY' END AS status0 FROM fam)"""


@query(
    "P-14",
    "p_partkey:i provider_parameter:s transformation:s equivalence_class:s morning_status:s requires_local_cache:b blocker:s",
    f"""WITH {SQL_MAPPING}
       SELECT p_partkey,
         CASE family WHEN 'none' THEN 'UNMAPPED' WHEN 'day' THEN 'issue_date' WHEN 'ivt' THEN 'q,u,v pressure-level fields' WHEN 'dir' THEN 'derived from operational IVT east/north components' WHEN 'tcwv' THEN 'tcwv'
           WHEN 'cape' THEN 'mucape/cape candidate' WHEN 'msl' THEN 'msl' WHEN 'rate' THEN 'tp/tprate' WHEN 'tp' THEN 'tp' WHEN 'soil1' THEN 'vsw level=1' WHEN 'soil2' THEN 'vsw level=2' WHEN 'soil3' THEN 'vsw level=3 (IFS Open Data)'
           WHEN 'soil' THEN 'vsw levels 1-3' WHEN 'sd' THEN 'sd' WHEN 'support' THEN 'operational IVT + frozen MedSea geometry/support algorithm' WHEN 'product' THEN 'MedSea temperature/OHC field × operational IVT'
           WHEN 'sst' THEN 'thetao near-surface from daily temperature dataset' WHEN 'ohc' THEN 'thetao profile 0-100 m' WHEN 'tmean' THEN 'thetao profile 0-100 m' ELSE 'u,v,q,t @ ' || family || ' hPa' END AS provider_parameter,
         CASE WHEN family = 'none' THEN 'MANUAL' WHEN family = 'day' THEN 'CALENDAR' WHEN family = 'ivt' THEN 'TRANSPORT_INTEGRAL' WHEN family = 'dir' THEN 'DIRECTION_COMPONENT' WHEN family IN ('tcwv', 'msl', 'sd') THEN 'RECEPTOR_DAY_STATISTIC'
           WHEN family = 'cape' THEN 'RECEPTOR_DAY_ANALOGUE' WHEN family = 'rate' THEN 'INTENSITY_APPROXIMATION' WHEN family = 'tp' THEN 'FORECAST_INCREMENT_SUM' WHEN family = 'soil' THEN 'SOIL_PROFILE_MEAN' WHEN starts_with(family, 'soil') THEN 'SOIL_LAYER'
           WHEN family = 'support' THEN 'CORRIDOR_SUPPORT' WHEN family = 'product' THEN 'ANOMALY_TIMES_TRANSPORT' WHEN family = 'sst' THEN 'CORRIDOR_ANOMALY' WHEN family = 'ohc' THEN 'HEAT_CONTENT_INTEGRAL' WHEN family = 'tmean' THEN 'DEPTH_MEAN'
           ELSE 'PRESSURE_LEVEL_STATISTIC' END AS transformation,
         CASE family WHEN 'none' THEN 'UNMAPPED' WHEN 'day' THEN 'EXACT_LOCAL' WHEN 'rate' THEN 'NON_EXACT_PROXY' WHEN 'support' THEN 'DERIVED_PROXY_REQUIRES_IVT_VALIDATION' ELSE 'PROXY_REQUIRES_VALIDATION' END AS equivalence_class,
         CASE WHEN timed AND today THEN 'CURRENT_DAY_ANALYSIS_FORECAST_FILL_REQUIRED' WHEN timed AND change THEN 'CURRENT_PROXY_PLUS_PREVIOUS_DAY_CACHE' WHEN timed AND lag AND family <> 'none' THEN 'READY_AFTER_OPERATIONAL_DAILY_CACHE'
           WHEN timed AND full_day AND status0 = 'AVAILABLE_AS_ANALYSIS_FORECAST_PROXY' THEN 'CURRENT_DAY_ANALYSIS_FORECAST_FILL_REQUIRED' ELSE status0 END AS morning_status,
         family IN ('product', 'sst', 'ohc', 'tmean') OR (timed AND (lag OR change OR today)) AS requires_local_cache,
         CASE WHEN blocker0 <> '' OR NOT timed THEN blocker0 WHEN change THEN 'CURRENT_DAY_PROXY_NOT_IDENTICAL_TO_END_OF_DAY_ERA5_TRAINING_STATE' WHEN today OR full_day THEN 'MORNING_RUN_CANNOT_OBSERVE_FULL_TRAINING_DAY_T' ELSE '' END AS blocker
       FROM b""",
)
def source_mapping(spark, sf):
    name = F.get(F.array(*[F.lit(n) for n in FEATURES]), (F.col("p_size") % len(FEATURES)).cast("int"))
    source = F.when(F.col("p_partkey") % 2 == 0, O.ATMOSPHERE).otherwise(O.MARINE)
    return O.source_mapping(B.table(spark, sf, "part").select("p_partkey", name.alias("name"), source.alias("source")), "name", "source")


@query(
    "P-15",
    "p_partkey:i best_rank:i priority:s",
    """WITH i AS (SELECT l_partkey, l_linenumber * 4 + l_suppkey % 7 AS rnk FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_partkey, min(rnk) AS best_rank FROM i GROUP BY 1)
       SELECT p_partkey, best_rank, CASE WHEN best_rank <= 10 THEN 'P1_TOP10_ANY_HORIZON' WHEN best_rank <= 25 THEN 'P2_TOP25_ANY_HORIZON' ELSE 'P3_OTHER_CORE' END AS priority FROM part LEFT JOIN b ON l_partkey = p_partkey""",
)
def priority_tiers(spark, sf):
    imp = B.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_partkey").alias("p_partkey"), (F.col("l_linenumber") * 4 + F.col("l_suppkey") % 7).alias("rnk")
    )
    return O.priority_tiers(B.table(spark, sf, "part").select("p_partkey"), imp, "p_partkey", "rnk")


# ---- target and master -------------------------------------------------------------------------------------------
@query(
    "F-01",
    "receptor_id:i date:d source_series_id:i target_observed_value:f2 target_observation_statistic:s",
    """WITH d AS (SELECT c_nationkey AS receptor_id, CAST(o_orderdate AS DATE) AS date, o_custkey AS sid, min(o_orderpriority) AS pr, CASE WHEN c_nationkey % 2 = 0 THEN 'ARPAL' ELSE 'ARPA_PIEMONTE' END AS provider,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS daily_value, max(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) AS daily_max FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
       b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY receptor_id, date ORDER BY pr, sid) = 1)
       SELECT receptor_id, date, sid AS source_series_id, CASE WHEN provider = 'ARPAL' THEN coalesce(daily_max, daily_value) ELSE daily_value END AS target_observed_value,
         CASE WHEN provider = 'ARPAL' THEN 'DAILY_MAX_FROM_HOURLY_SOURCE' ELSE 'CANONICAL_DAILY_PRIMARY_VALUE' END AS target_observation_statistic FROM b""",
)
def target_series(spark, sf):
    o, c = B.table(spark, sf, "orders"), B.table(spark, sf, "customer")
    d = (
        o.join(c, o.o_custkey == c.c_custkey)
        .groupBy(F.col("c_nationkey").alias("receptor_id"), F.to_date("o_orderdate").alias("date"), F.col("o_custkey").alias("source_series_id"))
        .agg(
            F.min("o_orderpriority").alias("source_priority"),
            F.sum(B.money(F.col("o_totalprice"))).cast("double").alias("daily_value"),
            F.max(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))).alias("daily_max"),
        )
        .withColumn("provider", F.when(F.col("receptor_id") % 2 == 0, "ARPAL").otherwise("ARPA_PIEMONTE"))
    )
    return M.target_series(d)


@query(
    "F-03",
    "receptor_id:i expected_grid_days:i numeric_days:i coverage_fraction:f years_with_numeric_values:i first_valid_date:d last_valid_date:d",
    f"""WITH {B.SQL_SPARSE} SELECT receptor_id, count(*) AS expected_grid_days, count(value) AS numeric_days, count(value) / count(*) AS coverage_fraction,
        count(DISTINCT CASE WHEN value IS NOT NULL THEN year(date) END) AS years_with_numeric_values, min(date) FILTER (WHERE value IS NOT NULL) AS first_valid_date, max(date) FILTER (WHERE value IS NOT NULL) AS last_valid_date FROM sparse GROUP BY 1""",
)
def target_coverage(spark, sf):
    return M.target_coverage(B.sparse_panel(spark, sf), "receptor_id", "date", "value")


DYNAMIC = ("value", "prev1d", "prev3d_sum", "season_day")
STATIC = ("customers", "mean_balance")


def master(spark, sf):
    w = W.SeasonWindow(KEY)
    panel = written(B.sparse_panel(spark, sf), "panel")  # receptors x days: labels, thresholds and features read it
    dyn = panel.select(
        "receptor_id", "date", "value", w.lag("value").alias("prev1d"), w.previous("value", 3).alias("prev3d_sum"), "season_day"
    )
    stat = (
        B.table(spark, sf, "customer")
        .groupBy(F.col("c_nationkey").alias("receptor_id"))
        .agg(F.count(F.lit(1)).alias("customers"), (F.sum(B.money(F.col("c_acctbal"))).cast("double") / F.count(F.lit(1))).alias("mean_balance"))
        .where(F.col("receptor_id") != 13)
    )
    return M.build_master(labels(spark, sf, panel), dyn, stat, "receptor_id", DYNAMIC, STATIC)


SQL_MASTER = f"""{B.SQL_LABELS}, dyn AS (SELECT receptor_id, date, value AS dynamic__value, max(value) {_frame(_day(1), _day(1))} AS dynamic__prev1d, {_full('sum', 'value', _day(3), _day(1), 3)} AS dynamic__prev3d_sum, season_day AS dynamic__season_day FROM sparse),
  stat AS (SELECT c_nationkey AS receptor_id, count(*) AS static__customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS static__mean_balance FROM customer WHERE c_nationkey <> 13 GROUP BY 1),
  master AS (SELECT l.*, dynamic__value, dynamic__prev1d, dynamic__prev3d_sum, dynamic__season_day, static__customers, static__mean_balance, d.receptor_id IS NOT NULL AS dynamic_match, s.receptor_id IS NOT NULL AS static_match
    FROM labels l LEFT JOIN dyn d ON d.receptor_id = l.receptor_id AND d.date = l.issue_date LEFT JOIN stat s ON s.receptor_id = l.receptor_id)"""


@query(
    "F-10 D-12 P-03 J-01 J-02 T-20",
    "fold_id:s receptor_id:i issue_date:d partition:s dynamic__value:f2 dynamic__prev1d:f2 dynamic__prev3d_sum:f2 dynamic__season_day:i static__customers:i static__mean_balance:f2 dynamic_match:b static_match:b label_extreme_within_72h:i",
    f"WITH {SQL_MASTER} SELECT * FROM master",
)
def training_master(spark, sf):
    return master(spark, sf)


PREDICTORS = [f"dynamic__{c}" for c in DYNAMIC] + [f"static__{c}" for c in STATIC]


@query(
    "A-27",
    "predictor:s rows:i non_null_rows:i missing_rows:i missing_fraction:f",
    f"WITH {SQL_MASTER}, u AS (SELECT unnest({PREDICTORS}) AS predictor, unnest([{', '.join(f'CAST({p} AS DOUBLE)' for p in PREDICTORS)}]) AS v FROM master) SELECT predictor, count(*) AS rows, count(v) AS non_null_rows, count(*) - count(v) AS missing_rows, (count(*) - count(v)) / count(*) AS missing_fraction FROM u GROUP BY 1",
)
def predictor_missingness(spark, sf):
    return M.missingness(master(spark, sf), PREDICTORS)


@query(
    "A-28",
    "fold_id:s predictor:s fit_rows:i non_null_rows:i unique_non_null_values:i std_non_null:f2 constant_in_fit:b",
    f"WITH {SQL_MASTER}, u AS (SELECT fold_id, unnest({PREDICTORS}) AS predictor, unnest([{', '.join(f'CAST({p} AS DOUBLE)' for p in PREDICTORS)}]) AS v FROM master WHERE partition = 'FIT') SELECT fold_id, predictor, count(*) AS fit_rows, count(v) AS non_null_rows, count(DISTINCT v) AS unique_non_null_values, stddev_pop(v) AS std_non_null, count(DISTINCT v) <= 1 AS constant_in_fit FROM u GROUP BY 1, 2",
)
def fit_predictor_audit(spark, sf):
    return M.predictor_audit(master(spark, sf).where("partition = 'FIT'"), "fold_id", PREDICTORS)


# ---- daily operation ---------------------------------------------------------------------------------------------
def snapshots(spark, sf):
    return B.table(spark, sf, "events").select(
        F.col("user_id").alias("receptor_id"), F.to_date("ts").alias("issue_date"), F.col("event_id").alias("run_id"), "value", F.col("event_type").alias("kind")
    )


@query(
    "R-01 R-02 D-15",
    "receptor_id:i issue_date:d run_id:i value:f2 extra:f",
    """WITH s AS (SELECT user_id AS receptor_id, CAST(ts AS DATE) AS issue_date, event_id AS run_id, value FROM events)
       , e AS (SELECT receptor_id, issue_date, arg_max(run_id, run_id) AS run_id, arg_max(value, run_id) AS value, 1.0 AS extra FROM s WHERE day(issue_date) <= 20 GROUP BY 1, 2),
       l AS (SELECT receptor_id, issue_date, arg_max(run_id, run_id) AS run_id, arg_max(value, run_id) AS value, CAST(NULL AS DOUBLE) AS extra FROM s WHERE day(issue_date) >= 11 AND receptor_id % 3 <> 0 GROUP BY 1, 2)
       SELECT * FROM l UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.receptor_id = e.receptor_id AND l.issue_date = e.issue_date)""",
)
def snapshot_upsert(spark, sf):
    """Two batches whose keys overlap in part, upserted one after the other, the second one twice.

    Days up to the 20th come first; the second batch replaces some keys from the 11th on, adds later ones and lacks a
    column of the first.
    """
    keys = ["receptor_id", "issue_date"]
    s = snapshots(spark, sf)
    day = F.dayofmonth("issue_date")
    early = O.latest_per_key(s.where(day <= 20), keys, "run_id").select("receptor_id", "issue_date", "run_id", "value", F.lit(1.0).alias("extra"))
    late = O.latest_per_key(s.where((day >= 11) & (F.col("receptor_id") % 3 != 0)), keys, "run_id").select("receptor_id", "issue_date", "run_id", "value")
    once = O.upsert(early, late, keys)
    return O.upsert(once, late, keys)


SPECS = {"prev1d": ("lag", "value", 1), "change_24h": ("change", "value", 1), "prev3d_sum": ("sum", "value", 3), "prev7d_mean": ("mean", "discount", 7), "incl3d_sum": ("incl_sum", "value", 3)}


@query(
    "R-04 R-03",
    "receptor_id:i date:d value:f2 prev1d:f2 change_24h:f2 prev3d_sum:f2 prev7d_mean:f incl3d_sum:f2",
    f"""WITH {B.SQL_DENSE}, h AS (SELECT receptor_id, date, value, max(value) {_frame(_day(1), _day(1))} AS prev1d, value - max(value) {_frame(_day(1), _day(1))} AS change_24h,
        {_full('sum', 'value', _day(3), _day(1), 3)} AS prev3d_sum, {_full('avg', 'discount', _day(7), _day(1), 7)} AS prev7d_mean, {_full('sum', 'value', _day(2), 'CURRENT ROW', 3)} AS incl3d_sum FROM dense)
        SELECT * FROM h WHERE date = DATE '1999-10-20'""",
)
def issue_day_overlay(spark, sf):
    p = B.dense_panel(spark, sf).select("receptor_id", "date", "value", "discount")
    issue = F.lit("1999-10-20").cast("date")
    snapshot = p.where(F.col("date") == issue).select("receptor_id", "date", "value", F.lit(None).cast("double").alias("prev1d"))
    return O.overlay_features(p, snapshot, KEY, "date", issue, SPECS)


@query(
    "E-22",
    "o_orderkey:i mode:s scientific:b inference:b",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'EXPERIMENTAL_PROSPECTIVE_BETA' WHEN month(o_orderdate) NOT BETWEEN 9 AND 12 THEN 'TECHNICAL_SMOKE_TEST__OUT_OF_SEASON__NON_SCIENTIFIC'
       WHEN o_orderpriority = '5-LOW' THEN 'DEGRADED_TECHNICAL_SMOKE__NON_SCIENTIFIC' ELSE 'BETA_BLOCKED__NO_INFERENCE' END AS mode, o_orderstatus = 'F' AS scientific,
       o_orderstatus = 'F' OR month(o_orderdate) NOT BETWEEN 9 AND 12 OR o_orderpriority = '5-LOW' AS inference FROM orders""",
)
def bulletin_modes(spark, sf):
    m = O.bulletin_mode(F.col("o_orderstatus") == "F", F.month("o_orderdate").between(9, 12), F.col("o_orderpriority") == "5-LOW")
    return B.table(spark, sf, "orders").select("o_orderkey", m.alias("m")).select("o_orderkey", "m.*")
