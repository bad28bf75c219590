"""Daily operation: snapshot upsert, schema alignment, re-derived features, source mapping, status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rainshed.operators.panel import season_day
from rainshed.operators.windows import SeasonWindow
from rainshed.sources.integrity import prepare_checkpoints


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the current dictionary in order; missing ones become NULL, unknown ones are left out."""
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def upsert(cache: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keyed replace-append: rows of ``batch`` replace the cache's rows with the same key."""
    fresh = align_schema(batch, cache.schema)
    return cache.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def latest_per_key(batch: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Last version of each key inside one batch; one candidate per key leaves each map task."""
    rest = [c for c in batch.columns if c not in keys]
    best = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("__b"))
    return best.select(*keys, *[F.col("__b")[c].alias(c) for c in rest])


def upsert_partitions(batch: DataFrame, path: str, keys: Sequence[str], partition: str) -> None:
    """Upsert into a Parquet table partitioned by day, rewriting only the days the batch touches.

    Old rows of those days come from pruned partitions; running the same batch again gives the same table.  The
    merged days are checkpointed first because their old files are replaced by this very write.
    """
    spark = batch.sparkSession
    prepare_checkpoints(spark)
    days = [r[0] for r in batch.select(partition).distinct().collect()]  # partition names of one batch
    if not days:
        return
    merged = batch
    try:
        old = spark.read.parquet(path).where(F.col(partition).isin(days))
        merged = upsert(old, batch, keys)
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
    merged.checkpoint().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def season_slice(cache: DataFrame, date: str, issue: Column, days: int = 14) -> DataFrame:
    """Rows from ``days`` before the issue day up to it: all that the history features of that day read."""
    return cache.where(F.col(date).between(F.date_sub(issue, days), issue))


def overlay_features(cache: DataFrame, snapshot: DataFrame, key: Sequence[str], date: str, issue: Column, specs: dict[str, tuple[str, str, int]]) -> DataFrame:
    """Re-derive history features of the issue day from the cache and lay them over the snapshot.

    ``specs``: output -> (kind, column, days) with kind lag, change, sum, mean, max, incl_sum, incl_mean.
    """
    w = SeasonWindow(key)
    make = {
        "lag": lambda c, n: w.lag(c, n),
        "change": lambda c, n: w.change(c, n),
        "sum": lambda c, n: w.previous(c, n, "sum"),
        "mean": lambda c, n: w.previous(c, n, "mean"),
        "max": lambda c, n: w.previous(c, n, "max"),
        "incl_sum": lambda c, n: w.inclusive(c, n, "sum"),
        "incl_mean": lambda c, n: w.inclusive(c, n, "mean"),
    }
    part = season_slice(cache, date, issue).select("*", F.year(date).alias("season_year"), season_day(F.col(date)).alias("season_day"))
    derived = part.select(*key, date, *[make[k](c, n).alias(out) for out, (k, c, n) in specs.items()])
    today = derived.where(F.col(date) == issue)
    kept = [c for c in snapshot.columns if c not in specs]
    return snapshot.select(*kept).join(today, [*key, date], "left")


# ---- source mapping ----------------------------------------------------------------------------------------------
ATMOSPHERE, MARINE = "era5", "medsea_ivt"
_PROXY, _OPEN = "PROXY_REQUIRES_VALIDATION", "AVAILABLE_AS_ANALYSIS_FORECAST_PROXY"
_SHIFT = "MODEL_SYSTEM_DISTRIBUTION_SHIFT_NOT_YET_VALIDATED"
_LATE = "CMEMS_PUBLICATION_LATENCY_AND_PRODUCT_SHIFT_VS_HISTORICAL_SERIES"
_LAST_DAY = "LATEST_PUBLISHED_DAY_NOT_GUARANTEED_CURRENT_DAY"
# Name pattern, provider parameter, transformation, equivalence class, morning status, needs the local
# cache, blocker; the first match of a source wins.
SOURCE_RULES = {
    ATMOSPHERE: (
        (r"season_day$", "issue_date", "CALENDAR", "EXACT_LOCAL", "READY", False, ""),
        (r"^(?!.*dir_).*ivt_", "q,u,v pressure-level fields", "TRANSPORT_INTEGRAL", _PROXY, _OPEN, False, "IVT_VERTICAL_LEVEL_EQUIVALENCE_NOT_YET_VALIDATED"),
        (r"ivt_dir_(sin|cos)", "derived from operational IVT east/north components", "DIRECTION_COMPONENT", _PROXY, _OPEN, False, "IVT_DIRECTION_DEPENDS_ON_UNVALIDATED_OPERATIONAL_IVT_PROXY"),
        (r"tcwv", "tcwv", "RECEPTOR_DAY_STATISTIC", _PROXY, _OPEN, False, ""),
        (r"cape", "mucape/cape candidate", "RECEPTOR_DAY_ANALOGUE", _PROXY, _OPEN, False, "CAPE_DEFINITION_AND_TEMPORAL_SAMPLING_EQUIVALENCE_NOT_YET_VALIDATED"),
        (r"mslp", "msl", "RECEPTOR_DAY_STATISTIC", _PROXY, _OPEN, False, ""),
        (r"(u|v|q|t|wind)925", "u,v,q,t @ 925 hPa", "PRESSURE_LEVEL_STATISTIC", _PROXY, _OPEN, False, ""),
        (r"(u|v|q|t|wind)850", "u,v,q,t @ 850 hPa", "PRESSURE_LEVEL_STATISTIC", _PROXY, _OPEN, False, ""),
        (r"(u|v|q|t|wind)700", "u,v,q,t @ 700 hPa", "PRESSURE_LEVEL_STATISTIC", _PROXY, _OPEN, False, ""),
        (r"precip_max_?1h", "tp/tprate", "INTENSITY_APPROXIMATION", "NON_EXACT_PROXY", "PROXY_ONLY", False, "PRECIP_1H_MAX_NOT_EXACTLY_REPRODUCIBLE_FROM_OPEN_IFS_CADENCE"),
        (r"precip", "tp", "FORECAST_INCREMENT_SUM", _PROXY, _OPEN, False, ""),
        (r"soil_water_l1", "vsw level=1", "SOIL_LAYER", _PROXY, _OPEN, False, _SHIFT),
        (r"soil_water_l2", "vsw level=2", "SOIL_LAYER", _PROXY, _OPEN, False, _SHIFT),
        (r"soil_water_l3", "vsw level=3 (IFS Open Data)", "SOIL_LAYER", _PROXY, _OPEN, False, _SHIFT),
        (r"soil_profile_mean", "vsw levels 1-3", "SOIL_PROFILE_MEAN", _PROXY, _OPEN, False, _SHIFT),
        (r"snow_depth_mwe", "sd", "RECEPTOR_DAY_STATISTIC", _PROXY, _OPEN, False, ""),
        (r"", "UNMAPPED", "MANUAL", "UNMAPPED", "BLOCKED", False, "UNMAPPED_ERA5_FEATURE"),
    ),
    MARINE: (
        (
            r"support_weight|medsea_support_(baseline|angle_wide|robust_core)",
            "operational IVT + frozen MedSea geometry/support algorithm",
            "CORRIDOR_SUPPORT",
            "DERIVED_PROXY_REQUIRES_IVT_VALIDATION",
            "AVAILABLE_IF_OPERATIONAL_IVT_AVAILABLE",
            False,
            "INHERITS_OPERATIONAL_IVT_EQUIVALENCE_GAP",
        ),
        (
            r"x_ivt_proxy",
            "MedSea temperature/OHC field × operational IVT",
            "ANOMALY_TIMES_TRANSPORT",
            _PROXY,
            "LATEST_AVAILABLE_MARINE_DAY_PLUS_OPERATIONAL_IVT",
            True,
            "CMEMS_PUBLICATION_LATENCY_AND_OPERATIONAL_IVT_EQUIVALENCE_NOT_YET_VALIDATED",
        ),
        (r"sst_anom", "thetao near-surface from daily temperature dataset", "CORRIDOR_ANOMALY", _PROXY, _LAST_DAY, True, _LATE),
        (r"ohc", "thetao profile 0-100 m", "HEAT_CONTENT_INTEGRAL", _PROXY, _LAST_DAY, True, _LATE),
        (r"tmean", "thetao profile 0-100 m", "DEPTH_MEAN", _PROXY, _LAST_DAY, True, _LATE),
        (r"", "UNMAPPED", "MANUAL", "UNMAPPED", "BLOCKED", False, "UNMAPPED_MEDSEA_FEATURE"),
    ),
}
MAPPING_FIELDS = ("provider_parameter", "transformation", "equivalence_class", "morning_status", "requires_local_cache", "blocker")


def source_mapping(names: DataFrame, name: str, source: str, rules: dict[str, Sequence[tuple]] = SOURCE_RULES) -> DataFrame:
    """Attributes of the first rule of the feature's source that its name matches; NULL for an unknown source.

    Atmospheric features that are not known exactly at issue time then get the overlay of their time suffix: lags need
    the completed daily cache, changes the cache and the current proxy, sums up to today a filled current day.  Each
    source's rules are one literal array whose index is found once per name.
    """
    n = F.col(name)
    found: Column | None = None
    for key, table in rules.items():
        index = F.lit(len(table) - 1)
        for i in range(len(table) - 2, -1, -1):
            index = F.when(n.rlike(table[i][0]), i).otherwise(index)
        entries = F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(MAPPING_FIELDS, r[1:])]) for r in table])
        here = F.get(entries, index)
        found = F.when(F.col(source) == key, here) if found is None else found.when(F.col(source) == key, here)
    m = names.withColumn("__m", found)
    today, change = n.contains("incl_today"), n.contains("change_24h")
    lag = n.rlike("_prev(1|3|7|14)d") & ~today & ~change
    full_day = n.rlike("_mean|_max|_min|_sum|soil_water|snow_depth|qwind") & ~n.contains("prev") & ~today & ~change
    timed = (F.col(source) == ATMOSPHERE) & (F.col("__m.equivalence_class") != "EXACT_LOCAL")
    mapped = F.col("__m.equivalence_class") != "UNMAPPED"
    own, blocker = F.col("__m.morning_status"), F.col("__m.blocker")
    filled = "CURRENT_DAY_ANALYSIS_FORECAST_FILL_REQUIRED"
    status = (
        F.when(timed & today, filled)
        .when(timed & change, "CURRENT_PROXY_PLUS_PREVIOUS_DAY_CACHE")
        .when(timed & lag & mapped, "READY_AFTER_OPERATIONAL_DAILY_CACHE")
        .when(timed & full_day & (own == _OPEN), filled)
        .otherwise(own)
    )
    extra = (
        F.when(timed & change, "CURRENT_DAY_PROXY_NOT_IDENTICAL_TO_END_OF_DAY_ERA5_TRAINING_STATE")
        .when(timed & (today | full_day), "MORNING_RUN_CANNOT_OBSERVE_FULL_TRAINING_DAY_T")
        .otherwise("")
    )
    return m.select(
        *names.columns,
        *[F.col(f"__m.{f}").alias(f) for f in MAPPING_FIELDS[:3]],
        status.alias("morning_status"),
        (F.col("__m.requires_local_cache") | (timed & (lag | change | today))).alias("requires_local_cache"),
        F.when(blocker == "", extra).otherwise(blocker).alias("blocker"),
    )


def priority_tiers(features: DataFrame, importance: DataFrame, predictor: str, rank: str) -> DataFrame:
    """Tier of each feature from its best importance rank over horizons."""
    best = importance.groupBy(predictor).agg(F.min(rank).alias("best_rank"))
    r = F.col("best_rank")
    tier = F.when(r <= 10, "P1_TOP10_ANY_HORIZON").when(r <= 25, "P2_TOP25_ANY_HORIZON").otherwise("P3_OTHER_CORE")
    return features.join(best, predictor, "left").withColumn("priority", tier)


# ---- bulletin ----------------------------------------------------------------------------------------------------
def bulletin_mode(allowed: Column, in_season: Column, degraded: Column) -> Column:
    """struct(mode, scientific, inference)."""

    def row(mode: str, scientific: bool, inference: bool) -> Column:
        return F.struct(F.lit(mode).alias("mode"), F.lit(scientific).alias("scientific"), F.lit(inference).alias("inference"))

    return (
        F.when(allowed, row("EXPERIMENTAL_PROSPECTIVE_BETA", True, True))
        .when(~in_season, row("TECHNICAL_SMOKE_TEST__OUT_OF_SEASON__NON_SCIENTIFIC", False, True))
        .when(degraded, row("DEGRADED_TECHNICAL_SMOKE__NON_SCIENTIFIC", False, True))
        .otherwise(row("BETA_BLOCKED__NO_INFERENCE", False, False))
    )


def padded_windows(events: DataFrame, start: str, end: str, days: int = 3) -> DataFrame:
    return events.withColumn("retrieval_start", F.date_sub(start, days)).withColumn("retrieval_end", F.date_add(end, days))
