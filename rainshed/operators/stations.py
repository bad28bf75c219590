"""Station series: cadence, sub-daily to daily with a statistic per code, coverage by year and basin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainshed import policy
from rainshed.functions.clock import wall_micros
from rainshed.operators.distributed import exact_quantiles, previous_in_order
from rainshed.sources.integrity import written


def policy_of(code: Column, policies: dict[str, str] = policy.STATION_POLICY) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in policies.items() for x in kv])
    return F.coalesce(F.element_at(pairs, code), F.lit("MEAN"))


def circular_strength(s: Column, c: Column) -> Column:
    return F.hypot(s, c)


def circular_angle(s: Column, c: Column) -> Column:
    """Angle of a mean (sin, cos) pair in 0..360; NULL when the resultant vanishes."""
    a = F.degrees(F.atan2(s, c))
    return F.when(F.hypot(s, c) >= policy.CIRCULAR_MIN_STRENGTH, F.when(a < 0, a + 360.0).otherwise(a))


def circular_mean(deg: Column, weight: Column | None = None) -> tuple[Column, Column]:
    """Aggregates (angle, resultant strength), optionally weighted; only weights above 0 count."""
    r = F.radians(F.pmod(deg, F.lit(360.0)))
    if weight is None:
        s, c = F.avg(F.sin(r)), F.avg(F.cos(r))
    else:
        w = F.when(deg.isNotNull() & (weight > 0), weight)
        s, c = F.sum(F.sin(r) * w) / F.sum(w), F.sum(F.cos(r) * w) / F.sum(w)
    return circular_angle(s, c), circular_strength(s, c)


def completeness(observed: Column, expected: Column) -> Column:
    return F.when(observed > expected, "OVERCOMPLETE").when(observed == expected, "COMPLETE").otherwise("PARTIAL")


def daily_station(
    obs: DataFrame,
    series: Sequence[str],
    code: str,
    ts: str,
    value: str,
    expected: Column,
    policies: dict[str, str] = policy.STATION_POLICY,
) -> DataFrame:
    """Daily rows per (series, code): primary statistic by code policy, linear statistics, count and coverage.

    One two-step aggregate; circular codes have no linear statistics.
    """
    keys = [*series, code]
    v = F.col(value).cast("double")
    rad = F.radians(F.pmod(v, F.lit(360.0)))
    agg = (
        obs.where(F.col(ts).isNotNull() & F.col(value).isNotNull())
        .groupBy(*keys, F.to_date(ts).alias("date_model"))
        .agg(
            F.count(F.lit(1)).alias("observed_count"),
            F.avg(v).alias("__m"),
            F.min(v).alias("__lo"),
            F.max(v).alias("__hi"),
            F.sum(v).alias("__total"),
            F.avg(F.sin(rad)).alias("__s"),
            F.avg(F.cos(rad)).alias("__c"),
        )
        .withColumn("daily_primary_statistic", policy_of(F.col(code), policies))
        .withColumn("expected_count_per_day", expected)
    )
    p = F.col("daily_primary_statistic")
    circular = p == "CIRCULAR_MEAN"
    primary = (
        F.when(p == "SUM", F.col("__total"))
        .when(p == "MIN", F.col("__lo"))
        .when(p == "MAX", F.col("__hi"))
        .when(circular, circular_angle(F.col("__s"), F.col("__c")))
        .otherwise(F.col("__m"))
    )
    return agg.select(
        *keys,
        "date_model",
        "expected_count_per_day",
        "observed_count",
        (F.col("observed_count") / F.col("expected_count_per_day")).alias("coverage_fraction"),
        completeness(F.col("observed_count"), F.col("expected_count_per_day")).alias("day_completeness"),
        "daily_primary_statistic",
        primary.alias("daily_value"),
        *[F.when(~circular, F.col(x)).alias(f"daily_{n}") for x, n in (("__m", "mean"), ("__lo", "min"), ("__hi", "max"), ("__total", "sum"))],
        F.when(circular, circular_strength(F.col("__s"), F.col("__c"))).alias("circular_resultant_strength"),
    )


def _tiles_day(seconds: Column, tolerance: float, most: int | None = None) -> Column:
    """Samples per day when the step tiles a day within tolerance, else NULL."""
    expected = F.bround(policy.DAY_SECONDS / seconds)
    ok = (expected >= 1) & (
        F.abs(expected * seconds - policy.DAY_SECONDS) <= F.greatest(F.lit(1.0), seconds * tolerance)
    )
    if most is not None:
        ok = ok & (expected <= most)
    return F.when(ok, expected.cast("int"))


def infer_cadence(obs: DataFrame, series: Sequence[str], ts: str, interval: str | None = None, daily: Column | None = None) -> DataFrame:
    """Nominal step and samples per day of each series.

    Daily sources first, then the median stated interval, then the median gap between successive times of at
    most six hours.  A gap that short starts in the same or the previous six-hour bucket, so the order is only
    resolved inside buckets; medians are taken from value counts.
    """
    keys = list(series)
    seconds = wall_micros(F.col(ts)) / 1e6
    timed = obs.where(F.col(ts).isNotNull()).select(*keys, seconds.alias("__s"))
    prev = previous_in_order(timed, keys, "__s", policy.DAY_SECONDS, ["__s"])
    gap = F.col("__s") - F.col("prev___s")
    # Read twice (cut points, then value counts); written so that the ordering work is done once.
    gaps = written(prev.select(*keys, gap.alias("gap")).where((gap > 0) & (gap <= policy.MAX_CADENCE_GAP_SECONDS)), "gaps")
    base = obs.groupBy(*keys).agg((F.bool_or(daily) if daily is not None else F.lit(False)).alias("__daily"))
    base = base.join(exact_quantiles(gaps, keys, "gap", [0.5], names=["__gap"]), keys, "left")
    if interval is not None:
        stated = obs.where(F.col(interval) > 0).select(*keys, F.col(interval).cast("double").alias("step"))
        base = base.join(exact_quantiles(stated, keys, "step", [0.5], names=["__interval"]), keys, "left")
    else:
        base = base.withColumn("__interval", F.lit(None).cast("double"))
    by_interval = _tiles_day(F.col("__interval"), policy.INTERVAL_TOLERANCE)
    by_gap = _tiles_day(F.col("__gap"), policy.DELTA_TOLERANCE, policy.MAX_SAMPLES_PER_DAY)
    staged = base.withColumn("__ei", by_interval).withColumn("__eg", by_gap)
    method = (
        F.when(F.col("__daily"), "DAILY_SOURCE")
        .when(F.col("__ei").isNotNull(), "INTERVAL_SECONDS")
        .when(F.col("__eg").isNotNull(), "MEDIAN_TIMESTAMP_DELTA")
        .otherwise("UNRESOLVED")
    )
    m = F.col("cadence_method")
    return staged.withColumn("cadence_method", method).select(
        *keys,
        F.when(m == "DAILY_SOURCE", policy.DAY_SECONDS)
        .when(m == "INTERVAL_SECONDS", F.bround("__interval").cast("int"))
        .when(m == "MEDIAN_TIMESTAMP_DELTA", F.bround("__gap").cast("int"))
        .alias("nominal_cadence_seconds"),
        F.when(m == "DAILY_SOURCE", 1)
        .when(m == "INTERVAL_SECONDS", F.col("__ei"))
        .when(m == "MEDIAN_TIMESTAMP_DELTA", F.col("__eg"))
        .alias("expected_count_per_day"),
        "cadence_method",
    )


def year_coverage(obs: DataFrame, station: Sequence[str], date: str, first_year: int, last_year: int, days: int = policy.SEASON_DAYS, rows: Column | None = None) -> DataFrame:
    """Rows, distinct days and coverage of every station and year; years without rows are explicit zeros.

    ``rows``: how many rows a group of ``obs`` stands for, where it is counted already.
    """
    per_day = obs.groupBy(*station, F.year(date).alias("year"), date).agg((F.count(F.lit(1)) if rows is None else rows).alias("__n"))
    per_year = per_day.groupBy(*station, "year").agg(F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("unique_dates"))
    years = F.explode(F.sequence(F.lit(first_year), F.lit(last_year)))
    zero = F.lit(0).cast("bigint")
    grid = per_year.select(*station).distinct().select("*", years.alias("year"), zero.alias("rows"), zero.alias("unique_dates"))
    inside = per_year.where(F.col("year").between(first_year, last_year))
    full = inside.unionByName(grid).groupBy(*station, "year").agg(F.max("rows").alias("rows"), F.max("unique_dates").alias("unique_dates"))
    return full.withColumn("coverage_pct", 100.0 * F.col("unique_dates") / days)


def basin_year(coverage: DataFrame, receptors: str, station: str, year: str, days: str) -> DataFrame:
    """Stations with data and valid station-days per receptor and year; a station may serve several receptors."""
    x = coverage.select(F.explode(receptors).alias("receptor_id"), station, year, days)
    return x.groupBy("receptor_id", year).agg(
        F.countDistinct(F.when(F.col(days) > 0, F.col(station))).alias("stations_with_data"),
        F.sum(days).alias("valid_station_days"),
    )


def basin_summary(by_year: DataFrame, year: str) -> DataFrame:
    """Years with data and median / max stations per year; a receptor has one row per year here."""
    n = F.col("stations_with_data")
    return by_year.groupBy("receptor_id").agg(
        F.count(year).alias("years_total"),
        F.count_if(n > 0).alias("years_with_data"),
        F.percentile(n, F.lit(0.5)).alias("median_stations"),
        F.max(n).alias("max_stations"),
    )
