"""Station-to-receptor relations, primary resolution and basin network statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainshed.operators.joins import active_per_day
from rainshed.operators.stations import circular_mean


def relation_key(provider: Column, station: Column, kind: Column, target: Column) -> Column:
    """The identifier a provider's relations are keyed by: station and kind, station, or target."""
    return (
        F.when(provider == "ARPA_PIEMONTE", F.concat_ws("|", station, kind))
        .when(provider == "CENTRO_FUNZIONALE_RAVDA", station)
        .when(provider == "ARPAL", target)
    )


def provider_join(series: DataFrame, relations: DataFrame) -> DataFrame:
    """Provider-aware left join as one equi join on a computed key.

    ``series``: provider, station_id, kind_source, target, ...; ``relations``: provider, station_or_target_id,
    kind_source, receptor_id, ...
    """
    p = F.col("provider")
    s = series.withColumn("__k", relation_key(p, F.col("station_id"), F.col("kind_source"), F.col("target")))
    ident = F.col("station_or_target_id")
    r = relations.withColumn("__k", relation_key(p, ident, F.col("kind_source"), ident)).drop("kind_source")
    return s.join(r, ["provider", "__k"], "left").drop("__k")


def resolve_primary(relations: DataFrame) -> DataFrame:
    """Canonical primary receptor per series, or the reason there is none.

    ``relations``: source_series_id, receptor_id, is_primary, nearest_receptor, receptor_ids_source (array).
    Rows are merged per (series, receptor) first, so a series has at most one row per receptor when collected.
    """
    per = relations.groupBy("source_series_id", "receptor_id").agg(
        F.bool_or("is_primary").alias("t"), F.min("nearest_receptor").alias("nearest"), F.max("receptor_ids_source").alias("src")
    )
    g = per.groupBy("source_series_id").agg(
        F.array_sort(F.collect_list("receptor_id")).alias("receptors"),
        F.array_sort(F.collect_list(F.when(F.col("t"), F.col("receptor_id")))).alias("true_receptors"),
        F.nullif(F.trim(F.min("nearest")), F.lit("")).alias("nearest"),
        F.array_sort(F.array_distinct(F.coalesce(F.max("src"), F.array().cast("array<string>")))).alias("source"),
    )
    nt, nr, near = F.size("true_receptors"), F.size("receptors"), F.col("nearest")
    resolution = (
        F.when(nt > 1, "MULTIPLE_TRUE_PRIMARY")
        .when(nt == 1, "RELATION_TABLE")
        .when(nr == 1, "SINGLE_RELATION_FALLBACK")
        .when(near.isNull(), "MULTI_RELATION_NEAREST_EMPTY")
        .when(~F.array_contains("receptors", near), "NEAREST_NOT_IN_RELATIONS")
        .when(F.size("source") == 0, "RECEPTOR_IDS_SOURCE_EMPTY")
        .when(F.col("source") != F.col("receptors"), "SOURCE_RELATION_SET_MISMATCH")
        .otherwise("NEAREST_RECEPTOR_VALIDATED")
    )
    res = F.col("resolution")
    primary = (
        F.when(res == "RELATION_TABLE", F.get("true_receptors", F.lit(0)))
        .when(res == "SINGLE_RELATION_FALLBACK", F.get("receptors", F.lit(0)))
        .when(res == "NEAREST_RECEPTOR_VALIDATED", near)
    )
    return g.withColumn("resolution", resolution).withColumn("primary_receptor", primary)


def canonical_relations(resolved: DataFrame) -> DataFrame:
    """One row per (series, receptor) of coherent series with the canonical primary flag."""
    ok = resolved.where(F.col("primary_receptor").isNotNull())
    return ok.select(
        "source_series_id", F.explode("receptors").alias("receptor_id"), "resolution", "primary_receptor"
    ).withColumn("canonical_is_primary", F.col("receptor_id") == F.col("primary_receptor"))


def rejected_relations(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("primary_receptor").isNull()).select("source_series_id", F.col("resolution").alias("reason"))


def primary_violations(canonical: DataFrame, series: str = "source_series_id", flag: str = "canonical_is_primary") -> DataFrame:
    """Series whose number of primary relations is not one."""
    return (
        canonical.groupBy(series)
        .agg(F.count(F.lit(1)).alias("relation_count"), F.sum(F.col(flag).cast("int")).alias("primary_count"))
        .where(F.col("primary_count") != 1)
    )


def network_stats(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Basin statistics per (receptor, code, day) over the stations of a basin.

    ``daily``: keys + station_key, canonical_is_primary, daily_value, coverage_fraction, day_completeness.
    A group holds one row per station and source column of one basin on one day.  Weights are coverage clipped
    to 0..1; the reported coverage is not clipped.
    """
    v, cov = F.col("daily_value"), F.col("coverage_fraction")
    w = F.coalesce(F.least(F.greatest(cov, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    q = F.percentile(v, F.array(F.lit(0.5), F.lit(0.9)))
    angle, strength = circular_mean(v)
    wangle, wstrength = circular_mean(v, w)
    wsum = F.sum(F.when(v.isNotNull() & (w > 0), w))
    return daily.groupBy(*keys).agg(
        # Sets of at most the stations of one basin: a second count-distinct would copy every row through Expand.
        F.size(F.collect_set("station_key")).alias("station_count"),
        F.size(F.collect_set(F.when(F.col("canonical_is_primary"), F.col("station_key")))).alias("primary_station_count"),
        F.avg(cov).alias("coverage_mean"),
        F.min(cov).alias("coverage_min"),
        F.avg((F.col("day_completeness") == "COMPLETE").cast("double")).alias("complete_fraction"),
        F.avg(v).alias("mean"),
        q[0].alias("median"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        q[1].alias("p90"),
        F.stddev_pop(v).alias("std"),
        F.when(wsum > 0, F.sum(v * w) / wsum).alias("coverage_weighted_mean"),
        angle.alias("cmean"),
        strength.alias("resultant_strength"),
        wangle.alias("coverage_weighted_cmean"),
        wstrength.alias("coverage_weighted_resultant_strength"),
    )


LINEAR_STATS = ("mean", "median", "min", "max", "p90", "std", "coverage_weighted_mean")
CIRCULAR_STATS = ("cmean", "resultant_strength", "coverage_weighted_cmean", "coverage_weighted_resultant_strength")


def mask_by_kind(stats: DataFrame, circular: Column) -> DataFrame:
    """Circular codes keep circular statistics only, other codes linear ones only."""
    return stats.select(
        *[
            F.when(~circular, F.col(c)).alias(c)
            if c in LINEAR_STATS
            else F.when(circular, F.col(c)).alias(c)
            if c in CIRCULAR_STATS
            else F.col(c)
            for c in stats.columns
        ]
    )


def station_fraction(stats: DataFrame, candidates: DataFrame, group: Sequence[str], date: str, member: str, start: str, end: str) -> DataFrame:
    """Observed over eligible stations per day; NULL when none is eligible."""
    eligible = active_per_day(candidates, group, member, start, end).withColumnRenamed("active", "eligible_station_count")
    if date != "date":
        eligible = eligible.withColumnRenamed("date", date)
    j = eligible.join(stats.select(*group, date, "station_count"), [*group, date], "full_outer")
    e, n = F.coalesce("eligible_station_count", F.lit(0)), F.col("station_count")
    return j.select(
        *group,
        date,
        e.alias("eligible_station_count"),
        n.alias("station_count"),
        F.when(e > 0, F.coalesce(n, F.lit(0)) / e).alias("station_fraction"),
    )


def widen(stats: DataFrame, keys: Sequence[str], code: str, codes: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Long statistics to ``obs_<code>_<stat>`` columns; the code list is fixed, so there is no discovery pass."""
    return stats.groupBy(*keys).agg(
        *[F.max(F.when(F.col(code) == c, F.col(m))).alias(f"obs_{c.lower()}_{m}") for c in codes for m in measures]
    )


def mapping_coverage(mapped: DataFrame) -> DataFrame:
    """Providers, distinct series and stations, primaries and span per receptor and variable."""
    return mapped.groupBy("receptor_id", "variable_code").agg(
        F.array_join(F.array_sort(F.collect_set("provider")), "|").alias("providers"),
        F.countDistinct("source_series_id").alias("series_count"),
        F.countDistinct("station_id").alias("station_count"),
        F.sum(F.col("canonical_is_primary").cast("int")).alias("primary_series_count"),
        F.sum("daily_rows").alias("daily_rows_total"),
        F.min("date_min").alias("date_min"),
        F.max("date_max").alias("date_max"),
    )


def observation_eligibility(availability: DataFrame, features: int, minimum: float = 0.80) -> DataFrame:
    """Per fold and receptor: every feature present and the least available one at or above the minimum."""
    pair = availability.groupBy("fold_id", "receptor_id").agg(
        F.countDistinct("feature_column").alias("feature_count"),
        F.min("availability_fraction").alias("minimum_availability"),
        F.avg("availability_fraction").alias("mean_availability"),
    )
    return pair.withColumn("eligible", (F.col("feature_count") == features) & (F.col("minimum_availability") >= minimum))
