"""Fold expansion, FIT-only thresholds and three-valued look-ahead labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainshed import policy
from rainshed.operators.windows import SeasonWindow, runs

FIT, VALIDATION, TEST = "FIT", "VALIDATION", "TEST"


def fold_array(folds: Sequence[tuple] = policy.FOLDS) -> Column:
    """Folds as a literal array, so expanding a panel by fold needs no join."""
    names = ("fold_id", "fit_end", "val_start", "val_end", "test_start", "test_end")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, f)]) for f in folds])


def partition_of(year: Column, fold: Column) -> Column:
    """FIT / VALIDATION / TEST of a year in a fold; NULL outside all three."""
    return (
        F.when(year <= fold["fit_end"], FIT)
        .when(year.between(fold["val_start"], fold["val_end"]), VALIDATION)
        .when(year.between(fold["test_start"], fold["test_end"]), TEST)
    )


def expand_folds(df: DataFrame, folds: Sequence[tuple] = policy.FOLDS, year: str = "season_year") -> DataFrame:
    """One row per fold the row's year belongs to, with ``fold_id`` and ``partition``."""
    return (
        df.withColumn("__f", F.explode(fold_array(folds)))
        .withColumn("fold_id", F.col("__f.fold_id"))
        .withColumn("partition", partition_of(F.col(year), F.col("__f")))
        .where(F.col("partition").isNotNull())
        .drop("__f")
    )


def fold_thresholds(
    panel: DataFrame, key: str, value: str, folds: Sequence[tuple] = policy.FOLDS, probs: Sequence[float] = (0.95, 0.975)
) -> DataFrame:
    """Exact quantiles per (fold, receptor) on FIT rows only.

    The panel holds one row per receptor and day, so a group has at most the days of the record.
    """
    fit = expand_folds(panel.select(key, "season_year", value), folds).where(
        (F.col("partition") == FIT) & F.col(value).isNotNull()
    )
    q = fit.groupBy("fold_id", key).agg(
        F.percentile(value, F.array(*[F.lit(float(p)) for p in probs])).alias("__q"), F.count(value).alias("fit_days")
    )
    names = ("q95_fit_threshold", "q975_fit_severity_threshold")
    return q.select("fold_id", key, "fit_days", *[F.col("__q")[i].alias(n) for i, n in zip(range(len(probs)), names)])


def three_valued(future_max: Column, future_count: Column, threshold: Column, days: int) -> Column:
    """1: some future day reaches the threshold; 0: every day present and below; NULL otherwise."""
    return F.when(future_max >= threshold, 1).when((future_count == days) & threshold.isNotNull(), 0)


def label_name(hours: int) -> str:
    return f"label_extreme_within_{hours}h"


def label_panel(
    panel: DataFrame,
    key: str,
    value: str,
    thresholds: DataFrame,
    folds: Sequence[tuple] = policy.FOLDS,
    horizons: dict[int, int] = policy.HORIZON_DAYS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Labels per (fold, receptor, day).

    The look-ahead windows do not depend on the fold, so they run once on the panel; folds and thresholds
    are attached afterwards.
    """
    w = SeasonWindow([key])
    ahead = panel.select(
        "*",
        *[w.future(value, d).alias(f"__m{h}") for h, d in horizons.items()],
        *[w.future_count(value, d).alias(f"__n{h}") for h, d in horizons.items()],
    )
    t = F.col("q95_fit_threshold")
    labelled = expand_folds(ahead, folds).join(thresholds, ["fold_id", key], "left")
    return labelled.select(
        "fold_id",
        key,
        F.col("date").alias("issue_date"),
        "season_year",
        "partition",
        "q95_fit_threshold",
        "q975_fit_severity_threshold",
        F.col(value).alias("current_target_observed_value"),
        *carry,
        *[
            three_valued(F.col(f"__m{h}"), F.col(f"__n{h}"), t, d).alias(label_name(h)) for h, d in horizons.items()
        ],
    )


def long_labels(labels: DataFrame, ids: Sequence[str], horizons: Sequence[int] = tuple(policy.HORIZON_DAYS)) -> DataFrame:
    entries = F.array(
        *[F.struct(F.lit(h).alias("horizon_hours"), F.col(label_name(h)).alias("label")) for h in horizons]
    )
    return labels.select(*ids, F.explode(entries).alias("__e")).select(*ids, "__e.*")


def label_support(labels: DataFrame, key: str) -> DataFrame:
    """Support per fold x partition x horizon x receptor, and pooled over receptors (NULL key)."""
    long = long_labels(labels, ["fold_id", "partition", key])
    y = F.col("label")
    per = long.groupBy("fold_id", "partition", "horizon_hours", key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(y).alias("eligible"),
        F.count_if(y == 1).alias("positive"),
        F.count_if(y == 0).alias("negative"),
    )
    both = per.groupingSets(
        [["fold_id", "partition", "horizon_hours", key], ["fold_id", "partition", "horizon_hours"]],
        "fold_id",
        "partition",
        "horizon_hours",
        key,
    ).agg(
        F.when(F.grouping(key) == 1, "POOLED").otherwise("RECEPTOR").alias("scope"),
        *[F.sum(c).alias(c) for c in ("rows", "eligible", "positive", "negative")],
    )
    return both.select(
        "*",
        (F.col("rows") - F.col("eligible")).alias("unknown"),
        F.try_divide(F.col("positive"), F.col("eligible")).alias("positive_fraction"),
    )


def positive_support(labels: DataFrame, key: str, hours: int) -> DataFrame:
    """Positive days, clusters of consecutive positive days and the sparse flag per fold, partition, receptor."""
    group = ["fold_id", "partition", key]
    positive = labels.where(F.col(label_name(hours)) == 1)
    clusters = runs(positive.select(*group, "issue_date"), group, "issue_date")
    counted = clusters.groupBy(*group).agg(
        F.sum("days").alias("positive_days"), F.count(F.lit(1)).alias("positive_clusters")
    )
    everything = labels.groupBy(*group).agg(F.count(label_name(hours)).alias("eligible"))
    return everything.join(counted, group, "left").select(
        *group,
        "eligible",
        F.coalesce("positive_days", F.lit(0)).alias("positive_days"),
        F.coalesce("positive_clusters", F.lit(0)).alias("positive_clusters"),
        (F.coalesce("positive_days", F.lit(0)) < policy.SPARSE_POSITIVE_LIMIT).alias("sparse_positive"),
    )
