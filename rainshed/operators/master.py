"""Feature admission, name mapping and assembly of the training master."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainshed.functions.text import FORBIDDEN_PATTERNS
from rainshed.operators.panel import CardinalityError, asserted_unique, duplicate_keys
from rainshed.operators.windows import first_by

# Classes admitted to the primary dynamic core and their missingness class.
PRIMARY_CLASSES = {
    "CORE_CAUSAL": "STANDARD",
    "CORE_CAUSAL_STRUCTURAL_LAG_GAP": "STRUCTURAL_SEASON_EDGE_NAN",
    "CORE_CAUSAL_CONDITIONAL_SUPPORT": "CONDITIONAL_MEDSEA_SUPPORT__NO_ZERO_IMPUTATION",
}
SUPPORT_CLASS = "SUPPORT_STATE_COMPANION"


class LeakageError(ValueError):
    pass


def project(df: DataFrame, keys: Sequence[str], source: str, columns: Sequence[str]) -> DataFrame:
    """Keys plus whitelisted columns renamed ``<source>__<column>``; anything else is never read."""
    return df.select(*keys, *[F.col(c).alias(f"{source}__{c}") for c in columns])


def missing_columns(df: DataFrame, expected: Sequence[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in expected if c not in have]


def _lookup(pairs: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def admit_features(
    inventory: DataFrame,
    exclusions: dict[tuple[str, str], str],
    calendar: Sequence[tuple[str, str]],
    companions: Sequence[str],
) -> DataFrame:
    """Admission of each (source, feature_column, feature_class): explicit exclusion > calendar > class > companion."""
    key = F.concat_ws("|", "source", "feature_column")
    cls = F.col("feature_class")
    excluded = _lookup({"|".join(k): v for k, v in exclusions.items()}, key) if exclusions else F.lit(None).cast("string")
    is_calendar = key.isin(*["|".join(c) for c in calendar])
    primary = cls.isin(*PRIMARY_CLASSES)
    companion = (cls == SUPPORT_CLASS) & F.col("feature_column").isin(*companions)
    role = (
        F.when(F.col("__ex").isNotNull(), F.lit(None))
        .when(is_calendar, "PRIMARY_CALENDAR_KNOWN")
        .when(primary, "PRIMARY_DYNAMIC_CORE")
        .when(companion, "PRIMARY_SUPPORT_COMPANION")
    )
    reason = (
        F.when(F.col("__ex").isNotNull(), F.col("__ex"))
        .when(is_calendar, "CANONICAL_SEASON_PROGRESS_INDEX")
        .when(primary, cls)
        .when(companion, "REQUIRED_TO_INTERPRET_CONDITIONAL_MEDSEA_FEATURES")
        .when(cls == SUPPORT_CLASS, "SUPPORT_COMPANION_NOT_SELECTED_FOR_PRIMARY_CORE")
        .otherwise(F.concat(F.lit("FEATURE_CLASS_"), cls))
    )
    missingness = F.when(
        F.col("model_role").isNotNull(),
        F.coalesce(
            F.when(F.col("model_role") == "PRIMARY_SUPPORT_COMPANION", "SUPPORT_STATE"),
            _lookup(PRIMARY_CLASSES, cls),
            F.lit("STANDARD"),
        ),
    )
    staged = inventory.withColumn("__ex", excluded)
    return (
        staged.withColumn("model_role", role)
        .withColumn("include", F.col("model_role").isNotNull())
        .withColumn("reason", reason)
        .withColumn("missingness_semantics", missingness)
        .drop("__ex")
    )


DEFAULT_STATIC_REASON = "NOT_SELECTED_FOR_PARSIMONIOUS_PRIMARY_STATIC_CORE"


def admit_static(descriptors: DataFrame, whitelist: DataFrame, reasons: DataFrame) -> DataFrame:
    """Whitelisted descriptors in, others out with their registered or the default reason."""
    j = descriptors.join(whitelist.withColumn("__in", F.lit(True)), "feature_column", "left").join(reasons, "feature_column", "left")
    inside = F.coalesce("__in", F.lit(False))
    return j.select(
        "feature_column",
        inside.alias("include"),
        F.when(~inside, F.coalesce("exclusion_reason", F.lit(DEFAULT_STATIC_REASON))).alias("exclusion_reason"),
    )


def map_names(canonical: DataFrame, available: DataFrame, declared: DataFrame, prefix: str = "static__") -> DataFrame:
    """Source column of each canonical name: exact > unprefixed > case-insensitive > declared > unique suffix.

    ``canonical``: name; ``available``: col; ``declared``: name, col.  Every rule is an equi join: for suffixes
    each available column lists its own suffixes.  More than one distinct column is AMBIGUOUS.
    """
    raw = F.when(F.col("name").startswith(prefix), F.expr(f"substring(name, {len(prefix) + 1})")).otherwise(F.col("name"))
    c = canonical.select("name", raw.alias("raw"), F.lower(raw).alias("low"))
    a = available.select("col").distinct()

    def hits(df: DataFrame, rank: int, method: str) -> DataFrame:
        return df.select("name", "col", F.lit(rank).alias("rank"), F.lit(method).alias("method"))

    exact = hits(c.join(a, F.col("name") == F.col("col")), 0, "EXACT_CANONICAL")
    plain = hits(c.join(a, F.col("raw") == F.col("col")), 1, "EXACT_UNPREFIXED")
    folded = hits(c.join(a, (F.col("low") == F.lower("col")) & (F.col("raw") != F.col("col"))), 2, "CASE_INSENSITIVE_UNPREFIXED")
    stated = hits(c.select("name").join(declared, "name").join(a, "col", "left_semi"), 3, "WHITELIST_DECLARED")
    tails = a.select("col", F.explode(F.transform(F.sequence(F.lit(1), F.length("col")), lambda i: F.substring(F.lower("col"), i, F.length("col")))).alias("low"))
    suffix = c.join(tails, "low")
    unique = suffix.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first("col").alias("col")).where("n = 1")
    found = exact.unionByName(plain).unionByName(folded).unionByName(stated).unionByName(hits(unique, 4, "UNIQUE_SUFFIX_MATCH"))
    # An exact canonical column settles the name; the other rules must agree on one column.
    best = found.groupBy("name").agg(
        F.min_by(F.struct("col", "method"), F.struct("rank", "col")).alias("b"),
        F.min("rank").alias("first_rank"),
        F.countDistinct("col").alias("columns"),
    )
    ambiguous = (F.col("first_rank") > 0) & (F.col("columns") > 1)
    return c.join(best, "name", "left").select(
        F.col("name").alias("canonical"),
        F.when(~ambiguous, F.col("b.col")).alias("source_column"),
        F.when(F.col("b").isNull(), "UNRESOLVED").when(ambiguous, "AMBIGUOUS").otherwise(F.col("b.method")).alias("method"),
    )


# ---- target ------------------------------------------------------------------------------------------------------
def target_series(daily: DataFrame, receptor: str = "receptor_id", date: str = "date") -> DataFrame:
    """One observed value per receptor and day: the series with the lowest priority wins, nothing is averaged.

    ``daily``: receptor, date, source_priority, source_series_id, provider, daily_value, daily_max.  One provider
    prefers the daily maximum and falls back to the daily value.
    """
    best = first_by(daily, [receptor, date], [F.col("source_priority"), F.col("source_series_id")])
    hourly = F.col("provider") == "ARPAL"
    value = F.when(hourly, F.coalesce("daily_max", "daily_value")).otherwise(F.col("daily_value"))
    return best.select(
        receptor,
        date,
        "source_series_id",
        value.alias("target_observed_value"),
        F.when(hourly, "DAILY_MAX_FROM_HOURLY_SOURCE").otherwise("CANONICAL_DAILY_PRIMARY_VALUE").alias("target_observation_statistic"),
        F.when(hourly, "DAILY_MAX_LEVEL").otherwise("DAILY_SOURCE_VALUE_NOT_INSTANTANEOUS_PEAK").alias("target_temporal_semantics"),
    )


def target_coverage(base: DataFrame, receptor: str, date: str, value: str) -> DataFrame:
    v, d = F.col(value), F.col(date)
    known = F.when(v.isNotNull(), d)
    return base.groupBy(receptor).agg(
        F.count(F.lit(1)).alias("expected_grid_days"),
        F.count(v).alias("numeric_days"),
        F.avg(v.isNotNull().cast("double")).alias("coverage_fraction"),
        F.countDistinct(F.year(known)).alias("years_with_numeric_values"),
        F.min(known).alias("first_valid_date"),
        F.max(known).alias("last_valid_date"),
    )


# ---- master ------------------------------------------------------------------------------------------------------
def check_leakage(predictors: Sequence[str]) -> None:
    """Fails when a predictor name matches a forbidden pattern; the names are schema metadata."""
    forbidden = re.compile("|".join(FORBIDDEN_PATTERNS))
    if bad := [p for p in predictors if forbidden.search(p.lower())]:
        raise LeakageError(f"forbidden predictor names: {bad}")


def build_master(
    labels: DataFrame,
    dynamic: DataFrame,
    static: DataFrame,
    receptor: str,
    dynamic_cols: Sequence[str],
    static_cols: Sequence[str],
    check: bool = True,
) -> DataFrame:
    """Labels with dynamic (receptor, day) and static (receptor) predictors, many-to-one on both joins.

    Join flags are kept so that coverage can be audited; predictor names are checked for leakage first.  With ``check``
    a repeated key on a "one" side fails the job that reads the master.
    """
    dyn = project(dynamic.withColumnRenamed("date", "issue_date"), [receptor, "issue_date"], "dynamic", dynamic_cols)
    stat = project(static, [receptor], "static", static_cols)
    check_leakage([*dyn.columns[2:], *stat.columns[1:]])
    dyn, stat = dyn.withColumn("dynamic_match", F.lit(True)), stat.withColumn("static_match", F.lit(True))
    if check:
        dyn, stat = asserted_unique(dyn, [receptor, "issue_date"]), asserted_unique(stat, [receptor])
    out = labels.join(dyn, [receptor, "issue_date"], "left").join(stat, receptor, "left")
    no = F.lit(False)
    return out.withColumn("dynamic_match", F.coalesce("dynamic_match", no)).withColumn("static_match", F.coalesce("static_match", no))


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if duplicate_keys(df, keys).limit(1).count():
        raise CardinalityError(f"repeated key on {list(keys)}")
    return df


def missingness(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing rows and fraction per column from one aggregate."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in columns])
    long = n.unpivot([*by, "rows"], list(columns), "predictor", "non_null_rows")
    missing = F.col("rows") - F.col("non_null_rows")
    return long.withColumn("missing_rows", missing).withColumn("missing_fraction", missing / F.col("rows"))


def predictor_audit(fit: DataFrame, fold: str, columns: Sequence[str]) -> DataFrame:
    """Non-null, distinct, population std and constant flag per fold and predictor on FIT rows.

    Values are counted per (fold, predictor, value) with partial aggregation; a count-distinct per column would
    copy every row once per predictor through the shuffle without combining.
    """
    long = fit.select(fold, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([fold], list(columns), "predictor", "v")
    n = F.col("n")
    h = long.groupBy(fold, "predictor", "v").agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("v").isNotNull(), n)
    g = h.groupBy(fold, "predictor").agg(
        F.sum("n").alias("fit_rows"),
        F.coalesce(F.sum(known), F.lit(0)).alias("non_null_rows"),
        F.count("v").alias("unique_non_null_values"),
        (F.sum(F.col("v") * n) / F.sum(known)).alias("mean_non_null"),
    )
    dev = (
        h.where(F.col("v").isNotNull())
        .join(g.select(fold, "predictor", "mean_non_null"), [fold, "predictor"])
        .groupBy(fold, "predictor")
        .agg(F.sqrt(F.sum(n * F.pow(F.col("v") - F.col("mean_non_null"), 2)) / F.sum("n")).alias("std_non_null"))
    )
    return g.join(dev, [fold, "predictor"], "left").withColumn("constant_in_fit", F.col("unique_non_null_values") <= 1)
