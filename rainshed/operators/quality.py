"""Agreement, profiles, drift and missingness checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainshed.operators.distributed import exact_quantiles, histogram, running_totals, value_splits
from rainshed.sources.integrity import written

PROFILE_PROBS = (0.001, 0.005, 0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99, 0.995, 0.999)
TAIL, EXTREME_TAIL = 0.01, 0.005
ROBUST_FACTOR = 1.349


def agreement(base: Column, test: Column) -> list[Column]:
    """n, Pearson, MAE, bias, RMSE and NRMSE over rows where both are present; NULL where undefined."""
    both = base.isNotNull() & test.isNotNull()
    b, t = F.when(both, base), F.when(both, test)
    d = t - b
    n = F.count(d)
    sb, st = F.stddev_pop(b), F.stddev_pop(t)
    rmse = F.sqrt(F.avg(d * d))
    return [
        n.alias("common_n"),
        F.when((n >= 3) & (sb > 0) & (st > 0), F.corr(b, t)).alias("pearson"),
        F.avg(F.abs(d)).alias("mae"),
        F.avg(d).alias("bias"),
        rmse.alias("rmse"),
        F.when(sb > 0, rmse / sb).alias("nrmse"),
    ]


def bounded_ratio(base: Column, test: Column, least: float) -> Column:
    """test / base where the base exceeds ``least``; else NULL."""
    return F.when(base > least, test / base)


def angular_difference(a: Column, b: Column) -> Column:
    """Smallest turn between two directions in degrees."""
    return F.abs((a - b + 540.0) % 360.0 - 180.0)


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.count_if(a & b), F.count_if(a | b))


def sensitivity(results: DataFrame, group: Sequence[str], ident: Sequence[str], value: str, support: str, base: str = "BASE") -> DataFrame:
    """Every scenario against the base scenario.

    The base value reaches its sibling rows through a window over one (receptor, time), which holds one row per
    scenario.
    """
    w = Window.partitionBy(*ident)
    is_base = F.col("scenario") == base
    paired = results.select(
        *dict.fromkeys([*group, *ident]),
        F.col(value).alias("__t"),
        (F.col(support) > 0).alias("__ts"),
        F.max(F.when(is_base, F.col(value))).over(w).alias("__b"),
        F.coalesce(F.max(F.when(is_base, F.col(support) > 0)).over(w), F.lit(False)).alias("__bs"),
    )
    return paired.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("__ts").alias("support_rows"),
        jaccard(F.col("__ts"), F.col("__bs")).alias("jaccard"),
        *agreement(F.col("__b"), F.col("__t")),
    )


# ---- distribution profile and drift ------------------------------------------------------------------------------
def profile(df: DataFrame, keys: Sequence[str], value: str, bounded: bool = False, splits: Sequence[float] | None = None) -> DataFrame:
    """Eleven exact quantiles, range, mean, population std, IQR and robust scale per key.

    ``bounded`` states that a key has few rows (a panel: at most the days of the record) and takes the quantiles in
    the same aggregate; otherwise they come from value ranges, for groups of any size.
    """
    names = [f"q{str(p)[2:]}" for p in PROFILE_PROBS]
    v = F.col(value)
    stats = [
        F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")
    ]
    if bounded:
        q = F.percentile(v, F.array(*[F.lit(p) for p in PROFILE_PROBS])).alias("__q")
        base = df.groupBy(*keys).agg(*stats, q)
        out = base.select(*base.columns[:-1], *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])
    else:
        out = df.groupBy(*keys).agg(*stats).join(exact_quantiles(df, keys, value, PROFILE_PROBS, names=names, splits=splits), list(keys), "left")
    iqr = F.col("q75") - F.col("q25")
    return out.select("*", iqr.alias("iqr"), F.when(iqr > 0, iqr / ROBUST_FACTOR).alias("robust_scale"))


def midrank_cdf(
    reference: DataFrame, current: DataFrame, keys: Sequence[str], value: str, ident: Sequence[str], bounded: bool = False, splits: Sequence[float] | None = None
) -> DataFrame:
    """Mid-rank position of each current value in the reference sample of its key.

    Both sides are merged to distinct values and one running total of reference counts serves every current
    value, so no pair of values is formed.
    """
    keys = list(keys)
    ref = histogram(reference, keys, value).select(*keys, value, F.col("n").alias("nref"))
    cur = current.where(F.col(value).isNotNull()).select(*keys, value).distinct().withColumn("nref", F.lit(0).cast("bigint"))
    merged = ref.unionByName(cur).groupBy(*keys, value).agg(F.sum("nref").alias("nref"))
    if bounded:
        by_key = Window.partitionBy(*keys)
        cum = merged.select("*", F.sum("nref").over(by_key.orderBy(value)).alias("cum_nref"), F.sum("nref").over(by_key).alias("tot_nref"))
    else:
        cum = running_totals(merged, keys, value, ["nref"], splits=value_splits(reference, value) if splits is None else splits)
    below = F.col("cum_nref") - F.col("nref")
    cdf = cum.select(
        *keys, value, F.when(F.col("tot_nref") > 0, (below + F.col("cum_nref")) / (2.0 * F.col("tot_nref"))).alias("percentile")
    )
    return current.select(*dict.fromkeys([*keys, *ident, value])).join(cdf, [*keys, value], "left")


def robust_z(x: Column, median: Column, scale: Column) -> Column:
    return F.when(scale > 0, (x - median) / scale)


def range_state(x: Column, n: Column, low: Column, high: Column, pct: Column) -> Column:
    """Position of a current value against history, most serious class first."""
    return (
        F.when(x.isNull(), "CURRENT_MISSING")
        .when(F.coalesce(n, F.lit(0)) == 0, "NO_HISTORICAL_REFERENCE")
        .when(x < low, "BELOW_HISTORICAL_MIN")
        .when(x > high, "ABOVE_HISTORICAL_MAX")
        .when((pct < EXTREME_TAIL) | (pct > 1 - EXTREME_TAIL), "WITHIN_RANGE_EXTREME_TAIL")
        .when((pct < TAIL) | (pct > 1 - TAIL), "WITHIN_RANGE_1PCT_TAIL")
        .otherwise("WITHIN_HISTORICAL_RANGE")
    )


def compatibility(
    current: DataFrame, history: DataFrame, keys: Sequence[str], ident: Sequence[str], value: str, bounded: bool = False
) -> DataFrame:
    """Range state, percentile and robust z of every current value against its key's history.

    ``bounded`` as in ``profile``: only for histories with few rows a key.
    """
    if not bounded:  # read by the profile, the ranks and their cut points
        history = written(history.select(*keys, value), "history")
        current = written(current.select(*dict.fromkeys([*keys, *ident, value])), "current")
    splits = None if bounded else value_splits(history, value)
    prof = profile(history, keys, value, bounded, splits).select(*keys, "n", "min", "max", F.col("q5").alias("median"), "robust_scale")
    pos = midrank_cdf(history, current, keys, value, ident, bounded, splits)
    x = F.col(value)
    return pos.join(prof, list(keys), "left").select(
        *dict.fromkeys([*keys, *ident]),
        value,
        "percentile",
        robust_z(x, F.col("median"), F.col("robust_scale")).alias("robust_z"),
        range_state(x, F.col("n"), F.col("min"), F.col("max"), F.col("percentile")).alias("range_state"),
    )


def compatibility_summary(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """Roll-up per feature: missing, outside, tails, largest robust z and the resulting state."""
    s = F.col("range_state")
    g = states.groupBy(*by).agg(
        F.count(F.lit(1)).alias("receptors"),
        F.count_if(s == "CURRENT_MISSING").alias("missing"),
        F.count_if(s.isin("BELOW_HISTORICAL_MIN", "ABOVE_HISTORICAL_MAX")).alias("outside"),
        F.count_if(s == "WITHIN_RANGE_EXTREME_TAIL").alias("extreme_tail"),
        F.count_if(s == "WITHIN_RANGE_1PCT_TAIL").alias("one_percent_tail"),
        F.max(F.abs("robust_z")).alias("max_abs_robust_z"),
    )
    state = (
        F.when(F.col("missing") == F.col("receptors"), "CURRENTLY_UNAVAILABLE")
        .when(F.col("outside") > 0, "REVIEW_OUTSIDE_TRAINING_SUPPORT")
        .when((F.col("extreme_tail") > 0) | (F.col("one_percent_tail") > 0), "REVIEW_TAIL")
        .otherwise("WITHIN_TRAINING_RANGE")
    )
    return g.withColumn("compatibility_state", state)


def missingness_shift(parts: DataFrame, part: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Missing fraction of each feature per part of the data (fold; FIT, VALIDATION, current)."""
    m = parts.groupBy(*part).agg(*[F.avg(F.col(f).isNull().cast("double")).alias(f) for f in features])
    return m.unpivot(list(part), list(features), "feature", "missing_fraction")


# ---- missing cells and gates -------------------------------------------------------------------------------------
def classify_missing(cells: DataFrame, rules: DataFrame, in_season: Column, support: Column) -> DataFrame:
    """Class of each (receptor, feature) cell: out of season > season edge > no support > unexpected.

    ``cells``: feature, value, season_day; ``rules``: feature, min_season_day, edge_reason, conditional.
    """
    j = cells.join(rules, "feature", "left")
    edge = F.col("season_day") < F.coalesce("min_season_day", F.lit(0))
    cls = (
        F.when(F.col("value").isNotNull(), "PRESENT")
        .when(~in_season, "EXPECTED_OUT_OF_SEASON")
        .when(edge, "EXPECTED_STRUCTURAL_SEASON_EDGE")
        .when(F.coalesce("conditional", F.lit(False)) & (support <= 0), "EXPECTED_CONDITIONAL_MEDSEA_NO_SUPPORT")
        .otherwise("UNEXPECTED_OPERATIONAL_MISSING")
    )
    reason = (
        F.when(F.col("missing_class") == "EXPECTED_OUT_OF_SEASON", "CORE_APPLIES_SEP_DEC_ONLY")
        .when(F.col("missing_class") == "EXPECTED_STRUCTURAL_SEASON_EDGE", F.col("edge_reason"))
        .when(F.col("missing_class") == "EXPECTED_CONDITIONAL_MEDSEA_NO_SUPPORT", "BASELINE_MEDSEA_SUPPORT_FALSE")
        .when(F.col("missing_class") == "UNEXPECTED_OPERATIONAL_MISSING", "NOT_EXPLAINED_BY_FROZEN_MISSINGNESS_POLICY")
        .otherwise("")
    )
    classed = j.withColumn("missing_class", cls)
    return classed.select(*cells.columns, "missing_class", reason.alias("missing_reason"))


def feature_gate(unexpected: Column, edge: Column, unsupported: Column, out_of_season: Column, outside: Column) -> Column:
    """Gate state of a feature, first match wins."""
    return (
        F.when(unexpected > 0, "BLOCK_UNEXPECTED_MISSING")
        .when(edge > 0, "ALLOW_EXPECTED_SEASON_EDGE_NAN")
        .when(unsupported > 0, "ALLOW_CONDITIONAL_MEDSEA_NAN")
        .when(out_of_season > 0, "BLOCK_OUT_OF_SEASON")
        .when(outside > 0, "ALLOW_BETA_WITH_RANGE_REVIEW")
        .otherwise("ALLOW_BETA_PRESENT")
    )


def compatibility_gate(missing: Column, receptors: Column, outside: Column, equivalence: Column) -> Column:
    return (
        F.when(missing == receptors, "BLOCKED_MISSING_CURRENT")
        .when(outside > 0, "REVIEW_OUTSIDE_TRAINING_SUPPORT")
        .when(F.coalesce(equivalence.contains("PROXY"), F.lit(False)), "PROXY_RANGE_PLAUSIBLE_SEMANTIC_VALIDATION_PENDING")
        .otherwise("READY_RANGE_CHECK")
    )


def final_gate(structural: Column, in_season: Column, unexpected: Column) -> tuple[Column, Column]:
    """(verdict, beta allowed)."""
    verdict = (
        F.when(~structural, "FAIL_BETA_GATE_STRUCTURE_OR_STATIC")
        .when(~in_season, "PASS_BETA_GATE_LOGIC__OUT_OF_SEASON_BLOCKED")
        .when(unexpected > 0, "PASS_BETA_GATE__UNEXPECTED_OPERATIONAL_MISSING_BLOCKED")
        .otherwise("PASS_PROSPECTIVE_BETA_ALLOWED__STRUCTURAL_NAN_ACCEPTED")
    )
    return verdict, structural & in_season & (unexpected == 0)


def static_identity(a: DataFrame, b: DataFrame, on: Sequence[str], cols: Sequence[str], atol: float = 1e-10, rtol: float = 1e-10) -> DataFrame:
    """Rows whose static values differ beyond tolerance, or exist on one side only, per column."""
    x = a.select(*on, F.lit(True).alias("__a"), *[F.col(c).alias(f"__a_{c}") for c in cols])
    y = b.select(*on, F.lit(True).alias("__b"), *[F.col(c).alias(f"__b_{c}") for c in cols])
    j = x.join(y, list(on), "full_outer")

    def differs(c: str) -> Column:
        p, q = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        close = (p.isNull() & q.isNull()) | (F.abs(p - q) <= atol + rtol * F.abs(q))
        return ~F.coalesce(close, F.lit(False))

    return j.agg(
        F.count_if(F.col("__a").isNull() | F.col("__b").isNull()).alias("unmatched_rows"),
        *[F.count_if(F.col("__a") & F.col("__b") & differs(c)).alias(f"diff_{c}") for c in cols],
    )


class SchemaOrderError(ValueError):
    pass


def require_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Exact predictor order, checked on the schema."""
    if list(df.columns) != list(expected):
        raise SchemaOrderError(f"expected {list(expected)}, found {df.columns}")
    return df
