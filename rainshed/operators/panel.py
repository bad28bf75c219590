"""Receptor-day panels: calendar keys, season filter, dense grid, validated joins, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainshed import policy


def in_season(date: Column, first_year: int, last_year: int, months: tuple[int, int] = policy.SEASON_MONTHS) -> Column:
    return F.month(date).between(*months) & F.year(date).between(first_year, last_year)


def season_span(ts: Column, first_year: int, last_year: int, months: tuple[int, int] = policy.SEASON_MONTHS) -> Column:
    """Range on a raw timestamp column that covers all seasons: unlike ``in_season`` it reaches the Parquet scan."""
    start = F.lit(f"{first_year}-{months[0]:02d}-01 00:00:00").cast("timestamp_ntz")
    end = F.lit(f"{last_year + months[1] // 12}-{months[1] % 12 + 1:02d}-01 00:00:00").cast("timestamp_ntz")
    return (ts >= start) & (ts < end)


def season_day(date: Column, start_month: int = policy.SEASON_START_MONTH) -> Column:
    return F.datediff(date, F.make_date(F.year(date), F.lit(start_month), F.lit(1))) + 1


def with_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date)
    return df.select(
        "*",
        F.year(d).alias("season_year"),
        F.month(d).alias("month"),
        F.dayofyear(d).alias("day_of_year"),
        season_day(d).alias("season_day"),
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL is the only missing value inside the library; one leaked NaN would spoil every completeness rule."""
    floats = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def season_calendar(keys: DataFrame, first_year: int, last_year: int, date: str = "date") -> DataFrame:
    """Every key on every season day, by exploding a date sequence (no join)."""
    m0, m1 = policy.SEASON_MONTHS
    start = F.make_date(F.col("season_year"), F.lit(m0), F.lit(1))
    end = F.last_day(F.make_date(F.col("season_year"), F.lit(m1), F.lit(1)))
    years = F.explode(F.sequence(F.lit(first_year), F.lit(last_year)))
    return keys.withColumn("season_year", years).withColumn(date, F.explode(F.sequence(start, end)))


def densify(
    daily: DataFrame,
    keys: DataFrame,
    measures: Sequence[str],
    first_year: int,
    last_year: int,
    date: str = "date",
) -> DataFrame:
    """Dense season panel over ``keys``; days without a row get NULL measures.

    ``daily`` is unique per (key, date).  Calendar rows and value rows are united and grouped after one
    repartition by (key, season_year); that layout also serves every season window downstream, so
    densifying, features and labels share a single exchange.
    """
    key = keys.columns
    # Keys are filtered here, so that every later use of the panel has the same plan and shares its exchanges.
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    skeleton = season_calendar(keys.where(known), first_year, last_year, date)
    values = daily.where(known & in_season(F.col(date), first_year, last_year)).select(
        *key, F.year(date).alias("season_year"), date, *measures
    )
    both = skeleton.withColumn("__grid", F.lit(True)).unionByName(
        values.withColumn("__grid", F.lit(None).cast("boolean")), allowMissingColumns=True
    )
    dense = (
        both.repartition(*key, "season_year")
        .groupBy(*key, "season_year", date)
        .agg(F.max("__grid").alias("__grid"), *[F.max(m).alias(m) for m in measures])
        .where(F.col("__grid"))
    )
    return dense.select(*key, date, "season_year", season_day(F.col(date)).alias("season_day"), *measures)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


class CardinalityError(ValueError):
    pass


def validated_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "many_to_one"
) -> DataFrame:
    """Equi join that fails when a "one" side repeats a key.

    The check is an aggregate per "one" side and stops at the first repeated key.
    """
    checks = {"one_to_one": (left, right), "many_to_one": (right,), "one_to_many": (left,)}[validate]
    for side in checks:
        if duplicate_keys(side, on).limit(1).count():
            raise CardinalityError(f"{validate}: repeated key on {list(on)}")
    return left.join(right, list(on), how)


def asserted_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows as they are; a job that meets a repeated key fails.

    The check is a count over the key in the layout that a join on the key needs anyway, so the side is read once and no
    job runs while the plan is built.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    text = F.lit(f"repeated key on {list(keys)}")
    return df.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(text).cast("boolean")).otherwise(True)).drop("__n")


def indicator_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join with ``match`` in both / left_only / right_only."""
    joined = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), list(on), how)
    match = (
        F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left_only").otherwise("right_only")
    )
    return joined.withColumn("match", match).drop("__l", "__r")


def match_fraction(joined: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((F.col("match") == "both").cast("double")).alias("match_fraction"),
    )


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Full outer comparison: presence class and one null-safe equality flag per column."""
    a = left.select(*keys, F.lit(True).alias("__l"), *[F.col(c).alias(f"__l_{c}") for c in cols])
    b = right.select(*keys, F.lit(True).alias("__r"), *[F.col(c).alias(f"__r_{c}") for c in cols])
    j = a.join(b, list(keys), "full_outer")
    presence = (
        F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left_only").otherwise("right_only")
    )
    return j.select(
        *keys,
        presence.alias("presence"),
        *[F.col(f"__l_{c}").eqNullSafe(F.col(f"__r_{c}")).alias(f"same_{c}") for c in cols],
    )


def reconcile_summary(compared: DataFrame, cols: Sequence[str]) -> DataFrame:
    both = F.col("presence") == "both"
    return compared.agg(
        F.count_if(both).alias("both_rows"),
        F.count_if(F.col("presence") == "left_only").alias("left_only_rows"),
        F.count_if(F.col("presence") == "right_only").alias("right_only_rows"),
        *[F.count_if(both & ~F.col(f"same_{c}")).alias(f"diff_{c}") for c in cols],
    )


def season_gaps(panel: DataFrame, key: Sequence[str], expected: int = policy.SEASON_DAYS) -> DataFrame:
    """Key-seasons whose day count is not the full season."""
    return (
        panel.groupBy(*key, "season_year").agg(F.count(F.lit(1)).alias("days")).where(F.col("days") != expected)
    )


def audit_panel(
    panel: DataFrame,
    key: Sequence[str],
    date: str,
    measures: Sequence[str],
    *,
    expected_rows: int | None = None,
    expected_receptors: int | None = None,
) -> DataFrame:
    """One verdict row: counts, duplicate keys, all-null columns, PASS/FAIL with reasons."""
    receptor = key[0]
    # Grouping by the primary key first makes duplicates and every count one two-step aggregate.
    per_key = panel.groupBy(*key, date).agg(
        F.count(F.lit(1)).alias("__n"), *[F.count(m).alias(f"__c_{m}") for m in measures]
    )
    per_receptor = per_key.groupBy(receptor).agg(
        F.sum("__n").alias("__n"),
        F.sum(F.col("__n") - 1).alias("__dup"),
        F.min("__n").alias("__lo"),
        F.max("__n").alias("__hi"),
        *[F.sum(f"__c_{m}").alias(f"__c_{m}") for m in measures],
    )
    total = per_receptor.agg(
        F.sum("__n").alias("rows"),
        F.sum("__dup").alias("duplicate_keys"),
        F.count(F.lit(1)).alias("receptors"),
        F.min("__lo").alias("min_samples_per_day"),
        F.max("__hi").alias("max_samples_per_day"),
        F.filter(
            F.array(*[F.when(F.sum(f"__c_{m}") == 0, F.lit(m)) for m in measures]), lambda x: x.isNotNull()
        ).alias("all_null"),
    )
    tests = [
        (F.col("duplicate_keys") > 0, F.concat(F.lit("duplicate_keys="), F.col("duplicate_keys"))),
        (F.size("all_null") > 0, F.concat(F.lit("all_null="), F.array_join("all_null", ","))),
    ]
    if expected_rows is not None:
        tests.append((F.col("rows") != expected_rows, F.concat(F.lit("rows="), F.col("rows"))))
    if expected_receptors is not None:
        tests.append((F.col("receptors") != expected_receptors, F.concat(F.lit("receptors="), F.col("receptors"))))
    reasons = F.filter(F.array(*[F.when(t, text) for t, text in tests]), lambda x: x.isNotNull())
    return total.withColumn("reasons", reasons).withColumn(
        "status", F.when(F.size("reasons") == 0, "PASS").otherwise("FAIL")
    )
