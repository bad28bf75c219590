"""Audits of time axes, grids, values and series status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainshed.functions.clock import wall_micros
from rainshed.operators.distributed import exact_quantiles, previous_in_order
from rainshed.sources.integrity import written


def time_audit(df: DataFrame, unit: Sequence[str], ts: str, order: str, start: Column, end: Column, step: str, order_width: float) -> DataFrame:
    """Missing, extra, duplicate and out-of-order times per unit against a regular grid, and the median step.

    ``start``/``end`` bound the expected grid of a unit; ``order`` is the position in the source.
    """
    unit = list(unit)
    present = df.groupBy(*unit, F.col(ts).alias("__ts")).agg(F.count(F.lit(1)).alias("__n"))
    bounds = df.groupBy(*unit).agg(start.alias("__start"), end.alias("__end"))
    expected = bounds.select(*unit, F.explode(F.sequence("__start", "__end", F.expr(step))).alias("__ts"), F.lit(True).alias("__want"))
    both = expected.join(present, [*unit, "__ts"], "full_outer")
    counts = both.groupBy(*unit).agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("time_count"),
        F.count_if("__want").alias("expected_time_count"),
        F.count_if(F.col("__want") & F.col("__n").isNull()).alias("missing_times"),
        F.count_if(F.col("__want").isNull()).alias("extra_times"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_times"),
    )
    sec = df.select(*unit, order, (wall_micros(F.col(ts)) / 1e6).alias("__s"))
    prev = previous_in_order(sec, unit, order, order_width, ["__s"])
    steps = prev.select(*unit, (F.col("__s") - F.col("prev___s")).alias("hop")).where(F.col("hop").isNotNull())
    steps = written(steps, "steps")  # read by the disorder count, the cut points and the value counts
    disorder = steps.groupBy(*unit).agg(F.count_if(F.col("hop") < 0).alias("out_of_order_times"))
    median = exact_quantiles(steps, unit, "hop", [0.5], names=["median_step_seconds"])
    return (
        counts.join(disorder, unit, "left")
        .join(median, unit, "left")
        .withColumn("out_of_order_times", F.coalesce("out_of_order_times", F.lit(0)))
    )


def out_of_month(df: DataFrame, unit: Sequence[str], ts: str, year: Column, month: Column) -> DataFrame:
    outside = (F.year(ts) != year) | (F.month(ts) != month)
    return df.groupBy(*unit).agg(F.count(F.lit(1)).alias("rows"), F.count_if(outside).alias("out_of_month_times"))


def grid_audit(cells: DataFrame, file: str, order: str, tolerance: float = 1e-8) -> DataFrame:
    """Grid signature per file (cell count, coordinate bounds, first and last cell in ``order``) against the first file's."""
    sig = cells.groupBy(file).agg(
        F.count(F.lit(1)).alias("cells"),
        F.min("lat").alias("lat_min"),
        F.max("lat").alias("lat_max"),
        F.min("lon").alias("lon_min"),
        F.max("lon").alias("lon_max"),
        *[f(c, order).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("first", F.min_by), ("last", F.max_by))],
    )
    names = ["cells", *[f"{c}_{n}" for n in ("min", "max", "first", "last") for c in ("lat", "lon")]]
    ref = sig.agg(F.min_by(F.struct(*names), file).alias("r")).scalar()
    marked = sig.withColumn("__r", ref)
    same = F.col("cells") == F.col("__r.cells")
    for n in names[1:]:
        same = same & (F.abs(F.col(n) - F.col("__r")[n]) <= tolerance)
    return marked.select(*sig.columns, same.alias("grid_matches"))


def value_audit(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    v = F.col(value)
    bad = v.isNull() | F.isnan(v)
    good = F.when(~bad, v)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("values"),
        F.count(good).alias("finite"),
        F.count_if(bad).alias("missing"),
        F.count_if(good < 0).alias("negative"),
        F.min(good).alias("min_value"),
        F.max(good).alias("max_value"),
    )


def review_reasons(counters: dict[str, Column]) -> Column:
    """``NAME=count`` for every counter above zero."""
    parts = [F.when(c > 0, F.concat(F.lit(f"{n}="), c.cast("string"))) for n, c in counters.items()]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def series_status(numeric: Column, reasons: Column) -> Column:
    return F.when(F.size(reasons) > 0, "REVIEW").when(numeric > 0, "DATA_OK").otherwise("NO_DATA_SOURCE")


def plausible_999(parameter: Column, unit: Column) -> Column:
    """999 is physically plausible for total radiation (W/m2) and pressure (hPa)."""
    p, u = F.lower(F.trim(parameter)), F.lower(F.trim(unit))
    pressure = p.isin("pressione", "pressione (barometro di prec.)") & (u == "hpa")
    return F.coalesce(((p == "radiazione totale") & u.contains("w/m")) | pressure, F.lit(False))


def sentinel_status(suspects: Column, plausible: Column) -> Column:
    return (
        F.when(suspects <= 0, "NONE").when(plausible, "FALSE_POSITIVE_999_PHYSICALLY_PLAUSIBLE").otherwise("REVIEW")
    )
