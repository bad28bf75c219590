"""Exact order statistics for groups of any size.

A window ordered by value over one key puts that key into one task.  Here a key is cut into value ranges
first: the cut points come from approximate global quantiles of the value, so a (key, range) group holds
about 1/n of the *whole* table at most, however large one key is.  Equal values are merged before the cut.
Only the cut points (at most ``n`` numbers) reach the driver, and they affect balance, never results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256
_RANGE = "__range"


def value_splits(df: DataFrame, value: str, n: int = RANGES) -> list[float]:
    """At most ``n - 1`` ascending cut points of a numeric column.

    One shuffle-free pass over a single column, run while the plan is built; give it the rows before any
    aggregation so that the scan is all it costs.
    """
    probs = [i / n for i in range(1, n)]
    return sorted(set(df.select(F.col(value).cast("double").alias("v")).approxQuantile("v", probs, 0.3 / n)))


def with_range(df: DataFrame, value: str, splits: Sequence[float]) -> DataFrame:
    """Adds the index of the value's range (a binary search per row)."""
    if not splits:
        return df.withColumn(_RANGE, F.lit(0))
    edges = [float("-inf"), *splits, float("inf")]
    cut = Bucketizer(splits=edges, inputCol="__v", outputCol=_RANGE, handleInvalid="keep")
    ranged = cut.transform(df.withColumn("__v", F.col(value).cast("double"))).drop("__v")
    return ranged.withColumn(_RANGE, F.col(_RANGE).cast("int"))


def _same(keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of keys with their prefixed copies."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return on


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    *,
    descending: bool = False,
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """Add ``cum_<c>`` (inclusive) and ``tot_<c>`` per key for rows that are unique per (keys, order).

    Two levels: range totals per key give the offsets, the window runs inside one range.
    """
    keys = list(keys)
    if splits is None:
        splits = value_splits(df, order)
    ranged = with_range(df, order, splits)
    totals = ranged.groupBy(*keys, _RANGE).agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    all_ranges = Window.partitionBy(*keys)
    by_range = all_ranges.orderBy(F.col(_RANGE).desc() if descending else F.col(_RANGE).asc())
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col(_RANGE).alias("__k_range"),
        *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums],
        *[F.sum(f"__t_{c}").over(all_ranges).alias(f"tot_{c}") for c in sums],
    )
    on = (F.col(_RANGE) == F.col("__k_range")) & _same(keys, "__k_")
    inside = (
        Window.partitionBy(*keys, _RANGE)
        .orderBy(F.col(order).desc() if descending else F.col(order).asc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = ranged.join(offsets, on).select(
        *df.columns,
        *[(F.col(f"__o_{c}") + F.sum(c).over(inside)).alias(f"cum_{c}") for c in sums],
        *[F.col(f"tot_{c}") for c in sums],
    )
    return out


def histogram(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """Distinct values with counts ``n``; NULL values are left out.  Partial aggregation absorbs hot keys."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.cast("bigint").alias("n"))


def _selected_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], splits: Sequence[float] | None) -> DataFrame:
    """(keys, i, quantile): linear-interpolated quantile number i of each key, by selection.

    Counts per (key, value range) tell which ranges hold the wanted ranks; only rows of those ranges are counted
    by value and ordered.  Most rows are read but never shuffled.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    ranged = with_range(rows, value, value_splits(rows, value) if splits is None else splits)
    counts = ranged.groupBy(*keys, _RANGE).agg(F.count(F.lit(1)).alias("__c"))
    key = Window.partitionBy(*keys)
    before = key.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col(_RANGE).alias("__k_range"),
        "__c",
        F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"),
        F.sum("__c").over(key).alias("__t"),
    )
    # Wanted 0-based ranks of each quantile that fall into the range.
    wanted = F.transform(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]),
        lambda x: F.struct(
            x["i"].alias("i"),
            F.floor(x["p"] * (F.col("__t") - 1)).alias("lo"),
            F.ceil(x["p"] * (F.col("__t") - 1)).alias("hi"),
            (x["p"] * (F.col("__t") - 1) - F.floor(x["p"] * (F.col("__t") - 1))).alias("f"),
        ),
    )
    end = F.col("__o") + F.col("__c")
    here = F.filter(
        wanted, lambda x: ((x["lo"] >= F.col("__o")) & (x["lo"] < end)) | ((x["hi"] >= F.col("__o")) & (x["hi"] < end))
    )
    needed = placed.withColumn("__w", here).where(F.size("__w") > 0).drop("__c", "__t")
    # A few counters a row: the planner broadcasts them while they are small and shuffles them beyond that.
    kept = ranged.join(needed, (F.col(_RANGE) == F.col("__k_range")) & _same(keys, "__k_"), "left_semi")
    values = kept.groupBy(*keys, _RANGE, value).agg(F.count(F.lit(1)).alias("__n"))
    inside = Window.partitionBy(*keys, _RANGE).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = values.withColumn("__cum", F.sum("__n").over(inside)).join(
        needed, (F.col(_RANGE) == F.col("__k_range")) & _same(keys, "__k_")
    )
    last = F.col("__o") + F.col("__cum")
    first = last - F.col("__n")

    def at(rank: Column) -> Column:
        return (rank >= first) & (rank < last)

    hits = spans.select(
        *keys, value, first.alias("__a"), last.alias("__b"), F.explode(F.filter("__w", lambda x: at(x["lo"]) | at(x["hi"]))).alias("__x")
    )

    def value_at(rank: str) -> Column:
        r = F.col(f"__x.{rank}")
        return F.max(F.when((r >= F.col("__a")) & (r < F.col("__b")), F.col(value)))

    picked = hits.groupBy(*keys, F.col("__x.i").alias("i")).agg(value_at("lo").alias("__lo"), value_at("hi").alias("__hi"), F.max("__x.f").alias("__f"))
    return picked.select(*keys, "i", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f")).alias("quantile"))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    *,
    names: Sequence[str] | None = None,
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per key as columns, without holding a group in one task."""
    names = list(names or [f"q{round(p * 1000):03d}" for p in probs])
    long = _selected_quantiles(df, keys, value, probs, splits)
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("quantile"))).alias(n) for i, n in enumerate(names)])


def quantile_grid(df: DataFrame, keys: Sequence[str], value: str, parts: int, *, splits: Sequence[float] | None = None) -> DataFrame:
    """The ``parts - 1`` inner quantiles i/parts of each key as rows (keys, i, quantile)."""
    long = _selected_quantiles(df, keys, value, [i / parts for i in range(1, parts)], splits)
    return long.withColumn("i", F.col("i") + 1)


def weighted_quantile_grid(counts: DataFrame, keys: Sequence[str], value: str, weight: str, parts: int, *, splits: Sequence[float] | None = None) -> DataFrame:
    """As ``quantile_grid``, from distinct values with counts (keys, value, weight): the rows themselves are not read again."""
    keys = list(keys)
    cum = running_totals(counts, keys, value, [weight], splits=splits)
    total, end = F.col(f"tot_{weight}"), F.col(f"cum_{weight}")
    begin = end - F.col(weight)
    scale = F.lit(float(parts)) / F.greatest(total - 1, F.lit(1))
    first = F.when(total > 1, F.greatest(F.floor((begin - 1) * scale), F.lit(1))).otherwise(1).cast("int")
    last = F.when(total > 1, F.least(F.ceil(end * scale), F.lit(parts - 1))).otherwise(parts - 1).cast("int")
    near = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    wanted = F.transform(near, lambda i: F.struct(i.alias("i"), (i.cast("double") / parts * (total - 1)).alias("at")))
    here = lambda r: (r >= begin) & (r < end)
    kept = F.filter(wanted, lambda x: here(F.floor(x["at"])) | here(F.ceil(x["at"])))
    hits = cum.select(*keys, value, begin.alias("__a"), end.alias("__b"), F.explode(kept).alias("__x")).select(*keys, value, "__a", "__b", "__x.*")
    low, high = F.floor("at"), F.ceil("at")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__a")) & (rank < F.col("__b")), F.col(value)))

    picked = hits.groupBy(*keys, "i").agg(at(low).alias("__lo"), at(high).alias("__hi"), F.max(F.col("at") - F.floor("at")).alias("__f"))
    return picked.select(*keys, "i", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f")).alias("quantile"))


def percent_rank_average(
    df: DataFrame, keys: Sequence[str], value: str, out: str, *, splits: Sequence[float] | None = None
) -> DataFrame:
    """Average-method percentile rank in 0..100; NULL values keep a NULL rank."""
    keys = list(keys)
    if splits is None:
        splits = value_splits(df, value)
    cum = running_totals(histogram(df, keys, value), keys, value, ["n"], splits=splits)
    rank = cum.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        F.col(value).alias("__r_value"),
        ((F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2) / F.col("tot_n") * 100).alias(out),
    )
    on = F.col(value) == F.col("__r_value")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    # Rows without a value go round the join: they would all meet on one key.
    ranked = df.where(F.col(value).isNotNull()).join(rank, on, "left").select(*df.columns, out)
    return ranked.unionByName(df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double")))


FAN = 4096  #: buckets of a level that share one of the next


def previous_in_order(df: DataFrame, keys: Sequence[str], order: str, width: float, cols: Sequence[str], levels: int = 2) -> DataFrame:
    """``prev_<c>`` of the preceding row per key by a numeric order column.

    A key is cut into order buckets of ``width``; each bucket hands its last row to the next non-empty bucket, so a key
    with most of the rows is still spread over many tasks.  Which bucket is the next is found in the same way: ``FAN``
    buckets share one of the level above, and only those of the last level are ordered in one window, 1 / (width * FAN)
    of the key's span.  ``keys``, ``order`` and ``cols`` hold no NULL order.
    """
    keys, bucket, ghost = list(keys), f"__b{levels}", f"__ghost{levels}"
    values = list(dict.fromkeys([order, *cols]))
    b = df.withColumn(bucket, F.floor(F.col(order) / width)).withColumn(ghost, F.lit(False))
    # Plain columns, not a struct: their buffers stay in a hash aggregate.
    last = b.groupBy(*keys, bucket).agg(*[F.max(order).alias(c) if c == order else F.max_by(c, order).alias(c) for c in values])
    if levels > 1:
        earlier = previous_in_order(last, keys, bucket, FAN, values, levels - 1)
        handed = earlier.select(*keys, bucket, *[F.col(f"prev_{c}").alias(c) for c in values])
    else:
        over = Window.partitionBy(*keys).orderBy(bucket)
        handed = last.select(*keys, bucket, *[F.lag(c).over(over).alias(c) for c in values])
    handed = handed.withColumn(ghost, F.lit(True)).where(F.col(order).isNotNull())
    # The row handed over sorts before its new bucket, so one window serves bucket and border alike.
    inside = Window.partitionBy(*keys, bucket).orderBy(order)
    both = b.unionByName(handed, allowMissingColumns=True)
    prev = both.select("*", *[F.lag(c).over(inside).alias(f"prev_{c}") for c in cols])
    return prev.where(~F.col(ghost)).drop(bucket, ghost)
