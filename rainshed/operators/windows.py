"""Strict-history windows inside one season, ranks and runs.

All day windows are *range* frames on the season day, so a missing row is a gap and never pulls in an
older day, and no frame reaches into another season.  A (receptor, season) group has at most one row per
calendar day, which bounds every window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rainshed.functions.clock import wall_micros

_AGG = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}


class SeasonWindow:
    """Column builders over (key, season_year) ordered by the day number."""

    def __init__(self, key: Sequence[str], day: str = "season_day", season: str = "season_year"):
        self.base: WindowSpec = Window.partitionBy(*key, season).orderBy(day)

    def frame(self, first: int, last: int) -> WindowSpec:
        return self.base.rangeBetween(first, last)

    def lag(self, col: str, days: int = 1) -> Column:
        """Value exactly ``days`` days ago; NULL over a gap or the season edge."""
        return F.max(col).over(self.frame(-days, -days))

    def change(self, col: str, days: int = 1) -> Column:
        return F.col(col) - self.lag(col, days)

    def _full(self, col: str, first: int, last: int, how: str) -> Column:
        f = self.frame(first, last)
        return F.when(F.count(col).over(f) == last - first + 1, _AGG[how](col).over(f))

    def previous(self, col: str, days: int, how: str = "sum") -> Column:
        """Aggregate of the ``days`` days before today; every one must hold a value."""
        return self._full(col, -days, -1, how)

    def inclusive(self, col: str, days: int, how: str = "sum") -> Column:
        return self._full(col, -(days - 1), 0, how)

    def partial(self, col: str, days: int, how: str = "sum") -> Column:
        """As ``inclusive`` but over whatever values the window has."""
        return _AGG[how](col).over(self.frame(-(days - 1), 0))

    def future(self, col: str, days: int, how: str = "max") -> Column:
        return _AGG[how](col).over(self.frame(1, days))

    def future_count(self, col: str, days: int) -> Column:
        return F.count(col).over(self.frame(1, days))

    def difference(self, col: str) -> Column:
        """Difference to the previous row, however old it is."""
        return F.col(col) - F.lag(col).over(self.base)


def complete(*cols: str) -> Column:
    """True when all antecedents are present."""
    out = F.col(cols[0]).isNotNull()
    for c in cols[1:]:
        out = out & F.col(c).isNotNull()
    return out


def rolling_hours(df: DataFrame, key: Sequence[str], ts: str, value: str, hours: Sequence[int]) -> DataFrame:
    """Partial rolling sums over the last h hours, ``<value>_<h>h``.

    Time is cut into buckets of the longest span; each bucket also gets the rows of the one before, as ghosts that are
    dropped again.  So a key of any length is spread over tasks, and a window holds two buckets.
    """
    span = max(hours) * 3600
    timed = df.withColumn("__s", F.floor(wall_micros(F.col(ts)) / 1_000_000)).withColumn("__b", F.floor(F.col("__s") / span))
    both = timed.withColumn("__ghost", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("__b", F.col("__b") + F.col("__ghost").cast("int"))
    w = Window.partitionBy(*key, "__b").orderBy("__s")
    sums = [F.sum(value).over(w.rangeBetween(-(h * 3600 - 1), 0)).alias(f"{value}_{h}h") for h in hours]
    return both.select("*", *sums).where(~F.col("__ghost")).drop("__s", "__b", "__ghost")


def metric_rank(group: Sequence[str], metric: str, descending: bool = True) -> Column:
    """Min-method rank inside a group; NULL metrics stay unranked."""
    order = F.col(metric).desc_nulls_last() if descending else F.col(metric).asc_nulls_last()
    return F.when(F.col(metric).isNotNull(), F.rank().over(Window.partitionBy(*group).orderBy(order)))


def panel_percent_rank(key: Sequence[str], value: str) -> Column:
    """Average-method percentile rank (0..100) within the days of one receptor; NULL stays NULL.

    For panels only: a receptor's days fit one window.  ``distributed.percent_rank_average`` has no such bound.
    """
    inside = Window.partitionBy(*key)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*key, value))
    rank = F.rank().over(inside.orderBy(F.col(value).asc_nulls_last())) + (ties - 1) / 2
    return F.when(F.col(value).isNotNull(), rank / F.count(value).over(inside) * 100)


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key.

    ``min_by`` on an ordering struct keeps one candidate per map task, so a key that holds a large share of
    the rows is reduced before the shuffle; a row-number window would sort all of it in one task.
    The order columns must be ascending expressions (negate numbers for descending).
    """
    names = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("__best"))
    return best.select(*key, *[F.col("__best")[n].alias(n) for n in names])


def runs(df: DataFrame, key: Sequence[str], date: str, merge_gap: int = 0, extra: Sequence[Column] = ()) -> DataFrame:
    """Gaps and islands: dates no further apart than ``merge_gap + 1`` days share a run.

    ``df`` has one row per (key, date) at most, so a key is bounded by the calendar.  ``extra`` are further
    aggregates over the rows of a run.
    """
    w = Window.partitionBy(*key).orderBy(date)
    new = F.coalesce((F.datediff(F.col(date), F.lag(date).over(w)) > merge_gap + 1).cast("int"), F.lit(1))
    return (
        df.withColumn("__new", new)
        .withColumn("run_id", F.sum("__new").over(w) - 1)
        .groupBy(*key, "run_id")
        .agg(F.min(date).alias("start_date"), F.max(date).alias("end_date"), F.count(F.lit(1)).alias("days"), *extra)
    )


def persistence(key: Sequence[str], order: str, value: str):
    """Returns df -> df with ``persistence``: how long the current value has lasted, in rows."""

    def apply(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*key).orderBy(order)
        changed = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
        island = df.withColumn("__i", F.sum(changed.cast("int")).over(w))
        inside = Window.partitionBy(*key, "__i").orderBy(order)
        return island.withColumn("persistence", F.row_number().over(inside)).drop("__i")

    return apply


def edge_null_audit(
    panel: DataFrame, key: Sequence[str], expected: dict[str, int], season: str = "season_year"
) -> DataFrame:
    """NULLs per derived column against the number a dense panel must have: seasons x window length."""
    groups = panel.groupBy(*key, season).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in expected])
    totals = groups.agg(F.count(F.lit(1)).alias("seasons"), *[F.sum(c).alias(c) for c in expected])
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"), F.col(c).alias("null_rows"), (F.col("seasons") * w).alias("expected_rows")
            )
            for c, w in expected.items()
        ]
    )
    return (
        totals.select(F.explode(entries).alias("e"))
        .select("e.*")
        .withColumn("status", F.when(F.col("null_rows") == F.col("expected_rows"), "PASS").otherwise("FAIL"))
    )
