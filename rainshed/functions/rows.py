"""Row-wise statistics and probability expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rainshed import policy


def _sum(values: Sequence[Column]) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out + v
    return out


def row_mean(cols: Sequence[Column]) -> Column:
    """Mean of the non-NULL values; NULL when there is none.  Plain arithmetic stays inside code generation."""
    total = _sum([F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    n = _sum([c.isNotNull().cast("int") for c in cols])
    return F.when(n > 0, total / n)


def row_min_strict(a: Column, b: Column) -> Column:
    """Minimum only when both are present (``least`` alone skips NULL)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def platt(p: Column, intercept: float | Column, slope: float | Column) -> Column:
    z = (intercept if isinstance(intercept, Column) else F.lit(intercept)) + slope * logit(p)
    return 1 / (1 + F.exp(-z))


SEVERITY = ("GRAY", "GREEN", "YELLOW", "RED")


def severity_max(states: Sequence[Column]) -> Column:
    """Worst state; unknown text counts as GRAY."""
    names = F.array(*[F.lit(s) for s in SEVERITY])
    return F.get(names, F.greatest(*[F.greatest(F.array_position(names, s), F.lit(1)) for s in states]).cast("int") - 1)


def horizon_state(p: Column, yellow: Column, red: Column, scientific: Column) -> Column:
    return (
        F.when(~scientific | p.isNull(), "GRAY").when(p >= red, "RED").when(p >= yellow, "YELLOW").otherwise("GREEN")
    )


def monthly_blend(date: Column, prev_value: Column, next_value: Column, prev_anchor: Column, next_anchor: Column) -> Column:
    """Linear blend between two monthly values anchored on day 15."""
    span = F.datediff(next_anchor, prev_anchor)
    w = clip(F.datediff(date, prev_anchor) / span, 0.0, 1.0)
    return prev_value * (1 - w) + next_value * w


def log_loss(y: Column, p: Column, eps: float = policy.PROBABILITY_CLIP) -> Column:
    q = clip(p, eps, 1 - eps)
    return -F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))
