"""Interval, band, overlap and priority joins expressed as equi joins on buckets or days."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainshed.operators.distributed import value_splits, with_range
from rainshed.operators.windows import first_by


def day_in_interval(intervals: DataFrame, days: DataFrame, on: Sequence[str], start: str, end: str, date: str, how: str = "inner") -> DataFrame:
    """Join daily rows to the intervals that contain them: intervals become days, then an equi join."""
    spread = intervals.withColumn(date, F.explode(F.sequence(F.col(start), F.col(end))))
    return spread.join(days, [*on, date], how)


def merge_intervals(intervals: DataFrame, key: Sequence[str], start: str, end: str) -> DataFrame:
    """Union of the (overlapping or touching) intervals of a key."""
    w = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > F.date_add(reach, 1)), 1).otherwise(0)
    return (
        intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull())
        .withColumn("__new", new)
        .withColumn("__i", F.sum("__new").over(w))
        .groupBy(*key, "__i")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("__i")
    )


def active_per_day(intervals: DataFrame, group: Sequence[str], member: str, start: str, end: str) -> DataFrame:
    """Members whose merged intervals contain each day, for every day on which something is active.

    +1 / -1 events per day and a running sum: no member x day product, and the window sees one row per
    (group, day).
    """
    merged = merge_intervals(intervals, [*group, member], start, end)
    change = F.array(
        F.struct(F.col(start).alias("date"), F.lit(1).alias("step")),
        F.struct(F.date_add(end, 1).alias("date"), F.lit(-1).alias("step")),
    )
    events = merged.select(*group, F.explode(change).alias("__e")).select(*group, "__e.*")
    per_day = events.groupBy(*group, "date").agg(F.sum("step").alias("__step"))
    w = Window.partitionBy(*group).orderBy("date")
    level = per_day.select(
        *group,
        "date",
        F.sum("__step").over(w).alias("active"),
        F.date_sub(F.lead("date").over(w), 1).alias("__until"),
    )
    return level.where(F.col("active") > 0).select(
        *group, F.explode(F.sequence(F.col("date"), F.coalesce("__until", "date"))).alias("date"), "active"
    )


def align_nearest(left: DataFrame, right: DataFrame, x: str, y: str, tolerance: float, left_id: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Nearest right value within ``tolerance``; left rows without one are dropped.  Ties go to the smaller value.

    An ordered merge: the distinct values of both sides stand in one order, cut into value ranges; each range is handed the
    last right value before it and the first one after it, so the neighbours of a value are found in one pass over its
    range.  No pair of values is formed, however many lie within the tolerance.  Rows of equal ``y`` are told apart by
    ``extra``, ascending; a null is near to nothing.  Left rows keep their number; ``left_id`` names them for the reader.
    """
    value, right_value, ghost = F.col("__at"), F.col("__right"), F.col("__ghost")
    one = first_by(right.where(F.col(y).isNotNull()).withColumn("__y", F.col(y).cast("double")), ["__y"], list(extra) or [F.lit(0)])
    probes = left.select(F.col(x).cast("double").alias("__at")).where("__at IS NOT NULL").distinct()
    both = probes.withColumn("__right", F.lit(None).cast("double")).unionAll(one.select(F.col("__y").alias("__at"), F.col("__y").alias("__right")))
    ranged = with_range(both, "__at", value_splits(both, "__at")).withColumn("__ghost", F.lit(False))
    ends = ranged.groupBy("__range").agg(F.min("__right").alias("__min"), F.max("__right").alias("__max"))  # a row a range
    order = Window.orderBy("__range")
    before = F.last("__max", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("__min", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    handed = ends.select("__range", before.alias("__before"), after.alias("__after"))
    handed = handed.select("__range", F.explode(F.array("__before", "__after")).alias("__at")).where("__at IS NOT NULL")
    merged = ranged.unionByName(handed.select("__at", value.alias("__right"), "__range", F.lit(True).alias("__ghost")))
    inside = Window.partitionBy("__range").orderBy("__at")
    low = F.last("__right", ignorenulls=True).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    high = F.first("__right", ignorenulls=True).over(inside.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    placed = merged.select("__at", "__right", "__ghost", low.alias("__low"), high.alias("__high")).where(right_value.isNull() & ~ghost)
    lower = F.col("__high").isNull() | (F.abs(value - F.col("__low")) <= F.abs(value - F.col("__high")))
    near = placed.select("__at", F.when(F.col("__low").isNotNull() & lower, F.col("__low")).otherwise(F.col("__high")).alias("__y"))
    near = near.where(F.abs(value - F.col("__y")) <= tolerance).join(one, "__y").drop("__y")
    return left.withColumn("__at", F.col(x).cast("double")).join(near, "__at").drop("__at")


BOX = ("west", "south", "east", "north")
LEVELS = (-30, 30)  # edges of cells: powers of two


def overlapping_boxes(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Pairs of overlapping boxes.

    Cells are nested: a box has the level whose edge, a power of two, is the first not less than its longer side, so it
    touches four cells of it at most.  Two boxes meet at the greater of their levels: a box stands in the cells of its own
    level, and in the enclosing cells of every greater level that the other side has.  Small boxes never meet one
    another in a large cell.  A pair is kept only in the cell of the south-west corner of its overlap, so no pair appears
    twice.
    """

    def sized(df: DataFrame, ident: str, tag: str) -> DataFrame:
        side = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
        level = F.when(side > 0, F.least(F.greatest(F.ceil(F.log2(side)).cast("int"), F.lit(LEVELS[0])), F.lit(LEVELS[1]))).otherwise(LEVELS[0])
        return df.select(ident, *[F.col(c).alias(f"{tag}_{c}") for c in BOX], level.alias("__own"))

    def spread(df: DataFrame, tag: str, others: list[int], own_tags: tuple[int, int], above_tag: int) -> DataFrame:
        own = [F.struct(F.col("__own").alias("level"), F.lit(t).alias("meets")) for t in own_tags]
        above = F.filter(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(above_tag).alias("meets")) for k in others]), lambda s: s["level"] > F.col("__own"))
        rows = df.withColumn("__at", F.explode(F.concat(F.array(*own), above))).select("*", "__at.*").drop("__at", "__own")
        edge = F.pow(F.lit(2.0), F.col("level"))

        def cover(lo: str, hi: str) -> Column:
            return F.explode(F.sequence(F.floor(F.col(lo) / edge), F.floor(F.col(hi) / edge)))

        return rows.withColumn("__bx", cover(f"{tag}_west", f"{tag}_east")).withColumn("__by", cover(f"{tag}_south", f"{tag}_north"))

    one, two = sized(a, a_id, "a"), sized(b, b_id, "b")
    levels = [sorted(r[0] for r in d.select("__own").distinct().collect()) for d in (one, two)]  # at most 61 numbers
    j = spread(one, "a", levels[1], (0, 1), 2).join(spread(two, "b", levels[0], (0, 2), 1), ["level", "meets", "__bx", "__by"])
    west, south = F.greatest("a_west", "b_west"), F.greatest("a_south", "b_south")
    overlap = (west < F.least("a_east", "b_east")) & (south < F.least("a_north", "b_north"))
    edge = F.pow(F.lit(2.0), F.col("level"))
    home = (F.floor(west / edge) == F.col("__bx")) & (F.floor(south / edge) == F.col("__by"))
    return j.where(overlap & home).select(a_id, b_id)


def priority_lookup(wanted: DataFrame, key: str, choices: str, available: DataFrame, name: str, score: str, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """First available choice of each key's ordered list; equal positions prefer the higher score.

    Names meet after ``normalise`` on both sides, if given.
    """
    same = normalise or (lambda c: c)
    exploded = wanted.select(key, F.posexplode(choices).alias("position", "__choice")).withColumn("__name", same(F.col("__choice"))).drop("__choice")
    hits = exploded.join(available.withColumn("__name", same(F.col(name))), "__name").drop("__name")
    return first_by(hits, [key], [F.col("position"), -F.col(score), F.col(name)])


def keyed_update(registry: DataFrame, updates: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Patch named columns where an update holds a value; other rows and columns stay."""
    u = updates.select(*on, *[F.col(c).alias(f"__u_{c}") for c in cols])
    j = registry.join(u, list(on), "left")
    return j.select(*[F.coalesce(F.col(f"__u_{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in registry.columns])
