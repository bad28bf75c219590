"""Gridded fields to receptors: weighted means, daily statistics, climatologies, vertical and area integrals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainshed.functions.clock import wall_micros
from rainshed.functions.geo import bearing_toward
from rainshed.operators.distributed import exact_quantiles

# Sea water density (kg/m3), specific heat (J/kg/K), gravity (m/s2).
RHO = 1025.0
CP = 3990.0
GRAVITY = 9.80665


def weighted_mean(value: Column, weight: Column) -> Column:
    """Weighted mean over the cells that hold a value; NULL when none does."""
    den = F.sum(F.when(value.isNotNull(), weight))
    return F.when(den > 0, F.sum(value * weight) / den)


def regrid(field: DataFrame, weights: DataFrame, time: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Receptor means per time step, all measures in one pass.

    The weight table is a dimension; whether it is broadcast is left to its measured size.
    """
    joined = field.select("cell_id", *time, *measures).join(weights.select("receptor_id", "cell_id", "w"), "cell_id")
    return joined.groupBy("receptor_id", *time).agg(*[weighted_mean(F.col(m), F.col("w")).alias(m) for m in measures])


def weight_sums(weights: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    s = weights.groupBy("receptor_id").agg(F.sum("w").alias("weight_sum"), F.count(F.lit(1)).alias("cells"))
    return s.withColumn("normalised", F.abs(F.col("weight_sum") - 1) <= tolerance)


def normalise_weights(weights: DataFrame) -> DataFrame:
    totals = weights.groupBy("receptor_id").agg(F.sum("w").alias("__total"))
    return weights.join(totals, "receptor_id").select("receptor_id", "cell_id", (F.col("w") / F.col("__total")).alias("w"))


def daily_flux(steps: DataFrame, e: str, n: str, magnitude: str) -> DataFrame:
    """Daily mean components, direction of the mean vector, mean and peak of the per-cell magnitude."""
    d = steps.groupBy("receptor_id", "date").agg(
        F.avg(e).alias("e_mean"),
        F.avg(n).alias("n_mean"),
        F.avg(magnitude).alias("mag_mean"),
        F.max(magnitude).alias("mag_max"),
        F.count(F.lit(1)).alias("samples"),
    )
    return d.withColumn("dir_deg_from_north", bearing_toward(F.col("e_mean"), F.col("n_mean")))


def daily_statistics(steps: DataFrame, stats: dict[str, Sequence[str]]) -> DataFrame:
    """``{measure: [mean, max, min, sum]}`` -> ``<measure>_<stat>`` per receptor and day."""
    fn = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}
    return steps.groupBy("receptor_id", "date").agg(
        *[fn[s](m).alias(f"{m}_{s}") for m, which in stats.items() for s in which], F.count(F.lit(1)).alias("samples")
    )


def daily_levels(steps: DataFrame, levels: Sequence[int], measures: Sequence[str], maxima: Sequence[str] = ()) -> DataFrame:
    """Daily means (and maxima) per pressure level as wide columns ``<measure><level>_<stat>``.

    Conditional aggregates over a fixed level list: one aggregate, no pivot pass over the data.
    """
    at = {lev: F.col("level") == lev for lev in levels}
    aggs = [F.avg(F.when(c, F.col(m))).alias(f"{m}{lev}_mean") for lev, c in at.items() for m in measures]
    aggs += [F.max(F.when(c, F.col(m))).alias(f"{m}{lev}_max") for lev, c in at.items() for m in maxima]
    return steps.groupBy("receptor_id", "date").agg(*aggs)


def daily_precipitation(steps: DataFrame, depth_m: str, strict: bool = False) -> DataFrame:
    """Millimetres per day and the wettest step.  A day without any value sums to 0 unless ``strict``."""
    total = F.sum(depth_m) * 1000
    return steps.groupBy("receptor_id", "date").agg(
        (total if strict else F.coalesce(total, F.lit(0.0))).alias("precip_sum_mm"),
        (F.max(depth_m) * 1000).alias("precip_max_step_mm"),
        F.count(F.lit(1)).alias("samples"),
    )


def magnitude_of_mean(steps: DataFrame, e: str, n: str) -> DataFrame:
    """Event variant: magnitude of the receptor-mean vector, not the mean of magnitudes."""
    return steps.withColumn("magnitude", F.hypot(F.col(e), F.col(n)))


# ---- climatology -------------------------------------------------------------------------------------------------
def climatology(field: DataFrame, date: str, value: str, period: str, first_year: int, last_year: int) -> DataFrame:
    """Mean per cell and calendar day (``period='day'``, MM-dd) or month over the baseline years."""
    key = F.date_format(date, "MM-dd") if period == "day" else F.date_format(date, "MM")
    base = field.where(F.year(date).between(first_year, last_year) & F.col(value).isNotNull())
    return base.groupBy("cell_id", key.alias("period")).agg(
        F.avg(value).alias("climatology"), F.count(F.lit(1)).alias("contributors")
    )


def anomaly(field: DataFrame, clim: DataFrame, date: str, value: str, period: str) -> DataFrame:
    key = F.date_format(date, "MM-dd") if period == "day" else F.date_format(date, "MM")
    keyed = field.withColumn("period", key)
    return keyed.join(clim.select("cell_id", "period", "climatology"), ["cell_id", "period"], "left").withColumn(
        "anomaly", F.col(value) - F.col("climatology")
    )


# ---- vertical integrals ------------------------------------------------------------------------------------------
def effective_thickness(levels: DataFrame, key: Sequence[str], level: str, thickness: str, wet: str, floor: str, zmax: float) -> DataFrame:
    """Thickness of each level inside 0..min(zmax, floor); a column has a handful of levels."""
    w = Window.partitionBy(*key).orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    thick = F.when(F.col(wet) & F.col(thickness).isNotNull(), F.col(thickness)).otherwise(0.0)
    target = F.coalesce(F.when(F.col(floor) > 0, F.least(F.col(floor), F.lit(float(zmax)))), F.lit(0.0))
    staged = levels.withColumn("__t", thick).withColumn("__bottom", F.sum("__t").over(w))
    top = F.col("__bottom") - F.col("__t")
    eff = F.greatest(F.least(F.col("__bottom"), target) - top, F.lit(0.0))
    return staged.select(*levels.columns, F.when(F.col(wet), eff).otherwise(0.0).alias("dz"))


def heat_content(column: DataFrame, key: Sequence[str], temperature: str, dz: str = "dz") -> DataFrame:
    """Heat content and mean temperature of a water column; valid only when all its depth holds a value."""
    t, z = F.col(temperature), F.col(dz)
    ok = t.isNotNull() & (z > 0)
    sums = column.groupBy(*key).agg(
        F.sum(z).alias("total"), F.sum(F.when(ok, z).otherwise(0.0)).alias("covered"), F.sum(F.when(ok, t * z)).alias("integral")
    )
    good = (F.col("total") > 0) & (F.col("covered") >= F.col("total") - 1e-3)
    return sums.select(
        *key,
        F.when(good, RHO * CP * F.col("integral")).alias("heat_content_j_m2"),
        F.when(good, F.col("integral") / F.col("total")).alias("tmean_c"),
        "covered",
    )


def column_flux(levels: DataFrame, key: Sequence[str], p: str, q: str, u: str, v: str, surface: str) -> DataFrame:
    """Vertical integral of moisture flux (trapezoid over pressure); levels below ground are left out and the
    gap between the lowest valid level and the surface is filled with that level's flux."""
    w = Window.partitionBy(*key).orderBy(p)
    fu, fv = F.col(q) * F.col(u), F.col(q) * F.col(v)
    ok = fu.isNotNull() & fv.isNotNull() & (F.col(p) <= F.col(surface))
    s = levels.select(*key, F.col(p).alias("__p"), F.col(surface).alias("__sp"), fu.alias("__fu"), fv.alias("__fv"), ok.alias("__ok"))
    w = Window.partitionBy(*key).orderBy("__p")
    s = s.select("*", *[F.lead(c).over(w).alias(f"{c}1") for c in ("__p", "__fu", "__fv", "__ok")])
    layer = F.col("__ok") & F.coalesce(F.col("__ok1"), F.lit(False))
    last = F.col("__ok") & ~F.coalesce(F.col("__ok1"), F.lit(False))

    def term(c: str) -> Column:
        slab = F.when(layer, 0.5 * (F.col(c) + F.col(f"{c}1")) * (F.col("__p1") - F.col("__p"))).otherwise(0.0)
        gap = F.when(last, F.col(c) * F.greatest(F.col("__sp") - F.col("__p"), F.lit(0.0))).otherwise(0.0)
        return F.sum(slab + gap)

    g = s.groupBy(*key).agg(term("__fu").alias("su"), term("__fv").alias("sv"), F.bool_or("__ok").alias("any_valid"))
    iu, iv = F.col("su") / GRAVITY, F.col("sv") / GRAVITY
    out = g.select(*key, F.when(F.col("any_valid"), iu).alias("ivt_e"), F.when(F.col("any_valid"), iv).alias("ivt_n"))
    return out.withColumn("ivt", F.hypot("ivt_e", "ivt_n"))


# ---- accumulations -----------------------------------------------------------------------------------------------
def cumulative_rate(steps: DataFrame, key: Sequence[str], step: str, total_m: str, hours: float = 3.0) -> DataFrame:
    """Cumulative totals -> increments clipped at 0 -> wettest mean rate (mm/h), and the last total (mm)."""
    w = Window.partitionBy(*key).orderBy(step)
    inc = F.greatest(F.col(total_m) - F.lag(total_m, 1, 0.0).over(w), F.lit(0.0))
    return (
        steps.withColumn("__inc", inc)
        .groupBy(*key)
        .agg(
            F.when(F.count(F.lit(1)) >= 2, F.max("__inc") * 1000 / hours).alias("max_rate_mm_h"),
            (F.max_by(total_m, step) * 1000).alias("last_total_mm"),
        )
    )


# ---- areas -------------------------------------------------------------------------------------------------------
def area_totals(field: DataFrame, key: Sequence[str], value: str, area: str) -> DataFrame:
    """Signed, positive and negative area integrals, area-weighted mean and valid area."""
    v, a = F.col(value), F.col(area)
    valid = F.sum(F.when(v.isNotNull(), a))
    return field.groupBy(*key).agg(
        F.sum(v * a).alias("signed_total"),
        F.sum(F.when(v.isNotNull(), F.greatest(v, F.lit(0.0)) * a)).alias("positive_total"),
        F.sum(F.when(v.isNotNull(), F.least(v, F.lit(0.0)) * a)).alias("negative_total"),
        F.when(valid > 0, F.sum(v * a) / valid).alias("area_mean"),
        valid.alias("valid_area_m2"),
    )


def block_mean(field: DataFrame, key: Sequence[str], value: str, area: str, degrees: float = 0.5) -> DataFrame:
    """Area-weighted block means on a coarser grid."""
    v, a = F.col(value), F.col(area)
    west = (F.floor(F.col("lon") / degrees) * degrees).alias("west")
    south = (F.floor(F.col("lat") / degrees) * degrees).alias("south")
    return field.groupBy(*key, west, south).agg(
        weighted_mean(v, a).alias("mean_value"), F.sum(a).alias("block_area_m2"), F.count(v).alias("valid_cells")
    )


def compare_grids(a: DataFrame, b: DataFrame, on: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """Difference statistics of two rasters on the same cells."""
    j = a.select(*on, F.col(value).alias("__a")).join(b.select(*on, F.col(value).alias("__b")), list(on))
    d = F.col("__b") - F.col("__a")
    return j.groupBy(*by).agg(
        F.count(d).alias("cells"),
        F.avg(d).alias("mean_diff"),
        F.min(d).alias("min_diff"),
        F.max(d).alias("max_diff"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.count_if(d != 0).alias("changed_cells"),
    )


# ---- extremes ----------------------------------------------------------------------------------------------------
def daily_peak(df: DataFrame, key: Sequence[str], ts: str, value: str) -> DataFrame:
    """Daily maximum and its first time: ``max_by`` on (value, reversed time) keeps one row per map task."""
    seconds = wall_micros(F.col(ts))
    return df.where(F.col(value).isNotNull()).groupBy(*key, F.to_date(ts).alias("date")).agg(
        F.max(value).alias("peak"), F.max_by(F.col(ts), F.struct(F.col(value), -seconds)).alias("peak_ts")
    )


def modal_category(df: DataFrame, key: Sequence[str], category: str) -> DataFrame:
    """Most frequent category, smallest on ties; counts are merged before the shuffle by key."""
    n = df.where(F.col(category).isNotNull()).groupBy(*key, category).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*key).agg(
        F.min_by(F.col(category), F.struct(-F.col("n"), F.col(category))).alias("modal"), F.max("n").alias("n")
    )


# ---- terrain -----------------------------------------------------------------------------------------------------
def slope_degrees(dem: DataFrame, tile: Sequence[str], row: str, col: str, z: str, spacing: float, block: int = 256) -> DataFrame:
    """Slope by central differences, one-sided at the raster border and beside absent cells.

    A raster (``tile``) is cut into blocks of ``block`` x ``block`` cells; a cell on a block's edge is also given to the
    block beyond it.  So both gradients come from windows inside a block, after one exchange, and a raster of any size
    is spread over tasks.
    """
    r, c = F.col(row), F.col(col)

    def copies(at: Column) -> Column:
        own = F.floor(at / block)
        return F.array_distinct(F.array(F.floor((at - 1) / block), own, F.floor((at + 1) / block)))

    # The own block, and those to which the cell is a halo above, below, left or right.
    rows = F.transform(copies(r), lambda b: F.struct(b.alias("__br"), F.floor(c / block).alias("__bc")))
    cols = F.transform(copies(c), lambda b: F.struct(F.floor(r / block).alias("__br"), b.alias("__bc")))
    spread = dem.withColumn("__b", F.explode(F.array_distinct(F.concat(rows, cols)))).select("*", "__b.*").drop("__b")
    spread = spread.repartition(*tile, "__br", "__bc")

    def gradient(along: str, across: str) -> Column:
        w = Window.partitionBy(*tile, "__br", "__bc", across).orderBy(along)
        there = [F.coalesce(F.lag(along).over(w) == F.col(along) - 1, F.lit(False)), F.coalesce(F.lead(along).over(w) == F.col(along) + 1, F.lit(False))]
        before, after = F.when(there[0], F.lag(z).over(w)), F.when(there[1], F.lead(z).over(w))
        steps = there[0].cast("int") + there[1].cast("int")
        return F.when(steps > 0, (F.coalesce(after, F.col(z)) - F.coalesce(before, F.col(z))) / (steps * spacing))

    g = spread.withColumn("__gx", gradient(col, row)).withColumn("__gy", gradient(row, col))
    own = (F.floor(r / block) == F.col("__br")) & (F.floor(c / block) == F.col("__bc"))
    return g.where(own).withColumn("slope_deg", F.degrees(F.atan(F.hypot("__gx", "__gy")))).drop("__gx", "__gy", "__br", "__bc")


def terrain_stats(cells: DataFrame, receptor: str, z: str, slope: str, bounds: Sequence[float] = (500.0, 1000.0, 1500.0)) -> DataFrame:
    """Elevation bands, relief, hypsometric proxy, slope fractions and exact elevation quantiles per receptor.

    A large receptor may hold most pixels, so the quantiles come from value ranges, not from one group.
    """
    v, s = F.col(z), F.col(slope)
    edges = [None, *bounds, None]
    bands = []
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (v >= lo)
        if hi is not None:
            inside = inside & (v < hi)
        bands.append(F.avg(F.when(v.isNotNull(), inside.cast("double"))).alias(f"band_{i}_fraction"))
    base = cells.groupBy(receptor).agg(
        F.count(v).alias("pixels"),
        F.min(v).alias("z_min"),
        F.max(v).alias("z_max"),
        F.avg(v).alias("z_mean"),
        F.stddev_pop(v).alias("z_std"),
        *bands,
        F.avg((s >= 15).cast("double")).alias("slope_ge15_fraction"),
    )
    relief = F.col("z_max") - F.col("z_min")
    base = base.withColumn("relief", relief).withColumn(
        "hypsometric", F.when(relief > 0, (F.col("z_mean") - F.col("z_min")) / relief)
    )
    q = exact_quantiles(cells, [receptor], z, [0.1, 0.5, 0.9], names=["z_p10", "z_median", "z_p90"])
    return base.join(q, receptor, "left")


def shape_descriptors(area_m2: Column, perimeter_m: Column, hull_area_m2: Column) -> list[Column]:
    pi = F.pi()
    return [
        (area_m2 / 1e6).alias("area_km2"),
        (perimeter_m / 1000).alias("perimeter_km"),
        F.when(area_m2 > 0, 2 * F.sqrt(area_m2 / pi) / 1000).alias("equivalent_diameter_km"),
        F.when(perimeter_m > 0, 4 * pi * area_m2 / (perimeter_m * perimeter_m)).alias("circularity"),
        F.when(hull_area_m2 > 0, area_m2 / hull_area_m2).alias("convexity"),
    ]


def is_monotone(levels: Sequence[Column]) -> Column:
    """True when the non-NULL levels never decrease."""
    present = F.filter(F.array(*levels), lambda x: x.isNotNull())
    return F.coalesce(present == F.array_sort(present), F.lit(True))
