"""Bearing-dependent corridor means over a marine grid: kernel weights, sector sums, interpolation, robustness."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainshed import policy
from rainshed.functions import geo

KM_PER_DEGREE = 111.0


def axis_edges(axis: DataFrame) -> DataFrame:
    """Cell edges from centres: midpoints inside, extrapolated at both ends.  ``axis`` is (axis, idx, centre)."""
    w = Window.partitionBy("axis").orderBy("idx")
    c = F.col("centre")
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    lo = F.coalesce((before + c) / 2, c - (after - c) / 2)
    hi = F.coalesce((c + after) / 2, c + (c - before) / 2)
    return axis.select("axis", "idx", "centre", lo.alias("lo"), hi.alias("hi"))


def grid_with_area(cells: DataFrame) -> DataFrame:
    """Adds ``area_m2`` to grid cells (cell_id, lat_idx, lon_idx, lat, lon)."""
    lats = cells.select(F.lit("lat").alias("axis"), F.col("lat_idx").alias("idx"), F.col("lat").alias("centre")).distinct()
    lons = cells.select(F.lit("lon").alias("axis"), F.col("lon_idx").alias("idx"), F.col("lon").alias("centre")).distinct()
    edges = axis_edges(lats.unionByName(lons))
    la = edges.where("axis = 'lat'").select(F.col("idx").alias("lat_idx"), F.col("lo").alias("la0"), F.col("hi").alias("la1"))
    lo = edges.where("axis = 'lon'").select(F.col("idx").alias("lon_idx"), F.col("lo").alias("lo0"), F.col("hi").alias("lo1"))
    area = geo.spherical_area(F.col("la0"), F.col("la1"), F.col("lo0"), F.col("lo1"))
    return cells.join(la, "lat_idx").join(lo, "lon_idx").select(*cells.columns, area.alias("area_m2"))


def cell_degrees(max_km: float) -> float:
    """The edge of the nested cells (360 degrees halved again and again) that is the last not less than the radius."""
    reach = max(max_km, 1e-3) / KM_PER_DEGREE
    return 360.0 / 2 ** max(math.floor(math.log2(360.0 / reach)), 0)


def within_distance(points: DataFrame, cells: DataFrame, max_km: float) -> DataFrame:
    """Pairs of a point (lat0, lon0) and a cell (lat, lon) at most ``max_km`` apart, with distance and bearing.

    Both sides stand in nested latitude/longitude cells of the level that fits the radius: a point is copied to the few
    cells its radius can reach and meets the others by cell (an equi join); the exact distance decides.  Work grows with
    the pairs in reach: places closer together than the radius spread over more and smaller cells as it shrinks.
    """
    size = cell_degrees(max_km)
    around = round(360 / size)
    reach = F.lit(max_km / KM_PER_DEGREE * 1.01 + 1e-6)
    top = F.least(F.abs(F.col("lat0")) + reach, F.lit(89.0))
    lon_reach = F.when(F.abs(F.col("lat0")) + reach >= 89.0, F.lit(180.0)).otherwise(
        F.least(reach / F.cos(F.radians(top)), F.lit(180.0))
    )

    def blocks(centre: Column, r: Column) -> Column:
        return F.sequence(F.floor((centre - r) / size).cast("int"), F.floor((centre + r) / size).cast("int"))

    lon_blocks = F.array_distinct(F.transform(blocks(F.col("lon0"), lon_reach), lambda b: F.pmod(b, F.lit(around))))
    spread = points.withColumn("__la", F.explode(blocks(F.col("lat0"), reach))).withColumn("__lo", F.explode(lon_blocks))
    placed = cells.withColumns({"__la": F.floor(F.col("lat") / size).cast("int"), "__lo": F.pmod(F.floor(F.col("lon") / size), F.lit(around)).cast("int")})
    joined = spread.join(placed, ["__la", "__lo"])
    args = [F.col(c) for c in ("lat0", "lon0", "lat", "lon")]
    return (
        joined.withColumn("distance_km", geo.haversine_km(*args))
        .where(F.col("distance_km") <= max_km)
        .withColumn("bearing", geo.initial_bearing(*args))
        .drop("__la", "__lo")
    )


def kernel_scenarios(scenarios: Sequence[tuple] = policy.KERNEL_SCENARIOS) -> Column:
    names = ("scenario", "sigma", "cutoff", "scale", "dmax")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s)]) for s in scenarios])


BASE_ONLY = policy.KERNEL_SCENARIOS[:1]


def sector_weights(receptors: DataFrame, grid: DataFrame, scenarios: Sequence[tuple] = BASE_ONLY) -> DataFrame:
    """(scenario, receptor, sector, cell) weights: area x distance decay x angular gaussian, with cut-offs.

    ``receptors`` is (receptor_id, lat0, lon0).  Scenarios and sectors are literal arrays, exploded.
    """
    widest = max(s[4] for s in scenarios)
    pairs = within_distance(receptors, grid, widest)
    sectors = F.sequence(F.lit(0), F.lit(policy.N_SECTORS - 1))
    expanded = (
        pairs.withColumn("sector", F.explode(sectors))
        .withColumn("angle", geo.angular_difference(F.col("bearing"), F.col("sector") * policy.SECTOR_STEP_DEG))
        .withColumn("k", F.explode(kernel_scenarios(scenarios)))
        .where((F.col("distance_km") <= F.col("k.dmax")) & (F.col("angle") <= F.col("k.cutoff")))
    )
    w = geo.kernel_weight(F.col("area_m2"), F.col("distance_km"), F.col("angle"), F.col("k.sigma"), F.col("k.scale"))
    return expanded.select(F.col("k.scenario").alias("scenario"), "receptor_id", "sector", "cell_id", w.alias("w")).where(
        F.col("w") > 0
    )


def sector_sums(field: DataFrame, weights: DataFrame, time: str, value: str) -> DataFrame:
    """Numerator and denominator per (scenario, receptor, sector, time); only cells with a value count."""
    j = field.where(F.col(value).isNotNull()).select("cell_id", time, value).join(weights, "cell_id")
    return j.groupBy("scenario", "receptor_id", "sector", time).agg(
        F.sum(F.col(value) * F.col("w")).alias("num"), F.sum("w").alias("den")
    )


def sector_profile(sums: DataFrame, time: str) -> DataFrame:
    """Sums of all sectors (at most 16) of a receptor and time in one map."""
    entry = F.struct(F.col("sector"), F.struct("num", "den"))
    return sums.groupBy("scenario", "receptor_id", time).agg(F.map_from_entries(F.collect_list(entry)).alias("profile"))


def corridor(panel: DataFrame, profile: DataFrame, on: Sequence[str], bearing: str) -> DataFrame:
    """Corridor mean at a source bearing: numerator and denominator are interpolated between the two sectors
    around the bearing, then divided.  No support gives NULL and support 0; there is no nearest fallback.
    """
    b = F.col(bearing)
    frac = geo.sector_fraction(b)

    def mixed(part: str) -> Column:
        def at(sector: Column) -> Column:
            return F.coalesce(F.element_at("profile", sector)[part], F.lit(0.0))

        return (1 - F.col("__f")) * at(F.col("__lo")) + F.col("__f") * at(F.col("__hi"))

    staged = panel.select("*", geo.sector_low(b).alias("__lo"), geo.sector_high(b).alias("__hi"), frac.alias("__f"))
    joined = staged.join(profile, list(on), "left").withColumn("__num", mixed("num")).withColumn("__den", mixed("den"))
    return joined.select(
        *panel.columns,
        *[c for c in profile.columns if c not in (*panel.columns, "profile")],
        F.when(F.col("__den") > 0, F.col("__num") / F.col("__den")).alias("corridor_value"),
        F.when(F.col("__den") > 0, F.col("__den")).otherwise(0.0).alias("corridor_support"),
    )


def corridor_at_bearing(observed: DataFrame, pairs: DataFrame, on: Sequence[str], bearing: str, value: str, scenarios: Sequence[tuple] = BASE_ONLY) -> DataFrame:
    """(on, scenario, corridor_value, corridor_support) when every time has its own bearing.

    ``observed``: field rows (receptor_id, time, cell_id, value) with the bearing of their receptor and time; ``pairs``:
    distance, bearing and area of each (receptor_id, cell_id) in reach.  Only the two sectors around the bearing count;
    as both sums are interpolated linearly, their weights are mixed per cell, and one aggregate sums all scenarios.
    Keys without a value in reach are left out: they have no support.
    """
    geometry = pairs.select("receptor_id", "cell_id", "area_m2", "distance_km", F.col("bearing").alias("__cell"))
    b = F.col(bearing)
    rows = observed.where(F.col(value).isNotNull()).join(geometry, ["receptor_id", "cell_id"])
    turn = [geo.angular_difference(F.col("__cell"), s(b) * policy.SECTOR_STEP_DEG) for s in (geo.sector_low, geo.sector_high)]
    rows = rows.select(*on, value, "area_m2", "distance_km", turn[0].alias("__low"), turn[1].alias("__high"), geo.sector_fraction(b).alias("__f"))
    sums = []
    for i, (_, sigma, cutoff, scale, dmax) in enumerate(scenarios):

        def weight(angle: str, sigma=sigma, cutoff=cutoff, scale=scale, dmax=dmax) -> Column:
            inside = (F.col("distance_km") <= dmax) & (F.col(angle) <= cutoff)
            return F.when(inside, geo.kernel_weight(F.col("area_m2"), F.col("distance_km"), F.col(angle), sigma, scale)).otherwise(0.0)

        w = (1 - F.col("__f")) * weight("__low") + F.col("__f") * weight("__high")
        sums += [F.sum(F.col(value) * w).alias(f"__n{i}"), F.sum(w).alias(f"__d{i}")]
    total = rows.groupBy(*on).agg(*sums)
    each = F.array(*[F.struct(F.lit(s[0]).alias("scenario"), F.col(f"__n{i}").alias("n"), F.col(f"__d{i}").alias("d")) for i, s in enumerate(scenarios)])
    long = total.select(*on, F.explode(each).alias("s"))
    return long.select(
        *on,
        "s.scenario",
        F.when(F.col("s.d") > 0, F.col("s.n") / F.col("s.d")).alias("corridor_value"),
        F.when(F.col("s.d") > 0, F.col("s.d")).otherwise(0.0).alias("corridor_support"),
    )


def support_class(sst_value: Column, sst_support: Column, ohc_value: Column, ohc_support: Column) -> Column:
    supported = (sst_support > 0) & (ohc_support > 0) & sst_value.isNotNull() & ohc_value.isNotNull()
    zero = F.lit(0.0)
    none = (
        (F.coalesce(sst_support, zero) <= 0)
        & (F.coalesce(ohc_support, zero) <= 0)
        & sst_value.isNull()
        & ohc_value.isNull()
    )
    return F.when(supported, "MEDSEA_SUPPORTED").when(none, "NO_MEDSEA_SOURCE_SUPPORT").otherwise("INCONSISTENT")


ROBUSTNESS_CLASSES = (
    "ROBUST_MEDSEA_SUPPORT",
    "BASELINE_ANGLE_SENSITIVE_SUPPORT",
    "WIDE_ONLY_MEDSEA_SUPPORT",
    "NO_MEDSEA_SUPPORT_ALL",
    "INCONSISTENT",
)


def robustness_class(narrow: Column, baseline: Column, wide: Column) -> Column:
    robust, sensitive, wide_only, none, odd = ROBUSTNESS_CLASSES
    return (
        F.when(narrow & baseline & wide, robust)
        .when(~narrow & baseline & wide, sensitive)
        .when(~narrow & ~baseline & wide, wide_only)
        .when(~narrow & ~baseline & ~wide, none)
        .otherwise(odd)
    )


def support_summary(df: DataFrame, sets: Sequence[Sequence[str]], cls: str, ivt: str) -> DataFrame:
    """Support counts, percentages and conditional means for several key sets in one pass."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    yes, no, odd = (F.col(cls) == c for c in ("MEDSEA_SUPPORTED", "NO_MEDSEA_SOURCE_SUPPORT", "INCONSISTENT"))
    n = F.count(F.lit(1))
    return df.groupingSets([list(s) for s in sets], *keys).agg(
        F.grouping_id().cast("bigint").alias("grouping_id"),
        n.alias("rows"),
        F.count_if(yes).alias("supported_rows"),
        F.count_if(no).alias("unsupported_rows"),
        F.count_if(odd).alias("inconsistent_rows"),
        (100.0 * F.count_if(yes) / n).alias("supported_pct"),
        F.avg(F.when(yes, F.col(ivt))).alias("ivt_mean_supported"),
        F.avg(F.when(no, F.col(ivt))).alias("ivt_mean_unsupported"),
    )


def class_pivot(df: DataFrame, key: Sequence[str], cls: str, choices: Sequence[str]) -> DataFrame:
    """Class counts as columns, zero-filled, with percentages."""
    n = F.count(F.lit(1))
    return df.groupBy(*key).agg(
        *[F.count_if(F.col(cls) == c).alias(c.lower()) for c in choices],
        n.alias("rows"),
        *[(100.0 * F.count_if(F.col(cls) == c) / n).alias(f"{c.lower()}_pct") for c in choices],
    )
