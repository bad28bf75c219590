"""Geometry, corridor and bucketed joins against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rainshed import policy
from rainshed.functions import geo
from rainshed.operators import corridor as C
from rainshed.operators import joins as J
from rainshed.operators import regrid as R


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_angles(spark):
    d = F.lit
    r = one(
        spark,
        toward=geo.bearing_toward(d(1.0), d(0.0)),
        wind=geo.wind_from(d(0.0), d(1.0)),
        diff=geo.angular_difference(d(350.0), d(20.0)),
        sector=geo.compass_sector(d(338.0)),
        none=geo.compass_sector(F.lit(None).cast("double")),
        low=geo.sector_low(d(350.0)),
        high=geo.sector_high(d(350.0)),
        even=geo.sector_nearest(d(11.25)),
        odd=geo.sector_nearest(d(33.75)),
    )
    assert (r.toward, r.wind, r.diff) == (90.0, 180.0, 30.0)
    assert (r.sector, r.none, r.low, r.high) == ("N-Tramontana", "NA", 15, 0)
    assert (r.even, r.odd) == (0.0, 45.0)


def haversine(a, b, c, d):
    p1, p2 = math.radians(a), math.radians(c)
    x = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * policy.EARTH_RADIUS_KM * math.asin(math.sqrt(min(1.0, x)))


@pytest.mark.parametrize("max_km", [120.0, 900.0, 2500.0])
def test_within_distance_equals_brute_force(spark, max_km):
    rng = np.random.default_rng(3)
    pts = [(i, float(la), float(lo)) for i, (la, lo) in enumerate([(45, 8), (0, 179.9), (-30, -179.5), (84, 10), (-89.5, 0), (60, 0.01)])]
    cells = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(1500)]
    p = spark.createDataFrame(pts, "receptor_id int, lat0 double, lon0 double")
    c = spark.createDataFrame(cells, "cell_id int, lat double, lon double")
    got = {(r.receptor_id, r.cell_id) for r in C.within_distance(p, c, max_km).collect()}
    want = {(i, j) for i, a, b in pts for j, la, lo in cells if haversine(a, b, la, lo) <= max_km}
    assert got == want


def test_corridor_three_cells_by_hand(spark):
    """Two sectors around the bearing, one without a value: the mean uses what remains, support is the mixed weight."""
    sums = spark.createDataFrame(
        [("BASE", "a", 4, 1, 20.0, 2.0), ("BASE", "a", 5, 1, 90.0, 3.0), ("BASE", "b", 4, 1, 5.0, 1.0)],
        "scenario string, receptor_id string, sector int, t int, num double, den double",
    )
    panel = spark.createDataFrame([("a", 1, 4.25 * 22.5), ("b", 1, 5.5 * 22.5), ("b", 1, 10 * 22.5)], "receptor_id string, t int, bearing double")
    out = C.corridor(panel, C.sector_profile(sums, "t"), ["receptor_id", "t"], "bearing").orderBy("receptor_id", "bearing").collect()
    a, none1, none2 = out[0], out[1], out[2]
    assert a.corridor_value == pytest.approx((0.75 * 20 + 0.25 * 90) / (0.75 * 2 + 0.25 * 3))
    assert a.corridor_support == pytest.approx(2.25)
    assert none1.corridor_value is None and none1.corridor_support == 0.0
    assert none2.corridor_value is None and none2.corridor_support == 0.0


def test_corridor_at_one_bearing_equals_the_all_sector_form(spark):
    rng = np.random.default_rng(12)
    cells = [(i, 40 + 0.5 * (i // 8), 5 + 0.5 * (i % 8), float(rng.uniform(1, 2))) for i in range(64)]
    receptors = spark.createDataFrame([("a", 41.0, 6.0), ("b", 42.5, 8.5)], "receptor_id string, lat0 double, lon0 double")
    grid = spark.createDataFrame(cells, "cell_id int, lat double, lon double, area_m2 double")
    panel = spark.createDataFrame([(r, t, float(rng.uniform(0, 360))) for r in "ab" for t in range(6)], "receptor_id string, t int, bearing double")
    values = [(i, t, None if rng.random() < 0.4 else float(rng.normal())) for i in range(64) for t in range(5)]  # none at t = 5
    field = spark.createDataFrame(values, "cell_id int, t int, v double")
    scenarios = policy.KERNEL_SCENARIOS
    sums = C.sector_sums(field, C.sector_weights(receptors, grid, scenarios), "t", "v")
    every = panel.withColumn("scenario", F.explode(F.array(*[F.lit(s[0]) for s in scenarios])))
    want = C.corridor(every, C.sector_profile(sums, "t"), ["scenario", "receptor_id", "t"], "bearing").where("corridor_support > 0")
    pairs = C.within_distance(receptors, grid, max(s[4] for s in scenarios))
    got = C.corridor_at_bearing(field.join(panel, "t"), pairs, ["receptor_id", "t"], "bearing", "v", scenarios).where("corridor_support > 0")
    key = lambda r: (r.scenario, r.receptor_id, r.t)
    a, b = {key(r): r for r in got.collect()}, {key(r): r for r in want.collect()}
    assert a.keys() == b.keys() and len(a) > 30
    for k in a:
        assert a[k].corridor_value == pytest.approx(b[k].corridor_value) and a[k].corridor_support == pytest.approx(b[k].corridor_support)


def test_weighted_mean_skips_missing_and_needs_support(spark):
    f = spark.createDataFrame([(0, 1, 2.0), (1, 1, None), (0, 2, None), (1, 2, None)], "cell_id int, t int, v double")
    w = spark.createDataFrame([("a", 0, 0.25), ("a", 1, 0.75)], "receptor_id string, cell_id int, w double")
    out = {r.t: r.v for r in R.regrid(f, w, ["t"], ["v"]).collect()}
    assert out == {1: 2.0, 2: None}


def test_precipitation_all_missing_is_zero_unless_strict(spark):
    s = spark.createDataFrame([("a", "2000-09-01", None)], "receptor_id string, date string, tp double")
    assert R.daily_precipitation(s, "tp").first().precip_sum_mm == 0.0
    assert R.daily_precipitation(s, "tp", strict=True).first().precip_sum_mm is None


def test_cell_edges(spark):
    axis = spark.createDataFrame([("lat", 0, 10.0), ("lat", 1, 12.0), ("lat", 2, 18.0)], "axis string, idx int, centre double")
    e = C.axis_edges(axis).orderBy("idx").collect()
    assert [(r.lo, r.hi) for r in e] == [(9.0, 11.0), (11.0, 15.0), (15.0, 21.0)]


def test_slope_matches_numpy_gradient(spark):
    z = np.random.default_rng(0).normal(size=(6, 5)) * 100
    rows = [(0, i, j, float(z[i, j])) for i in range(6) for j in range(5)]
    df = spark.createDataFrame(rows, "tile int, r int, c int, z double")
    got = R.slope_degrees(df, ["tile"], "r", "c", "z", 30.0).toPandas().pivot(index="r", columns="c", values="slope_deg").to_numpy()
    gy, gx = np.gradient(z, 30.0, 30.0)
    assert np.allclose(got, np.degrees(np.arctan(np.hypot(gx, gy))))


@pytest.mark.parametrize("block", [1, 2, 3])
def test_slopes_are_equal_at_block_borders(spark, block):
    z = np.random.default_rng(1).normal(size=(7, 6)) * 100
    rows = [(t, i, j, float(z[i, j] * (t + 1))) for t in range(2) for i in range(7) for j in range(6)]
    df = spark.createDataFrame(rows, "tile int, r int, c int, z double")
    out = R.slope_degrees(df, ["tile"], "r", "c", "z", 30.0, block)
    assert out.count() == len(rows)
    whole = {(x.tile, x.r, x.c): x.slope_deg for x in R.slope_degrees(df, ["tile"], "r", "c", "z", 30.0).collect()}
    assert {(x.tile, x.r, x.c): x.slope_deg for x in out.collect()} == whole
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.split("== Initial Plan ==")[-1].count("Exchange") == 1


def test_a_missing_cell_is_no_neighbour(spark):
    df = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 2.0), (0, 0, 3, 9.0)], "tile int, r int, c int, z double")
    got = {x.c: x.slope_deg for x in R.slope_degrees(df, ["tile"], "r", "c", "z", 1.0).collect()}
    assert got[3] is None  # alone in its row and column
    assert R.slope_degrees(df.limit(0), ["tile"], "r", "c", "z", 1.0).count() == 0


def test_align_nearest_when_all_values_lie_within_the_tolerance(spark):
    n = 4000
    a = spark.createDataFrame([(i, (i % 997) / 1e4) for i in range(n)] + [(n, None)], "i int, x double")
    b = spark.createDataFrame([((i * 7 % 2003) / 2e4, i) for i in range(2003)] + [(0.01, 9999), (None, 1)], "y double, k int")
    out = J.align_nearest(a, b, "x", "y", 1.0, ["i"], [F.col("k")]).collect()
    ys = sorted({(i * 7 % 2003) / 2e4 for i in range(2003)})
    assert len(out) == n
    for r in out:
        at = int(np.searchsorted(ys, r.x))
        near = min((abs(r.x - y), y) for y in ys[max(at - 1, 0) : at + 2])
        assert r.y == near[1]
    assert all(r.k != 9999 for r in out if r.y == 0.01)  # of equal values the first by the extra order
    none = J.align_nearest(a, b.limit(0), "x", "y", 1.0, ["i"])
    assert none.count() == 0 and J.align_nearest(a.limit(0), b, "x", "y", 1.0, ["i"]).count() == 0


def test_align_nearest_hands_values_over_empty_ranges(spark):
    left = [(i, float(i)) for i in range(0, 3000, 3)]
    right = [(1.0,), (1500.2,), (2998.5,)]
    got = {r.i: r.y for r in J.align_nearest(spark.createDataFrame(left, "i int, x double"), spark.createDataFrame(right, "y double"), "x", "y", 5000.0, ["i"]).collect()}
    assert got == {i: min((abs(x - y), y) for (y,) in right)[1] for i, x in left}


def test_align_nearest_brute_force(spark):
    rng = np.random.default_rng(5)
    left, right = np.round(rng.uniform(-5, 5, 200), 2), np.round(rng.uniform(-5, 5, 80), 2)
    a = spark.createDataFrame([(i, float(x)) for i, x in enumerate(left)], "i int, x double")
    b = spark.createDataFrame([(float(y),) for y in sorted(set(right))], "y double")
    got = {r.i: r.y for r in J.align_nearest(a, b, "x", "y", 0.07, ["i"]).collect()}
    want = {}
    for i, x in enumerate(left):
        near = sorted((abs(x - y), y) for y in set(right) if abs(x - y) <= 0.07)
        if near:
            want[i] = near[0][1]
    assert got == want


def test_overlapping_boxes_brute_force(spark):
    rng = np.random.default_rng(6)

    def boxes(n):
        w, s = rng.uniform(-4, 4, n), rng.uniform(-4, 4, n)
        return [(i, float(w[i]), float(s[i]), float(w[i] + rng.uniform(0.01, 3)), float(s[i] + rng.uniform(0.01, 3))) for i in range(n)]

    a, b = boxes(60), boxes(70)
    a += [(100, -50.0, -50.0, 50.0, 50.0), (101, 0.0, 0.0, 0.001, 0.002), (102, 0.0005, 0.0, 0.0006, 0.0001), (103, 1.0, 1.0, 1.0, 1.0)]
    b += [(200, 0.0, 0.0, 0.0008, 0.5), (201, -3.0, -4.0, 4.0, 4.0), (202, 2.0, 2.0, 4.0, 4.0)]
    schema = "{} int, west double, south double, east double, north double"
    out = J.overlapping_boxes(spark.createDataFrame(a, schema.format("a_id")), spark.createDataFrame(b, schema.format("b_id")), "a_id", "b_id")
    got = sorted((r.a_id, r.b_id) for r in out.collect())
    want = sorted((p[0], q[0]) for p in a for q in b if max(p[1], q[1]) < min(p[3], q[3]) and max(p[2], q[2]) < min(p[4], q[4]))
    assert got == want


def test_active_per_day_brute_force(spark):
    rng = np.random.default_rng(7)
    base = pd.Timestamp("2000-01-01")
    rows = []
    for i in range(80):
        a = int(rng.integers(0, 60))
        rows.append((f"g{i % 2}", f"m{i % 9}", (base + pd.Timedelta(days=a)).date(), (base + pd.Timedelta(days=a + int(rng.integers(0, 12)))).date()))
    df = spark.createDataFrame(rows, "g string, m string, d0 date, d1 date")
    got = {(r.g, r.date): r.active for r in J.active_per_day(df, ["g"], "m", "d0", "d1").collect()}
    want: dict = {}
    for g, m, a, b in rows:
        for d in pd.date_range(a, b):
            want.setdefault((g, d.date()), set()).add(m)
    assert got == {k: len(v) for k, v in want.items()}


def test_column_flux_by_hand(spark):
    """Levels 500 and 700 hPa valid, 900 hPa below ground at 800 hPa: one slab and the surface gap."""
    rows = [(1, 50000.0, 2.0, 1.0, 0.0), (1, 70000.0, 4.0, 1.0, 0.0), (1, 90000.0, 8.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "k int, p double, q double, u double, v double").withColumn("sp", F.lit(80000.0))
    r = R.column_flux(df, ["k"], "p", "q", "u", "v", "sp").first()
    assert r.ivt_e == pytest.approx((0.5 * (2 + 4) * 20000 + 4 * 10000) / R.GRAVITY)
