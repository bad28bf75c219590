"""Station statistics, network resolution and probability evaluation on hand cases and brute force."""

import datetime as dt
from hashlib import md5

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rainshed.operators import evaluate as E
from rainshed.operators import fitting
from rainshed.operators import models as M
from rainshed.operators import network as N
from rainshed.operators import stations as S

T0 = dt.datetime(2000, 9, 1)


def series(spark, rows):
    return spark.createDataFrame(rows, "s string, code string, ts timestamp, v double")


def test_daily_policies(spark):
    h = [T0 + dt.timedelta(hours=i) for i in range(3)]
    rows = [("a", c, t, v) for c in ("PRECIP_MM", "WIND_DIR_DEG", "DISCHARGE_MIN_M3_S", "DISCHARGE_MAX_M3_S", "AIR_TEMP_C") for t, v in zip(h, (350.0, 10.0, 0.0))]
    d = {r.code: r for r in S.daily_station(series(spark, rows), ["s"], "code", "ts", "v", F.lit(2)).collect()}
    assert d["PRECIP_MM"].daily_value == 360.0
    assert d["DISCHARGE_MIN_M3_S"].daily_value == 0.0 and d["DISCHARGE_MAX_M3_S"].daily_value == 350.0
    assert d["AIR_TEMP_C"].daily_value == pytest.approx(120.0)
    w = d["WIND_DIR_DEG"]
    assert min(w.daily_value, 360 - w.daily_value) == pytest.approx(0.0, abs=1e-9)
    assert w.daily_mean is None and w.daily_sum is None and 0.9 < w.circular_resultant_strength < 1
    assert w.day_completeness == "OVERCOMPLETE" and w.coverage_fraction == 1.5


def test_opposite_directions_have_no_mean(spark):
    d = S.daily_station(series(spark, [("a", "WIND_DIR_DEG", T0, 0.0), ("a", "WIND_DIR_DEG", T0, 180.0)]), ["s"], "code", "ts", "v", F.lit(2)).first()
    assert d.daily_value is None and d.circular_resultant_strength < 1e-12


def test_cadence_methods(spark):
    rows = [("gap", T0 + dt.timedelta(minutes=30 * i), None, False) for i in range(40)]
    rows += [("stated", T0 + dt.timedelta(hours=7 * i), 900, False) for i in range(5)]
    rows += [("daily", T0 + dt.timedelta(days=i), None, True) for i in range(3)]
    rows += [("odd", T0 + dt.timedelta(seconds=7000 * i), None, False) for i in range(9)]
    rows += [("five", T0 + dt.timedelta(seconds=21500 * i), None, False) for i in range(9)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, interval_seconds int, d boolean").repartition(4)
    got = {r.s: (r.nominal_cadence_seconds, r.expected_count_per_day, r.cadence_method) for r in S.infer_cadence(df, ["s"], "ts", "interval_seconds", F.col("d")).collect()}
    assert got["gap"] == (1800, 48, "MEDIAN_TIMESTAMP_DELTA")
    assert got["stated"] == (900, 96, "INTERVAL_SECONDS")
    assert got["daily"] == (86400, 1, "DAILY_SOURCE")
    assert got["odd"] == (None, None, "UNRESOLVED")
    # Gaps of "five" also cross day buckets: the previous row is found in the bucket before.
    assert got["five"] == (21500, 4, "MEDIAN_TIMESTAMP_DELTA")


def test_primary_resolution_order(spark):
    rows = [
        ("true", "A", True, "B", ["A", "B"]),
        ("true", "B", False, "B", ["A", "B"]),
        ("single", "A", False, "", []),
        ("near", "A", False, "B", ["B", "A"]),
        ("near", "B", False, "B", ["B", "A"]),
        ("two", "A", True, "A", ["A"]),
        ("two", "B", True, "A", ["A"]),
        ("mismatch", "A", False, "A", ["A"]),
        ("mismatch", "B", False, "A", ["A"]),
        ("off", "A", False, "C", ["A", "B"]),
        ("off", "B", False, "C", ["A", "B"]),
    ]
    df = spark.createDataFrame(rows, "source_series_id string, receptor_id string, is_primary boolean, nearest_receptor string, receptor_ids_source array<string>")
    res = N.resolve_primary(df)
    got = {r.source_series_id: (r.resolution, r.primary_receptor) for r in res.collect()}
    assert got == {
        "true": ("RELATION_TABLE", "A"),
        "single": ("SINGLE_RELATION_FALLBACK", "A"),
        "near": ("NEAREST_RECEPTOR_VALIDATED", "B"),
        "two": ("MULTIPLE_TRUE_PRIMARY", None),
        "mismatch": ("SOURCE_RELATION_SET_MISMATCH", None),
        "off": ("NEAREST_NOT_IN_RELATIONS", None),
    }
    assert N.primary_violations(N.canonical_relations(res)).count() == 0
    assert N.rejected_relations(res).count() == 3


# ---- evaluation --------------------------------------------------------------------------------------------------
def preds(spark, y, p, **extra):
    pdf = pd.DataFrame({"y": y, "p": p, **extra})
    return spark.createDataFrame(pdf)


def brute(y, p):
    y, p = np.asarray(y), np.asarray(p, float)
    ap, tp_before = 0.0, 0
    for t in sorted(set(p), reverse=True):
        tp, n = ((p >= t) & (y == 1)).sum(), (p >= t).sum()
        ap += (tp - tp_before) * tp / n
        tp_before = tp
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    q = np.clip(p, 1e-8, 1 - 1e-8)
    return ap / len(pos), auc, np.mean((p - y) ** 2), -np.mean(np.where(y == 1, np.log(q), np.log(1 - q)))


def test_average_precision_with_ties(spark):
    r = E.probability_metrics(preds(spark, [1, 0, 1, 0], [0.9, 0.9, 0.5, 0.1]), [], "y", "p").first()
    assert r.average_precision == pytest.approx((1 / 2 + 2 / 3) / 2)


def test_metrics_equal_brute_force_on_skewed_scores(spark):
    rng = np.random.default_rng(0)
    p = np.round(np.concatenate([rng.beta(1, 9, 900), np.full(500, 0.05)]), 3)
    y = (rng.uniform(size=p.size) < p * 2).astype(int)
    r = E.probability_metrics(preds(spark, y, p).repartition(5), [], "y", "p").first()
    assert (r.average_precision, r.roc_auc, r.brier_score, r.log_loss) == pytest.approx(brute(y, p), abs=1e-9)


def test_one_class_is_null(spark):
    r = E.probability_metrics(preds(spark, [0, 0], [0.2, 0.3]), [], "y", "p").first()
    assert r.average_precision is None and r.roc_auc is None and r.brier_score == pytest.approx(0.065)
    one = E.probability_metrics(preds(spark, [1, 1], [0.2, 0.3]), [], "y", "p").first()
    assert one.average_precision == 1.0 and one.roc_auc is None


def test_sweep_and_selection_brute_force(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.beta(1, 4, 400), 3)
    y = (rng.uniform(size=400) < p).astype(int)
    key = np.where(np.arange(400) % 3 == 0, "a", "b")
    sweep = E.threshold_sweep(preds(spark, y, p, k=key), ["k"], "y", "p").toPandas()
    chosen = E.choose_thresholds(spark.createDataFrame(sweep), ["k"]).toPandas()
    for k in "ab":
        yy, pp, s = y[key == k], p[key == k], sweep[sweep.k == k]
        levels = np.unique(np.concatenate([0.001 + np.arange(999) * (0.998 / 998.0), np.quantile(pp, np.arange(1, 100) / 100)]))
        assert abs(len(s) - len(levels)) <= 3
        for t, tp, fp, fn, tn in s[["threshold", "tp", "fp", "fn", "tn"]].itertuples(index=False):
            alarm = pp >= t
            assert (tp, fp, fn, tn) == ((alarm & (yy == 1)).sum(), (alarm & (yy == 0)).sum(), (~alarm & (yy == 1)).sum(), (~alarm & (yy == 0)).sum())
        best = chosen[(chosen.k == k) & (chosen.rule == "MAX_CSI")].iloc[0]
        assert best.csi == s.csi.max()
        r80 = chosen[(chosen.k == k) & (chosen.rule != "MAX_CSI")].iloc[0]
        assert r80.recall >= 0.8 and r80.precision == s[s.recall >= 0.8].precision.max()


def test_recall_rule_falls_back(spark):
    rows = [(0.5, 1, 0, 1, 1, 1.0, 0.5, 0.5), (0.9, 0, 0, 2, 1, None, 0.0, 0.0)]
    sweep = spark.createDataFrame(rows, "threshold double, tp int, fp int, fn int, tn int, precision double, recall double, csi double")
    assert {r.rule: r.threshold for r in E.choose_thresholds(sweep, []).collect()} == {"MAX_CSI": 0.5, "RECALL80_MAX_PRECISION": 0.5}


def test_clusters(spark):
    d = [dt.date(2000, 9, i) for i in (1, 2, 3, 5, 9, 10)]
    df = spark.createDataFrame(
        [("a", d[0], 1, 0.1), ("a", d[1], 1, 0.9), ("a", d[2], 0, 0.9), ("a", d[3], 1, 0.1), ("a", d[4], 0, 0.9), ("a", d[5], 0, 0.9)],
        "r string, date date, y int, p double",
    )
    m = E.cluster_metrics(df, [], "r", "date", "y", "p", F.lit(0.5)).first()
    assert (m.true_clusters, m.hit_clusters, m.alert_clusters, m.false_alert_clusters) == (2, 1, 2, 1)


def test_bootstrap_equals_explicit_resampling(spark):
    rng = np.random.default_rng(4)
    n = 120
    pdf = pd.DataFrame({"r": rng.choice(list("abc"), n), "yr": rng.choice([1, 2], n), "p": np.round(rng.uniform(size=n), 2)})
    pdf["y"] = (rng.uniform(size=n) < pdf.p).astype(int)
    df = spark.createDataFrame(pdf)
    blocks = E.numbered_blocks(df, ["r", "yr"])
    ids = blocks.toPandas().set_index("block_id")
    for most in (1 << 20, 100):  # all replicates at once, and a few at a time
        got = E.block_bootstrap(df, ["r", "yr"], "y", "p", 5, 11, most).toPandas().set_index("replicate")
        assert sorted(got.index) == [1, 2, 3, 4, 5]
        for rep in got.index:
            drawn = [int(md5(f"{rep}|{b}|11".encode()).hexdigest()[:8], 16) % len(ids) for b in range(len(ids))]
            s = pd.concat([pdf[(pdf.r == ids.r[b]) & (pdf.yr == ids.yr[b])] for b in drawn])
            assert got.loc[rep, list(E.METRICS)].tolist() == pytest.approx(brute(s.y, s.p), abs=1e-9)
    assert E.block_bootstrap(df.limit(0), ["r", "yr"], "y", "p", 5).count() == 0


def test_platt_recovers_its_own_curve(spark):
    rng = np.random.default_rng(9)
    p = rng.uniform(0.02, 0.98, 6000)
    z = np.log(p / (1 - p))
    y = (rng.uniform(size=p.size) < 1 / (1 + np.exp(-(0.4 + 0.7 * z)))).astype(int)
    a, b = M.fit_platt(preds(spark, y, p), "y", "p")
    assert a == pytest.approx(0.4, abs=0.12) and b == pytest.approx(0.7, abs=0.08)


def test_permutations_keep_the_values(spark):
    df = spark.createDataFrame([(i, i % 5, float(i)) for i in range(200)], "i int, r int, v double").withColumn("s", F.col("r") * 10.0)
    moved = M.permute_rows(df, ["i"], "v", 3).toPandas().sort_values("i")
    assert sorted(moved.v) == [float(i) for i in range(200)] and (moved.v != moved.i).sum() > 150
    swapped = M.permute_receptors(df, "r", "s", 3).toPandas()
    assert swapped.groupby("r").s.nunique().max() == 1 and sorted(swapped.s.unique()) == [0.0, 10.0, 20.0, 30.0, 40.0]


def test_importance_finds_the_signal(spark):
    rng = np.random.default_rng(8)
    n = 600
    pdf = pd.DataFrame({"i": range(n), "r": np.arange(n) % 10, "signal": rng.normal(size=n), "noise": rng.normal(size=n)})
    pdf["y"] = (pdf.signal + 0.3 * rng.normal(size=n) > 0.5).astype(float)
    pdf["part"], pdf["fixed"] = 0, pdf.r.astype(float)
    df = spark.createDataFrame(pdf)
    names = ["signal", "noise", "fixed"]
    fits = M.fit(df, "part", "r", "y", names, M.in_every_part([0], fitting.Logistic("ridge", 0, 1.0, 0.0)))
    val = M.with_contributions(df, "part", names, ["i", "r", "y"], {0: fits[0, "ridge"]})
    imp = M.permutation_importance(val, "part", ["i", "r"], "r", names, ["fixed"], "y", 2).toPandas().set_index("predictor")
    assert imp.mean_ap_drop["signal"] > 0.3 and abs(imp.mean_ap_drop["noise"]) < 0.1 and (imp.repeats == 2).all()


def test_empty_and_gappy_predictors_are_kept(spark):
    rows = [(0, i % 4, float(i % 2), float(i) if i % 3 else None, None) for i in range(60)]
    df = spark.createDataFrame(rows, "part int, r int, y double, a double, b double")
    fits = M.fit(df, "part", "r", "y", ["a", "b"], [m for s in (fitting.Logistic("line", 0, 1.0, 0.0, 0), fitting.Boosting("trees", 0, rounds=3)) for m in M.in_every_part([0], s)])
    assert set(fits) == {(0, "line"), (0, "trees")} and fits[0, "line"].scaling.gappy.tolist() == [0, 1]
    got = fitting.scored(df, "part", ["a", "b"], ["y"], fits)
    assert got.count() == 120 and got.where("p IS NULL OR p <= 0 OR p >= 1").count() == 0
