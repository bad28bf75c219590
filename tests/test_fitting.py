import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainshed.operators import fitting as T
from rainshed.operators import models as M
from rainshed.plans import model_queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 500
    x = rng.normal(size=(n, 4))
    x[:, 1] = np.round(x[:, 1] * 3)
    x[rng.random(n) < 0.2, 2] = np.nan
    x[:, 3] = np.nan  # a predictor without any value
    z = 1.2 * x[:, 0] - 0.8 * (x[:, 1] > 1) + np.where(np.isnan(x[:, 2]), 1.5, 0.5 * x[:, 2]) - 0.3
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(float)
    part = rng.integers(0, 2, n)
    w = rng.uniform(0.5, 2.0, n)
    return x, y, part, w


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, part, w = data
    some = [(int(p), float(a), float(b), *[None if math.isnan(v) else float(v) for v in r]) for r, a, p, b in zip(x, y, part, w)]
    some += [(0, None, 1.0, 0.0, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0, 0.0, None, 0.0)]  # no label; one class
    return spark.createDataFrame(some, "part int, y double, w double, a double, b double, c double, d double").repartition(3)


@pytest.fixture(scope="module")
def blocks(rows):
    return T.pack(rows, "part", "y", ["w"], ["a", "b", "c", "d"], size=40).persist()


def test_logistic_fits_are_optimal_and_all_together(rows, blocks, data):
    x, y, part, w = data
    known = rows.where("y IS NOT NULL")
    scaling = T.scalings(known, blocks, "part", ["a", "b", "c", "d"])
    models = [T.Logistic(f"{p}-{c}-{l1}-{k}", p, c, l1, k) for p in (0, 1, 7) for c in (0.1, 1.0) for l1 in (0.0, 0.5, 1.0) for k in (None, 0)]
    fits = T.fit_logistics(blocks, scaling, [*models, T.Logistic("one class", 2, 1.0, 0.5)])
    assert set(fits) == {m.name for m in models if m.part != 7} | {"one class"}
    assert fits["one class"].margin(np.zeros((1, 4)))[0] == pytest.approx(math.log((1 - 1e-8) / 1e-8))
    for m in models:
        if m.part == 7:
            continue
        of = part == m.part
        s = fits[m.name].scaling
        known_c = x[of][~np.isnan(x[of, 2]), 2]
        assert s.fill.tolist() == pytest.approx([np.median(x[of, 0]), np.median(x[of, 1]), np.median(known_c), 0.0])
        assert s.gappy.tolist() == [2, 3]
        z = s.features(x[of])
        assert z.mean(axis=0) == pytest.approx(np.zeros(6), abs=1e-9)
        wi = w[of] if m.weight == 0 else np.ones(of.sum())
        b = fits[m.name].beta
        gradient = np.r_[1.0, 0.0] if False else (wi * (1 / (1 + np.exp(-(b[0] + z @ b[1:]))) - y[of])) @ np.column_stack([np.ones(of.sum()), z]) / wi.sum()
        lam = 1 / (m.c * wi.sum())
        assert abs(gradient[0]) < 1e-8
        for j in range(1, 7):
            slope = gradient[j] + lam * (1 - m.l1_ratio) * b[j]
            bound = lam * m.l1_ratio
            assert abs(slope + bound * np.sign(b[j])) < 1e-8 if b[j] else abs(slope) <= bound + 1e-8
        each = fits[m.name].contributions(x[of])
        assert b[0] + each.sum(axis=1) == pytest.approx(fits[m.name].margin(x[of]))


def plain_boosting(x, y, w, cuts, rate, leaves, rounds, least, l2):
    """One split at a time over all thresholds, rows re-read each time."""
    codes = T.coded(x, cuts)
    share = (w * y).sum() / w.sum()
    m = np.full(len(y), math.log(share / (1 - share)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m))
        g, h = w * (p - y), w * p * (1 - p)
        nodes = [np.arange(len(y))]

        def best(rows):
            out = None
            for j in range(x.shape[1]):
                c = codes[rows, j]
                for gone_left in ([False, True] if (c == 255).any() else [False]):
                    for b in range(255):
                        left = np.where(c == 255, gone_left, c <= b)
                        a, o = rows[left], rows[~left]
                        if min(len(a), len(o)) >= least and min(h[a].sum(), h[o].sum()) >= 1e-3:
                            gain = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (a, o)) - g[rows].sum() ** 2 / (h[rows].sum() + l2)
                            if gain > 1e-10 and (out is None or gain > out[0] + 1e-9):
                                out = (gain, a, o)
            return out

        found = [best(nodes[0])]
        while len(nodes) < leaves and any(found):
            i = max((i for i in range(len(nodes)) if found[i]), key=lambda i: found[i][0])
            _, a, o = found[i]
            nodes[i : i + 1], found[i : i + 1] = [a, o], [best(a), best(o)]
        for rows in nodes:
            m[rows] -= rate * g[rows].sum() / (h[rows].sum() + l2)
    return m


def test_boosting_equals_growing_one_split_at_a_time(rows, blocks, data):
    x, y, part, w = data
    cuts = T.bin_cuts(rows.where("y IS NOT NULL"), "part", ["a", "b", "c", "d"], bins=12)
    assert [len(c) for c in cuts[0]] [0] == 11 and len(cuts[0][3]) == 0
    models = [T.Boosting(f"{p}-{k}", p, 0.3, 5, 4, 10, 1.0, k) for p in (0, 1) for k in (None, 0)]
    fits = T.fit_boostings(blocks, cuts, [*models, T.Boosting("one class", 2, rounds=2)], rebase=2)
    for m in models:
        of = part == m.part
        wi = w[of] if m.weight == 0 else np.ones(of.sum())
        f = fits[m.name]
        assert f.margin(x[of]) == pytest.approx(plain_boosting(x[of], y[of], wi, cuts[m.part], 0.3, 5, 4, 10, 1.0), abs=1e-6)
        assert len(f.trees) == 4 and len(f.losses) == 5 and all(b < a for a, b in zip(f.losses, f.losses[1:]))
        assert all((t.feature < 0).sum() <= 5 for t in f.trees)
    assert all(len(t.feature) == 1 for t in fits["one class"].trees)


def test_small_parts_grow_in_one_job_as_in_passes(spark, rows, blocks):
    cuts = T.bin_cuts(rows.where("y IS NOT NULL"), "part", ["a", "b", "c", "d"], bins=12)
    models = [T.Boosting(f"{p}-{k}-{r}", p, 0.3, 5, r, 10, 1.0, k) for p in (0, 1) for k in (None, 0) for r in (6, 9)] + [T.Boosting("one class", 2, rounds=2)]

    def jobs(name, **how):
        spark.sparkContext.setJobGroup(name, name)
        fits = T.fit_boostings(blocks, cuts, models, **how)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return fits, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    alone, few = jobs("alone")
    together, many = jobs("together", alone=0, rebase=4)
    some, _ = jobs("some", alone=int((rows.where("part = 0 AND y IS NOT NULL")).count()))
    assert few < 9 < many  # no pass a round
    assert list(alone) == list(together) == list(some) == [m.name for m in models]
    for name, f in alone.items():
        for g in (together[name], some[name]):
            assert len(f.trees) == len(g.trees) and f.start == pytest.approx(g.start) and f.first_gain == pytest.approx(g.first_gain)
            assert f.losses == pytest.approx(g.losses, abs=1e-9)
            for a, b in zip(f.trees, g.trees):
                assert a.feature.tolist() == b.feature.tolist() and a.code.tolist() == b.code.tolist() and a.missing_left.tolist() == b.missing_left.tolist()
                assert a.value == pytest.approx(b.value, abs=1e-9)


def test_best_splits_equal_trying_every_threshold():
    rng = np.random.default_rng(2)
    hist = np.zeros((3, 30, 256))
    for i in range(30):
        codes = np.r_[rng.integers(0, 12, 60), np.full(0 if i % 3 else 9, T.MISSING)]
        hist[2, i] = np.bincount(codes, minlength=256)
        hist[0, i] = np.bincount(codes, rng.normal(size=len(codes)), 256)
        hist[1, i] = np.bincount(codes, rng.uniform(0.01, 0.3, len(codes)), 256)
    hist[:, 7] = 0.0
    for i, got in enumerate(T.best_splits(hist, 1.0, 10, 1e-3)):
        v, gone, best = hist[:, i], hist[:, i, 255], 0.0
        for gone_left in (0, 1):
            for b in range(255):
                left = v[:, : b + 1].sum(axis=1) + gone_left * gone
                right = v.sum(axis=1) - left
                if min(left[2], right[2]) >= 10 and min(left[1], right[1]) >= 1e-3:
                    best = max(best, sum(s[0] ** 2 / (s[1] + 1) for s in (left, right)) - v[0].sum() ** 2 / (v[1].sum() + 1))
        if best <= 1e-10:
            assert got is None
            continue
        assert got[0] == pytest.approx(best)
        left = v[:, : got[1] + 1].sum(axis=1) + (gone if got[2] and gone[2] else 0)
        assert got[3] == pytest.approx(left) and got[4] == pytest.approx(v.sum(axis=1) - left)


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_a_newton_step_is_exact_where_predictors_nearly_depend_on_each_other(share):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(300, 8))
    z[:, 1] = z[:, 0] + 1e-3 * rng.normal(size=300)
    z[:, 2] = z[:, 0] - z[:, 3] + 1e-3 * rng.normal(size=300)
    z[:, 7] = 0.0  # a predictor without any value
    z = np.column_stack([np.ones(300), z])
    h, g, beta = z.T @ z / 300, z.T @ rng.normal(size=300) / 300 - z.T @ z[:, 2] / 300, rng.normal(size=9) * 0.1
    beta[8] = 0.0
    l1, l2 = np.full(9, 1e-5 * share), np.full(9, 1e-5 * (1 - share))
    l1[0] = l2[0] = 0.0
    x = T._newton_step(beta, g, h, l1, l2)
    slope = g + h @ (x - beta) + l2 * x
    off = np.where(x != 0, np.abs(slope + l1 * np.sign(x)), np.maximum(np.abs(slope) - l1, 0.0))
    assert off.max() < 1e-11


def test_a_missing_value_learns_its_side(spark):
    rows = [(0, float(i % 2), 1.0, None if i % 2 else float(i % 7)) for i in range(200)]
    d = spark.createDataFrame(rows, "part int, y double, w double, a double")
    f = T.fit_boostings(T.pack(d, "part", "y", ["w"], ["a"]), T.bin_cuts(d, "part", ["a"]), [T.Boosting("m", 0, 0.3, 4, 20)])["m"]
    p = f.margin(np.array([[np.nan], [0.0], [6.0]]))
    assert p[0] > 2 and p[1] < -2 and p[2] < -2


def test_scores_carry_every_model_and_odd_parts(spark, rows, blocks):
    known = rows.where("y IS NOT NULL")
    fits = T.fit_logistics(blocks, T.scalings(known, blocks, "part", ["a", "b", "c", "d"]), [T.Logistic(n, p, c, 0.0) for p in (0, 1) for n, c in ((f"{p}x", 1.0), (f"{p}y", 0.1))])
    by = {(int(k[0]), k[1]): v for k, v in fits.items()}
    out = T.scored(rows, "part", ["a", "b", "c", "d"], ["y"], by).groupBy("part", "model").agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")).collect()
    assert {(r.part, r.model) for r in out} == set(by)
    assert all(0 < r.lo < r.hi < 1 for r in out)
    empty = rows.limit(0)
    assert T.scored(empty, "part", ["a", "b", "c", "d"], ["y"], by).count() == 0
    assert T.fit_logistics(T.pack(empty, "part", "y", ["w"], ["a"]), {}, [T.Logistic("m", 0, 1.0, 0.0)]) == {}


def test_scores_of_many_linear_models_are_no_long_expression(spark, rows, blocks):
    known = rows.where("y IS NOT NULL")
    scaling = T.scalings(known, blocks, "part", ["a", "b", "c", "d"])
    fits = {(p, f"m{i}"): T.LinearFit(scaling[p], np.r_[0.1 * i, np.linspace(-1, 1, len(scaling[p].mean))], 0.0, 0.0, 1) for p in (0, 1) for i in range(60)}
    plan = lambda f: T.scored(rows, "part", ["a", "b", "c", "d"], ["y"], f)._jdf.queryExecution().optimizedPlan().toString()
    few = {k: v for k, v in fits.items() if k[1] == "m0"}
    assert len(plan(fits)) < len(plan(few)) + 100
    got = T.scored(rows, "part", ["a", "b", "c", "d"], ["y", "a", "b", "c", "d"], fits).toPandas()
    assert len(got) == 60 * known.where("part < 2").count() + 60 * rows.where("y IS NULL AND part < 2").count()
    for (p, name), f in fits.items():
        some = got[(got.part == p) & (got.model == name)]
        x = some[["a", "b", "c", "d"]].to_numpy(dtype=np.float64)
        assert some.p.to_numpy() == pytest.approx(1 / (1 + np.exp(-(f.beta[0] + f.scaling.features(x) @ f.beta[1:]))))


def test_every_fold_horizon_and_configuration(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(Q.M, "fit", lambda rows, part, receptor, y, predictors, models: asked.extend(models) or {})
    monkeypatch.setattr(Q.fitting, "scored", lambda rows, part, columns, keep, fits, out="p": rows.select(part, *keep, F.lit("M1").alias("model"), F.lit(0.5).alias(out)))
    got = Q.candidate_benchmark(spark, SF).select("fold_id", "horizon_hours").distinct().collect()
    assert {(r.fold_id, r.horizon_hours) for r in got} <= set(Q.PARTS.values())
    assert {m.part for m in asked} == set(Q.PARTS) and len(asked) == 16 * 9
    assert len({m.name for m in asked}) == 16 * 9


def test_importance_of_a_linear_model_equals_scoring_again(spark):
    rng = np.random.default_rng(1)
    n = 60
    rows = [(i % 2, i, int(rng.integers(0, 5)), float(rng.random() < 0.4)) for i in range(n)]
    static = {r: float(v) for r, v in enumerate(rng.normal(size=5))}
    each = {i: [float(rng.normal()), static[r]] for _, i, r, _ in rows}
    d = spark.createDataFrame([(p, i, r, y, 0.1 + sum(each[i]), each[i]) for p, i, r, y in rows], "part int, k int, receptor int, y double, margin double, contributions array<double>")
    got = {(r.part, r.predictor): r for r in M.permutation_importance(d, "part", ["k"], "receptor", ["x", "s"], ["s"], "y", repeats=3, seed=9).collect()}
    assert set(got) == {(p, c) for p in (0, 1) for c in ("x", "s")} and all(r.repeats == 3 for r in got.values())

    def ap(pairs):
        pos = sum(y for _, y in pairs)
        out = 0.0
        for m in sorted({m for m, _ in pairs}, reverse=True):
            above = [y for v, y in pairs if v >= m]
            out += sum(y for v, y in pairs if v == m) * sum(above) / len(above)
        return out / pos

    from hashlib import md5

    h = lambda *a: md5("|".join(map(str, a)).encode()).hexdigest()
    for p in (0, 1):
        mine = [(i, r, y) for q, i, r, y in rows if q == p]
        base = ap([(0.1 + sum(each[i]), y) for i, _, y in mine])
        order = sorted((i for i, _, _ in mine), key=lambda i: int(h(i, 9)[:15], 16))
        towns = sorted({r for _, r, _ in mine}, key=lambda r: int(h(r, 10)[:15], 16))
        drops = {"x": [], "s": []}
        for k in range(3):
            s1, s2 = 1 + int(h(k, 9)[:8], 16) % (len(order) - 1), 1 + int(h(k, 10)[:8], 16) % (len(towns) - 1)
            give = {i: order[(at + s1) % len(order)] for at, i in enumerate(order)}
            town = {r: towns[(at + s2) % len(towns)] for at, r in enumerate(towns)}
            drops["x"].append(base - ap([(0.1 + each[give[i]][0] + each[i][1], y) for i, _, y in mine]))
            drops["s"].append(base - ap([(0.1 + each[i][0] + static[town[r]], y) for i, r, y in mine]))
        for c in ("x", "s"):
            assert got[p, c].mean_ap_drop == pytest.approx(np.mean(drops[c]), abs=1e-9)
            assert got[p, c].std_ap_drop == pytest.approx(np.std(drops[c]), abs=1e-9)


def test_losses_are_plain_numbers_however_a_forest_grows(spark, rows, blocks):
    """Rows of a result are made of them, and Spark takes no NumPy number."""
    cuts = T.bin_cuts(rows.where("y IS NOT NULL"), "part", ["a", "b", "c", "d"], bins=12)
    for how in ({}, {"alone": 0}):
        f = T.fit_boostings(blocks, cuts, [T.Boosting("m", 0, 0.3, 5, 2, 10)], **how)["m"]
        assert {type(x) for x in [*f.losses, f.start, f.first_gain]} == {float}
        lower = sum(b < a for a, b in zip(f.losses, f.losses[1:]))
        assert spark.createDataFrame([(lower,)], "n int").first().n == 2
