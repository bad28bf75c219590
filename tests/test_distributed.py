"""Order statistics for skewed keys against NumPy / pandas; one key holds half of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rainshed.operators import distributed as D


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    hot = pd.DataFrame({"k": "hot", "v": np.concatenate([rng.exponential(1.0, 3000), np.full(1000, 0.25)])})
    cold = pd.DataFrame({"k": [f"c{i % 7}" for i in range(3500)], "v": np.round(rng.normal(5, 2, 3500), 1)})
    one = pd.DataFrame({"k": ["single"], "v": [4.0]})
    pdf = pd.concat([hot, cold, one], ignore_index=True)
    pdf["id"] = range(len(pdf))
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_exact_quantiles(skewed):
    pdf, df = skewed
    got = D.exact_quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.975, 1.0], names=list("abcde")).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert np.allclose(got.loc[k].astype(float), np.quantile(g.v, [0, 0.1, 0.5, 0.975, 1.0]), rtol=0, atol=1e-12)


def test_quantile_grid(skewed):
    pdf, df = skewed
    got = D.quantile_grid(df, ["k"], "v", 100).toPandas()
    assert len(got) == 99 * pdf.k.nunique()
    for k, g in pdf.groupby("k"):
        q = got[got.k == k].sort_values("i")
        assert np.allclose(q["quantile"], np.quantile(g.v, np.arange(1, 100) / 100), rtol=0, atol=1e-12)


def test_hot_key_is_spread_over_ranges(skewed):
    pdf, df = skewed
    splits = D.value_splits(df, "v")
    sizes = df.groupBy("k").agg({"v": "count"}).toPandas()
    assert sizes["count(v)"].max() > len(pdf) / 2
    ranged = D.with_range(D.histogram(df, ["k"], "v"), "v", splits)
    assert ranged.groupBy("k", "__range").count().toPandas()["count"].max() < len(pdf) / 20


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(skewed, descending):
    pdf, df = skewed
    got = D.running_totals(D.histogram(df, ["k"], "v"), ["k"], "v", ["n"], descending=descending).toPandas()
    h = pdf.groupby(["k", "v"]).size().rename("n").reset_index().sort_values("v", ascending=not descending)
    h["cum"] = h.groupby("k").n.cumsum()
    m = got.merge(h, on=["k", "v"])
    assert len(m) == len(h) and (m.cum_n == m["cum"]).all()
    assert (got.groupby("k").tot_n.first() == pdf.groupby("k").size()).all()


def test_percent_rank_average(skewed):
    pdf, df = skewed
    got = D.percent_rank_average(df, ["k"], "v", "r").toPandas().set_index("id").r.sort_index()
    want = pdf.groupby("k").v.rank(method="average", pct=True) * 100
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_previous_in_order(skewed):
    pdf, df = skewed
    got = D.previous_in_order(df, ["k"], "id", 64.0, ["v"]).toPandas().set_index("id").prev_v.sort_index()
    want = pdf.sort_values("id").groupby("k").v.shift(1)
    assert np.array_equal(got.to_numpy(), want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_previous_in_order_over_levels_of_buckets(spark, monkeypatch, levels):
    """One unit with all rows, gaps wider than buckets, and equal orders that are told apart by nothing."""
    monkeypatch.setattr(D, "FAN", 3)
    rng = np.random.default_rng(3)
    at = np.sort(rng.choice(5000, 300, replace=False))
    pdf = pd.DataFrame({"k": "only", "t": at.astype(float), "v": rng.normal(size=300)})
    got = D.previous_in_order(spark.createDataFrame(pdf), ["k"], "t", 10.0, ["v", "t"], levels).toPandas().sort_values("t")
    assert np.array_equal(got.prev_v.to_numpy(), pdf.v.shift(1).to_numpy(), equal_nan=True)
    assert np.array_equal(got.prev_t.to_numpy(), pdf.t.shift(1).to_numpy(), equal_nan=True)
    assert list(got.columns) == ["k", "t", "v", "prev_v", "prev_t"]


def test_weighted_quantile_grid_equals_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 500)) for v in np.round(rng.normal(size=n), 1)]
    df = spark.createDataFrame(rows, "k string, v double")
    counts = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    for parts in (4, 100):
        got = D.weighted_quantile_grid(counts, ["k"], "v", "n", parts, splits=[-0.5, 0.0, 0.6]).collect()
        assert len(got) == 3 * (parts - 1)
        for r in got:
            assert r.quantile == pytest.approx(np.quantile([v for k, v in rows if k == r.k], r.i / parts))
