import numpy as np
import pytest
from pyspark.sql import functions as F

from rainshed.llm import topk as T


def brute(rows, k, asks):
    """rows: (id, vector) that take part."""
    out = []
    for q, v in {(q, tuple(v)) for q, v in rows if asks(q)}:
        n = max(len(v), max(len(w) for _, w in rows))
        pad = lambda x: list(x) + [0] * (n - len(x))
        scores = sorted((-sum(a * b for a, b in zip(pad(v), pad(w))), i) for i, w in rows if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("params", [T.Params(), T.Params(k=3, rows=64, queries=8, leaf=4, fan=3)])
def test_equals_brute_force(spark, params):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 6))
    x = (centres[rng.integers(0, 9, 400)] + 0.05 * rng.normal(size=(400, 6))).astype("float32")
    x[50:90] = x[50]  # ties
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(500, [float("nan")] * 6), (550, None), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (650, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    rows += [(700, [0.5, 0.25]), (100, rows[100][1]), (750, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("v", F.lit(2))
    got = sorted(tuple(r) for r in T.top_k(d, F.col("vec_id") % 50 == 0, params).collect())
    whole = [(i, [int(np.floor(256 * np.float64(np.float32(a)))) for a in v]) for i, v in rows if i is not None and v is not None and all(a is not None and np.isfinite(a) for a in v)]
    assert got == brute(whole, params.k, lambda i: i % 50 == 0)


def test_clusters_are_pruned_and_large_values_exact():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (30, 8))
    rows = centres[rng.integers(0, 30, 3000)] + rng.integers(-5, 5, (3000, 8))
    s = T.Search(rows[:300], np.arange(300), rows, np.arange(3000), T.Params())
    assert s.visited < 0.3 * 300 * 3000
    big = rng.integers(-(1 << 30), 1 << 30, (60, 4))
    s = T.Search(big[:5], np.arange(5), big, np.arange(60), T.Params(leaf=4))
    for i in range(5):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(big[i], w)), j) for j, w in enumerate(big) if j != i)[:5]
        assert s.best[i] == [(-a, j) for a, j in want]


def test_few_and_no_rows(spark):
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert T.top_k(one, F.col("vec_id") % 50 == 0).count() == 0
    assert T.top_k(one.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_too_long_vectors_end_the_job(spark):
    rows = spark.createDataFrame([(0, [4e7, 1e15]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        T.top_k(rows, F.col("vec_id") % 50 == 0).count()
