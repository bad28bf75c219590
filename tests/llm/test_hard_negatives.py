import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainshed.llm import hard_negatives as H


def ints(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def brute(rows, asks, p):
    """rows: (id, vector, label)."""
    whole = [(i, ints(v), l) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, q, label in {(i, tuple(v), l) for i, v, l in whole if asks(i)}:
        scores = sorted((-sum(x * y for x, y in zip(q, v)), i, l == label) for i, v, l in whole if i != a)
        for s, pos in [(-s, i) for s, i, same in scores if same][: p.positives]:
            fits = [(-t, i) for t, i, same in scores if not same and p.low * s <= -100 * t <= p.high * s]
            out += [(a, pos, r + 1, i, s, t) for r, (t, i) in enumerate(fits[: p.negatives])]
    return sorted(out)


SMALL = H.Params(rows=32, anchors=3, focus=2, sample=20)


@pytest.mark.parametrize("params", [H.Params(), SMALL, H.Params(positives=2, negatives=4, low=10, high=99, rows=50, anchors=2, sample=1)])
def test_equals_brute_force(spark, params):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(7, 6)) * rng.gamma(1.0, size=(7, 1))
    x = (centres[rng.integers(0, 7, 400)] + 0.2 * rng.normal(size=(400, 6))).astype("float32")
    x[50:90] = x[50]  # ties
    x[95:99] = 0
    rows = [(i, [float(a) for a in v], int(rng.integers(0, 4))) for i, v in enumerate(x)]
    rows += [(500, [float("nan")] * 6, 1), (550, None, 1), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (650, [float("inf")] + [0.0] * 5, 1), (None, [1.0] * 6, 1), (660, [1.0] * 6, None)]
    rows += [(700, [0.5, 0.25], 2), rows[100], rows[101], (750, [], 0), (800, [-1.0] * 6, 3)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).withColumns({c: F.lit(1) for c in ("anchor", "slot", "bucket", "score", "v", "length")})
    got = sorted(tuple(r) for r in H.hard_negatives(d, F.col("vec_id") % 25 == 0, params).collect())
    assert got == brute(rows, lambda i: i % 25 == 0, params)


def test_coordinates_prune_and_miss_nothing():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8))
    v = np.floor(256 * (centres[rng.integers(0, 40, 3000)] + 0.05 * rng.normal(size=(3000, 8)))).astype(np.int64)
    lengths = np.sqrt((v.astype(float) ** 2).sum(axis=1))
    b = H.Bucket.of(np.arange(3000), np.zeros(3000, dtype=np.int64), v, lengths)
    seen = 0
    for i in range(0, 3000, 100):
        scores = v @ v[i]
        for least in (int(np.sort(scores)[-20]), int(scores.max()) + 1, 0, -5):
            rows = b.candidates(v[i], lengths[i], least, 4)
            assert set(np.flatnonzero(scores >= least)) <= set(rows.tolist())
            assert (b.scores(v[i], lengths[i], rows) == scores[rows]).all()
            seen += len(rows) if least == int(np.sort(scores)[-20]) else 0
    assert seen < 0.3 * 30 * 3000


def test_few_rows_and_too_long_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    asks = F.col("vec_id") % 50 == 0
    one = spark.createDataFrame([(0, [1.0], 1)], schema)
    assert H.hard_negatives(one, asks).count() == 0
    assert H.hard_negatives(one.limit(0), asks).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        H.hard_negatives(spark.createDataFrame([(0, [1e30], 1), (1, [1.0], 1)], schema), asks).count()
