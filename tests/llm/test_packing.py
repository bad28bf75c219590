import numpy as np
import pytest

from rainshed.llm import packing as P


@pytest.mark.parametrize("values", [[], [0], [5, -3, 0, 1 << 40, -(1 << 62), (1 << 62)], list(range(-300, 70_000, 7))])
def test_integers_come_back(values):
    x = np.array(values, dtype=np.int64)
    assert P.unpack(P.pack(x)).tolist() == values
    assert P.unpack(P.pack(x.astype(np.int32))).tolist() == x.astype(np.int32).tolist()


@pytest.mark.parametrize("n, size", [(0, 1), (1, 1), (1000, 5), (50_000, 30_000)])
def test_ranked_numbers_come_back_and_are_small(n, size):
    x = (size * np.random.default_rng(n).random(n) ** 6).astype(np.int64)
    x = np.random.default_rng(1).permutation(size)[x]
    data = P.pack_ranked(x)
    assert P.unpack_ranked(data).tolist() == x.tolist()
    if n > 10_000:
        assert len(data) < len(P.pack(x))
