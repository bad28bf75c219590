from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainshed.llm import language_model as M
from rainshed.llm.common import read
from rainshed.llm.elias_fano import Codebook, EliasFano


@pytest.mark.parametrize("n, universe", [(0, 5), (1, 1), (5, 10), (1000, 5000), (1000, 10**9), (300, 301)])
def test_elias_fano_against_plain_arrays(n, universe):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, universe, n))
    e = EliasFano(*EliasFano.encode(v, universe + 50))
    assert (e.access(np.arange(n)) == v).all()
    if n:
        x, b = rng.integers(0, universe + 40, 300), rng.integers(0, n, 300)
        end = np.minimum(n, b + rng.integers(0, 50, 300))
        want = [next((i for i in range(p, q) if v[i] >= z), q) for z, p, q in zip(x, b, end)]
        assert e.successor(x, b, end).tolist() == want


def test_codebook_is_near():
    x = np.random.default_rng(0).normal(size=5000)
    book, codes = Codebook.encode(x)
    assert len(book) <= 256 and np.abs(book[codes] - x).max() < 0.6 and np.abs(book[codes] - x).mean() < 0.02


def plain_scores(training, texts, least, discount):
    """The same model from dictionaries, not quantised."""
    seqs = [M.tokens(t) for t in training]
    one, two, three = Counter(), Counter(), Counter()
    for s in seqs:
        one.update(s)
        two.update(zip(s, s[1:]))
        three.update(zip(s, s[1:], s[2:]))
    n, v = sum(one.values()), len(one)
    two = {k: c for k, c in two.items() if c >= least}
    three = {k: c for k, c in three.items() if c >= least}
    p1 = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))

    def p2(u, w):
        if (u, w) in two:
            return (two[u, w] - discount) / one[u]
        kept = [(c, b) for (a, b), c in two.items() if a == u]
        left, rest = 1 - sum((c - discount) / one[u] for c, _ in kept), 1 - sum(p1(b) for _, b in kept)
        return left / rest * p1(w)

    def p3(t, u, w):
        if (t, u, w) in three:
            return (three[t, u, w] - discount) / two[t, u]
        kept = [(c, b) for (a, x, b), c in three.items() if (a, x) == (t, u)]
        if (t, u) not in two:
            return p2(u, w)
        left, rest = 1 - sum((c - discount) / two[t, u] for c, _ in kept), 1 - sum(p2(u, b) for _, b in kept)
        return left / rest * p2(u, w)

    out = []
    for t in texts:
        s = M.tokens(t)
        base = sum(log10(p1(w)) for w in s)
        lm = sum(log10(p1(w) if i == 0 else p2(s[0], w) if i == 1 else p3(s[i - 2], s[i - 1], w)) for i, w in enumerate(s))
        out.append((len(s), sum(one[w] > 0 for w in s), base, lm))
    return out, n


def check(spark, texts, train, params):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = M.scored(docs, F.col("doc_id") < train, params)
    want, n = plain_scores(texts[:train], texts, params.least, params.discount)
    rows = {r.doc_id: r for r in found.documents.collect()}
    assert found.total == n and len(rows) == len(texts)
    for i, (tokens, known, base, lm) in enumerate(want):
        r = rows[i]
        assert (r.train, r.n_tokens, r.n_known) == (i < train, tokens, known)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.score == pytest.approx(lm, abs=0.02 * tokens + 0.02)
    return rows, found


@pytest.mark.parametrize("params", [M.Params(), M.Params(least=3, shard=40, range=30), M.Params(discount=0.3, shard=300, range=700)])
def test_scores_equal_the_plain_model(spark, params):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    chain = rng.dirichlet(np.full(30, 0.2), size=30)
    texts = []
    for _ in range(150):
        w, s = 0, []
        for _ in range(rng.integers(0, 40)):
            w = rng.choice(30, p=chain[w])
            s.append(words[w])
        texts.append(" ".join(s))
    texts += ["unseen words only", None, "", "W1 w2 unseen w3"]
    rows, found = check(spark, texts, 120, params)
    assert sum(r.score - r.base_score for i, r in rows.items() if i >= 120) > 0
    tries = [M.Trie.loads(r.trie) for r in found.triples.collect()]
    assert (len(tries) > 5) == (params.range < 100)
    contexts = [tuple(t.labels[c]) for t in tries for c in t.contexts]
    assert len(contexts) == len(set(contexts))  # all n-grams of a context are in one range
    assert all(len(t.codes) == len(t.kept) and t.kept.min(initial=9) >= params.least for t in tries)


def test_every_pair_and_triple_of_two_occurrences_counts(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"c{x}" for x in rng.integers(0, 5, 30)) for _ in range(60)]
    texts += ["a rare line of words", "a rare line of words again", "line of others", "A rare line of words", None]
    check(spark, texts, 63, M.Params(shard=100, range=100))
    assert M.Params().least == 2


def test_values_are_quantised_to_a_byte(spark):
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 11} c{i % 5}") for i in range(200)], "doc_id long, text string")
    trie = M.Trie.loads(M.scored(docs, F.lit(True)).pairs.first().trie)
    assert trie.codes.dtype == np.uint8 and trie.weights.dtype == np.uint8 and len(trie.book) <= 256
    names = [" ", *sorted({w for i in range(200) for w in f"a{i % 7} b{i % 11} c{i % 5}".split()})]  # words are numbered in byte order
    label = [names[x] for x in trie.labels.tolist()]
    node = [label[c] for c in trie.contexts[:, 0].tolist()].index("a3")
    child = np.array([label.index(x) for x in ("b1", "a3")])
    assert (trie.level.find(np.array([node, node]), child) >= 0).tolist() == [True, False]


def test_odd_rows_and_empty_tables(spark, odd, odd_rows, empty):
    out = M.held_out_scores(odd, params=M.Params(shard=50)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == sorted((i or 0, len((t or "").encode().split()) + 1) for i, t, *_ in odd_rows)
    assert all(r.score <= 0 and r.base_score < 0 for r in out)
    assert M.held_out_scores(empty).count() == 0
    none = M.scored(odd, F.lit(False))
    assert none.total == 0 and none.documents.count() == len(odd_rows)


def test_repeated_text_scores_better_than_words_alone(spark):
    out = M.held_out_scores(read(spark, "/root/testdata/sf0.001", "documents")).agg({"score": "sum", "base_score": "sum"}).first()
    assert out["sum(score)"] > out["sum(base_score)"]
