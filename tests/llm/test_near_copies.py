import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainshed.llm import near_copies as N
from rainshed.llm.common import word_list
from rainshed.llm.simhash import shingle_hashes


def similarity(a, b, n=5):
    x, y = (N.shingles(word_list(t), n) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_odd_rows_keep_one_of_each_group(odd, empty):
    out = N.deduplicated(odd)
    assert out.columns == odd.columns
    kept = out.select("doc_id").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 3, 4, 5, 8, 9, 10]
    assert len(kept) == 8  # and the row without an id
    assert N.deduplicated(empty).count() == 0


def copies(rng, words, text, share):
    w = text.split()
    for i in rng.sample(range(len(w)), max(1, int(share * len(w)))):
        w[i] = rng.choice(words)
    return " ".join(w)


def test_planted_near_copies_go_and_nothing_else_does(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(5000)]
    rows, planted = [], []
    for i in range(150):
        text = " ".join(rng.choices(words, k=rng.randrange(60, 400)))
        rows.append((10 * i, text, "s"))
        for j in range(1, 4):
            rows.append((10 * i + j, copies(rng, words, text, rng.choice([0.005, 0.01, 0.02])), "s"))
    texts = {i: t for i, t, _ in rows}
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    kept = {r.doc_id for r in N.deduplicated(d).select("doc_id").collect()}
    planted = [(i, i - i % 10) for i in texts if i % 10 and similarity(texts[i], texts[i - i % 10]) >= 0.8]
    assert len(planted) > 300
    assert sum(i not in kept for i, _ in planted) >= 0.98 * len(planted)
    for i in texts.keys() - kept:  # whatever went is similar to another document of its group, and one of these stays
        group = [j for j in texts if j // 10 == i // 10 and j != i]
        assert any(similarity(texts[i], texts[j]) >= 0.8 for j in group) and any(j in kept for j in group)


def test_a_band_of_unlike_texts_is_taken_apart(spark):
    """One band of one value: texts that share a value without being similar must all meet those that are."""
    params = N.Params(bands=1, rows=1)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(6)]
    rows = [(6 * k + i, base[i] + (" tail" if k else ""), "s") for k in range(2) for i in range(6)]
    least = {i: shingle_hashes(word_list(t), 5) for i, t, _ in rows}
    assert all(len(v) > 50 for v in least.values())
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    nodes = spark.createDataFrame([(i, i, [7]) for i, _, _ in rows], "node long, fp long, bands array<long>")
    links = N.linked(nodes, d.selectExpr("doc_id AS node", "text"), params).collect()
    assert {(r.a, r.b) for r in links} == {(i, i + 6) for i in range(6)}


def links_in_one_band(spark, texts):
    """Links between texts that all share the first band; and the pairs that were verified."""
    asked = []

    def counted(pairs, of, params, verified=N.verified):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return verified(pairs, of, params)

    nodes = spark.createDataFrame([(i, 1 << 62 | i * 0x123456789ABC, [7]) for i in range(len(texts))], "node long, fp long, bands array<long>")
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(N, "verified", counted)
        return {(r.a, r.b) for r in N.linked(nodes, rows, N.Params()).collect()}, asked


def test_pairs_of_a_large_group_grow_with_its_size(spark):
    """Every text differs from all others, each in its own words, by more than the least similarity allows."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base = rng.choices(words, k=200)
    texts = []
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(200), 6):
            w[k] = f"own{i}x{k}"
        texts.append(" ".join(w))
    texts.append(texts[100] + " tail")
    pairs, asked = links_in_one_band(spark, texts)
    assert (100, 120) in pairs
    assert all(similarity(texts[a], texts[b]) >= 0.8 for a, b in pairs)
    assert len(asked) < 8 * len(texts)


def test_shingles_are_hashed_once_and_in_bounded_batches(spark, monkeypatch):
    """By one Python worker of a task: two, each with its batches, took an executor beyond its memory."""
    plans, real = {}, N.written

    def recorded(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(N, "written", recorded)
    texts = spark.createDataFrame([(i, f"a b c d e f g h {i}") for i in range(4)] + [(9, "")], "node long, text string")
    nodes = spark.createDataFrame([(i, i) for i in (0, 1, 2, 3, 9)], "node long, component long")
    found = {tuple(sorted((r.a, r.b))) for r in N.alike(nodes, texts, N.Params(least=0.5)).collect()}
    assert found == {(a, b) for a in range(4) for b in range(a + 1, 4)}
    assert plans["grams"].count("ArrowEvalPython") == 1
    N.deduplicated(spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")).count()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == N.Params().batch


def test_the_links_of_a_band_are_those_of_all_its_pairs(spark):
    """Chains: a text may be similar to one that has found its own link already, whatever their sizes and order."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(6):
        w = rng.choices(words, k=rng.randrange(30, 200))
        for _ in range(10):
            texts.append(" ".join(w))
            w = list(w)
            for k in rng.sample(range(len(w)), rng.randrange(0, 1 + len(w) // 25)):
                w[k] = rng.choice(words)
            w = w[rng.randrange(0, 3) :] + rng.choices(words, k=rng.randrange(0, 3))
    rng.shuffle(texts)
    pairs, _ = links_in_one_band(spark, texts)
    truth = {(a, b) for b in range(len(texts)) for a in range(b) if similarity(texts[a], texts[b]) >= 0.8}

    def groups(links):
        of = list(range(len(texts)))
        for a, b in list(links) * len(texts):
            of[a] = of[b] = min(of[a], of[b])
        return of

    assert pairs <= truth and groups(pairs) == groups(truth)
    assert len(set(groups(truth))) > 6  # and some of them are not linked


@pytest.mark.parametrize("n", [0, 1, 5, 5000])
def test_band_keys_are_those_of_plain_minima(n):
    hashes = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    keys = N.band_keys(hashes, N.Params())
    assert len(keys) == (20 if n else 0)
    flip, turn = N._turns(140)
    if n:
        plain = [min((int(h) ^ int(f)) * int(t) % (1 << 64) for h in hashes.tolist()) for f, t in zip(flip[:7, 0], turn[:7, 0])]
        assert N.xxhash.xxh64_intdigest(np.array(plain, dtype=np.uint64).tobytes(), 0) >> 1 == keys[0]


def test_the_rows_of_the_prefix_filter_are_not_broadcast(spark):
    """Spark sizes the larger texts' rows as if each were in one size class."""
    nodes = spark.range(40).select(F.col("id").alias("node"), (F.col("id") % 2).alias("component"))
    word = F.concat(F.lit("w"), F.col("i").cast("string"), F.lit("of"), F.expr("id div 4").cast("string"))
    last = F.when(F.col("i") < 39, word).otherwise(F.concat(F.lit("x"), F.col("id").cast("string")))
    texts = spark.range(40).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(39)))).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", last.alias("w")))).alias("w"))
    texts = texts.select(F.col("id").alias("node"), F.concat_ws(" ", F.col("w.w")).alias("text"))
    found = N.alike(nodes, texts, N.Params())
    assert {tuple(r) for r in found.collect()} == {(a, b) for a in range(40) for b in range(a + 1, 40) if a // 4 == b // 4 and (b - a) % 2}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
