import random
from collections import Counter

from pyspark.sql import functions as F

from rainshed.llm import mixing as M


def water(sizes, weights, most):
    """Targets by repeated sharing."""
    total = sum(sizes)
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free and total - sum(out) > 1e-9:
        rest, w = total - sum(out[i] for i in range(len(sizes)) if i not in free), sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / w >= most * sizes[i]]
        for i in free:
            out[i] = rest * weights[i] / w
        for i in over:
            out[i] = most * sizes[i]
            free.discard(i)
        if not over:
            break
    return out


def test_targets_equal_repeated_sharing(spark):
    rng = random.Random(9)
    for n in (1, 2, 7, 12):
        sizes = [rng.choice([0, 3, 50, 1000, 90_000]) + rng.randint(0, 9) for _ in range(n)]
        rows = [(None if i == n - 1 else f"s{i:02d}", s) for i, s in enumerate(sizes)]
        got = {r.source: r.target for r in M.targets(spark.createDataFrame(rows, "source string, source_size long"), M.Params()).collect()}
        want = water(sizes, [(5, 2, 1)[i % 3] for i in range(n)], 3)
        for (s, _), w in zip(rows, want):
            assert abs(got[s] - w) < 1e-3


def test_mix_meets_its_targets_and_spreads_its_sources(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(["w"] * rng.randint(0, 90)), "hot" if i % 3 == 0 else rng.choice(["a", "b", None])) for i in range(900)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("sid", F.lit("x"))
    p = M.Params(block=16)
    m = M.mix(d, p)
    rows = m.documents.collect()
    assert len(rows) == len(docs) and {r.doc_id: r.size for r in rows} == {i: len(t.split()) for i, t, _ in docs}
    source = {i: s for i, _, s in docs}
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    for s in target:
        assert abs(taken[s] - target[s]) <= 1
    slots = m.schedule.orderBy("slot", "sid").collect()
    assert sum(r.words for r in slots) == sum(taken.values())
    # low discrepancy: in each window of slots every source has nearly its share
    share = Counter(r.sid for r in slots)
    for a in range(0, len(slots) - 200, 100):
        here = Counter(r.sid for r in slots[a : a + 200])
        assert all(abs(here[s] - 200 * n / len(slots)) <= 6 for s, n in share.items())
    for sid in share:  # consecutive ranks, each pass over all blocks before the next
        own = [r for r in slots if r.sid == sid]
        assert [r.rank for r in own] == list(range(len(own)))
    again = M.mix(d.repartition(5), p).documents.collect()
    assert sorted(again) == sorted(rows)


def test_odd_rows(odd, odd_rows, empty):
    rows = M.mix(odd).documents.collect()
    assert sorted((r.doc_id or 0, r.size) for r in rows) == sorted((i or 0, len((t or "").encode().split())) for i, t, *_ in odd_rows)
    out = M.mixed(odd)
    assert out.columns == odd.columns
    want = Counter()
    for r in rows:
        if r.taken:
            want[r.doc_id] += -(-r.taken // r.size)
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == want
    assert M.mix(empty).documents.count() == 0 and M.mixed(empty).count() == 0
