import random
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from rainshed.llm import common
from rainshed.llm import simhash as S
from rainshed.llm.common import components


def by_hand(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest_reachable(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_equal_all_pairs_within_the_radius(spark):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    values = set(seeds) | {0, 1, (1 << 64) - 1, (1 << 64) - 16}
    for s in seeds:  # near ones, up to six bits away
        for _ in range(8):
            x = s
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            values.add(x)
    d = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    got = sorted(tuple(r) for r in S.links(d).collect())
    want = sorted(tuple(sorted((signed(a), signed(b)))) for a, b in combinations(values, 2) if (a ^ b).bit_count() <= 4)
    assert got == want
    thin = [tuple(r) for r in S.thinned(S.links(d)).collect()]
    assert len(thin) < len(want)
    nodes = {x for p in want for x in p}
    assert smallest_reachable(nodes, thin) == smallest_reachable(nodes, want)


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 201), (201, 202), (202, 200)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = smallest_reachable({x for p in links for x in p}, links)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, odd_rows, empty):
    rows = S.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows)
    prints = sorted((r.doc_id or 0, r.fingerprint) for r in rows)
    assert prints == sorted((i or 0, f"{by_hand(t):016x}") for i, t, *_ in odd_rows)
    values = {by_hand(t) for _, t, *_ in odd_rows}
    reach = smallest_reachable(values, [(a, b) for a, b in combinations(values, 2) if (a ^ b).bit_count() <= 4])
    first = {}
    for i, t, *_ in odd_rows:
        if i is not None:
            k = reach[by_hand(t)]
            first[k] = min(first.get(k, i), i)
    assert {(r.fingerprint, r.component_id) for r in rows} == {(f"{by_hand(t):016x}", first.get(reach[by_hand(t)])) for _, t, *_ in odd_rows}
    assert S.near_duplicates(empty).count() == 0


def test_fingerprints_of_many_shingles_are_counted_in_parts():
    words = [f"w{i}" for i in range(40_000)]
    assert np.uint64(S.fingerprint_of(" ".join(words), 4) & (1 << 64) - 1) == np.uint64(by_hand(" ".join(words)))


def test_the_rows_of_the_grid_are_not_broadcast(spark):
    """Spark sizes them as if there were one for each fingerprint, not one for each choice of groups."""
    d = spark.range(200).select(F.xxhash64(F.col("id") % 150).alias("fp")).distinct()
    found = S.links(d, S.Params(radius=24, groups=25))
    got = [tuple(r) for r in found.collect()]
    fps = sorted(r.fp for r in d.collect())
    assert sorted(got) == [(a, b) for a, b in combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 24]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_components_of_many_links_are_merged(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_BROADCAST", 10)
    links = spark.range(50).where("id % 10 < 8").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = spark.range(50).select(F.col("id").alias("node")).join(components(links), "node", "left")
    assert {r.node: r.component for r in found.collect()} == {i: i // 10 * 10 if i % 10 < 9 else None for i in range(50)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
