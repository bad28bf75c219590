import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainshed.llm import collocations as C
from rainshed.llm.automata import Automaton, union


def brute(rows, p):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, p.longest + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= p.least}
    gone = set()
    for (lang, w), a in cand.items():
        for m in range(2, len(w)):
            gone |= {(lang, w[i : i + m]) for i in range(len(w) - m + 1) if 100 * a >= p.inside * cand[lang, w[i : i + m]]}
    out = []
    for lang in {k[0] for k in cand}:
        kept = []
        for (g, w), a in cand.items():
            if g == lang and (g, w) not in gone:
                score, _, l, r = min((p.scale * a // (f[g, w[:k]] + f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]]) for k in range(1, len(w)))
                kept.append((-score, -a, " ".join(w).encode(), l, r))
        out += [(lang, i + 1, w.decode(), -a, l, r, n[lang], -s) for i, (s, a, w, l, r) in enumerate(sorted(kept)[: p.top])]
    return sorted(out)


def random_rows(n, langs):
    rng = random.Random(8)
    words = ["a", "B", "c", "dd", "é", "x\x01y", "zz", "'", "漢"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " ! "]
    return [(rng.choice(langs), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(40)))) for _ in range(n)]


@pytest.mark.parametrize("params", [C.Params(least=5), C.Params(least=9, longest=3, top=7, inside=40, shard=60, range=50, fan=3)])
def test_equals_counting_outright(spark, params):
    rows = random_rows(300, ["en", "en", "fr", None, "und"])
    d = spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumns({"n": F.lit(1), "phrase": F.lit("x"), "shard": F.lit(2)})
    assert sorted(map(tuple, C.collocations(d, params).collect())) == brute(rows, params)


def test_unions_in_many_rounds_are_whole(spark):
    params = C.Params(least=3, shard=20, range=10, fan=2)
    rows = random_rows(60, ["en"])
    table = C.shards(spark.createDataFrame(rows, "lang string, text string").repartition(4), params).cache()
    points, most = C.cut_points(table, params)
    assert most > 16 and len(points["en"]) > 16
    assert sorted(map(tuple, C.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(4), params).collect())) == brute(rows, params)
    table.unpersist()


def test_odd_rows(spark, odd, odd_rows, empty):
    params = C.Params(least=2)
    got = sorted(map(tuple, C.collocations(odd, params).collect()))
    assert got == brute([(r[2], r[1]) for r in odd_rows], params)
    assert C.collocations(empty).count() == 0
    assert C.collocations(odd.where("text IS NULL")).count() == 0


def test_a_longer_phrase_takes_the_place_and_ties_go_to_the_first_cut(spark):
    rows = [("en", "left right")] * 40 + [("en", "one two three")] * 30
    got = {r.phrase: r for r in C.collocations(spark.createDataFrame(rows, "lang string, text string")).collect()}
    assert set(got) == {"left right", "one two three"}
    assert (got["one two three"].l, got["one two three"].r, got["one two three"].score, got["left right"].n) == (30, 30, 1_000_000, 170)


def items(a, n):
    rows, weights = a.rows(n)
    return [(tuple(a.labels[x] for x in r), w) for r, w in zip(rows.tolist(), weights.tolist())]


def automaton(counts):
    labels = sorted({w for k in counts for w in k})
    keys = sorted(counts)
    rows = np.array([[labels.index(w) for w in k] for k in keys], dtype=np.int64).reshape(len(keys), -1)
    return Automaton.build(labels, rows, np.array([counts[k] for k in keys], dtype=np.int64))


def test_automata_share_suffixes_unite_and_compose():
    rng = random.Random(2)
    words = [b"a", b"bb", b"c", "é".encode(), b"zz"]
    tables = [Counter(tuple(rng.choice(words) for _ in range(3)) for _ in range(60)) for _ in range(4)]
    autos = [Automaton.loads(automaton(t).dumps()) for t in tables]
    for a, t in zip(autos, tables):
        assert items(a, 3) == sorted(t.items())
    both, live = union(autos, 3, 4)
    total = sum(tables, Counter())
    assert items(both, 3) == sorted((k, v) for k, v in total.items() if v >= 4)
    asked = autos[0].compose(both, 3).tolist()
    assert asked == [total[k] if total[k] >= 4 else 0 for k in sorted(tables[0])]
    same = automaton({(w, b"x", b"y"): 7 for w in words})
    assert len(same.weight) == 4  # one chain for all
    assert [x.tolist() for x in live] == [[total[k] >= 4 for k in sorted(t)] for t in tables]
    none, _ = union([], 2)
    assert items(none, 2) == [] and items(Automaton.loads(none.dumps()), 2) == []
    assert autos[0].compose(none, 3).tolist() == [0] * len(tables[0])
