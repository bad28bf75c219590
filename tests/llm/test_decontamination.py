import random

from pyspark.sql import functions as F

from rainshed.llm import decontamination as D


def grams(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items, least=0.8):
    out = []
    for i, text in docs:
        for j, item in {x for x in items}:
            n = min(len((item or "").split()), 5)
            g = grams(item, n) if n else set()
            if g and len(g & grams(text, n)) >= least * len(g) - 1e-9:
                out.append((i, j, len(g & grams(text, n)), len(g)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    items = [(j, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 8, 14, 30, 59])))) for j in range(40)]
    items += [(100, items[3][1]), (3, items[3][1]), (101, None), (102, " "), (None, "w1 w2 w3 w4 w5 w6")]
    docs = []
    for i in range(120):
        w = rng.choices(words, k=rng.choice([0, 4, 50, 400]))
        for _ in range(rng.choice([0, 1, 2])):
            part = rng.choice(items)[1] or ""
            part = part.split()
            for k in range(len(part)):
                if rng.random() < 0.02:
                    part[k] = "other"
            at = rng.randint(0, len(w))
            w[at:at] = part
        docs.append((i, " ".join(w).upper() if i % 5 == 0 else "\n".join(w)))
    docs += [(7, docs[7][1]), (None, items[0][1]), (200, None), (201, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("h", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = brute(docs, items)
    for params in (D.Params(), D.Params(block_bytes=300)):
        got = [(r.doc_id, r.item_id, r.shared, r.shingles) for r in D.contained(d, b, params).collect()]
        assert sorted(got, key=str) == want
        dirty = {i for i, *_ in want}
        kept = D.clean(d, b, params)
        assert kept.columns == d.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in dirty)


def test_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contained(odd, none).count() == 0 and D.clean(odd, none).count() == odd.count()
    some = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert D.contained(empty, some).count() == 0
    assert sorted(r.doc_id for r in D.contained(odd, some).collect()) == [3, 3]
