import math
import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from rainshed.llm import language, quality, toxicity
from rainshed.llm.common import fold, read
from rainshed.llm.queries import QUERIES


def held(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def test_fold_is_crc32_of_the_id(spark):
    d = spark.createDataFrame([(0,), (17,), (-5,), (None,)], "doc_id long").select("doc_id", fold(F.col("doc_id"), 5).alias("f"))
    assert {r.doc_id: r.f for r in d.collect()} == {0: held(0, 5), 17: held(17, 5), -5: held(-5, 5), None: 0}


@pytest.mark.parametrize("name, label, least", [("op3_toxicity", "toxic", 0.97), ("op4_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    out = QUERIES[name](spark, sf).join(read(spark, sf, "labels"), "doc_id").where("held_out").select("predicted", label).collect()
    assert len(out) > 50
    assert sum(p == y for p, y in out) / len(out) >= least


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op5_language"](spark, sf).join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) >= 0.96


def test_toxic_sentences_are_located_from_document_labels(spark):
    rng = random.Random(1)
    clean = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "magna", "aliqua", "enim"]
    bad = ["grumptious", "grumptiously", "grumptions", "slobwort"]
    texts, labels = [], []
    for i in range(400):
        s = [" ".join(rng.choices(clean, k=8)) for _ in range(5)]
        if i % 4 == 0:
            s[rng.randrange(5)] = " ".join([*rng.choices(clean, k=4), rng.choice(bad), *rng.choices(clean, k=3)])
        texts.append((i, ". ".join(s)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    probe = spark.createDataFrame([(1, "lorem ipsum. sit GRUMPTIOUSNESS amet! elit sed"), (2, "lorem ipsum dolor. sed magna")], "doc_id long, text string")
    got = {r.doc_id: r.toxicity for r in toxicity.score(probe, model).collect()}
    assert got[1].score > 0.5 > got[2].score
    text = "lorem ipsum. sit GRUMPTIOUSNESS amet! elit sed"
    assert [text[s.start : s.end] for s in got[1].spans] == [" sit GRUMPTIOUSNESS amet"]  # an unseen form, found by its beginning


def test_odd_rows_keep_every_row_and_column(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for d, n in ((odd, len(odd_rows)), (empty, 0)):
        q = quality.score(d, quality.fit(d, labels), "_q")
        t = toxicity.score(d, toxicity.fit(d, labels), "_t")
        lang = language.predict(d, language.fit(d), "_l")
        assert q.columns[:-1] == t.columns[:-1] == lang.columns[:-1] == d.columns
        assert all(0 <= r._q <= 1 for r in q.collect()) and q.count() == n
        assert all(0 <= r._t.score <= 1 for r in t.collect()) and t.count() == n
        found = lang.select("text", "_l").collect()
        assert len(found) == n
        for r in found:
            assert (r._l.lang == "und") == (not any(map(str.isalpha, r.text or "")))
            assert 0 <= r._l.score <= 1


def test_no_labels_and_one_class(spark, odd):
    for rows in ([], [(1, 1, 1), (5, 1, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        assert all(0 <= r.s <= 1 for r in quality.score(odd, quality.fit(odd, labels), "s").collect())
        assert all(0 <= r.s.score <= 1 for r in toxicity.score(odd, toxicity.fit(odd, labels), "s").collect())


def test_narrow_margins_are_not_accepted(spark):
    model = language.Model((("a", b"some words in one language here"), ("b", b"some words in one language here")), 5, 0.02)
    lang, score, accepted = language.classifier(model)("some words")
    assert (lang, score, accepted) == ("a", 0.0, False)


def test_every_text_of_the_language_sample_is_learned(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(3000)]
    texts = [(i, "xx", " ".join(words[5 * i : 5 * i + 5]) + " and so on" * 90) for i in range(500)]
    texts += [(1000 + i, "xx", "a copy of one text") for i in range(90)]
    docs = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    content = dict(language.fit(docs).dictionaries)["xx"]
    assert all(language.letters(t[:1024]) in content for _, _, t in texts)
    assert content.count(b"a copy of one text") == 1


def test_quality_learns_whole_texts_and_no_held_out_labels(spark):
    rng = random.Random(3)
    words = {k: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(40)] for k in (0, 1, 2)}
    say = lambda k, n: " ".join(rng.choices(words[k], k=n))
    rows = [(i, say(2, 1100) + " " + say(i % 2, 200), i % 2) for i in range(160)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    assert sum(w.encode() in model.good for w in words[1]) > 20 and not any(w.encode() in model.good for w in words[0])
    others = spark.createDataFrame([(i, y if held(i, 5) else 0) for i, _, y in rows], "doc_id long, quality int")
    assert quality.fit(docs, others).weights == model.weights


def test_words_late_in_a_text_teach_a_language(spark):
    rng = random.Random(6)
    words = {k: ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(60)] for k in ("both", "xx", "yy")}
    say = lambda k, n: " ".join(rng.choices(words[k], k=n))
    rows = [(i, lang, say("both", 300) + " " + say(lang, 100)) for i, lang in enumerate(["xx", "yy"] * 30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    of = language.classifier(model)
    for lang in ("xx", "yy"):
        assert [of(say(lang, 40))[0] for _ in range(5)] == [lang] * 5


def test_the_toxicity_fit_is_the_same_at_every_size(spark):
    rng = random.Random(7)
    clean, bad = [f"w{i}ord" for i in range(60)], ["grumptious", "slobwort"]
    say = lambda i: ". ".join(" ".join([*rng.choices(clean, k=7), rng.choice(bad) if i % 10 == 0 and s == 1 else "fine"]) for s in range(6))
    texts = [(i, say(i), int(i % 10 == 0)) for i in range(300)]
    more = [(1000 * k + i, t, y) for k in range(10) for i, t, y in texts]
    params = toxicity.Params(most_rows=250)  # binds for the clean class of the larger table only
    biases = []
    for rows in (texts, more):
        d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        biases.append(toxicity.fit(d.drop("toxic"), d.drop("text"), params).bias)
    assert abs(biases[0] - biases[1]) < 0.35


def plain_noisy_or(model, text):
    """Sentences, words and features as the module cuts them; one multiplication a sentence."""
    keep, any_ = 1.0, False
    for _, _, words in toxicity.sentences(text or "", model.longest):
        z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in toxicity.features(w))
        keep, any_ = keep * (1 - 1 / (1 + math.exp(-min(max(z, -30), 30)))), True
    return 1 - keep if any_ else model.empty


def test_scores_equal_plain_ones(spark, odd, odd_rows):
    texts = [r[1] for r in odd_rows]
    tox = toxicity.Model(-1.5, {f: 0.4 for w in ("alpha", "word", "text") for f in toxicity.features(w)}, toxicity.Params().longest, 0.25)
    got = sorted((r.text or "", r.s.score) for r in toxicity.score(odd, tox, "s").collect())
    assert [t for t, _ in got] == sorted(t or "" for t in texts)
    assert all(s == pytest.approx(plain_noisy_or(tox, t), abs=1e-9) for t, s in got)

    good, bad = b"alpha beta gamma delta omega " * 40, b"sigma kappa theta iota rho text word " * 40
    q = quality.Model(good, bad, 5, (0.1, 0.3), (0.2, 0.1), (0.5, -1.0, 0.7))

    def size(content, data):
        return len(zstandard.ZstdCompressor(level=5, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False).compress(data))

    for r in quality.score(odd, q, "s").collect():
        data = (r.text or "").encode()
        x, y = (size(good, data), size(bad, data)) if data else (0, 0)
        n = max(len(data), 1)
        z = 0.5 - 1.0 * ((x - y) / n - 0.1) / 0.2 + 0.7 * (min(x, y) / n - 0.3) / 0.1
        assert r.s == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)

    lang = language.Model((("aa", good), ("bb", bad), ("cc", good)), 5, 0.02)
    raw = lambda content, data: len(zstandard.ZstdCompressor(level=5, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False).compress(data))
    for r in language.predict(odd, lang, "s").collect():
        if not any(map(str.isalpha, r.text or "")):
            assert (r.s.lang, r.s.score, r.s.accepted) == ("und", 0.0, False)
            continue
        data = language.letters(r.text)
        sizes = [raw(c, data) for _, c in lang.dictionaries]
        best = min(sizes)
        rest = sorted(sizes)[1]
        assert r.s.lang == lang.dictionaries[sizes.index(best)][0]
        assert r.s.score == pytest.approx(1 - best / rest) and r.s.accepted == (rest >= best * 1.02)
