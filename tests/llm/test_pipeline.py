import corpus_pipeline as C
from rainshed.llm.common import read, word_list
from rainshed.llm.decontamination import Index, Params, blocks
from rainshed.llm.near_copies import shingles

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = read(spark, SF, "documents")
    seen = [docs]
    for name, stage in C.STAGES:
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    rows = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in seen[:-1]]
    assert all(d.columns == docs.columns for d in seen[:-1])
    # quality: documents labelled good stay
    good = {r.doc_id for r in read(spark, SF, "labels").where("quality = 1").collect()}
    assert len(good & rows[1].keys()) >= 0.98 * len(good & rows[0].keys())
    # near duplicates: of all pairs of five-word similarity 0.8 at least 9 in 10 lost one, and whatever went had such a partner
    sets = {i: shingles(word_list(t), 5) for i, t in rows[1].items()}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    kept = rows[2].keys()
    assert len(near) > 5 and sum(a not in kept or b not in kept for a, b in near) >= 0.9 * len(near)
    partners = {x for p in near for x in p}
    assert rows[1].keys() - kept <= partners
    assert all(a in kept or b in kept or any(a in p or b in p for p in near if kept & set(p)) for a, b in near)
    # decontamination: exactly the documents that contain an item went
    index = [Index(b, Params()) for b in blocks(read(spark, SF, "benchmark"), Params())]
    dirty = {i for i, t in rows[2].items() if any(x.hits(t) for x in index)}
    assert rows[3].keys() == rows[2].keys() - dirty
    # mixing: at most three passes, only documents of the input
    copies = seen[4].groupBy("doc_id").count().collect()
    assert all(r["count"] <= 3 and word_list(rows[3][r.doc_id]) for r in copies)
    # token files: a row for each row of the mix, starts without gaps
    out = sorted(seen[5].collect(), key=lambda r: r.start)
    assert len(out) == seen[4].count()
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens


def test_run_gives_the_last_stage(spark):
    out = C.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
