import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken

from rainshed.llm import byte_bpe as B
from rainshed.llm import queries

PARAMS = B.Params()


@pytest.fixture(scope="module")
def ranks():
    with open(PARAMS.vocabulary, "rb") as file:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("plain", pat_str=PARAMS.pattern, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


def test_perfect_hash_is_minimal_and_agrees_with_itself():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    h = B.PerfectHash(keys)
    slots = h.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    other = np.random.default_rng(2).integers(0, 1 << 63, 500).astype(np.uint64)
    for k in (keys[:500], other):
        assert h.slots(k).tolist() == [h.slot(int(x)) for x in k]
    assert B.PerfectHash(keys[:0]).slots(other).tolist() == [-1] * 500
    with pytest.raises(ValueError):
        B.PerfectHash(np.array([7, 7], dtype=np.uint64))


def test_every_code_point_and_random_pieces_as_the_library(plain):
    rng = random.Random(3)
    texts = [f"the{c}the 12{c}12 !!{c}!! {c}{c} x" for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000)])]
    texts += ["".join(rng.choice("abcde \n.é漢1") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(rng.choice("etaoins") for _ in range(30000)), "a" * 20001, " " * 999, "<|endoftext|>"]
    small = B.Params(remembered=50, batch=100)
    for params, some in ((PARAMS, texts), (small, texts[-3500:])):
        got = [ids(x) for x in B.Encoder(B.read_vocabulary(params.vocabulary), params).encode(some)]
        assert got == plain.encode_ordinary_batch(some, num_threads=1)


def test_vocabulary_must_be_whole(ranks):
    with pytest.raises(ValueError):
        B.Vocabulary({k: v for k, v in ranks.items() if k != b"a"})


def digest(data):
    return hashlib.sha256(data).hexdigest()


def expected(rows, plain):
    out = []
    for doc_id, text in rows:
        i = plain.encode_ordinary(text or "")
        out.append((doc_id, len(i), digest(np.array(i, dtype="<u4").tobytes()), digest((text or "").encode())))
    return sorted(out, key=str)


def test_query_equals_the_library(spark, plain):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_byte_bpe(spark, sf).collect()), key=str) == expected(rows, plain)


def test_odd_and_no_rows(spark, odd, odd_rows, empty, plain):
    coded = B.decode(B.encode(odd)).collect()
    got = sorted(((r.doc_id, r.n_tokens, digest(bytes(r.ids)), digest(bytes(r.bytes))) for r in coded), key=str)
    assert got == expected([(r[0], r[1]) for r in odd_rows], plain)
    assert B.decode(B.encode(empty)).count() == 0
