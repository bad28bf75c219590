import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rainshed.llm import token_files as T

P = T.Params()
TOKENIZER = T._tokenizer(P.tokenizer)
BITS = ["a", "word", " ", "  ", "\n", "\t", ",", ".", "'s", "it's", "é", "ß", "1", "12a", "|", "$$$", "漢", " ", "\u3000", "\xa0", "\x1c", "<|endoftext|>", "!", "??", "ñandú", "\r\n", "🙂", "²", "_", " foo,", "\nBaz", " le", "e\u0301"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=20).map("".join) | st.text(max_size=30))
def test_pieces_give_the_ids_of_the_whole_text(text):
    encoder = T.encoder(P.tokenizer, 50)
    got = np.frombuffer(encoder.text(text), dtype="<u4").tolist()
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=40), max_size=12), st.integers(2, 5))
def test_grammar_round_trip(documents, least):
    data = [np.array([*d, 2], dtype="<u4").tobytes() for d in documents]
    shard = T.Shard(T.packed(list(range(len(data))), data, 6, T.Params(least=least)))
    assert shard.tokens().tobytes() == b"".join(data)
    for i, d in enumerate(data):
        assert shard.document(i).tobytes() == d
    n = int(shard.starts[-1])
    for a, b in ((0, n), (1, n - 1), (n // 3, n // 2), (n, n + 5)):
        assert shard.span(a, b).tolist() == shard.tokens()[a:b].tolist()


def test_grammar_compresses_and_splits_overlaps():
    rules, seq = T.grammar(np.array([7] * 9 + [2] + [7, 8] * 50), 10, 2, 2)
    assert len(seq) < 20 and len(rules) > 2
    assert T.grammar(np.array([1, 3, 1, 3]), 70_000, 2, 2)[0].tolist() == [[1, 3]]


def test_no_pair_with_the_least_count_is_left():
    rng = np.random.default_rng(1)
    passage = rng.integers(3, 40_000, 70)
    tokens = np.concatenate([np.r_[rng.integers(3, 400, 50), passage, 2] for _ in range(300)] + [np.full(5000, 9)])
    for first, least in ((50_257, 12), (65_500, 12), (70_000, 3)):
        rules, seq = T.grammar(tokens, first, 2, least)
        pairs = np.column_stack([seq[:-1], seq[1:]])
        pairs = pairs[(pairs != 2).all(axis=1)]
        # runs of one symbol overlap themselves; they are the only ones that may count more
        _, counts = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0, return_counts=True)
        assert counts.max() < least
        assert T.expansion_lengths(rules, first).max() >= 70


def test_files_of_odd_rows(spark, odd, odd_rows, empty):
    out = T.encoded(odd, T.Params(shard=500)).collect()
    ids = {}
    for i, text, *_ in odd_rows:
        ids.setdefault(i, []).append(np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4"))
    rows = sorted(out, key=lambda r: r.start)
    keys = [(-1 if r.doc_id is None else r.doc_id) for r in rows]
    assert keys == sorted(keys) and len(rows) == len(odd_rows)
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(ids[r.doc_id][0]))
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][0].tobytes())
        at += r.n_tokens
    assert T.encoded(empty).count() == 0


def test_forgetting_changes_nothing():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(500)]
    encoder = T.Encoder(P.tokenizer, 20)
    for _ in range(20):
        text = " ".join(rng.choice(words) + rng.choice(["", ",", ".\nX"]) for _ in range(60))
        assert np.frombuffer(encoder.text(text), dtype="<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
