"""Byte-level BPE by ranks: texts to ids and ids back to bytes.

Two tiers.  The text is cut by the vocabulary's pattern.  Whole pieces that are tokens are found first, all new pieces of
a batch at once, through a minimal perfect hash over the vocabulary: levels of bit arrays, where a key rests in the first
level whose bit it has alone, and its slot is the number of bits set before it.  A slot's token is compared with the piece,
so a foreign piece is never taken for a token.  What misses is merged from its bytes: neighbours in a linked list, a heap of
(rank, place), the lowest rank first, the leftmost of equal ones.  Ids of pieces are remembered up to a bound.

A vocabulary is a file of lines "base64 rank"; the driver reads it once and sends it along (1 MB for 50,000 tokens).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from struct import pack

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from rainshed.llm.common import bounded_batches

GOLDEN, LOW = 0x9E3779B97F4A7C15, (1 << 64) - 1


@dataclass(frozen=True)
class Params:
    vocabulary: str = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pattern: str = public_tokenizers.PATTERN
    remembered: int = 200_000  #: pieces of a generation, of which a worker keeps two, and joined pairs of tokens
    longest: int = 64  #: characters of a piece that is kept
    batch: int = 1 << 20  #: characters encoded at a time, or one text


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    z = keys + np.uint64((level + 1) * GOLDEN & LOW)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys to 0 .. n-1, one to one; any other key to some slot or to -1."""

    def __init__(self, keys: np.ndarray, space: float = 2.0):
        self.sizes: list[int] = []
        words, left, level = [], keys.astype(np.uint64), 0
        while len(left):
            if level == 64:
                raise ValueError("two keys are equal")
            size = -(-int(space * len(left)) // 64) * 64 or 64
            place = _mixed(left, level) % np.uint64(size)
            alone = np.bincount(place.astype(np.int64), minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[place.astype(np.int64)]]
            self.sizes.append(size)
            level += 1
        self.words = np.concatenate(words) if words else np.zeros(0, dtype="<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]
        self.plain, self.ranked = self.words.tolist(), self.before.tolist()

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        rest, offset = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            place = _mixed(keys[rest], level) % np.uint64(size)
            word, bit = offset + (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            there = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[rest[there]] = (self.before[word] + np.bitwise_count(below))[there]
            rest, offset = rest[~there], offset + size // 64
        return out


    def slot(self, key: int) -> int:
        """The same for one key, in plain integers."""
        offset = 0
        for level, size in enumerate(self.sizes):
            z = key + (level + 1) * GOLDEN & LOW
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & LOW
            z = (z ^ z >> 27) * 0x94D049BB133111EB & LOW
            place = (z ^ z >> 31) % size
            word, bit = offset + (place >> 6), place & 63
            bits = self.plain[word]
            if bits >> bit & 1:
                return self.ranked[word] + (bits & (1 << bit) - 1).bit_count()
            offset += size >> 6
        return -1


class Vocabulary:
    """Ranks of byte strings behind a perfect hash.  Every single byte must be a token; ranks are distinct."""

    def __init__(self, ranks: dict[bytes, int]):
        if len(set(ranks.values())) < len(ranks) or not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("ranks must be distinct and hold every single byte")
        tokens = list(ranks)
        keys = np.fromiter(map(xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
        self.hash = PerfectHash(keys)
        slots = self.hash.slots(keys)
        self.token = [b""] * len(tokens)
        self.rank = np.zeros(len(tokens), dtype=np.int64)
        for slot, token in zip(slots.tolist(), tokens):
            self.token[slot] = token
            self.rank[slot] = ranks[token]
        self.of_rank = dict(zip(self.rank.tolist(), self.token))
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.two = self.ranks([bytes([a, b]) for a in range(256) for b in range(256)])

    def ranks(self, strings: list[bytes]) -> list[int]:
        """The rank of each string, -1 of those that are no token."""
        keys = np.fromiter(map(xxh3_64_intdigest, strings), dtype=np.uint64, count=len(strings))
        slots = self.hash.slots(keys)
        token, ranks = self.token, self.rank[slots].tolist()
        return [r if s >= 0 and token[s] == x else -1 for s, r, x in zip(slots.tolist(), ranks, strings)]

    def rank_of(self, string: bytes) -> int:
        slot = self.hash.slot(xxh3_64_intdigest(string))
        return int(self.rank[slot]) if slot >= 0 and self.token[slot] == string else -1


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as file:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))})


@dataclass
class Encoder:
    vocabulary: Vocabulary
    params: Params = Params()
    known: dict[str, bytes] = field(default_factory=dict)  #: pieces to their ids as little-endian 32-bit bytes
    old: dict[str, bytes] = field(default_factory=dict)  #: the generation before
    pairs: dict[bytes, int] = field(default_factory=dict)  #: joined neighbours to their rank

    def __post_init__(self) -> None:
        self.cut = regex.compile(self.params.pattern)

    def _rank(self, joined: bytes) -> int:
        if len(self.pairs) >= self.params.remembered:
            self.pairs.clear()
        rank = self.pairs[joined] = self.vocabulary.rank_of(joined)
        return rank

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a piece that is no token itself."""
        n, known, two, push, pop = len(piece), self.pairs.get, self.vocabulary.two, heapq.heappush, heapq.heappop
        end = list(range(1, n + 1))  # of the part that begins here; 0: merged into the part before
        start = list(range(-1, n))  # of the part that ends at this place's left
        ids = [self.vocabulary.single[b] for b in piece]
        heap = [(r, a, a + 2) for a, pair in enumerate(zip(piece, piece[1:])) if (r := two[pair[0] << 8 | pair[1]]) >= 0]
        heapq.heapify(heap)
        while heap:
            rank, a, b = pop(heap)
            middle = end[a]
            if not middle or middle >= b or end[middle] != b:
                continue  # one of the two has been merged otherwise
            end[a], end[middle], ids[a] = b, 0, rank
            if b < n:
                start[b] = a
                to = end[b]
                joined = piece[a:to]
                if (r := known(joined)) is None:
                    r = self._rank(joined)
                if r >= 0:
                    push(heap, (r, a, to))
            if a:
                before = start[a]
                joined = piece[before:b]
                if (r := known(joined)) is None:
                    r = self._rank(joined)
                if r >= 0:
                    push(heap, (r, before, b))
        return [i for i, e in zip(ids, end) if e]

    def _learn(self, pieces: set[str]) -> None:
        """All of ``pieces`` into ``known``: from the older generation or anew."""
        old, known = self.old, self.known
        rest = []
        for piece in pieces:
            if (ids := old.get(piece)) is None:
                rest.append(piece)
            else:
                known[piece] = ids
        strings = [p.encode() for p in rest]
        for piece, string, rank in zip(rest, strings, self.vocabulary.ranks(strings)):
            ids = [rank] if rank >= 0 else self.merged(string)
            known[piece] = pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit bytes."""
        at, longest = 0, self.params.longest
        while at < len(texts):
            cut, size = [], 0
            while at < len(texts) and (not cut or size < self.params.batch):
                text = texts[at] or ""
                cut.append(self.cut.findall(text))
                size += len(text)
                at += 1
            if len(self.known) > self.params.remembered:
                self.old, self.known = self.known, {}
            new = set().union(*cut).difference(self.known)
            self._learn(new)
            ids = self.known.__getitem__
            for pieces in cut:
                yield b"".join(map(ids, pieces))
            for piece in new:
                if len(piece) > longest:
                    del self.known[piece]


_encoders: dict[Params, Encoder] = {}


def encode(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of every whole text, little-endian unsigned 32-bit integers in one binary value.

    Null and empty texts have no ids.  Every row gives one row: repeated rows are encoded each, null ids stay null.
    Strings of special tokens are ordinary text.  Other columns are not looked at, whatever their names.  A very long
    text is one batch, a very long piece is merged in n log n steps.
    """
    bounded_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(params.vocabulary))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if params not in _encoders:
            _encoders[params] = Encoder(vocabulary.value, params)
        for frame in frames:
            ids = list(_encoders[params].encode(frame["text"].tolist()))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_tokens": [len(i) // 4 for i in ids], "ids": ids})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decode(encoded: DataFrame, params: Params = Params()) -> DataFrame:
    """The given rows with ``bytes``: what their ``ids`` stand for.  An id that is no rank ends the job with a KeyError."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(params.vocabulary))

    def texts(ids: pd.Series) -> pd.Series:
        of_rank = vocabulary.value.of_rank
        return pd.Series([None if i is None else b"".join(map(of_rank.__getitem__, np.frombuffer(i, dtype="<u4").tolist())) for i in ids])

    return encoded.withColumn("bytes", F.pandas_udf(texts, "binary")("ids"))
