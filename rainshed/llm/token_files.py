"""Token-id files: documents in ascending id order, encoded by a public tokenizer, compressed by a grammar for each shard.

Encoding.  The text is cut before each single space or line feed between two words, where the tokenizer's own
pre-tokenizer always cuts, so that encoding the pieces one by one gives the ids of the whole text; the ids of a piece are
remembered.  Texts with other white space or with what could be a special token's string go to the tokenizer whole.

Grammar.  Re-Pair in rounds: all pairs of symbols with the least count or more, over the whole shard, become nonterminals
and are replaced from left to right, until no pair has it; pairs with the end id are left, so no rule crosses a document.  A shard stores its
rules, the length of each rule's expansion, its symbols and, for each document, its id and its lengths in symbols and in
tokens.  ``Shard.document`` and ``Shard.span`` decode a document or a range of tokens without the rest.

Files.  A shard is a row of a Parquet table in the shared folder: Spark commits it, and a lost task writes it again.
Shards are cut at ``Params.shard`` tokens, at the next end of a document.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rainshed.llm.common import bounded_batches
from rainshed.sources.integrity import scratch_dir

MAGIC = b"RPG1"
HEAD = struct.Struct("<4sIIIIQ")  # magic, documents, first nonterminal, rules, bit planes over 16 bits, symbols
#: a line feed, letters, then marks: the pre-tokenizer cuts between the three
CORE = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!|*$&%#]*)")


@dataclass(frozen=True)
class Params:
    tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")
    end: int = 2
    shard: int = 1 << 20
    least: int = 12  #: occurrences of a pair from which on it gets a rule
    remembered: int = 500_000


@lru_cache(maxsize=4)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder(dict):
    """Texts to their ids as little-endian 32-bit bytes; as a dict, pieces to theirs.

    A piece that begins with a line feed stands for itself, any other for itself after a space.  Two generations of
    pieces are remembered, ``most`` each.
    """

    def __init__(self, path: str, most: int):
        super().__init__()
        self.tokenizer, self.most, self.old = _tokenizer(path), most, {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.marks: dict[str, bytes] = {"": b""}
        self.feed = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Letters with at most a space before them are one unit of the pre-tokenizer: straight to the model."""
        if word.isascii():
            unit = word.replace(" ", self.letters[32])
        else:
            unit = word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(unit)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            return self._word(" " + piece)
        m = CORE.fullmatch(piece)
        if not m:
            return self._whole(piece if piece[:1] == "\n" else f" {piece}")
        feed, word, marks = m.groups()
        if marks:
            if marks not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks = {"": b""}
                self.marks[marks] = self._whole(marks)
            return self[feed + word] + self.marks[marks]
        return self.feed + self._word(word) if feed else self._word(f" {word}")

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self._piece(piece)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        flat = text.replace("\n", " ")
        if "  " in flat or flat[0] == " " or flat[-1] == " " or "<|" in text or not flat.isprintable():
            return self._whole(text)
        head, *pieces = text.replace("\n", " \n").split(" ")
        return self._whole(head) + b"".join(map(self.__getitem__, pieces))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return list(map(self.text, texts))


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most: int) -> Encoder:
    """One for each worker process, so that pieces are remembered from task to task."""
    if (path, most) not in _encoders:
        _encoders[path, most] = Encoder(path, most)
    return _encoders[path, most]


def grammar(tokens: np.ndarray, first: int, end: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(rules as rows (left, right), symbols).  Rule r is symbol ``first + r`` and refers to smaller symbols only.

    Rounds go on until no pair without the end id has ``least`` occurrences.  In a round all such pairs are replaced, from
    left to right; a rule that would be used less than twice because its places overlap others' waits.  Only pairs with a
    symbol of the round before can be new, so others are left out until no new one is found; a last round looks at all.
    """
    seq, rules, next_symbol, fresh = np.asarray(tokens, dtype=np.uint32), [], first, 0
    while len(seq) > 1:
        wide = next_symbol > 65_535
        half = np.uint64(32) if wide else np.uint32(16)
        kind, bits = (np.uint64, 17) if wide else (np.uint32, 17)
        turn, drop = (kind(0x9E3779B97F4A7C15), kind(64 - bits)) if wide else (kind(0x9E3779B1), kind(32 - bits))
        nothing = kind(np.iinfo(kind).max)
        inner = seq != end
        both = inner[:-1] & inner[1:]
        if fresh:
            new = seq >= fresh
            both &= new[:-1] | new[1:]
        there = np.flatnonzero(both)
        keys = (seq[there].astype(kind) << half) | seq[there + 1].astype(kind)
        ordered = np.sort(keys)
        heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.r_[heads, len(ordered)])
        often = np.flatnonzero(counts >= least)
        if not len(often):
            if not fresh:
                break
            fresh = 0
            continue
        best = ordered[heads[often[np.lexsort((ordered[heads[often]], -counts[often]))]]]
        for pairs in (best, best[:1]):
            slot = (pairs * turn) >> drop
            key_of = np.full(1 << bits, nothing, dtype=kind)
            key_of[slot[::-1]] = pairs[::-1]  # of pairs in one slot the most frequent stays
            pairs = pairs[key_of[slot] == pairs]
            rank_of = np.zeros(1 << bits, dtype=np.int32)
            rank_of[(pairs * turn) >> drop] = np.arange(len(pairs))
            place = (keys * turn) >> drop
            hit = np.flatnonzero(key_of[place] == keys)
            at = there[hit]
            index = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], index, 0))
            odd = ((index - run) & 1) == 0  # pairs that overlap: every other one
            at, rank = at[odd], rank_of[place[hit[odd]]]
            used = np.bincount(rank, minlength=len(pairs)) >= 2
            if used.any():
                break
        else:
            if not fresh:
                break
            fresh = 0
            continue
        at, rank = at[used[rank]], rank[used[rank]]
        seq = seq.copy()
        seq[at] = next_symbol + (np.cumsum(used) - 1)[rank]
        stay = np.ones(len(seq), dtype=bool)
        stay[at + 1] = False
        seq = seq[stay]
        rules.append(np.column_stack([pairs[used] >> half, pairs[used] & kind((1 << int(half)) - 1)]).astype(np.uint32))
        fresh, next_symbol = next_symbol, next_symbol + int(used.sum())
    return (np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32)), seq


def packed(ids: list[int | None], documents: list[bytes], first: int, params: Params) -> bytes:
    """A shard's bytes: header, null flags, ids, lengths in tokens and in symbols, rules, expansion lengths, symbols."""
    tokens = np.frombuffer(b"".join(documents), dtype="<u4")
    sizes = np.array([len(d) // 4 for d in documents], dtype="<u4")
    rules, seq = grammar(tokens, first, params.end, params.least)
    lengths = expansion_lengths(rules, first)
    spans = np.where(seq >= first, lengths[np.maximum(seq.astype(np.int64) - first, 0)] if len(rules) else 1, 1)
    ends = np.searchsorted(np.cumsum(spans), np.cumsum(sizes, dtype=np.int64)) + 1
    symbols = np.diff(np.r_[0, ends]).astype("<u4")
    high = int(seq.max(initial=0)) >> 16
    planes = high.bit_length()  # of one bit each, for what does not fit 16 bits
    null = np.array([i is None for i in ids], dtype=np.uint8)
    number = np.array([0 if i is None else i for i in ids], dtype="<i8")
    head = HEAD.pack(MAGIC, len(ids), first, len(rules), planes, len(seq))
    body = [null, number, sizes, symbols, rules.astype("<u4"), lengths.astype("<u4"), (seq & 0xFFFF).astype("<u2")]
    body += [np.packbits((seq >> np.uint32(16 + b)) & 1 == 1) for b in range(planes)]
    return head + b"".join(x.tobytes() for x in body)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    out = [0] * len(rules)
    for r, (a, b) in enumerate(rules.tolist()):
        out[r] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return np.array(out, dtype=np.int64)


class Shard:
    """A shard read back from its bytes."""

    def __init__(self, data: bytes):
        magic, n, self.first, rules, planes, symbols = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        null, number = take("u1", n), take("<i8", n)
        self.ids = [None if x else int(i) for x, i in zip(null, number)]
        self.sizes, self.symbol_sizes = take("<u4", n), take("<u4", n)
        self.rules, self.lengths, self.symbols = take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules), take("<u2", symbols)
        for b in range(planes):
            bit = np.unpackbits(take("u1", -(-symbols // 8)), count=symbols)
            self.symbols = self.symbols.astype(np.uint32) | bit.astype(np.uint32) << np.uint32(16 + b)
        self.starts = np.r_[0, np.cumsum(self.sizes, dtype=np.int64)]
        self.symbol_starts = np.r_[0, np.cumsum(self.symbol_sizes, dtype=np.int64)]
        # expansions of all rules one after another, then one place for every terminal
        self.offsets = np.r_[0, np.cumsum(self.lengths, dtype=np.int64)]
        flat: list[bytes] = []
        one = struct.Struct("<I").pack
        for a, b in self.rules.tolist():
            flat.append((flat[a - self.first] if a >= self.first else one(a)) + (flat[b - self.first] if b >= self.first else one(b)))
        self.flat = np.r_[np.frombuffer(b"".join(flat), dtype="<u4"), np.arange(self.first, dtype="<u4")]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        s = symbols.astype(np.int64)
        terminal = s < self.first
        rule = np.where(terminal, 0, s - self.first)
        size = np.where(terminal, 1, self.lengths[rule] if len(self.lengths) else 1).astype(np.int64)
        begin = np.where(terminal, self.offsets[-1] + s, self.offsets[rule])
        upto = np.cumsum(size)
        return self.flat[np.repeat(begin - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)].astype("<u4")

    def tokens(self) -> np.ndarray:
        return self._expand(self.symbols)

    def document(self, i: int) -> np.ndarray:
        return self._expand(self.symbols[self.symbol_starts[i] : self.symbol_starts[i + 1]])

    def span(self, start: int, stop: int) -> np.ndarray:
        """The tokens [start, stop) of the shard; only the documents they are in are decoded."""
        stop = min(stop, int(self.starts[-1]))
        if start >= stop:
            return np.zeros(0, dtype="<u4")
        a = int(np.searchsorted(self.starts, start, side="right")) - 1
        b = int(np.searchsorted(self.starts, stop, side="left"))
        part = self._expand(self.symbols[self.symbol_starts[a] : self.symbol_starts[b]])
        return part[start - self.starts[a] : stop - self.starts[a]]


def write(documents: DataFrame, path: str, params: Params = Params()) -> None:
    """Encodes (doc_id, text) and writes the shards (part, seq, n_docs, n_tokens, shard) to ``path``.

    Null ids come first; equal ids are ordered by a hash of their texts.  A null or empty text is the end id alone.
    """
    bounded_batches(documents.sparkSession)
    first = _tokenizer(params.tokenizer).get_vocab_size()

    def shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, end = encoder(params.tokenizer, params.remembered), struct.pack("<I", params.end)
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def row() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "seq": [seq], "n_docs": [len(ids)], "n_tokens": [size], "shard": [packed(ids, held, first, params)]})

        for frame in frames:
            numbers = [None if pd.isna(x) else int(x) for x in frame["doc_id"]]
            for i, tokens in zip(numbers, coder.encode([t if isinstance(t, str) else None for t in frame["text"]])):
                ids.append(i)
                held.append(tokens + end)
                size += len(tokens) // 4 + 1
                if size >= params.shard:
                    yield row()
                    seq, ids, held, size = seq + 1, [], [], 0
        if ids:
            yield row()

    order = ["doc_id", F.xxhash64("text")]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInPandas(shards, "part int, seq int, n_docs int, n_tokens bigint, shard binary").write.parquet(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: ids before the document's, its own, and their checksum."""
    table = spark.read.parquet(path)
    shards = table.select("part", "seq", "n_tokens")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    within = shards.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    base = within.join(parts.select("part", before.alias("before")), "part").select("part", "seq", (F.col("before") + F.col("within")).alias("base"))

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, seq, data in zip(frame["part"], frame["seq"], frame["shard"]):
                s = Shard(data)
                tokens = s.tokens()
                cut = s.starts.tolist()
                crc = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])]
                yield pd.DataFrame({"part": part, "seq": seq, "doc_id": pd.array(s.ids, dtype="Int64"), "own": s.starts[:-1], "n_tokens": s.sizes.astype(np.int64), "ids_crc32": crc})

    rows = table.select("part", "seq", "shard").mapInPandas(decode, "part int, seq int, doc_id bigint, own bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def encoded(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """Writes the files to a new folder of the shared one and reads them back."""
    path = scratch_dir(documents.sparkSession, "tokens")
    write(documents, path, params)
    return read_back(documents.sparkSession, path)
