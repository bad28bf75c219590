"""Language-model scores from n-gram tries in Elias-Fano form with quantised back-off probabilities.

Shards.  Documents are dealt into shards of about ``Params.shard`` tokens, of training documents or of others.  A shard
numbers its words in byte order and stays in the shared folder.

Passes: words, pairs, triples.  The first numbers all words in byte order, range by range; from then on only numbers travel.
In each pass a shard sorts its distinct n-grams by their context and sends them, with their counts, to the ranges of
contexts they belong to.  A range adds the counts of the training shards, keeps n-grams of
``Params.least`` occurrences or more, makes its part of the trie, and answers every shard from the trie.  A longer n-gram
is only asked for where both its parts are kept, as no other can be.  Cut points of the ranges come from a bounded sample
and affect balance only; all n-grams of a context are in one range.

Model: P(w | v u) is (c(v u w) - D) / c(v u) for a kept triple, else the back-off weight of (v u) times
P(w | u); P(w | u) likewise down to P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)).  A weight is what the kept continuations
leave, over what the shorter context gives all others, so the probabilities of a context add up to one.  The log of a
document's score is a sum over its n-grams: each kept one brings what it adds to the backed-off log, each context its weight.

Trie of a range: the nodes are its contexts, the numbers of their successors follow.  The first successor's place of each
node is a monotone sequence; the successors' numbers are made monotone by adding the last number of the node before, and
are found by a successor search relative to it.  Values are one byte each.  A task maps the levels from an unlinked file.
"""

from __future__ import annotations

import bisect
import mmap
import pickle
import tempfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainshed.llm.common import bounded_batches, fold, removed, share, word_list, written
from rainshed.llm.elias_fano import Codebook, EliasFano
from rainshed.llm.packing import pack, pack_bytes, pack_ranked, unpack, unpack_bytes, unpack_ranked

END = b" "  # no word has a space; nor a line feed, which stands between the words of a list
ADD = 0.1
SHARD = "shard long, train boolean, n long, words binary, ids binary, docs binary, sample array<binary>"
STATE = "shard long, train boolean, words binary, ids binary, extra binary, docs binary"
PART = "range int, shard long, part binary"
ANSWER = "range int, shard long, answer binary, trie binary"


@dataclass(frozen=True)
class Params:
    least: int = 2  #: training occurrences from which on a pair or triple is kept
    discount: float = 0.5
    shard: int = 1 << 20  #: tokens
    range: int = 1 << 21  #: tokens of the corpus to a range
    points: int = 1 << 20  #: sampled pairs, at most, on the driver


def tokens(text: str | None) -> list[bytes]:
    words = word_list(text)
    words.append(END)
    return words


# ---- shards ------------------------------------------------------------------------------------------------------
class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Shard:
    def __init__(self) -> None:
        self.number, self.ids, self.docs, self.size = _Numbers({END: 0}), [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = tokens(text)
        self.ids.append(np.fromiter(map(self.number.__getitem__, words), dtype=np.int32, count=len(words)))
        self.docs.append(doc_id)
        self.size += len(words)

    def row(self, shard: int, train: bool) -> tuple:
        words = sorted(self.number)
        to = np.zeros(len(words), dtype=np.int32)
        to[[self.number[w] for w in words]] = np.arange(len(words))
        ids = to[np.concatenate(self.ids)]
        none = np.array([d is None for d in self.docs])
        docs = pickle.dumps((pack(none.astype(np.int64)), pack(np.array([d or 0 for d in self.docs], dtype=np.int64)), pack(np.array(list(map(len, self.ids))))))
        sample = [b"\n".join(words[i] for i in ids[at : at + 2].tolist()) for at in range(0, len(ids), max(len(ids) // 64, 1))]
        return shard, train, len(ids), pack_bytes(b"\n".join(words)), pack_ranked(ids), docs, sample


def shards(documents: DataFrame, train: Column, params: Params) -> DataFrame:
    bounded_batches(documents.sparkSession, 4 << 20)
    names = [c.split()[0] for c in SHARD.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, number = {True: _Shard(), False: _Shard()}, TaskContext.get().partitionId() << 32
        for frame in frames:
            none = frame["none"].tolist()
            for doc_id, gone, text, t in zip(frame["doc_id"].tolist(), none, frame["text"].tolist(), frame["train"].tolist()):
                open_[t].add(None if gone else doc_id, text if isinstance(text, str) else None)
                if open_[t].size >= params.shard:
                    yield pd.DataFrame([open_[t].row(number, t)], columns=names, dtype=object)
                    open_[t], number = _Shard(), number + 1
        for t, s in open_.items():
            if s.docs:
                yield pd.DataFrame([s.row(number, t)], columns=names, dtype=object)
                number += 1

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text", "train")
    return rows.mapInPandas(run, SHARD)


def cut_points(table: DataFrame, params: Params) -> list[tuple[bytes, ...]]:
    """Ascending pairs that divide all pairs into ranges; their first words divide the words."""
    n, many = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    wanted = -(-n // params.range)
    if wanted < 2:
        return []
    sample = table.select(F.explode("sample").alias("s")).where(share(F.col("s")) < params.points / (65 * many)).distinct()
    found = sorted(tuple(bytes(r["s"]).split(b"\n")) for r in sample.toLocalIterator())
    return sorted({found[i * len(found) // wanted] for i in range(1, wanted)}) if found else []


# ---- parts of a shard for the ranges -----------------------------------------------------------------------------
@dataclass
class Part:
    """N-grams of a shard by context: contexts (k, order) and successors as places in ``labels``, both ascending."""

    labels: np.ndarray  #: numbers of words, ascending
    known: np.ndarray  #: training count of each label that a probability of the shorter n-grams needs, else 0
    contexts: np.ndarray
    context_counts: np.ndarray  #: training count of each context
    sizes: np.ndarray  #: successors of each context
    successors: np.ndarray
    counts: np.ndarray  #: in this shard, 0 unless it trains
    shorter: np.ndarray  #: training count of the n-gram without its first word

    def slice(self, a: int, b: int) -> Part:
        x, y = np.r_[0, np.cumsum(self.sizes)][[a, b]]
        contexts, successors = self.contexts[a:b], self.successors[x:y]
        there = np.zeros(len(self.labels), dtype=bool)
        there[contexts.ravel()] = there[successors] = True
        at = np.cumsum(there) - 1
        needed = np.zeros(len(self.labels), dtype=bool)  # counts of other labels are not asked for
        needed[successors if contexts.shape[1] == 1 else contexts[:, -1]] = True
        return Part(self.labels[there], (self.known * needed)[there], at[contexts], self.context_counts[a:b], self.sizes[a:b], at[successors], self.counts[x:y], self.shorter[x:y])

    def dumps(self) -> bytes:
        columns = [self.contexts[:, j] for j in range(self.contexts.shape[1])]
        first, later = pack(np.diff(columns[0], prepend=0)), [pack(c) for c in [*columns[1:], self.successors]]
        rest = (np.diff(self.labels, prepend=0), self.known, self.context_counts, self.sizes, self.counts, self.shorter)
        return pickle.dumps((first, later, [pack(x) for x in rest]), protocol=5)

    @classmethod
    def loads(cls, data: bytes) -> Part:
        first, later, rest = pickle.loads(data)
        *columns, successors = map(unpack, later)
        labels, known, context_counts, sizes, counts, shorter = map(unpack, rest)
        return cls(np.cumsum(labels), known, np.column_stack([np.cumsum(unpack(first)), *columns]), context_counts, sizes, successors, counts, shorter)

    def bounds(self, points: Sequence[tuple[int, ...]]) -> Iterator[tuple[int, int, int]]:
        """(range, begin, end) of the contexts of each range; ``points`` as numbers of words."""
        place = lambda i: tuple(self.labels[self.contexts[i]].tolist())
        begin, n = 0, len(self.contexts)
        while begin < n:
            at = bisect.bisect_right(points, place(begin))
            end = n if at >= len(points) else bisect.bisect_left(range(n), points[at], lo=begin, key=place)
            yield at, begin, end
            begin = end

    def asked(self, points: Sequence[tuple[int, ...]]) -> list[int]:
        """How many n-grams each range is asked for."""
        upto = np.r_[0, np.cumsum(self.sizes)]
        return [int(upto[b] - upto[a]) for _, a, b in self.bounds(points)]


# ---- the trie of a range -----------------------------------------------------------------------------------------
def level(parents: np.ndarray, children: np.ndarray, nodes: int, width: int) -> tuple:
    """Pointers and numbers of a level in Elias-Fano form; parents ascend, children ascend within a parent."""
    starts = np.searchsorted(parents, np.arange(nodes + 1))
    full = np.flatnonzero(starts[1:] > starts[:-1])
    span = np.zeros(nodes, dtype=np.int64)
    span[full] = children[starts[full + 1] - 1] + 1
    base = np.r_[0, np.cumsum(span)]
    top = int(base[-1])
    return EliasFano.encode(starts, len(children) + 1), EliasFano.encode(base, top + 1), EliasFano.encode(children + base[parents], top + width + 1)


class Level:
    def __init__(self, stored: tuple):
        pointers, base, numbers = stored
        self.pointers, self.base, self.numbers = EliasFano(*pointers), EliasFano(*base), EliasFano(*numbers)

    def find(self, node: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Place of the child among the successors of the node, -1 if it is none."""
        if not len(node) or not self.numbers.n:
            return np.full(len(node), -1, dtype=np.int64)
        heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])  # each run of a node is looked up once
        times = np.diff(np.r_[heads, len(node)])
        begin, end = self.pointers.access(node[heads]), self.pointers.access(node[heads] + 1)
        base = self.base.access(node[heads])
        begin, end, base = (np.repeat(x, times) for x in (begin, end, base))
        out = np.full(len(node), -1, dtype=np.int64)
        some = np.flatnonzero(begin < end)
        value = child[some] + base[some]
        at = self.numbers.successor(value, begin[some], end[some])
        inside = at < end[some]
        hit = np.zeros(len(some), dtype=bool)
        hit[inside] = self.numbers.access(at[inside]) == value[inside]
        out[some[hit]] = at[hit]
        return out


def mapped(levels: tuple) -> tuple:
    """The levels, their arrays lying in an unlinked memory-mapped file."""
    parts: list[np.ndarray] = []

    def gather(x):
        if isinstance(x, np.ndarray) and x.nbytes:
            parts.append(x)
        elif isinstance(x, (tuple, list)):
            for y in x:
                gather(y)

    gather(levels)
    size = sum(-(-x.nbytes // 64) * 64 for x in parts)
    with tempfile.TemporaryFile() as f:
        f.truncate(max(size, 64))
        area = mmap.mmap(f.fileno(), max(size, 64))
    at = 0

    def placed(x):
        nonlocal at
        if isinstance(x, np.ndarray) and x.nbytes:
            view = np.frombuffer(area, dtype=x.dtype, count=x.size, offset=at).reshape(x.shape)
            view[:] = x
            at += -(-x.nbytes // 64) * 64
            return view
        return tuple(placed(y) for y in x) if isinstance(x, (tuple, list)) else x

    return placed(levels)


@dataclass
class Trie:
    """Of one range: contexts in order, their successors, values and weights.  ``stored`` is what the file has."""

    labels: np.ndarray  #: numbers of words, ascending
    contexts: np.ndarray
    stored: tuple  #: levels, value codes, weight codes
    kept: np.ndarray  #: training counts of the successors

    def __post_init__(self) -> None:
        levels, (self.book, self.codes), (self.weight_book, self.weights) = mapped(self.stored)
        self.level = Level(levels)

    def dumps(self) -> bytes:
        columns = [pack(self.contexts[:, j]) for j in range(self.contexts.shape[1])]
        return pickle.dumps((pack(np.diff(self.labels, prepend=0)), columns, self.stored, pack(self.kept)), protocol=5)

    @classmethod
    def loads(cls, data: bytes) -> Trie:
        labels, columns, stored, kept = pickle.loads(data)
        return cls(np.cumsum(unpack(labels)), np.column_stack([unpack(c) for c in columns]), stored, unpack(kept))


def _log_ratio(left: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """log10 of what the continuations of a context leave, over what the shorter context gives all others."""
    bound = lambda x: np.clip(1 - x, 1e-6, 1.0)
    return np.log10(bound(left) / bound(rest))


def united(parts: Sequence[Part], floor: float, params: Params) -> tuple[Trie, list[np.ndarray], list[np.ndarray]]:
    """The trie of a range; for each part the trie's number of each of its contexts, and of each of its labels."""
    labels = np.unique(np.concatenate([p.labels for p in parts]))
    known = np.zeros(len(labels), dtype=np.int64)
    names = [np.searchsorted(labels, p.labels) for p in parts]
    for to, p in zip(names, parts):
        known[to] = np.maximum(known[to], p.known)
    rows, counts_ = [to[p.contexts] for to, p in zip(names, parts)], [p.context_counts for p in parts]
    every = np.concatenate(rows)
    order = np.lexsort(every.T[::-1])
    new = np.ones(len(every), dtype=bool)
    new[1:] = (every[order][1:] != every[order][:-1]).any(axis=1)
    number = np.zeros(len(every), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    contexts, of_context = every[order][new], np.concatenate(counts_)[order][new]
    numbers = np.split(number, np.cumsum(list(map(len, rows)))[:-1])
    key = np.concatenate([np.repeat(k, p.sizes) * len(labels) + to[p.successors] for p, k, to in zip(parts, numbers, names)])
    distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
    total = np.bincount(back, weights=np.concatenate([p.counts for p in parts]), minlength=len(distinct)).astype(np.int64)
    keep = total >= params.least
    parent, child, c = distinct[keep] // len(labels), distinct[keep] % len(labels), total[keep]
    p = (c - params.discount) / of_context[parent]
    if contexts.shape[1] == 1:
        shorter = (known[child] + ADD) / floor
    else:
        shorter = (np.concatenate([x.shorter for x in parts])[first[keep]] - params.discount) / known[contexts[parent, -1]]
    sums = [np.bincount(parent, weights=x, minlength=len(contexts)) for x in (p, shorter)]
    weight = np.where(np.bincount(parent, minlength=len(contexts)) > 0, _log_ratio(*sums), 0.0)
    value = np.log10(p) - weight[parent] - np.log10(shorter)
    stored = (level(parent, child, len(contexts), len(labels)), Codebook.encode(value), Codebook.encode(weight))
    return Trie(labels, contexts, stored, c), numbers, names


def answered(trie: Trie, part: Part, numbers: np.ndarray, names: np.ndarray) -> bytes:
    """Weights of the part's contexts; which of its n-grams the trie has, their training counts and values; both as codes."""
    place = trie.level.find(np.repeat(numbers, part.sizes), names[part.successors])
    hit = place[place >= 0]
    books = [np.asarray(b, dtype="<f4").tobytes() for b in (trie.weight_book, trie.book)]
    found = np.packbits(place >= 0).tobytes()
    return pickle.dumps((books, pack_bytes(trie.weights[numbers].tobytes()), pack_bytes(found), pack(trie.kept[hit]), pack_bytes(trie.codes[hit].tobytes())), protocol=5)


def _range_answers(floor: float, params: Params) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("shard")
        parts = [Part.loads(p) for p in frame["part"]]
        trie, numbers, names = united(parts, floor, params)
        out = [(key[0], s, answered(trie, p, n, to), None) for s, p, n, to in zip(frame["shard"], parts, numbers, names)]
        return pd.DataFrame([*out, (key[0], None, None, trie.dumps())], columns=["range", "shard", "answer", "trie"], dtype=object)

    return run


WORDS = "range int, shard long, answer binary, points binary, total long, types long, size long"


def _word_answers(wanted: frozenset[bytes]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Place in the range and training count of each word, to every shard that has it; the range's totals and, of the words
    that cut points are made of, the places."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("shard")
        parts = [pickle.loads(p) for p in frame["part"]]
        lists = [unpack_bytes(w).split(b"\n") for w, _ in parts]
        words = sorted(set().union(*lists))
        at = dict(zip(words, range(len(words))))
        places = [np.fromiter(map(at.__getitem__, x), dtype=np.int64, count=len(x)) for x in lists]
        total = np.zeros(len(words), dtype=np.int64)
        for to, (_, counts) in zip(places, parts):
            total[to] += unpack(counts)
        rows = [(key[0], s, pickle.dumps((pack(np.diff(to, prepend=0)), pack(total[to]))), None, 0, 0, 0) for s, to in zip(frame["shard"], places)]
        points = pickle.dumps([(w, at[w]) for w in wanted if w in at])
        rows.append((key[0], None, None, points, int(total.sum()), int((total > 0).sum()), len(words)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in WORDS.split(", ")], dtype=object)

    return run


def _joined(state: DataFrame, answers: DataFrame) -> DataFrame:
    """Each shard with all its answers in the order of the ranges; merged at every size, as neither side is bounded."""
    mine = answers.where("shard IS NOT NULL").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("range", "answer"))).alias("answers"))
    return state.join(mine.hint("merge"), "shard", "left")


def _mapped(df: DataFrame, of: Callable[[object], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that ``of`` makes of each row, one after another: a shard in memory at a time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield pd.DataFrame(list(of(row)), columns=names, dtype=object)

    return df.mapInPandas(run, schema)


# ---- what a shard does -------------------------------------------------------------------------------------------
def _word_parts(points: list[tuple[bytes, ...]]) -> Callable[[object], Iterator[tuple]]:
    def of(row) -> Iterator[tuple]:
        words, ids = unpack_bytes(row.words).split(b"\n"), unpack_ranked(row.ids)
        counts = np.bincount(ids, minlength=len(words)) if row.train else np.zeros(len(words), dtype=np.int64)
        begin = 0
        while begin < len(words):
            at = bisect.bisect_right(points, (words[begin],))
            end = len(words) if at >= len(points) else bisect.bisect_left(words, points[at][0], lo=begin)
            yield at, row.shard, pickle.dumps((pack_bytes(b"\n".join(words[begin:end])), pack(counts[begin:end])), protocol=5)
            begin = end

    return of


def _after_words(total: int, types: int, least: int, base: dict[int, int], end: int) -> Callable[[object], Iterator[tuple]]:
    """State: words of ``least`` training occurrences; places hold them, 0 stands for any others between them."""
    floor = total + ADD * (types + 1)

    def of(row) -> Iterator[tuple]:
        ids = unpack_ranked(row.ids)
        answers = [(a["range"], *map(unpack, pickle.loads(a["answer"]))) for a in row.answers]
        words = np.concatenate([base[r] + np.cumsum(p) for r, p, _ in answers])
        known = np.concatenate([k for *_, k in answers])
        none, doc_ids, sizes = map(unpack, pickle.loads(row.docs))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        logs = np.log10((known + ADD) / floor)
        log = np.bincount(doc, weights=logs[ids], minlength=len(sizes))
        n_known = np.bincount(doc, weights=known[ids] > 0, minlength=len(sizes)).astype(np.int64)
        ids, doc, words, known = _narrowed(ids, doc, words, known, known[ids] >= least)
        docs = (none, doc_ids, sizes, n_known, log, log.copy())
        yield row.shard, row.train, pack(np.diff(words, prepend=0)), _places(ids, doc), pickle.dumps((pack(known),)), pickle.dumps(docs, protocol=5)

    return of


def _narrowed(ids: np.ndarray, doc: np.ndarray, words: np.ndarray, known: np.ndarray, stay: np.ndarray) -> tuple:
    """Places that ``stay``, numbered from 1 by their words alone, and a 0 after each stretch of them."""
    keep = stay.copy()
    keep[1:] |= stay[:-1]
    used = np.zeros(len(words) + 1, dtype=bool)
    used[ids[stay]] = True
    to = np.cumsum(used)
    used = used[: len(words)]
    return np.where(stay, to[ids], 0)[keep], doc[keep], words[used], known[used]


def _places(ids: np.ndarray, doc: np.ndarray) -> bytes:
    return pickle.dumps((pack_ranked(ids), pack(np.diff(doc, prepend=0))), protocol=5)


@dataclass
class _State:
    """A shard between passes."""

    words: np.ndarray  #: their numbers among all words
    ids: np.ndarray  #: place in ``words`` + 1, or 0
    doc: np.ndarray
    extra: list[np.ndarray]
    end: int  #: place in ``words`` of the end, -1 if it is not there

    @classmethod
    def of(cls, row, end: int) -> _State:
        ids, doc = pickle.loads(row.ids)
        ids, doc = unpack_ranked(ids), unpack(doc)
        words = np.cumsum(unpack(row.words))
        at = np.flatnonzero(words == end)
        return cls(words, ids, np.cumsum(doc), [unpack(x) for x in pickle.loads(row.extra)], int(at[0]) if len(at) else -1)

    def inner(self) -> np.ndarray:
        """Places of words, not of ends: what comes next belongs to the same document."""
        return (self.ids > 0) & (self.ids != self.end + 1)

    def pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs that begin at the places ``at``, as (first, second) word numbers, ascending; which is where."""
        wide = len(self.words) + 1
        key, which = np.unique(self.ids[at] * wide + self.ids[at + 1], return_inverse=True)
        return np.column_stack([key // wide, key % wide]) - 1, which


def _pair_places(s: _State) -> np.ndarray:
    inner = s.inner()
    return np.flatnonzero(inner[:-1] & (s.ids[1:] > 0))


def _pair_part(s: _State, train: bool) -> tuple[Part, np.ndarray, np.ndarray]:
    """Contexts: all words but the end; the pairs at each place, and the places."""
    at = _pair_places(s)
    rows, which = s.pairs(at)
    counts = np.bincount(which, minlength=len(rows)) if train else np.zeros(len(rows), dtype=np.int64)
    contexts = np.unique(s.ids[s.inner()]) - 1
    sizes = np.bincount(np.searchsorted(contexts, rows[:, 0]), minlength=len(contexts))
    known = s.extra[0]
    return Part(s.words, known, contexts[:, None], known[contexts], sizes, rows[:, 1], counts, np.zeros(len(rows), dtype=np.int64)), which, at


def _triple_part(s: _State, train: bool) -> tuple[Part, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts: the kept pairs whose second word is not the end.  Also which context is at which place, and the triples."""
    known, begins, of_pair = s.extra
    pair_at = np.flatnonzero(begins)
    rows, which = s.pairs(pair_at)
    pair = np.full(len(s.ids), -1, dtype=np.int64)
    pair[pair_at] = which
    goes_on = rows[:, 1] != s.end
    number = np.cumsum(goes_on) - 1  # of a pair among the contexts
    at = pair_at[pair_at + 1 < len(s.ids)]
    at = at[(pair[at + 1] >= 0) & goes_on[pair[at]]]
    wide = len(s.words) + 1
    key, first, triple = np.unique(number[pair[at]] * wide + s.ids[at + 2], return_index=True, return_inverse=True)
    counts = np.bincount(triple, minlength=len(key)) if train else np.zeros(len(key), dtype=np.int64)
    sizes = np.bincount(key // wide, minlength=int(goes_on.sum()))
    part = Part(s.words, known, rows[goes_on], of_pair[goes_on], sizes, key % wide - 1, counts, of_pair[pair[at + 1][first]])
    here = pair_at[goes_on[which]]
    return part, number[pair[here]], here, triple, at


def _parts(triples: bool, points: list[tuple[int, ...]], end: int) -> Callable[[object], Iterator[tuple]]:
    def of(row) -> Iterator[tuple]:
        part = (_triple_part if triples else _pair_part)(_State.of(row, end), row.train)[0]
        for at, a, b in part.bounds(points):
            yield at, row.shard, part.slice(a, b).dumps()

    return of


def _replies(answers: list | None, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the contexts, which n-grams are kept, counts and values of those, over all ranges."""
    weights, found, counts, values = [np.zeros(0)], [np.zeros(0, dtype=bool)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    for a, size in zip(answers if answers is not None else [], lengths):
        books, w, f, c, v = pickle.loads(a["answer"])
        weight_book, book = (np.frombuffer(b, "<f4").astype(np.float64) for b in books)
        weights.append(weight_book[np.frombuffer(unpack_bytes(w), np.uint8)])
        found.append(np.unpackbits(np.frombuffer(unpack_bytes(f), np.uint8), count=size).astype(bool))
        counts.append(unpack(c))
        values.append(book[np.frombuffer(unpack_bytes(v), np.uint8)])
    return tuple(map(np.concatenate, (weights, found, counts, values)))


def _after_pairs(points: list[tuple[int, ...]], end: int) -> Callable[[object], Iterator[tuple]]:
    def of(row) -> Iterator[tuple]:
        s = _State.of(row, end)
        part, which, at = _pair_part(s, False)
        weights, found, counts, values = _replies(row.answers, part.asked(points))
        none, doc_ids, sizes, n_known, base, score = pickle.loads(row.docs)
        score = score.copy()
        inner = np.flatnonzero(s.inner())
        if len(inner):
            score += np.bincount(s.doc[inner], weights=weights[np.searchsorted(part.contexts[:, 0], s.ids[inner] - 1)], minlength=len(score))
        value = np.zeros(len(found))
        value[found] = values
        if len(at):
            score += np.bincount(s.doc[at], weights=value[which], minlength=len(score))
        begins = np.zeros(len(s.ids) + 1, dtype=bool)
        begins[at[found[which]]] = True
        stay = begins[:-1].copy()
        stay[1:] |= begins[:-2]
        keep = stay.copy()
        keep[1:] |= stay[:-1]
        shifted = np.where(s.ids > 0, s.ids - 1, 0)
        ids, doc, words, known = _narrowed(shifted, s.doc, s.words, s.extra[0], stay)
        extra = (pack(known), pack(begins[:-1][keep].astype(np.int64)), pack(counts))
        yield row.shard, row.train, pack(np.diff(words, prepend=0)), _places(ids, doc), pickle.dumps(extra), pickle.dumps((none, doc_ids, sizes, n_known, base, score), protocol=5)

    return of


def _after_triples(points: list[tuple[int, ...]], end: int) -> Callable[[object], Iterator[tuple]]:
    def of(row) -> Iterator[tuple]:
        s = _State.of(row, end)
        none, doc_ids, sizes, n_known, base, score = pickle.loads(row.docs)
        score = score.copy()
        if len(s.ids):
            part, context, here, triple, at = _triple_part(s, False)
            weights, found, _, values = _replies(row.answers, part.asked(points))
            value = np.zeros(len(found))
            value[found] = values
            if len(here):
                score += np.bincount(s.doc[here], weights=weights[context], minlength=len(score))
            if len(at):
                score += np.bincount(s.doc[at], weights=value[triple], minlength=len(score))
        for gone, i, n, k, b, x in zip(none.tolist(), doc_ids.tolist(), sizes.tolist(), n_known.tolist(), base.tolist(), score.tolist()):
            yield None if gone else i, row.train, n, k, b, x

    return of


def _handed_on(df: DataFrame, name: str, *before: DataFrame) -> DataFrame:
    """``df`` written; the tables that it was made from, which nothing reads again, are removed, and so are their shuffles."""
    new = written(df, name)
    del df
    for old in before:
        removed(old)
    new.sparkSession.sparkContext._jvm.System.gc()  # lets Spark drop the shuffles of plans that are gone
    return new


# ---- the operator ------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Scored:
    """``documents``: (doc_id, train, n_tokens, n_known, base_score, score); the tries are tables (range, trie)."""

    documents: DataFrame
    pairs: DataFrame
    triples: DataFrame
    total: int  #: training tokens
    types: int


def scored(documents: DataFrame, train: Column, params: Params = Params()) -> Scored:
    """Learns from the rows of ``documents`` (doc_id, text) where ``train`` holds and scores all rows.

    A null or empty text is the end alone.  Without training tokens every score is that of an unknown word each.  Repeated
    rows and ids are rows of their own; a null id stays null.  A text of any length is scored whole.  No documents give no
    rows.  Other columns are not looked at.
    """
    table = written(shards(documents, train, params), "shards")
    cuts = cut_points(table, params)
    firsts = sorted({p[0] for p in cuts})
    parts = _mapped(table.select("shard", "train", "words", "ids"), _word_parts([(w,) for w in firsts]), PART)
    words = written(parts.groupBy("range").applyInPandas(_word_answers(frozenset({END, *(w for p in cuts for w in p)})), WORDS), "words")
    ranges = sorted(words.where("shard IS NULL").select("range", "total", "types", "size", "points").collect())  # one row a range
    total, types = sum(r.total for r in ranges), sum(r.types for r in ranges)
    base, numbers, upto = {}, {}, 0
    for r in ranges:
        base[r["range"]] = upto
        numbers |= {w: upto + at for w, at in pickle.loads(r.points)}
        upto += r["size"]
    points = [tuple(map(numbers.__getitem__, p)) for p in cuts]
    firsts = [(numbers[w],) for w in firsts]
    floor, end = total + ADD * (types + 1), numbers.get(END, -1)
    state = _joined(table.select("shard", "train", "ids", "docs"), words.select("range", "shard", "answer"))
    state = _handed_on(_mapped(state, _after_words(total, types, params.least, base, end), STATE), "state", table, words)

    def asked(state: DataFrame, triples: bool, points: list[tuple[int, ...]], name: str) -> DataFrame:
        parts = _mapped(state, _parts(triples, points, end), PART)
        return written(parts.groupBy("range").applyInPandas(_range_answers(floor, params), ANSWER), name)

    pairs = asked(state, False, firsts, "pairs")
    state = _handed_on(_mapped(_joined(state, pairs), _after_pairs(firsts, end), STATE), "state", state)
    triples = asked(state, True, points, "triples")
    rows = _mapped(_joined(state, triples), _after_triples(points, end), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    tries = [t.where("trie IS NOT NULL").select("range", "trie") for t in (pairs, triples)]
    return Scored(rows, *tries, total, types)


def held_out_scores(documents: DataFrame, parts: int = 10, held: int = 0, params: Params = Params()) -> DataFrame:
    """Learns from the documents whose fold is not ``held`` and scores all."""
    found = scored(documents, fold(F.col("doc_id"), parts) != held, params)
    n = F.lit(found.total).cast("long").alias("train_tokens")
    return found.documents.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", n, "base_score", "score")
