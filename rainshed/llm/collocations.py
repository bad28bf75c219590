"""Phrase collocations: exact counts of word sequences within pieces of text, scored against the counts of their parts.

Shards.  Texts are cut into pieces and words, per language; about ``Params.shard`` words make a shard: its words in order,
numbered, kept in the shared folder.

Counting, one length after the other.  A sequence of n words can only reach ``least`` if both its parts of n - 1 words do,
which is all that is left out (exact, at every size).  A shard sorts its sequences and builds a count transducer for each
prefix range (``automata``); transducers of up to ``fan`` shards over one range are united, weights summed, cut into
narrower ranges and united again until one is left for each range, which keeps what reached ``least``.  On the way back
each transducer is composed with what its union kept, down to the shard, which drops the words that no sequence needs.
Cut points come from a bounded sample and affect balance only.

Parts.  The parts of all candidates, distinct, go to the range that holds them, are built into an acceptor there and
composed with the range's counts.
"""

from __future__ import annotations

import bisect
import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainshed.llm.automata import Automaton, union
from rainshed.llm.common import bounded_batches, share, written
from rainshed.llm.packing import pack_bytes, pack_ranked, unpack_bytes, unpack_ranked

UPPER = bytes(range(65, 91))
CUT = b"\xff"  # in no UTF-8 text
TABLE = bytes.maketrans(UPPER + b".,;:!?\n\x0b\x0c\r\t", UPPER.lower() + CUT * 10 + b" ")
SHARD = "shard long, lang string, n long, words binary, ids binary, alive binary, sample array<binary>"
NODE = "lang string, range int, node long, counts binary"
UNION = f"{NODE}, kept binary"  # a union, or to a transducer what the union kept of it

Points = dict[str, list[tuple[bytes, ...]]]


@dataclass(frozen=True)
class Params:
    longest: int = 4  #: words of a phrase
    least: int = 30  #: occurrences of a candidate
    inside: int = 80  #: per cent of a phrase's occurrences within a longer one from which on the phrase goes
    scale: int = 2_000_000  #: of the score
    top: int = 2000  #: phrases of a language that are returned
    shard: int = 1 << 20  #: words
    range: int = 1 << 21  #: words of the corpus to a prefix range
    fan: int = 1024  #: transducers of one union
    points: int = 1 << 20  #: sampled sequences, at most, on the driver


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Shard:
    """Words of one language as they come; numbered in byte order from 1 when the shard ends; 0 stands between pieces."""

    def __init__(self) -> None:
        self.number, self.ids, self.size = _Numbers({CUT: 0}), [], 0

    def add(self, text: str) -> None:
        words = text.encode("utf-8", "surrogatepass").translate(TABLE).replace(CUT, b" \xff ").split()
        if words:
            words.append(CUT)
            self.ids.append(np.fromiter(map(self.number.__getitem__, words), dtype=np.int32, count=len(words)))
            self.size += len(words) - 1

    def row(self, shard: int, lang: str) -> tuple:
        del self.number[CUT]
        words = sorted(self.number)
        to = np.zeros(len(words) + 1, dtype=np.int32)
        to[[self.number[w] for w in words]] = np.arange(1, len(words) + 1)
        ids = to[np.concatenate(self.ids)]
        sample = []
        for at in range(0, len(ids), max(len(ids) // 64, 1)):
            run = ids[at : at + 4].tolist()
            run = run[: run.index(0)] if 0 in run else run
            if run:
                sample.append(b" ".join(words[i - 1] for i in run))
        return shard, lang, int((ids > 0).sum()), pack_bytes(b"\n".join(words)), pack_ranked(ids), None, sample


def shards(docs: DataFrame, params: Params) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[str, _Shard] = defaultdict(_Shard)
        number = TaskContext.get().partitionId() << 32
        names = [c.split()[0] for c in SHARD.split(", ")]

        def flush(langs: list[str]) -> pd.DataFrame:
            nonlocal number
            rows = []
            for lang in langs:
                if (s := open_.pop(lang)).size:
                    rows.append(s.row(number, lang))
                    number += 1
            return pd.DataFrame(rows, columns=names, dtype=object)

        for frame in frames:
            for lang, text in zip(frame["lang"].tolist(), frame["text"].tolist()):
                if text:
                    open_[lang].add(text)
                    if open_[lang].size >= params.shard:
                        yield flush([lang])
            if sum(s.size for s in open_.values()) > 4 * params.shard:  # many languages, all of them small here
                yield flush(list(open_))
        yield flush(list(open_))

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInPandas(run, SHARD)


def cut_points(shard_table: DataFrame, params: Params) -> tuple[Points, int]:
    """Ascending word sequences that divide each language's sequences into ranges; the most shards of a language."""
    total = shard_table.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("shards")).collect()
    sample = shard_table.select("lang", F.explode("sample").alias("s"))
    rate = params.points / max(64 * sum(r.shards for r in total), 1)
    by_lang: dict[str, set[tuple[bytes, ...]]] = defaultdict(set)
    for lang, s in sample.where(share(F.col("s")) < rate).distinct().toLocalIterator():
        by_lang[lang].add(tuple(bytes(s).split(b" ")))
    points = {}
    for lang, n, _ in total:
        found, wanted = sorted(by_lang[lang]), -(-n // params.range)
        points[lang] = sorted({found[i * len(found) // wanted] for i in range(1, wanted)}) if found else []
    return points, max((r.shards for r in total), default=1)


def _grams(ids: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sequences of n words from the places ``at``: ascending label numbers from 0, which one is where, counts."""
    wide = int(ids.max(initial=0)) + 1
    values, which = np.unique(ids[at], return_inverse=True)
    rows = values[:, None].astype(np.int64)
    for j in range(1, n):
        keys, which = np.unique(which.astype(np.int64) * wide + ids[at + j], return_inverse=True)
        rows = np.column_stack([rows[keys // wide], keys % wide])
    return rows - 1, which, np.bincount(which, minlength=len(rows))


def _places(ids: np.ndarray, alive: bytes | None, n: int) -> np.ndarray:
    """Where a sequence of n words may begin: two sequences of n - 1 that reached the least count overlap there."""
    if n == 1:
        return np.flatnonzero(ids > 0)
    a = np.unpackbits(np.frombuffer(unpack_bytes(alive), np.uint8), count=len(ids)).astype(bool)
    return np.flatnonzero(a[:-1] & a[1:])


def _cut(labels: list[bytes], rows: np.ndarray, weights: np.ndarray, points: list[tuple[bytes, ...]], step: int) -> list[tuple[int, Automaton]]:
    """(number of the coarse range, its transducer) for the ranges that hold a sequence."""
    place = lambda i: tuple(labels[x] for x in rows[i].tolist())
    out, begin = [], 0
    while begin < len(rows):
        at = bisect.bisect_right(points, place(begin)) // step
        end = len(rows)
        if (at + 1) * step - 1 < len(points):
            end = bisect.bisect_left(range(len(rows)), points[(at + 1) * step - 1], lo=begin, key=place)
        out.append((at, Automaton.build(labels, rows[begin:end], weights[begin:end])))
        begin = end
    return out


def _pieces(shard_table: DataFrame, n: int, points: Points, step: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, lang, words, ids, alive in zip(*[frame[c] for c in ("shard", "lang", "words", "ids", "alive")]):
                ids = unpack_ranked(ids)
                rows, _, counts = _grams(ids, _places(ids, alive, n), n)
                cut = _cut(unpack_bytes(words).split(b"\n"), rows, counts, points[lang], step)
                yield pd.DataFrame([(lang, at, shard, a.dumps()) for at, a in cut], columns=["lang", "range", "node", "counts"], dtype=object)

    return shard_table.select("shard", "lang", "words", "ids", "alive").mapInPandas(run, NODE)


def _bits(live: np.ndarray) -> bytes:
    return len(live).to_bytes(8, "little") + pack_bytes(np.packbits(live).tobytes())


def _flags(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(unpack_bytes(bits[8:]), np.uint8), count=int.from_bytes(bits[:8], "little")).astype(bool)


def _united(n: int, least: int, points: Points, narrow: int, step: int, last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """One union; the result is cut from ranges of ``step * narrow`` to ranges of ``step`` points.  The ``last`` union also
    answers each transducer which of its sequences it kept."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        lang, at, batch = key
        frame = frame.sort_values("node")
        whole, live = union([Automaton.loads(c) for c in frame["counts"]], n, least)
        parts = [(at, whole)] if narrow == 1 and len(whole.label) else _cut(whole.labels, *whole.rows(n), points[lang], step)
        out = [(lang, r, batch, a.dumps(), None) for r, a in parts]
        if last:
            out += [(lang, at, node, None, _bits(x)) for node, x in zip(frame["node"], live)]
        return pd.DataFrame(out, columns=["lang", "range", "node", "counts", "kept"], dtype=object)

    return run


def _passed_down(n: int) -> Callable[[pd.Series, pd.Series], pd.Series]:
    """Which sequences of a transducer are left in its union: composed with what was kept of the union's ranges."""

    def run(mine: pd.Series, theirs: pd.Series) -> pd.Series:
        out = []
        for m, t in zip(mine, theirs):
            a = Automaton.loads(m)
            found = [a.compose(_left(Automaton.loads(x["counts"]), _flags(x["kept"]), n), n) for x in t]
            out.append(_bits(reduce(np.add, found) > 0))
        return pd.Series(out, dtype=object)

    return run


def _left(a: Automaton, live: np.ndarray, n: int) -> Automaton:
    rows, weights = a.rows(n)
    return Automaton.build(a.labels, rows[live], weights[live])


def _advance(shard_table: DataFrame, replies: DataFrame, n: int) -> DataFrame:
    """Shards with the words that a sequence of n words of the least count covers, and where such a sequence begins."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for shard, lang, words, ids, alive, kept in zip(*[frame[c] for c in ("shard", "lang", "words", "ids", "alive", "kept")]):
                words, ids = unpack_bytes(words).split(b"\n"), unpack_ranked(ids)
                at = _places(ids, alive, n)
                _, which, _ = _grams(ids, at, n)
                live = np.concatenate([_flags(r["kept"]) for r in sorted(kept, key=lambda r: r["range"])])
                begins = np.zeros(len(ids), dtype=bool)
                begins[at[live[which]]] = True
                covered = begins.copy()
                for j in range(1, n):
                    covered[j:] |= begins[: len(ids) - j]
                keep = covered.copy()
                keep[1:] |= covered[:-1]  # one place after each run stays, as the end of a piece
                used = np.unique(ids[covered])
                to = np.zeros(len(words) + 1, dtype=np.int32)
                to[used] = np.arange(1, len(used) + 1)
                new = np.where(covered, to[ids], 0)[keep]
                out.append((shard, lang, pack_bytes(b"\n".join(words[u - 1] for u in used.tolist())), pack_ranked(new), pack_bytes(np.packbits(begins[keep]).tobytes())))
            yield pd.DataFrame(out, columns=["shard", "lang", "words", "ids", "alive"], dtype=object)

    # Merged at every size: neither side is bounded, and a small one that is broadcast would hide what a large one costs.
    both = shard_table.select("shard", "lang", "words", "ids", "alive").join(replies.hint("merge"), "shard")
    return both.mapInPandas(run, "shard long, lang string, words binary, ids binary, alive binary")


def counted(shard_table: DataFrame, n: int, points: Points, most: int, params: Params) -> tuple[DataFrame, DataFrame | None]:
    """(lang, range, counts) of the sequences of n words that reach the least count; the shards for n + 1 words.

    ``most``: shards of a language, at most.  Ranges are numbered in units of ``steps[j]`` cut points before round j.
    """
    rounds = max(1, math.ceil(math.log(max(most, 2), params.fan) - 1e-9))
    ranges = max(map(len, points.values()), default=0) + 1
    narrow = max(1, math.ceil(ranges ** (1 / rounds) - 1e-9))
    steps = [narrow ** (rounds - 1 - j) for j in range(rounds)] + [1]

    def batch(j: int) -> Column:
        batches = -(-most // params.fan ** (j + 1))
        return F.lit(0).cast("long") if j == rounds - 1 else F.pmod(F.xxhash64("node", F.lit(j)), F.lit(batches))

    pieces = _pieces(shard_table, n, points, steps[0])
    levels = [pieces if rounds == 1 else written(pieces, "pieces")]
    for j in range(rounds):
        last = j == rounds - 1
        one = _united(n, params.least if last else 1, points, steps[j] // steps[j + 1], steps[j + 1], last)
        groups = levels[j].withColumn("batch", batch(j)).groupBy("lang", "range", "batch")
        levels.append(written(groups.applyInPandas(one, UNION), "united"))
    union_, kept = levels[-1].where("counts IS NOT NULL").drop("kept"), levels[-1].where("kept IS NOT NULL").drop("counts")
    if n == params.longest:
        return union_, None
    for j in reversed(range(rounds - 1)):  # from the transducers that the last union read down to the shards'
        wide = F.floor(F.col("range") / (steps[j] // steps[j + 1])).cast("int").alias("range")
        theirs = kept.join(levels[j + 1].select("lang", "range", "node", "counts"), ["lang", "range", "node"])
        theirs = theirs.groupBy("lang", wide, F.col("node").alias("batch")).agg(F.collect_list(F.struct("counts", "kept")).alias("theirs"))
        both = levels[j].withColumn("batch", batch(j)).join(theirs, ["lang", "range", "batch"])
        kept = both.select("lang", "range", "node", F.pandas_udf(_passed_down(n), "binary")("counts", "theirs").alias("kept"))
    replies = kept.groupBy(F.col("node").alias("shard")).agg(F.collect_list(F.struct("range", "kept")).alias("kept"))
    return union_, written(_advance(shard_table, replies, n), "shards")


def _phrases(counts: DataFrame, n: int) -> DataFrame:
    """(lang, phrase, words, a) of the sequences of a table of transducers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, c in zip(frame["lang"], frame["counts"]):
                a = Automaton.loads(c)
                rows, weights = a.rows(n)
                names = [x.decode("utf-8", "surrogatepass") for x in a.labels]
                phrases = [" ".join([names[i] for i in r]) for r in rows.tolist()]
                yield pd.DataFrame({"lang": [lang] * len(phrases), "phrase": phrases, "words": [n] * len(phrases), "a": weights.tolist()}, dtype=object)

    return counts.select("lang", "counts").mapInPandas(run, "lang string, phrase string, words int, a long")


def _looked_up(parts: DataFrame, counts: list[DataFrame], points: Points) -> DataFrame:
    """(lang, part, f): the distinct ``parts`` (lang, part) of a range are built into an acceptor and composed with its counts."""

    def place(lang: pd.Series, part: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(points[g], tuple(p.encode("utf-8", "surrogatepass").split(b" "))) for g, p in zip(lang, part)], dtype="int32")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        lang, _, n = key
        wanted = sorted({tuple(p.encode("utf-8", "surrogatepass").split(b" ")) for p in left["part"]})
        labels = sorted({w for p in wanted for w in p})
        at = {x: i for i, x in enumerate(labels)}
        f = np.zeros(len(wanted), dtype=np.int64)
        if wanted:
            rows = np.array([[at[w] for w in p] for p in wanted], dtype=np.int64)
            asked = Automaton.build(labels, rows, np.ones(len(rows), dtype=np.int64))
            for c in right["counts"]:
                f += asked.compose(Automaton.loads(c), int(n))
        names = [b" ".join(p).decode("utf-8", "surrogatepass") for p in wanted]
        return pd.DataFrame({"lang": [lang] * len(names), "part": names, "f": f.tolist()}, dtype=object)

    asked = parts.select("lang", "part", F.size(F.split("part", " ")).alias("words"), F.pandas_udf(place, "int")("lang", "part").alias("range"))
    every = reduce(DataFrame.unionAll, [c.select("lang", "range", F.lit(n).alias("words"), "counts") for n, c in enumerate(counts, 1)])
    return asked.groupBy("lang", "range", "words").cogroup(every.groupBy("lang", "range", "words")).applyInPandas(run, "lang string, part string, f long")


def scored(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate that no longer candidate takes the place of.

    ``docs`` has lang and text; null languages are ``und``, null texts have no words, no documents give no rows.  Repeated
    rows count each.  A text of any length is counted whole.  Other columns are not looked at.  Score:
    ``scale * a // (l + r)`` of the cut with the lowest score, of equal ones the first, computed in 38 decimal digits.
    """
    table = written(shards(docs, params), "shards")
    points, most = cut_points(table, params)
    totals = table.groupBy("lang").agg(F.sum("n").alias("n"))
    counts, left = [], table
    for n in range(1, params.longest + 1):
        one, left = counted(left, n, points, most, params)
        counts.append(one)
    phrases = reduce(DataFrame.unionAll, [_phrases(c, n) for n, c in enumerate(counts[1:], 2)])
    phrases = written(phrases, "phrases")
    words, size = F.split("phrase", " "), F.col("words")
    joined = lambda begin, length: F.array_join(F.slice(words, begin, length), " ")
    cuts = phrases.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": joined(F.lit(1), F.col("k")), "right": joined(F.col("k") + 1, size - F.col("k"))})
    parts = cuts.select("lang", F.explode(F.array("left", "right")).alias("part")).distinct()
    f = written(_looked_up(parts, counts, points), "parts")
    cuts = cuts.join(f.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(f.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(f"(cast(a AS decimal(19)) * {params.scale}) div (cast(l AS decimal(19)) + r)")
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    inner = phrases.where("words > 2").select(
        "lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))).alias("phrase")
    )
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.expr("cast(longer AS decimal(19)) * 100") < F.expr(f"cast(a AS decimal(19)) * {params.inside}")))
    return kept.join(totals, "lang").select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``scored``, each language's first ``Params.top`` by score, then a, both descending, then phrase in byte order: rank from 1."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(docs, params).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= params.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
