"""Hard-negative mining by coordinate pruning of inner-product search.

Index.  Rows are ranged by length into buckets of ``Params.rows``, longest first.  A bucket stores its vectors as integers,
its greatest length and, for every coordinate of the vectors scaled to length one, the list of rows sorted by it.  All
buckets are written once.

Search for scores of at least t.  A bucket whose greatest length l has |q| l < t cannot hold one; the others meet a row only
at a cosine of c = t / (|q| l) or more.  For each of the anchor's few greatest coordinates, that bounds a row's coordinate
x from both sides: between a c - s and a c + s, s = sqrt((1 - a a)(1 - c c)), a the anchor's coordinate.  The stretches of
the sorted lists are intersected; what is left is verified by exact integer products.

Two searches: the best rows of an anchor's label; then, for the window of scores that each of these allows, the best rows of
other labels.  A hashed sample of bounded size gives each anchor a first t; results are exact whatever it holds.  Anchors
are laid out by the length they need, so a block of anchors meets the buckets at least that long and no other; buckets are
never copied to blocks that need none of their rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainshed.llm.common import bounded_batches, share, written
from rainshed.llm.topk import integers


@dataclass(frozen=True)
class Params:
    positives: int = 5
    negatives: int = 3
    low: int = 50  #: per cent of the positive's score
    high: int = 95
    rows: int = 4096  #: of a length bucket
    anchors: int = 1024  #: of a block
    focus: int = 4  #: coordinates
    sample: int = 2048  #: rows that give the first thresholds


def matrix(arrays: pd.Series) -> np.ndarray:
    out = np.zeros((len(arrays), max(map(len, arrays), default=0)), dtype=np.int64)
    for i, a in enumerate(arrays):
        out[i, : len(a)] = a
    return out


@dataclass
class Bucket:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray  #: (n, d)
    longest: float
    sorted_rows: np.ndarray  #: (d, n): rows by ascending scaled coordinate
    sorted_values: np.ndarray  #: (d, n)

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lengths: np.ndarray) -> Bucket:
        unit = (vectors / np.where(lengths > 0, lengths, 1)[:, None]).T
        order = np.argsort(unit, axis=1, kind="stable")
        return cls(ids, labels, vectors, float(lengths.max(initial=0)), order.astype(np.int32), np.take_along_axis(unit, order, axis=1))

    def candidates(self, q: np.ndarray, length: float, least: float, focus: int) -> np.ndarray:
        """Rows whose product with ``q`` may be ``least`` or more; no other row's can."""
        n, every = len(self.ids), np.arange(len(self.ids))
        if least <= 0 or not n:
            return every
        reach = length * self.longest
        if reach * (1 + 1e-9) < least:
            return every[:0]
        c = min(least / reach, 1.0)
        a = q[: len(self.sorted_rows)] / length
        hits = np.zeros(n, dtype=np.int64)
        used = 0
        for f in np.argsort(-np.abs(a), kind="stable")[:focus].tolist():
            x = min(max(float(a[f]), -1.0), 1.0)
            spread = math.sqrt(max((1 - x * x) * (1 - c * c), 0.0)) + 1e-6
            low = x * c - spread if x > -c else -1.0
            high = x * c + spread if x < c else 1.0
            i, j = np.searchsorted(self.sorted_values[f], [low - 1e-6, high + 1e-6], side="left")
            if j - i < n:
                hits[self.sorted_rows[f][i:j]] += 1
                used += 1
        return np.flatnonzero(hits == used) if used else every

    @cached_property
    def _doubles(self) -> np.ndarray:
        return self.vectors.astype(np.float64)

    def scores(self, q: np.ndarray, length: float, rows: np.ndarray) -> np.ndarray:
        """Exact products: no partial sum is beyond the product of the lengths, which fits 53 or else 62 bits."""
        w = min(len(q), self.vectors.shape[1])
        if length * self.longest < 2.0**52:
            return (self._doubles[rows, :w] @ q[:w].astype(np.float64)).astype(np.int64)
        return self.vectors[rows, :w] @ q[:w]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def prepared(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    """(vec_id, label, v, length, asks) of the rows that take part.

    A vector of a length from 2^31 on could give products beyond 64 bits: the job ends with an error that says so.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), integers(F.col("embedding")).alias("v"), is_anchor.alias("asks"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    checked = F.when(length < 2.0**31, length).otherwise(F.raise_error(F.lit("a vector's length is beyond 2^31: scores would pass 64 bits")).cast("double"))
    return rows.withColumn("length", checked)


def index(rows: DataFrame, n: int, params: Params) -> DataFrame:
    """(bucket, longest, data): numbers of buckets ascend as their greatest lengths descend."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not (some := list(frames)):
            return
        frame = pd.concat(some, ignore_index=True).sort_values("length", ascending=False, kind="stable")
        for at in range(0, len(frame), params.rows):
            some = frame.iloc[at : at + params.rows]
            b = Bucket.of(some["vec_id"].to_numpy(np.int64), some["label"].to_numpy(np.int64), matrix(some["v"]), some["length"].to_numpy(np.float64))
            number = (TaskContext.get().partitionId() << 32) + at // params.rows
            yield pd.DataFrame({"bucket": [number], "longest": [b.longest], "data": [pickle.dumps(b, protocol=5)]})

    ranged = rows.select("vec_id", "label", "v", "length").repartitionByRange(-(-max(n, 1) // params.rows), F.desc("length"), "vec_id")
    return written(ranged.mapInPandas(run, "bucket long, longest double, data binary"), "buckets")


@dataclass
class Want:
    """A window of scores; ``least``: as many as are wanted are known to score so much."""

    slot: int
    low: int
    high: int
    least: int


@dataclass
class Anchor:
    anchor: int
    vec_id: int
    label: int
    v: np.ndarray
    length: float
    wants: list[Want]

    @property
    def need(self) -> float:
        """The length that a bucket must have."""
        least = min(w.least for w in self.wants)
        if least <= 0:
            return -math.inf
        return least / self.length * (1 - 1e-9) if self.length > 0 else math.inf


def found_in(bucket: Bucket, a: Anchor, same: bool, k: int, focus: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, slot, vec_id, score): the bucket's k best of each window."""
    rows = bucket.candidates(a.v, a.length, min(w.least for w in a.wants), focus)
    rows = rows[((bucket.labels[rows] == a.label) == same) & (bucket.ids[rows] != a.vec_id)]
    if not len(rows):
        return
    scores, ids = bucket.scores(a.v, a.length, rows), bucket.ids[rows]
    for w in a.wants:
        fits = np.flatnonzero((scores >= max(w.low, w.least)) & (scores <= w.high))
        for i in fits[best(scores[fits], ids[fits], k)].tolist():
            yield a.anchor, w.slot, int(ids[i]), int(scores[i])


def searched(anchors: DataFrame, buckets: DataFrame, sample: Bucket, same: bool, k: int, params: Params) -> DataFrame:
    """(anchor, slot, vec_id, score, rank): for each window of each anchor the k best rows, of its label or of others.

    ``anchors``: anchor, vec_id, label, v, length and wants, an array of (slot, low, high).
    """
    spark = anchors.sparkSession

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for anchor, vec_id, label, v, length, wants in frame[["anchor", "vec_id", "label", "v", "length", "wants"]].itertuples(index=False):
                a = Anchor(anchor, vec_id, label, np.asarray(v, dtype=np.int64), length, [Want(w["slot"], w["low"], w["high"], w["low"]) for w in wants])
                others = np.flatnonzero(((sample.labels == label) == same) & (sample.ids != vec_id))
                scores = sample.scores(a.v, length, others)
                for w in a.wants:
                    fits = scores[(scores >= w.low) & (scores <= w.high)]
                    if len(fits) >= k:
                        w.least = int(np.partition(fits, len(fits) - k)[len(fits) - k])
                rows.append((a.need, pickle.dumps(a, protocol=5)))
            yield pd.DataFrame(rows, columns=["need", "data"])

    def block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not (some := list(frames)):
            return
        frame = pd.concat(some, ignore_index=True).sort_values("need", kind="stable")
        for at in range(0, len(frame), params.anchors):
            some = frame.iloc[at : at + params.anchors]
            number = (TaskContext.get().partitionId() << 32) + at // params.anchors
            yield pd.DataFrame({"block": [number], "need": [some["need"].iloc[0]], "anchors": [pickle.dumps([pickle.loads(d) for d in some["data"]], protocol=5)]})

    bounded_batches(spark)
    n = anchors.count()
    asked = anchors.mapInPandas(first, "need double, data binary").repartitionByRange(-(-max(n, 1) // params.anchors), "need", F.xxhash64("data"))
    blocks = written(asked.mapInPandas(block, "block long, need double, anchors binary"), "blocks")
    known = sorted(buckets.select("bucket", "longest").toLocalIterator())  # two numbers for every ``params.rows`` rows
    numbers, longest = [b for b, _ in known], np.array([x for _, x in known])

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b, need in zip(frame["block"], frame["need"]):
                m = int(np.searchsorted(-longest, -need, side="right"))
                yield pd.DataFrame({"block": b, "bucket": numbers[:m]}).astype("int64")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for bucket, some in zip(frame["data"], frame["anchors"]):
                b = pickle.loads(bucket)
                rows = [r for a in pickle.loads(some) if a.need <= b.longest for r in found_in(b, a, same, k, params.focus)]
                yield pd.DataFrame(rows, columns=["anchor", "slot", "vec_id", "score"]).astype("int64")

    pairs = blocks.select("block", "need").mapInPandas(meet, "block long, bucket long")
    met = buckets.select("bucket", "data").repartition(max(len(known), 1), "bucket").join(pairs, "bucket").join(blocks.select("block", "anchors"), "block")
    found = met.select("data", "anchors").mapInPandas(search, "anchor long, slot long, vec_id long, score long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sampled(rows: DataFrame, n: int, params: Params) -> Bucket:
    """A hashed sample of about ``params.sample`` rows, at most 2^21 components, for first thresholds only."""
    width = max(rows.agg(F.max(F.size("v"))).first()[0] or 1, 1)
    most = max(min(params.sample, (1 << 21) // width), 1)
    some = rows.where(share(F.col("vec_id")) < most / max(n, 1)).select("vec_id", "label", "v", "length").distinct().limit(2 * most).toPandas()
    return Bucket.of(some["vec_id"].to_numpy(np.int64), some["label"].to_numpy(np.int64), matrix(some["v"]), some["length"].to_numpy(np.float64))


def hard_negatives(vectors: DataFrame, is_anchor: Column, params: Params = Params()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``is_anchor`` holds.

    ``vectors`` has vec_id, embedding and label.  A component x counts as floor(256 x).  An anchor's positives are its
    ``positives`` best other rows of the same label; a positive's negatives are the ``negatives`` best rows of other labels
    that score ``low`` to ``high`` per cent of it.  Ties go to the smaller vec_id.  Rows with a null vec_id, label or vector,
    or with a null or non-finite component, take no part; shorter vectors count as padded with zeros.  A repeated row is a
    candidate each time, a repeated anchor is answered once.  No rows, no anchors or no positives give no rows.  Vectors so
    long that scores could pass 64 bits end the job with an error.  Other columns are not looked at.
    """
    rows = written(prepared(vectors, is_anchor), "vectors")
    n = rows.count()
    buckets, sample = index(rows, n, params), sampled(rows, n, params)
    distinct = rows.where("asks").select("vec_id", "label", "v", "length").distinct()
    anchors = written(distinct.select(F.monotonically_increasing_id().alias("anchor"), "*"), "anchors")
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("slot"), F.lit(-(1 << 62)).cast("long").alias("low"), F.lit(1 << 62).cast("long").alias("high")))
    near = searched(anchors.withColumn("wants", all_), buckets, sample, True, params.positives, params)
    positives = written(near.select("anchor", F.col("rank").cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    exact = F.col("positive_score").cast("decimal(19)")
    low, high = F.ceil(exact * params.low / 100).cast("long"), F.floor(exact * params.high / 100).cast("long")
    windows = positives.select("anchor", F.struct("slot", low.alias("low"), high.alias("high")).alias("want")).where("want.low <= want.high")
    wants = windows.groupBy("anchor").agg(F.collect_list("want").alias("wants"))  # at most ``positives``
    far = searched(anchors.join(wants, "anchor"), buckets, sample, False, params.negatives, params)
    named = far.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    return named.join(positives, ["anchor", "slot"]).join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
