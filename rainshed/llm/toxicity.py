"""Toxicity by multiple-instance learning: labels are on documents, scores on sentences.

A document is toxic if some sentence is: P(document) = 1 - product of (1 - P(sentence)), noisy-or.  A sentence's log
odds are a bias plus the weights of its distinct words, a word counting by itself and by its first letters, so that
inflected forms of a learned word are recognised.  The weights follow from the likelihood of the document labels alone,
by proximal gradient steps with an L1 penalty, which leaves ordinary words at exactly zero.  Scoring the sentences of a
document again locates the offending ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rainshed.llm.common import bounded_batches, labelled, labelled_sample

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Params:
    """The fit reads about ``most_rows`` labelled documents of each class, whole.  A sentence without a stop is cut
    every ``longest`` words.  Features in fewer than ``least`` documents are left out."""

    most_rows: int = 2000
    longest: int = 64
    least: int = 3
    steps: int = 150
    rate: float = 0.5
    penalty: float = 2e-4


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]
    longest: int
    empty: float


def features(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in PREFIXES if len(word) >= n]]


def sentences(text: str, longest: int) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, distinct words) in character positions."""
    for m in _SENTENCE.finditer(text):
        words = _WORD.findall(m.group().lower())
        if len(words) <= longest:
            if words:
                yield m.start(), m.end(), set(words)
            continue
        spans = list(_WORD.finditer(m.group()))
        for i in range(0, len(spans), longest):
            part = spans[i : i + longest]
            yield m.start() + part[0].start(), m.start() + part[-1].end(), {w.group().lower() for w in part}


def _grouped(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0)


def train(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, width: int, params: Params, weights: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """documents: feature numbers (repeats count) and how many of them each sentence has; no sentence is empty.
    ``weights`` of documents: what each stands for among all labelled ones."""
    counts = np.array([len(sizes) for _, sizes in documents])
    docs = np.flatnonzero(counts)
    y = labels[docs]
    stands = np.ones(len(docs)) if weights is None else weights[docs] * (len(docs) / weights[docs].sum())
    ids = np.concatenate([ids for ids, _ in documents]).astype(np.int64)
    sizes = np.concatenate([sizes for _, sizes in documents]).astype(np.int64)
    starts, owner = np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(len(sizes)), sizes)
    first, of = np.r_[0, np.cumsum(counts[docs])[:-1]], np.repeat(np.arange(len(docs)), counts[docs])
    prior = min(max((stands * y).mean(), 0.01), 0.99)
    bias = float(np.log(1 / max((1 - prior) ** (-len(docs) / len(sizes)) - 1, 1e-6)) * -1)
    w, square, square_bias = np.zeros(width), np.full(width, 1e-8), 1e-8
    for _ in range(params.steps):
        z = np.clip(bias + _grouped(w[ids], starts), -30, 30)
        p = 1 / (1 + np.exp(-z))
        keep = -np.logaddexp(0, z)  # log(1 - p)
        none = np.minimum(_grouped(keep, first), -1e-9)  # log(1 - P(document))
        some = 1 - np.exp(none)
        pull = (stands * (y * np.exp(none) / some - (1 - y)))[of] * p / len(docs)  # d loglik / d z; p = -d log(1-p) / dz
        g = np.bincount(ids, weights=pull[owner], minlength=width)
        square += g * g
        square_bias += pull.sum() ** 2
        pace = params.rate / np.sqrt(square)
        w += pace * g
        w = np.sign(w) * np.maximum(np.abs(w) - pace * params.penalty, 0)
        bias += 0.1 * params.rate / np.sqrt(square_bias) * pull.sum()
    return float(bias), w


def fit(documents: DataFrame, labels: DataFrame, params: Params = Params(), parts: int = 5, held: int = 0) -> Model:
    """Learns from labelled documents outside the held-out fold.  With labels of one class only, or none, every
    sentence-free score is the smoothed share of toxic labels and no word has a weight."""
    bounded_batches(documents.sparkSession)
    sample = labelled_sample(documents, labels, "toxic", parts, held, params.most_rows)

    @pandas_udf("array<string>")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([sorted({f for _, _, words in sentences(t or "", params.longest) for x in words for f in features(x)}) for t in s])

    rows = sample.select(F.explode(known("text")).alias("f")).groupBy("f").count().where(F.col("count") >= params.least).select("f")
    names = sorted(r.f for r in rows.collect())
    share = dict(sample.groupBy("label").count().collect())
    # The sample has a bound for each class; each of its documents stands for its share of the class, at every size.
    known = dict(labelled(labels, "toxic", parts, held).groupBy("label").count().collect())
    total = sum(known.values())
    prior = (known.get(1, 0) + 1) / (total + 2)
    if len(share) < 2 or not names:
        return Model(float(np.log(prior / (1 - prior))) if len(share) == 1 else -3.0, {}, params.longest, prior if total else 0.0)
    number = {f: i for i, f in enumerate(names)}

    @pandas_udf("ids binary, sizes binary")
    def numbered(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out = []
            for t in s:
                bags = [[number[f] for x in sorted(w) for f in features(x) if f in number] for _, _, w in sentences(t or "", params.longest)]
                bags = [x for x in bags if x]
                ids = np.array([i for x in bags for i in x], dtype=np.int32)
                out.append((ids.tobytes(), np.array([len(x) for x in bags], dtype=np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["ids", "sizes"])

    rows = sorted(sample.select("id", "label", numbered("text").alias("d")).collect(), key=lambda r: (r.id, r.label, bytes(r.d.ids)))
    documents = [(np.frombuffer(r.d.ids, dtype=np.int32), np.frombuffer(r.d.sizes, dtype=np.int32)) for r in rows]
    stands = np.array([known[r.label] / share[r.label] for r in rows])
    bias, w = train(documents, np.array([r.label for r in rows], dtype=float), len(names), params, stands)
    return Model(bias, {f: float(w[i]) for f, i in number.items() if w[i]}, params.longest, 0.0)


class _Weights(dict):
    """Word to the sum of its features' weights, remembered; forgotten when large, so memory is bounded."""

    def __init__(self, weights: dict[str, float], most: int = 400_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        total = sum(self.weights.get(f, 0.0) for f in features(word))
        self[word] = total
        return total


def scorer(model: Model, least: float = 0.5):
    """A function from a text to (score, [(start, end, sentence score)] of the sentences that score ``least`` or more)."""
    weight = _Weights(model.weights).__getitem__

    def of(text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        none, spans, seen = 0.0, [], False
        for start, end, words in sentences(text or "", model.longest):
            z = min(max(model.bias + sum(map(weight, words)), -30.0), 30.0)
            keep = -np.log1p(np.exp(z))
            none, seen = none + keep, True
            p = 1 - float(np.exp(keep))
            if p >= least:
                spans.append((start, end, p))
        return (1 - float(np.exp(none)) if seen else model.empty), spans

    return of


def score(documents: DataFrame, model: Model, column: str = "toxicity", least: float = 0.5) -> DataFrame:
    """``documents`` with struct ``column``: score, spans (start, end, score of the offending sentences, character
    positions counted from 0).  All rows and columns stay.  Null, empty and word-free texts score 0 without spans."""
    bounded_batches(documents.sparkSession)

    @pandas_udf("score double, spans array<struct<start:int,end:int,score:double>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = scorer(model, least)
        for s in batches:
            found = [of(x) for x in s]
            yield pd.DataFrame({"score": [x[0] for x in found], "spans": [[{"start": a, "end": b, "score": p} for a, b, p in x[1]] for x in found]})

    return documents.withColumn(column, scored(F.col("text")))
