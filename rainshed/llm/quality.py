"""Quality by compression: one zstandard dictionary from good text, one from bad; which of them fits a text better?

A document is compressed whole with either dictionary.  The difference of the two sizes, divided by the text's length,
and the smaller of the two ratios (text that repeats itself fits any dictionary) are turned into a probability of good
quality by a logistic calibration, fitted on labelled documents that went into neither dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rainshed.llm.common import bounded_batches, fold, labelled_sample, share


@dataclass(frozen=True)
class Params:
    """most_rows bounds the labelled documents of a class that the fit reads; half of them go into the
    dictionaries, whole, in pieces of ``piece`` characters; of a class with more than ``most_rows`` pieces about so many
    are taken, from anywhere in the texts.  The other half are measured whole for the calibration."""

    most_rows: int = 3000
    piece: int = 8192
    dictionary_bytes: int = 112_640
    level: int = 3
    ridge: float = 1e-3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    level: int
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; the raw texts themselves where there are too few to train on."""
    whole = sum(map(len, texts))
    if len(texts) >= 8 and whole >= 8 * 1024:
        try:
            return zstandard.train_dictionary(min(size, whole // 4), texts).as_bytes()
        except zstandard.ZstdError:  # too little in common to train on
            pass
    return b"\n".join(texts)[:size]


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    if len(content) < 8:
        return zstandard.ZstdCompressor(level=level, write_content_size=False)
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False)


def measures(good: bytes, bad: bytes, level: int):
    """A function from texts to an array (texts, 2): size difference over length, smaller size over length."""
    g, b = _compressor(good, level), _compressor(bad, level)

    def of(texts) -> np.ndarray:
        out = np.zeros((len(texts), 2))
        for i, text in enumerate(texts):
            data = text.encode("utf-8", "surrogatepass") if text else b""
            if data:
                x, y = len(g.compress(data)), len(b.compress(data))
                out[i] = (x - y) / len(data), min(x, y) / len(data)
        return out

    return of


def logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Newton steps for a ridge logistic regression with an intercept in column 0."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame, params: Params = Params(), parts: int = 5, held: int = 0) -> Model:
    """Learns from labelled documents outside the held-out fold.  Without labels of both classes the score is the share
    of good labels (one half without any)."""
    bounded_batches(documents.sparkSession)
    sample = labelled_sample(documents, labels, "quality", parts, held, params.most_rows)
    size = F.lit(params.piece)
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), size), lambda i: F.substring(F.col("text"), i + 1, size))
    teach = sample.where("part < 0.5 AND text IS NOT NULL")
    rate = F.lit(0.0)
    for value, n in teach.groupBy("label").agg(F.sum(F.size(pieces))).collect():
        rate = F.when(F.col("label") == value, params.most_rows / n).otherwise(rate)
    teach = teach.select("id", "label", F.posexplode(pieces).alias("at", "text")).where(share(F.struct("id", "at")) < rate)
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for row in sorted(teach.select("id", "label", "at", "text").collect()):
        texts[row.label].append(row.text.encode("utf-8", "surrogatepass"))
    good, bad = (dictionary(texts[k], params.dictionary_bytes) for k in (1, 0))

    @pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = measures(good, bad, params.level)
        for s in batches:
            yield pd.Series(list(of(s)))

    counts = dict(sample.groupBy("label").count().collect())
    held_back = sample.where("part >= 0.5").select("id", "label", measured("text").alias("m")).collect()
    rows = sorted(held_back, key=lambda r: (r.id, r.label, r.m))
    y = np.array([r.label for r in rows], dtype=float)
    if len(set(y)) < 2:
        good_share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return Model(good, bad, params.level, (0.0, 0.0), (1.0, 1.0), (float(np.log(good_share / (1 - good_share))), 0.0, 0.0))
    x = np.array([r.m for r in rows])
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != held))
    sizes = known.groupBy(F.col("quality").cast("int").alias("q")).count()
    prior = dict(sizes.collect())
    z = np.c_[np.ones(len(x)), (x - centre) / scale]
    w = logistic(z, y, params.ridge)
    # the sample is balanced by its bound; the intercept goes back to the shares of all labels outside the held-out fold
    w[0] += np.log(max(prior.get(1, 1), 1) / max(prior.get(0, 1), 1)) - np.log(y.mean() / (1 - y.mean()))
    return Model(good, bad, params.level, tuple(map(float, centre)), tuple(map(float, scale)), tuple(map(float, w)))


def score(documents: DataFrame, model: Model, column: str = "quality_score") -> DataFrame:
    """``documents`` with the probability of good quality of each whole text.  All rows and columns stay.

    Null and empty texts get the calibrated score of a text that both dictionaries fit equally.
    """
    bounded_batches(documents.sparkSession)

    @pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of, w = measures(model.good, model.bad, model.level), np.array(model.weights)
        for s in batches:
            z = w[0] + ((of(s) - np.array(model.centre)) / np.array(model.scale)) @ w[1:]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return documents.withColumn(column, scored(F.col("text")))
