"""Benchmark decontamination: which short test items are inside which long documents?

The containment of an item is the share of its distinct word shingles that a document has.  Items are partitioned by
their number of shingles, doubling from class to class.  Of each item the index keeps its MinHash sketch: the k smallest
shingle hashes, k being more than the share of shingles that the largest item of the class may miss at the threshold.
So any document that contains enough of the item has at least one hash of the sketch; there is no false negative.  A
document looks its own shingle hashes up in the index and verifies each candidate by its shingles themselves.

Documents are never exchanged: the index travels to them, in blocks of at most ``Params.block_bytes`` of item text, one
pass over the documents for each block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rainshed.llm.common import bounded_batches, word_list
from rainshed.llm.simhash import shingle_hashes

BITS = 22


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    least: float = 0.8
    block_bytes: int = 8 << 20


class Index:
    """Sketches of a block of items, by the shingle length in words: items shorter than a shingle are one of their own."""

    def __init__(self, items: list[tuple[int | None, str]], params: Params):
        self.params = params
        self.ids: list[int | None] = []
        self.grams: list[set[bytes]] = []
        self.sketch: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = word_list(text)
            if not words:
                continue
            n = min(len(words), params.shingle)
            i = len(self.ids)
            self.ids.append(item_id)
            self.grams.append({b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)})
            hashes = np.unique(shingle_hashes(words, n))
            largest = (1 << len(hashes).bit_length()) - 1
            for h in hashes[: int((1 - params.least) * largest + 1e-9) + 1].tolist():
                self.sketch[n][h].append(i)
        self.maybe = {}
        for n, found in self.sketch.items():
            bits = np.zeros(1 << BITS, dtype=bool)
            bits[np.fromiter(found, dtype=np.uint64) & np.uint64((1 << BITS) - 1)] = True
            self.maybe[n] = bits

    def hits(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item, shared shingles, shingles of the item) of the items that the text contains."""
        words, out = word_list(text), []
        for n, sketch in self.sketch.items():
            if len(words) < n:
                continue
            hashes = shingle_hashes(words, n)
            likely = hashes[self.maybe[n][hashes & np.uint64((1 << BITS) - 1)]].tolist()
            candidates = {i for h in likely for i in sketch.get(h, ())}
            if candidates:
                own = {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}
                for i in candidates:
                    shared = len(self.grams[i] & own)
                    if shared >= self.params.least * len(self.grams[i]) - 1e-9:
                        out.append((self.ids[i], shared, len(self.grams[i])))
        return sorted(out, key=lambda x: (x[0] is None, x))


def blocks(items: DataFrame, params: Params) -> Iterator[list[tuple[int | None, str]]]:
    """The distinct items (item_id, text) with text, in blocks of about ``block_bytes``, one at a time on the driver."""
    known = items.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + 2 * size // params.block_bytes if size > params.block_bytes else 1
    for k in range(n):
        part = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        if rows := sorted(((r.item_id, r.text) for r in part.collect()), key=lambda x: (x[0] is None, x)):
            yield rows


def hits(text: Column, items: list[tuple[int | None, str]], params: Params) -> Column:
    """array<struct<item_id, shared, shingles>> of the block's items that the text contains."""

    @pandas_udf("array<struct<item_id:bigint,shared:int,shingles:int>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(items, params)
        for s in batches:
            yield pd.Series([[{"item_id": i, "shared": a, "shingles": b} for i, a, b in index.hits(x)] for x in s], dtype=object)

    return of(text)


def contained(documents: DataFrame, items: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, item_id, shared, shingles, containment) for each document row and distinct item of at least the threshold.

    Words are split at ASCII white space with A-Z lower-cased.  An item of fewer words than a shingle is one shingle; an
    item without words is in no document.  Null and empty texts contain nothing.  Repeated document rows repeat their
    pairs; repeated items count once.
    """
    bounded_batches(documents.sparkSession)
    found = [documents.select("doc_id", F.explode(hits(F.col("text"), b, params)).alias("h")) for b in blocks(items, params)]
    none = documents.sparkSession.createDataFrame([], documents.select("doc_id").schema).withColumn("h", F.lit(None).cast("struct<item_id:bigint,shared:int,shingles:int>"))
    pairs = reduce(DataFrame.unionByName, found, none)
    return pairs.select("doc_id", "h.item_id", "h.shared", "h.shingles", (F.col("h.shared") / F.col("h.shingles")).alias("containment"))


def clean(documents: DataFrame, items: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of ``documents`` that contain no item."""
    bounded_batches(documents.sparkSession)
    return reduce(lambda d, b: d.where(F.size(hits(F.col("text"), b, params)) == 0), blocks(items, params), documents)
