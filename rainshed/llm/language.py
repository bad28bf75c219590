"""Language identification: compress a text with a raw-content dictionary of each language and take the smallest.

Letters only, lower-cased, with one space between words, on both sides: marks and digits say little about a language.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rainshed.llm.common import bounded_batches

UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Params:
    """The fit learns about ``most_rows`` pieces of ``piece`` characters of each language, from anywhere in the texts of
    all documents: that bounds a dictionary.  Equal pieces of the sample count once.  A prediction is accepted if the
    second-best size exceeds the best by the share ``margin`` at least."""

    most_rows: int = 600
    piece: int = 1024
    level: int = 5
    margin: float = 0.02


@dataclass(frozen=True)
class Model:
    dictionaries: tuple[tuple[str, bytes], ...]
    level: int
    margin: float


def letters(text: str) -> bytes:
    return _OTHER.sub(" ", text).strip().lower().encode("utf-8", "surrogatepass")


def fit(documents: DataFrame, params: Params = Params()) -> Model:
    """One dictionary for each non-null lang of ``documents``; pieces are chosen and ordered by hashes of the id and place."""
    known = documents.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    size = F.lit(params.piece)
    places = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), size)
    rate = F.lit(0.0)
    for lang, n in known.groupBy("lang").agg(F.sum(F.size(places))).collect():
        rate = F.when(F.col("lang") == lang, params.most_rows / n).otherwise(rate)
    hashed = lambda at: F.xxhash64(F.coalesce("doc_id", F.lit(0)), at)
    chosen = F.filter(places, lambda at: F.pmod(hashed(at), F.lit(1 << 31)) / F.lit(float(1 << 31)) < rate)
    few = known.withColumn("at", F.explode(chosen))
    few = few.select(hashed(F.col("at")).alias("h"), "lang", F.substring(F.col("text"), F.col("at") + 1, size).alias("text"))
    texts: dict[str, dict[bytes, None]] = defaultdict(dict)
    for row in sorted(few.collect()):
        texts[row.lang][letters(row.text)] = None
    joined = {k: b" ".join(v) for k, v in texts.items()}
    return Model(tuple(sorted(joined.items())), params.level, params.margin)


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    if len(content) < 8:
        return zstandard.ZstdCompressor(level=level, write_content_size=False)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False)


def classifier(model: Model):
    """A function from a text to (language, score, accepted)."""
    by_language = [(k, _compressor(v, model.level)) for k, v in model.dictionaries]

    def of(text: str | None) -> tuple[str, float, bool]:
        if not text or not by_language or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        data = letters(text)
        sizes = sorted((len(c.compress(data)), k) for k, c in by_language)
        best = sizes[0][0]
        second = sizes[1][0] if len(sizes) > 1 else 2 * best
        return sizes[0][1], 1 - best / second, second >= best * (1 + model.margin)

    return of


def predict(documents: DataFrame, model: Model, column: str = "language") -> DataFrame:
    """``documents`` with struct ``column``: lang, score (1 - best size / second size), accepted.  All rows stay.

    Null texts and texts without a letter are ``und``, score 0, not accepted.  Equal sizes: the smaller code wins, with
    score 0.  A narrow margin leaves the best language in place and says accepted = false.
    """
    bounded_batches(documents.sparkSession)

    @pandas_udf("lang string, score double, accepted boolean")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = classifier(model)
        for s in batches:
            yield pd.DataFrame([of(x) for x in s], columns=["lang", "score", "accepted"])

    return documents.withColumn(column, predicted(F.col("text")))
