"""One document of each group of near copies: pairs from two kinds of fingerprints, each verified by exact similarity.

Candidates are the pairs that the SimHash grid join links (``simhash.links``), which finds near-identical texts, and pairs
that agree on a band of MinHash values, which finds the rest: 64 bits within a radius that a grid can serve hold a fifth
of the pairs of similarity 0.9 only.  A candidate counts if the two texts' sets of word shingles have a Jaccard similarity
of ``Params.least`` or more.  Equal texts are one node from the start.

A band that many texts share is never paired out.  Its texts meet its centre, the one that shares most bands with most
texts.  A band whose texts are all in one component then is done.  The texts of the others are joined exactly by a prefix
filter (``alike``): texts of similarity ``Params.least`` have one of their rarest shingles in common, so the many texts
that differ from a group each in its own way meet nobody.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rainshed.llm import simhash
from rainshed.llm.common import bounded_batches, components, sized, word_list, written


@dataclass(frozen=True)
class Params:
    """At a similarity of 0.8 a pair shares at least one of 20 bands of 7 values with a chance of 0.991."""

    shingle: int = 5
    least: float = 0.8
    bands: int = 20
    rows: int = 7
    grid: simhash.Params = simhash.Params(shingle=5)
    step: float = 1.05  #: ratio of two size classes of the prefix filter
    batch: int = 1 << 20  #: bytes of a batch that goes to a Python worker; hashes of its shingles come back, several times as many


@lru_cache(maxsize=4)
def _turns(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    flip, turn = rng.integers(0, 1 << 63, (2, n, 1), dtype=np.int64).astype(np.uint64)
    return flip, turn | np.uint64(1)


def band_keys(hashes: np.ndarray, params: Params) -> list[int]:
    """A 63-bit key for each band of MinHash values; a text without shingles has none."""
    if not len(hashes):
        return []
    flip, turn = _turns(params.bands * params.rows)
    least = np.full(len(flip), np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[None, i : i + 4096] ^ flip) * turn).min(axis=1))
    wide = least.reshape(params.bands, params.rows)
    return [xxhash.xxh64_intdigest(wide[b].tobytes(), b) >> 1 for b in range(params.bands)]


def shingles(words: list[bytes], n: int) -> set[bytes]:
    """Runs of n words; the whole sequence if it is shorter; none without words."""
    if not words:
        return set()
    return {b" ".join(words[k : k + n]) for k in range(max(len(words) - n + 1, 1))}


def with_prints(documents: DataFrame, params: Params) -> DataFrame:
    """``documents`` with _llm_row, _llm_text (digest of the words), _llm_fp and _llm_bands."""

    @pandas_udf("words string, fp bigint, bands array<bigint>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out = []
            for text in s:
                words = word_list(text)
                hashes = simhash.shingle_hashes(words, params.shingle)
                out.append((xxhash.xxh3_128_hexdigest(b" ".join(words)), simhash.fingerprint_from(hashes), band_keys(hashes, params)))
            yield pd.DataFrame(out, columns=["words", "fp", "bands"])

    p = F.col("_llm_p")
    rows = documents.withColumn("_llm_row", F.monotonically_increasing_id()).withColumn("_llm_p", of("text"))
    return rows.withColumns({"_llm_text": p["words"], "_llm_fp": p["fp"], "_llm_bands": p["bands"]}).drop("_llm_p")


def verified(pairs: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """(a, b, similar) of each pair (a, b) of rows, from the whole texts (node, text)."""

    @pandas_udf("boolean")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, mine = None, set()
        for a, x, y in batches:
            out = []
            for i, left, right in zip(a.tolist(), x, y):
                if i != last:  # the same text meets many others
                    last, mine = i, shingles(word_list(left), params.shingle)
                theirs = shingles(word_list(right), params.shingle)
                shared = len(mine & theirs)
                out.append(shared >= params.least * (len(mine) + len(theirs) - shared) - 1e-9)
            yield pd.Series(out, dtype=bool)

    pairs = written(pairs, "pairs")
    named = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "named")
    few = written(texts.join(sized(named, named.count()), "node", "left_semi"), "texts")  # whole texts are only exchanged if they are in a pair
    x, y = (few.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}")) for n in ("a", "b"))
    # Merged at every size: copies shrink so much in a file that its size says nothing about the texts in memory.
    both = pairs.join(y.hint("merge"), "b").join(x.hint("merge"), "a")
    return both.select("a", "b", similar("a", "text_a", "text_b").alias("similar"))


def linked(nodes: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """(a, b): verified links between ``nodes`` (node, fp, bands) that join all that any chain of candidates joins."""
    smallest = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    same = nodes.join(smallest, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = simhash.thinned(simhash.links(nodes.select("fp").distinct(), params.grid))
    one, two = (smallest.select(F.col("fp").alias(f), F.col("first").alias(n)) for f, n in (("a", "x"), ("b", "y")))
    near = near.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    bands = written(nodes.select("node", F.explode("bands").alias("band")), "bands")
    several = bands.join(bands.groupBy("band").count().where("count > 1"), "band")
    bands = written(several.join(several.groupBy("node").agg(F.sum("count").alias("met")), "node"), "shared")
    centre = bands.groupBy("band").agg(F.max_by("node", F.struct("met", -F.col("node"))).alias("centre"))
    star = bands.join(centre, "band").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    met = same.unionAll(near).unionAll(star).distinct()
    found = written(verified(met, texts, params).where("similar").select("a", "b"), "found")
    left = written(undecided(bands, found), "undecided")
    return found.unionAll(verified(alike(left, texts, params), texts, params).where("similar").select("a", "b"))


def undecided(bands: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component) of the texts in bands (band, node) whose texts are in several components of the links found."""
    of = components(found)
    named = written(bands.join(of, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")), "named")
    several = named.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return named.join(several.select("band"), "band", "left_semi").select("node", "component").distinct()


def alike(nodes: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """(a, b): all pairs of ``nodes`` (node, component) of different components that can be similar, by a prefix filter.

    The shingles of a text are ranked, those of one component only first, then by the number of texts that have them.
    Sets of n and m shingles are similar if they share t = least / (1 + least) * (n + m); so the first one they share is
    at a place of n - t and m - t at most.  Texts meet by shingle and by the size class of the smaller one, which bounds
    the places of both before they are joined.  Texts of the component that a shingle is most frequent in do not meet.
    """
    least, step = params.least, params.step

    @pandas_udf("array<bigint>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([np.unique(simhash.shingle_hashes(word_list(t), params.shingle)).view(np.int64) for t in s])

    def need(n: Column, m: Column) -> Column:
        return least / (1 + least) * (n + m) - 1e-6

    def size_class(n: Column) -> Column:
        return F.floor(F.log(n) / float(np.log(step))).cast("int")

    # Else Spark also filters by the hashes' size below the explode: each text is hashed twice, by two workers of a task.
    once = hashes.asNondeterministic()
    few = texts.join(nodes.select("node"), "node", "left_semi").select("node", once("text").alias("all"))
    grams = written(few.select("node", F.size("all").alias("n"), F.explode("all").alias("s")).join(nodes, "node"), "grams")
    each = grams.groupBy("s", "component").count().groupBy("s")
    kinds = each.agg(F.sum("count").alias("df"), (F.count("*") > 1).alias("shared"), F.max_by("component", F.struct("count", "component")).alias("main"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("shared", "df", "s")) - 1
    n, at = F.col("n"), F.col("place")
    ranked = grams.join(kinds.hint("merge"), "s").withColumn("place", place).where(F.col("shared") & (at <= n - need(n, least * n)))
    ranked = written(ranked.select("node", "component", "n", "s", "place", (F.col("main") == F.col("component")).alias("main")), "prefixes")
    small = ranked.where(at <= n - need(n, n)).withColumn("class", size_class(n))
    classes = F.sequence(size_class(least * n - 1e-6), size_class(n))
    large = ranked.withColumn("class", F.explode(classes)).where(at <= n - need(n, F.pow(F.lit(step), F.col("class"))))
    large = large.select("s", "class", *[F.col(c).alias(f"{c}_b") for c in ("node", "component", "n", "place", "main")])
    t = need(n, F.col("n_b"))
    fits = (n <= F.col("n_b")) & (F.col("component") != F.col("component_b")) & (at <= n - t) & (F.col("place_b") <= F.col("n_b") - t)
    sides = [(small.where("NOT main"), large), (small.where("main"), large.where("NOT main_b"))]
    # Merged at every size: Spark sizes the larger texts' rows by what they were before the explode, and would broadcast them.
    met = [x.join(y.hint("merge"), ["s", "class"]).where(fits).select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")) for x, y in sides]
    return met[0].unionAll(met[1]).distinct()


def deduplicated(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """``documents`` with one row of each group: that of its smallest id (of its smallest texts, if the id repeats).

    Texts without words are equal to one another and similar to no other.  Texts of fewer words than a shingle are similar
    only if equal.  Null ids come last.  Repeated rows are copies.  An empty table stays empty; a very long text is read
    whole; clashing columns stay as they are.
    """
    bounded_batches(documents.sparkSession, params.batch)
    rows = written(with_prints(documents, params), "prints")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text", "source").alias("h"), F.col("_llm_row").alias("row"))
    best = rows.groupBy("_llm_text").agg(F.min(rank).alias("first"), F.first("_llm_fp").alias("fp"), F.first("_llm_bands").alias("bands"))
    nodes = written(best.select(F.col("first.row").alias("node"), "first", "fp", "bands"), "nodes")
    texts = rows.select(F.col("_llm_row").alias("node"), "text")
    of = components(linked(nodes.select("node", "fp", "bands"), texts, params))
    named = nodes.join(of, "node", "left").select("first", F.coalesce("component", "node").alias("component"))
    stays = named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_llm_row"))
    stays = written(stays, "stays")  # its size is known then, and texts are not exchanged for a small one
    return rows.join(sized(stays, stays.count()), "_llm_row", "left_semi").select(*[F.col(c) for c in documents.columns])
