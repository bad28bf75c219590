"""SimHash near-duplicates: a grid join of per-segment bit counts under the Manhattan distance, verified exactly.

A fingerprint's 64 bits form 32 segments of two bits.  The count of set bits of each segment (0, 1 or 2) is written in
unary, so that the Manhattan distance of two count vectors is the number of differing bits of their embeddings; it is
never more than the Hamming distance.  The segments form ``Params.groups`` groups, more than the radius.  Counts that
differ by the radius at most agree on ``groups - radius`` whole groups, so every link meets in a cell of a grid over
the counts of some such choice of groups.  A pair is kept in the first choice it agrees on only, if the Manhattan bound
and then the exact distance hold.

Equal fingerprints are one node from the start, so copies make no pairs.  Links are thinned to a spanning forest of each
task before they are exchanged; connectivity stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rainshed.llm.common import bounded_batches, components, word_list, written

SEED = 42
SEGMENTS = 32
LOW = 0x5555555555555555


@dataclass(frozen=True)
class Params:
    """More groups: smaller cells, but more rows in the join (one for each choice of groups - radius of the groups)."""

    shingle: int = 4
    radius: int = 4
    groups: int = 7


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of each run of ``n`` words joined by one space; of the whole sequence if it is shorter; none without words."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    hashes = (digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()))
    return np.fromiter(hashes, dtype=np.uint64, count=len(words) - n + 1)


def fingerprint_of(text: str | None, n: int) -> int:
    """Bit b is set if it is set in more than half of the shingle hashes.  In signed 64-bit form."""
    return fingerprint_from(shingle_hashes(word_list(text), n))


def fingerprint_from(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[i : i + (1 << 15)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, n: int) -> Column:
    @pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([fingerprint_of(x, n) for x in s], dtype="int64")

    return of(text)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def group_masks(groups: int) -> list[int]:
    """The bits of each group of segments, as equal in size as can be."""
    cut = [SEGMENTS * g // groups for g in range(groups + 1)]
    return [_signed(sum(3 << (2 * s) for s in range(cut[g], cut[g + 1]))) for g in range(groups)]


def embedded(fp: Column) -> Column:
    """Counts of the two-bit segments in unary: low bit if at least one is set, high bit if both are."""
    low, shifted = F.lit(LOW), F.shiftrightunsigned(fp, 1)
    one = fp.bitwiseOR(shifted).bitwiseAND(low)
    two = fp.bitwiseAND(shifted).bitwiseAND(low)
    return one.bitwiseOR(F.shiftleft(two, 1))


def links(fingerprints: DataFrame, params: Params = Params()) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints (column fp) at ``radius`` or fewer differing bits, each once."""
    masks, keep = group_masks(params.groups), params.groups - params.radius
    if keep < 1:
        raise ValueError("groups must exceed radius")
    choices = list(combinations(range(params.groups), keep))
    e = embedded(F.col("fp"))
    cells = []
    for c in choices:
        mask = 0
        for g in c:
            mask |= masks[g]
        # groups before the choice's last one and outside it must differ, or an earlier choice has the pair
        differ = sum(1 << g for g in range(c[-1]) if g not in c)
        cells.append(F.struct(F.xxhash64(F.lit(len(cells)), e.bitwiseAND(F.lit(_signed(mask & ((1 << 64) - 1))))).alias("cell"), F.lit(differ).alias("differ"), F.lit(len(cells)).alias("choice")))
    rows = fingerprints.select("fp", F.explode(F.array(*cells)).alias("c")).select("fp", "c.cell", "c.differ", "c.choice")
    left = rows.select(F.col("fp").alias("a"), "cell", "differ", "choice")
    right = rows.select(F.col("fp").alias("b"), "cell", F.col("choice").alias("choice_b"))
    gap = embedded(F.col("a")).bitwiseXOR(embedded(F.col("b")))
    condition = (F.col("a") < F.col("b")) & (F.col("choice") == F.col("choice_b"))
    condition &= (F.bit_count(gap) <= params.radius) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= params.radius)
    for g, mask in enumerate(masks):
        condition &= (F.col("differ").bitwiseAND(F.lit(1 << g)) == 0) | (gap.bitwiseAND(F.lit(mask)) != 0)
    # Merged at every size: Spark sizes a table by what it was before the explode, and would broadcast all these rows.
    return left.join(right.hint("merge"), "cell").where(condition).select("a", "b")


def thinned(pairs: DataFrame, most: int = 500_000) -> DataFrame:
    """A spanning forest of the links that each task sees, in batches of ``most`` nodes: the same components from fewer rows."""

    def forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for frame in frames:
            kept = []
            for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    kept.append((a, b))
            yield pd.DataFrame(kept, columns=["a", "b"]).astype("int64")
            if len(parent) > most:
                parent = {}

    return pairs.mapInPandas(forest, "a bigint, b bigint")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``documents``.

    component_id is the smallest doc_id reachable over links, itself included; a null id is nobody's smallest, and is
    null only where a component has no other.  Null and empty texts have fingerprint zero and are linked like any other.
    Repeated rows and ids give a row each.  An empty table gives an empty result.
    """
    bounded_batches(documents.sparkSession)
    prints = written(documents.select("doc_id", fingerprint(F.col("text"), params.shingle).alias("fp")), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    joined = components(thinned(links(nodes.select("fp"), params)))
    named = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = named.join(smallest, "component").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
