"""Many models over the same rows, fitted together.

Rows of all parts (a fold and a horizon, say) are packed into blocks once.  A step of every model that is still being
fitted is one pass over the blocks: a task adds up what each model needs over its blocks, sums meet by model, and only
vectors of the length of the predictors (logistic models) or one best split a node and predictor (trees) reach the driver.
Boosted trees take thousands of passes; where a part has at most ``ALONE`` rows, a task grows a model's whole forest.

Logistic models with an elastic net: proximal Newton steps.  Boosted trees: predictors are binned once to byte codes, the
last code stands for a missing value; trees grow best gain first up to a number of leaves, from histograms of gradient
and curvature; each split learns the side of missing values; leaves are shrunk by ``l2``.
"""

from __future__ import annotations

import heapq
import math
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainshed.operators.distributed import exact_quantiles, quantile_grid
from rainshed.sources.integrity import written

MISSING = 255  #: the code of a missing value
BUCKETS = 16  #: groups in which the sums of all models meet
ALONE = 1 << 16  #: rows of a part whose boosted models are grown by one task each
PASS = 1 << 18  #: rows times models of a task of a boosting pass
STATE = "part int, margins long, data binary"


def _sigmoid(m: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(m))
    return np.where(m >= 0, 1.0, e) / (1.0 + e)


def _losses(m: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.log1p(np.exp(-np.abs(m))) + np.maximum(m, 0.0) - y * m


def pack(rows: DataFrame, part: str, y: str, weights: Sequence[str], columns: Sequence[str], size: int = 1 << 16) -> DataFrame:
    """(part, data): blocks of at most about ``size`` rows of one part.  Missing predictors are NaN; labels have no gaps."""
    doubles = [y, *weights, *columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, list[np.ndarray]] = {}

        def block(p: int) -> pd.DataFrame:
            a = np.concatenate(kept.pop(p))
            k = 1 + len(weights)
            return pd.DataFrame({"part": [p], "data": [pickle.dumps((a[:, k:], a[:, 0], a[:, 1:k]), protocol=5)]})

        for frame in frames:
            for p, some in frame.groupby("part"):
                kept.setdefault(int(p), []).append(some[doubles].to_numpy(dtype=np.float64, na_value=np.nan))
                if sum(map(len, kept[int(p)])) >= size:
                    yield block(int(p))
        for p in list(kept):
            yield block(p)

    chosen = rows.where(F.col(y).isNotNull()).select(F.col(part).cast("int").alias("part"), *[F.col(c).cast("double").alias(c) for c in doubles])
    return chosen.mapInPandas(run, "part int, data binary")


def summed(blocks: DataFrame, of: Callable[[int, tuple], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """Per key the sum of the vectors that ``of(part, block)`` yields; added in the order of the tasks, so reruns agree."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for frame in frames:
            for part, data in zip(frame["part"], frame["data"]):
                for key, v in of(part, pickle.loads(data)):
                    acc[key] = acc[key] + v if key in acc else v
        task = TaskContext.get().partitionId()
        yield pd.DataFrame([(k, k % BUCKETS, task, v.tobytes()) for k, v in acc.items()], columns=["key", "bucket", "task", "v"])

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        out = [(k, sum(map(np.frombuffer, some.sort_values("task")["v"])).tobytes()) for k, some in frame.groupby("key")]
        return pd.DataFrame(out, columns=["key", "v"])

    parts = blocks.mapInPandas(add, "key long, bucket int, task int, v binary")
    found = parts.groupBy("bucket").applyInPandas(meet, "key long, v binary").collect()
    return {r["key"]: np.frombuffer(r["v"]) for r in found}


# ---- logistic models ---------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Logistic:
    """``weight``: number of the weight column, None: rows count alike.  Penalty: lambda = 1 / (c * sum of weights)."""

    name: str
    part: int
    c: float
    l1_ratio: float
    weight: int | None = None


@dataclass
class Scaling:
    """FIT-only preparation of a part: medians fill gaps (0 where a predictor has no value), indicators of the gaps of the
    predictors that have any; all centred and scaled by the population deviation."""

    fill: np.ndarray
    gappy: np.ndarray
    mean: np.ndarray
    std: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        gaps = np.isnan(x)
        return np.column_stack([np.where(gaps, self.fill, x), gaps[:, self.gappy].astype(np.float64)])

    def features(self, x: np.ndarray) -> np.ndarray:
        return (self.raw(x) - self.mean) / self.std


@dataclass
class LinearFit:
    scaling: Scaling
    beta: np.ndarray  #: intercept first
    objective: float
    residual: float  #: greatest violation of the optimality conditions, on the scale of mean gradients
    steps: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.beta[0] + self.scaling.features(x) @ self.beta[1:]

    def terms(self) -> list[tuple[int, bool, float, float, float, float]]:
        """(predictor, whether it is the indicator of its gaps, fill, mean, deviation, coefficient) of each coefficient
        that is not zero, in order; the margin is the intercept and the sum of their terms."""
        s, p = self.scaling, len(self.scaling.fill)
        where = [(j, False, float(s.fill[j])) for j in range(p)] + [(int(j), True, 0.0) for j in s.gappy]
        return [(*w, float(s.mean[k]), float(s.std[k]), float(b)) for k, (w, b) in enumerate(zip(where, self.beta[1:])) if b]

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """(n, predictors): what each predictor, with its indicator, adds to the margin."""
        p = len(self.scaling.fill)
        each = self.scaling.features(x) * self.beta[1:]
        out = each[:, :p].copy()
        out[:, self.scaling.gappy] += each[:, p:]
        return out


def scalings(rows: DataFrame, blocks: DataFrame, part: str, columns: Sequence[str]) -> dict[int, Scaling]:
    """Per part; exact medians, and moments from two passes over the blocks."""
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in columns]).collect()
    long = rows.select(F.col(part), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([part], list(columns), "column", "value")
    medians = {(r[part], r["column"]): r["m"] for r in exact_quantiles(long, [part, "column"], "value", [0.5], names=["m"]).collect()}
    out = {}
    for r in counts:
        fill = np.array([medians.get((r[part], c), 0.0) for c in columns])
        gappy = np.flatnonzero([r[c] < r["n"] for c in columns])
        out[r[part]] = Scaling(fill, gappy, np.zeros(len(columns) + len(gappy)), np.ones(len(columns) + len(gappy)))
    n = {r[part]: r["n"] for r in counts}
    for p, s in summed(blocks, lambda p, b: iter([(p, out[p].raw(b[0]).sum(axis=0))])).items():
        out[p].mean = s / n[p]
    for p, s in summed(blocks, lambda p, b: iter([(p, ((out[p].raw(b[0]) - out[p].mean) ** 2).sum(axis=0))])).items():
        std = np.sqrt(s / n[p])
        out[p].std = np.where(std > 0, std, 1.0)
    return out


def _newton_step(beta: np.ndarray, g: np.ndarray, h: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """The minimiser of the quadratic model with both penalties; vectors of the predictors only.

    The coefficients that are not zero are solved for at once for the signs they have; the way there stops where one of
    them had better be zero, and a zero one whose slope exceeds its penalty joins.  Coordinate descent creeps where
    predictors nearly depend on each other, and is left to the case that some depend on others outright.
    """
    a, b = h + np.diag(l2), h @ beta - g
    value = lambda x: 0.5 * x @ a @ x - b @ x + l1 @ np.abs(x)
    x, near = beta.copy(), 1e-12 * max(1.0, np.abs(b).max())
    for _ in range(50 * len(beta)):
        slope, sign, active = a @ x - b, np.sign(x), (x != 0) | (l1 == 0)
        if np.abs(slope + l1 * sign)[active].max(initial=0.0) <= near:
            excess = np.where(active, 0.0, np.abs(slope) - l1)
            j = int(np.argmax(excess))
            if excess[j] <= near:
                return x
            active[j], sign[j] = True, -np.sign(slope[j])
        to = x.copy()
        try:
            to[active] = np.linalg.solve(a[np.ix_(active, active)], (b - l1 * sign)[active])
        except np.linalg.LinAlgError:
            break
        stops = [to]
        for j in np.flatnonzero((x * to < 0) & (l1 > 0)):
            stop = x + x[j] / (x[j] - to[j]) * (to - x)
            stop[j] = 0.0
            stops.append(stop)
        x = min(stops, key=value)
    return _descended(beta, g, h, l1, l2)


def _descended(beta: np.ndarray, g: np.ndarray, h: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """As ``_newton_step``, by coordinate descent."""
    new, slope = beta.copy(), g.copy()  # slope: g + h (new - beta)
    diagonal = np.diag(h) + l2 + 1e-12
    for _ in range(10_000):
        moved = 0.0
        for j in range(len(beta)):
            u = new[j] - (slope[j] + l2[j] * new[j]) / diagonal[j]
            x = math.copysign(max(abs(u) - l1[j] / diagonal[j], 0.0), u)
            if (d := x - new[j]) != 0.0:
                slope += h[:, j] * d
                new[j] = x
                moved = max(moved, abs(d))
        if moved < 1e-12:
            break
    return new


def fit_logistics(blocks: DataFrame, scaling: dict[int, Scaling], models: Sequence[Logistic], tolerance: float = 1e-9, most: int = 100) -> dict[str, LinearFit]:
    """Every model whose part has rows.  A part with one class gets that class's share (clipped) and no coefficients."""
    models = [m for m in models if m.part in scaling]
    beta = [np.zeros(1 + len(scaling[m.part].mean)) for m in models]
    tried, best, step = [b.copy() for b in beta], [None] * len(models), [1.0] * len(models)
    fits: dict[int, LinearFit] = {}
    for passes in range(1, most + 1):
        open_ = [i for i in range(len(models)) if i not in fits]
        if not open_:
            break
        by_part: dict[int, list[tuple[int, int | None, np.ndarray]]] = {}
        for i in open_:
            by_part.setdefault(models[i].part, []).append((i, models[i].weight, tried[i]))

        def of(part: int, block: tuple) -> Iterator[tuple[int, np.ndarray]]:
            x, y, w = block
            if part not in by_part:
                return
            z = np.column_stack([np.ones(len(x)), scaling[part].features(x)])
            for i, k, b in by_part[part]:
                wi = np.ones(len(y)) if k is None else w[:, k]
                m = z @ b
                p = _sigmoid(m)
                h = z.T @ (z * (wi * p * (1 - p))[:, None])
                yield i, np.concatenate([[(wi * _losses(m, y)).sum(), wi.sum(), (wi * y).sum()], z.T @ (wi * (p - y)), h.ravel()])

        for i, s in summed(blocks, of).items():
            m, q = models[i], len(beta[i])
            total, share = s[1], s[2] / s[1]
            if share <= 0 or share >= 1:
                p = min(max(share, 1e-8), 1 - 1e-8)
                fits[i] = LinearFit(scaling[m.part], np.r_[math.log(p / (1 - p)), np.zeros(q - 1)], 0.0, 0.0, passes)
                continue
            lam = 1.0 / (m.c * total)
            l1, l2 = np.full(q, lam * m.l1_ratio), np.full(q, lam * (1 - m.l1_ratio))
            l1[0] = l2[0] = 0.0
            b = tried[i]
            f = s[0] / total + (l1 * np.abs(b) + 0.5 * l2 * b * b).sum()
            if best[i] is not None and f > best[i][0] + 1e-13 * abs(best[i][0]) and step[i] > 1e-6:
                step[i] /= 2  # too far: half the way from the best point
                tried[i] = beta[i] + step[i] * (best[i][1] - beta[i])
                continue
            g, h = s[3 : 3 + q] / total, s[3 + q :].reshape(q, q) / total
            slope = g + l2 * b
            off = np.where(b != 0, np.abs(slope + l1 * np.sign(b)), np.maximum(np.abs(slope) - l1, 0.0)).max()
            if off <= tolerance or step[i] <= 1e-6:
                fits[i] = LinearFit(scaling[m.part], b, f, float(off), passes)
                continue
            beta[i], step[i] = b, 1.0
            tried[i] = _newton_step(b, g, h, l1, l2)
            best[i] = (f, tried[i])
    if left := [m.name for i, m in enumerate(models) if i not in fits]:
        raise RuntimeError(f"no convergence in {most} passes: {left}")
    return {models[i].name: fit for i, fit in fits.items()}


# ---- boosted trees -----------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Boosting:
    name: str
    part: int
    rate: float = 0.1
    leaves: int = 31
    rounds: int = 200
    least: int = 20  #: rows of a leaf
    l2: float = 1.0
    weight: int | None = None
    curvature: float = 1e-3  #: of a leaf, at least


@dataclass
class Tree:
    """Node 0 is the root; ``feature`` is -1 in leaves."""

    feature: np.ndarray
    code: np.ndarray  #: codes up to this go left
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def places(self, codes: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row; ``node``: where the rows are known to pass, moved on in place."""
        node = np.zeros(len(codes), dtype=np.int64) if node is None else node
        moving = np.flatnonzero(self.feature[node] >= 0)
        while len(moving):
            at = node[moving]
            c = codes[moving, self.feature[at]]
            left = np.where(c == MISSING, self.missing_left[at], c <= self.code[at])
            node[moving] = np.where(left, self.left[at], self.right[at])
            moving = moving[self.feature[node[moving]] >= 0]
        return node

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        return self.value[self.places(codes)]


@dataclass
class Forest:
    cuts: list[np.ndarray]  #: ascending, of each predictor
    start: float
    trees: list[Tree] = field(default_factory=list)
    first_gain: float = 0.0  #: of the first split of all
    losses: list[float] = field(default_factory=list)  #: mean weighted loss before the first round and after each

    def margin(self, x: np.ndarray) -> np.ndarray:
        codes = coded(x, self.cuts)
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += tree(codes)
        return out


def coded(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Number of cuts below each value, or ``MISSING``."""
    out = np.full(x.shape, MISSING, dtype=np.uint8)
    for j, c in enumerate(cuts):
        known = ~np.isnan(x[:, j])
        out[known, j] = np.searchsorted(c, x[known, j], side="left")
    return out


def bin_cuts(rows: DataFrame, part: str, columns: Sequence[str], bins: int = MISSING) -> dict[int, list[np.ndarray]]:
    """Per part and predictor at most ``bins - 1`` cuts: midpoints of the distinct values, or else exact quantiles."""
    long = rows.select(F.col(part), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([part], list(columns), "column", "value")
    values = long.where("value IS NOT NULL").groupBy(part, "column", "value").agg(F.lit(1).alias("one"))
    sizes = values.groupBy(part, "column").count()
    few = values.join(sizes.where(F.col("count") <= bins), [part, "column"]).groupBy(part, "column").agg(F.sort_array(F.collect_set("value")).alias("v"))
    many = quantile_grid(long.join(sizes.where(F.col("count") > bins).select(part, "column"), [part, "column"], "left_semi"), [part, "column"], "value", bins)
    many = many.groupBy(part, "column").agg(F.sort_array(F.collect_set("quantile")).alias("v"))
    cuts = {(r[part], r["column"]): (np.array(r["v"][:-1]) + np.array(r["v"][1:])) / 2 for r in few.collect()}
    cuts |= {(r[part], r["column"]): np.array(r["v"]) for r in many.collect()}
    parts = [r[0] for r in rows.select(part).distinct().collect()]
    return {p: [cuts.get((p, c), np.zeros(0)) for c in columns] for p in parts}


@dataclass
class _Node:
    g: float
    h: float
    n: float
    split: tuple | None = None  #: (gain, feature, code, missing left, left sums, right sums); () where there is none
    kids: tuple[int, int] | None = None


class _Growth:
    """One model: the forest so far and the tree that is growing, with splits that may turn out not to be needed."""

    def __init__(self, model: Boosting, forest: Forest):
        self.model, self.forest, self.fresh = model, forest, list[bytes]()  # trees since the margins were renewed
        self.nodes: list[_Node] = [_Node(0.0, 0.0, math.inf)]
        self.asked = [0]  # whose histograms the next pass adds up

    @property
    def done(self) -> bool:
        return len(self.forest.losses) > self.model.rounds

    def _open(self, i: int) -> bool:
        return self.nodes[i].split is None and self.nodes[i].n >= 2 * self.model.least

    def take(self, found: Iterable[tuple]) -> None:
        """(predictor, slot, best split or None, sums) of the asked nodes; the tree grows on."""
        best: dict[int, tuple] = {}
        for j, slot, split, sums in found:
            if j == 0 and self.asked[slot] == 0:
                self.nodes[0].g, self.nodes[0].h, self.nodes[0].n = sums[:3]
                self.forest.losses.append(float(sums[3] / sums[4]))
            if split is not None:
                better = (-round(split[0], 9), j)
                if slot not in best or better < best[slot][0]:
                    best[slot] = (better, (split[0], j, *split[1:5]))
        if self.done:
            return
        for s, at in enumerate(self.asked):
            self.nodes[at].split = best[s][1] if s in best else ()
        self.advance()

    def advance(self) -> None:
        """After the asked histograms have come: grow as far as they allow; ask for more, or end the tree."""
        chosen: list[int] = []
        while True:
            leaves, heap, unknown, chosen = 1, [], False, []
            front = [0]
            while True:
                for i in front:
                    if self._open(i):
                        unknown = True
                    elif self.nodes[i].split:
                        heapq.heappush(heap, (-self.nodes[i].split[0], i))
                if leaves >= self.model.leaves or unknown or not heap:
                    break
                _, i = heapq.heappop(heap)
                chosen.append(i)
                leaves += 1
                front = list(self._kids(i))
            if leaves >= self.model.leaves or not unknown:
                return self._end(chosen)
            for _, i in heapq.nsmallest(self.model.leaves - leaves, heap):  # may be split next whatever comes
                self._kids(i)
            self.asked = [i for i in range(len(self.nodes)) if self._open(i)]
            return None

    def _kids(self, i: int) -> tuple[int, int]:
        node = self.nodes[i]
        if node.kids is None:
            node.kids = len(self.nodes), len(self.nodes) + 1
            self.nodes += [_Node(*node.split[4]), _Node(*node.split[5])]
        return node.kids

    def _end(self, chosen: list[int]) -> None:
        tree = self.tree(set(chosen))
        if not self.forest.trees and self.nodes[0].split:
            self.forest.first_gain = self.nodes[0].split[0]
        self.forest.trees.append(tree)
        self.fresh.append(pickle.dumps(tree, protocol=5))
        self.nodes, self.asked = [_Node(0.0, 0.0, math.inf)], [0]

    def tree(self, split: set[int] | None = None) -> Tree:
        """The nodes as a tree, in their order; with ``split`` only those are inner nodes, and the rest of the grown ones go."""
        m, n = self.model, self.nodes
        inner = [x.kids is not None and (split is None or i in split) for i, x in enumerate(n)]
        kept = [0] + sorted(k for x, ok in zip(n, inner) if ok for k in x.kids)
        at = {i: place for place, i in enumerate(kept)}
        rows = []
        for i in kept:
            x = n[i]
            value = -m.rate * x.g / (x.h + m.l2) if x.h + m.l2 > 0 else 0.0
            rows.append((x.split[1], x.split[2], x.split[3], at[x.kids[0]], at[x.kids[1]], value) if inner[i] else (-1, 0, False, 0, 0, value))
        kinds = (np.int64, np.int64, bool, np.int64, np.int64, np.float64)
        return Tree(*[np.array(c, dtype=k) for c, k in zip(zip(*rows), kinds)])


def best_splits(hist: np.ndarray, l2: float, least: int, curvature: float) -> list[tuple | None]:
    """(gain, code, missing left, left sums, right sums) of each of the histograms (3, histograms, 256) of gradient,
    curvature and rows; None where no split is allowed."""
    total, gone = hist.sum(axis=2), hist[:, :, MISSING]
    upto = np.cumsum(hist[:, :, :MISSING], axis=2)
    best: list[tuple | None] = [None] * hist.shape[1]
    score = lambda s: s[0] ** 2 / (s[1] + l2)
    for missing_left in (False, True):
        at = np.flatnonzero(gone[2] > 0) if missing_left else np.arange(hist.shape[1])
        if not len(at):
            continue
        left = upto[:, at] + gone[:, at, None] if missing_left else upto
        right = total[:, at, None] - left
        ok = (left[2] >= least) & (right[2] >= least) & (left[1] >= curvature) & (right[1] >= curvature)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, score(left) + score(right) - score(total[:, at])[:, None], -np.inf)
        code = np.argmax(np.round(gain, 10), axis=1)
        for k in np.flatnonzero(gain[np.arange(len(at)), code] > 1e-10):
            i, b = at[k], int(code[k])
            if best[i] is None or gain[k, b] > best[i][0] + 1e-10:
                side = missing_left if gone[2, i] > 0 else bool(left[2, k, b] >= right[2, k, b])
                best[i] = (float(gain[k, b]), b, side, tuple(left[:, k, b].tolist()), tuple(right[:, k, b].tolist()))
    return best


def _sums(codes: np.ndarray, here: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int) -> np.ndarray:
    """Histograms (predictors, 3, slots, 256) of gradient, curvature and rows; ``here``: the slot of a row, or -1."""
    some = np.flatnonzero(here >= 0)
    columns = codes.shape[1]
    if not columns:
        return np.zeros((0, 3, slots, 256))
    size = columns * slots * 256
    place = codes[some].T + here[some] * 256 + (np.arange(columns) * slots * 256)[:, None]
    place = place.ravel()
    each = [np.bincount(place, np.tile(x[some], columns), size) for x in (g, h)]
    return np.stack([*each, np.bincount(place, minlength=size)]).reshape(3, columns, slots, 256).swapaxes(0, 1)


_margins: dict[tuple, tuple[int, np.ndarray]] = {}  # of a worker, see ``_margin``


def _margin(key: tuple, stored: np.ndarray, fresh: list[bytes], codes: np.ndarray, most: int = 1 << 23) -> np.ndarray:
    """A model's margins on a block: the stored ones and the trees since.  A worker that saw the block before goes on from
    there; it keeps up to ``most`` numbers and is right whatever it has kept."""
    known, m = _margins.get(key, (0, stored))
    if known < len(fresh):
        for t in fresh[known:]:
            m = m + pickle.loads(t)(codes)
        if sum(len(x) for _, x in _margins.values()) + len(m) > most:
            _margins.clear()
        _margins[key] = (len(fresh), m)
    return m


def _histograms(blocks: RDD, growing: dict[int, list[tuple]], limits: dict[int, tuple]) -> list[tuple]:
    """(model, predictor, slot, best split or None, sums) of each asked node; sums: of the node, loss and weight.

    An RDD, because a pass is imperative code over blocks and there are thousands of short ones: planning a DataFrame for
    each took three times as long as the pass.
    """

    def add(task: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        acc: dict[tuple[int, int], np.ndarray] = {}
        for name, part, (codes, y, w, margins) in rows:
            for model, at, k, fresh, tree, asked in growing.get(part, []):
                m = _margin((name, model), margins[:, at], fresh, codes)
                wi = np.ones(len(y)) if k is None else w[:, k]
                p = _sigmoid(m)
                slot = np.full(len(tree.feature), -1)
                slot[asked] = np.arange(len(asked))
                here = slot[tree.places(codes)]
                for j, hist in enumerate(_sums(codes, here, wi * (p - y), wi * p * (1 - p), len(asked))):
                    v = np.concatenate([hist.ravel(), [0.0, 0.0]])
                    if j == 0 and asked[0] == 0:
                        v[-2:] = (wi * _losses(m, y)).sum(), wi.sum()
                    acc[model, j] = acc[model, j] + v if (model, j) in acc else v
        found = [(key, (task, v)) for key, v in acc.items()]
        return iter([b for key, x in found for b in choose((key, [x]))] if alone else found)

    def choose(item: tuple) -> list[tuple]:
        (model, j), some = item
        v = sum(v for _, v in sorted(some, key=lambda x: x[0]))  # in the order of the tasks, so reruns agree
        hist = v[:-2].reshape(3, -1, 256)
        return [(model, j, s, split, (*hist[:, s].sum(axis=1).tolist(), *v[-2:].tolist())) for s, split in enumerate(best_splits(hist, *limits[model]))]

    alone = blocks.getNumPartitions() == 1  # its sums are the sums
    sums = blocks.mapPartitionsWithIndex(add)
    return (sums if alone else sums.groupByKey(min(BUCKETS, blocks.getNumPartitions())).flatMap(choose)).collect()


def _grown(growth: _Growth, codes: np.ndarray, y: np.ndarray, w: np.ndarray) -> Forest:
    """The whole forest from all rows of its part."""
    model, columns = growth.model, codes.shape[1]
    wi = np.ones(len(y)) if model.weight is None else w[:, model.weight]
    margin = np.full(len(y), growth.forest.start)
    while not growth.done:
        if growth.asked == [0]:
            p = _sigmoid(margin)
            g, h, tail = wi * (p - y), wi * p * (1 - p), ((wi * _losses(margin, y)).sum(), wi.sum())
            node = np.zeros(len(y), dtype=np.int64)
        slots = len(growth.asked)
        slot = np.full(len(growth.nodes), -1)
        slot[growth.asked] = np.arange(slots)
        hist = _sums(codes, slot[growth.tree().places(codes, node)], g, h, slots)
        splits = best_splits(hist.swapaxes(0, 1).reshape(3, columns * slots, 256), model.l2, model.least, model.curvature)
        totals = hist[0].sum(axis=2).T.tolist()
        growth.take((i // slots, i % slots, split, (*totals[i % slots], *tail)) for i, split in enumerate(splits))
        if growth.fresh:
            margin += growth.forest.trees[-1](codes)
            growth.fresh.clear()
    return growth.forest


def _fit_alone(blocks: DataFrame, growths: dict[int, _Growth], sizes: dict[int, float]) -> dict[int, Forest]:
    """Forests of models whose parts have few rows (``sizes``): a task a model, the longest first."""
    longest = sorted(growths, key=lambda i: -sizes[i] * growths[i].model.leaves * growths[i].model.rounds)
    task = {i: k for k, i in enumerate(longest)}
    of: dict[int, list[int]] = {}
    for i in longest:
        of.setdefault(growths[i].model.part, []).append(i)
    cuts = {p: growths[some[0]].forest.cuts for p, some in of.items()}

    def copies(row: tuple) -> list[tuple]:
        if row[0] not in of:
            return []
        x, y, w = pickle.loads(row[1])
        data = pickle.dumps((coded(x, cuts[row[0]]), y, w), protocol=5)
        return [(task[i], data) for i in of[row[0]]]

    def grow(k: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        codes, y, w = map(np.concatenate, zip(*(pickle.loads(data) for _, data in rows)))
        order = np.lexsort([*codes.T, *w.T, y])  # rows in whatever order give the same sums
        yield longest[k], pickle.dumps(_grown(growths[longest[k]], codes[order], y[order], w[order]), protocol=5)

    rows = blocks.select("part", "data").rdd.flatMap(copies).partitionBy(len(longest), lambda k: k)
    return {i: pickle.loads(f) for i, f in rows.mapPartitionsWithIndex(grow).collect()}


def _kept(blocks: DataFrame) -> RDD:
    """The blocks in memory, or on the executors' disks, named by their content, about ``PASS`` margins to a task."""
    size = blocks.agg(F.coalesce(F.sum("margins"), F.lit(0))).first()[0]
    n = max(1, min(-(-size // PASS), blocks.count()))
    name = uuid.uuid4().hex
    rows = blocks.select("part", "data").repartition(n).rdd
    return rows.map(lambda r: (name + md5(r["data"]).hexdigest(), r["part"], pickle.loads(r["data"]))).persist(StorageLevel.MEMORY_AND_DISK)


def fit_boostings(blocks: DataFrame, cuts: dict[int, list[np.ndarray]], models: Sequence[Boosting], rebase: int = 50, alone: int = ALONE) -> dict[str, Forest]:
    """Every model whose part has rows.  One class alone gives a constant forest.

    A model whose part has at most ``alone`` rows is grown by one task, and all those at once.  The others grow together,
    in passes over the blocks: the margins are kept with the blocks and renewed every ``rebase`` rounds, so a lost executor
    costs a re-read of blocks and a few trees.
    """
    models = [m for m in models if m.part in cuts]

    def of(part: int, block: tuple) -> Iterator[tuple[int, np.ndarray]]:
        _, y, w = block
        for i, m in enumerate(models):
            if m.part == part:
                wi = np.ones(len(y)) if m.weight is None else w[:, m.weight]
                yield i, np.array([(wi * y).sum(), wi.sum(), len(y)])

    sums = summed(blocks, of)
    growths: list[_Growth] = []
    for i, m in enumerate(models):
        share = min(max(sums[i][0] / sums[i][1], 1e-8), 1 - 1e-8)
        growths.append(_Growth(m, Forest(cuts[m.part], math.log(share / (1 - share)))))
    small = {i: g for i, g in enumerate(growths) if sums[i][2] <= alone}
    found = {}
    if small:
        found = {models[i].name: f for i, f in _fit_alone(blocks, small, {i: sums[i][2] for i in small}).items()}
    if large := [g for i, g in enumerate(growths) if i not in small]:
        parts = {g.model.part for g in large}
        _fit_together(blocks.where(F.col("part").isin(sorted(parts))), {p: cuts[p] for p in parts}, large, rebase)
        found |= {g.model.name: g.forest for g in large}
    for m in models:
        del found[m.name].trees[m.rounds :]
    return {m.name: found[m.name] for m in models}


def _fit_together(blocks: DataFrame, cuts: dict[int, list[np.ndarray]], growths: Sequence[_Growth], rebase: int) -> None:
    """Grow the forests, all at once, in passes over the blocks."""
    models = [g.model for g in growths]
    columns = {}  # of a model in the margins of its part
    for m in models:
        columns[m.name] = sum(1 for other in models[: models.index(m)] if other.part == m.part)
    starts = {p: np.array([g.forest.start for g in growths if g.model.part == p]) for p in cuts}

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            data, sizes = [], []
            for part, d in zip(frame["part"], frame["data"]):
                x, y, w = pickle.loads(d)
                data.append(pickle.dumps((coded(x, cuts[part]), y, w, np.tile(starts[part], (len(y), 1))), protocol=5))
                sizes.append(len(y) * len(starts[part]))
            yield pd.DataFrame({"part": frame["part"], "margins": sizes, "data": data})

    table = written(blocks.mapInPandas(first, STATE), "boosting")
    state = _kept(table)
    limits = {i: (m.l2, m.least, m.curvature) for i, m in enumerate(models)}
    while any(not g.done for g in growths):
        growing: dict[int, list[tuple]] = {}
        for i, g in enumerate(growths):
            if not g.done:
                growing.setdefault(g.model.part, []).append((i, columns[g.model.name], g.model.weight, list(g.fresh), g.tree(), np.array(g.asked)))
        found: dict[int, list[tuple]] = {}
        for model, *some in _histograms(state, growing, limits):
            found.setdefault(model, []).append(some)
        for i, g in enumerate(growths):
            if not g.done:
                g.take(found[i])
        if max(len(g.fresh) for g in growths) >= rebase:
            table = _rebased(table, growths, columns)
            state.unpersist()
            state = _kept(table)
    state.unpersist()


def _rebased(state: DataFrame, growths: Sequence[_Growth], columns: dict[str, int]) -> DataFrame:
    """Blocks with margins that include every tree so far."""
    trees: dict[int, list[tuple[int, list[bytes]]]] = {}
    for g in growths:
        trees.setdefault(g.model.part, []).append((columns[g.model.name], list(g.fresh)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            data = []
            for part, d in zip(frame["part"], frame["data"]):
                codes, y, w, margins = pickle.loads(d)
                margins = margins.copy()
                for at, fresh in trees.get(part, []):
                    for t in fresh:
                        margins[:, at] += pickle.loads(t)(codes)
                data.append(pickle.dumps((codes, y, w, margins), protocol=5))
            yield pd.DataFrame({"part": frame["part"], "margins": frame["margins"], "data": data})

    new = written(state.mapInPandas(run, STATE), "boosting")
    for g in growths:
        g.fresh.clear()
    return new


# ---- scores ------------------------------------------------------------------------------------------------------
def scored(rows: DataFrame, part: str, columns: Sequence[str], keep: Sequence[str], fits: dict[tuple[int, str], LinearFit | Forest], out: str = "p") -> DataFrame:
    """(keep, part, model, probability) of every row and every model of its part; ``fits`` by part and model name.

    Linear models are a table that meets the rows; forests run over batches of rows.
    """
    linear: dict[tuple[int, str], LinearFit] = {}
    forests: dict[int, list[tuple[str, Forest]]] = {}
    for (p, name), fit in sorted(fits.items(), key=lambda x: x[0]):
        if isinstance(fit, LinearFit):
            linear[p, name] = fit
        else:
            forests.setdefault(p, []).append((name, fit))
    both = []
    if linear or not fits:
        both.append(_by_linear(rows, part, columns, keep, linear, out))
    if forests:
        # Hundreds of trees a row: a table of few files would keep few cores busy.
        spread = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))
        both.append(_by_forests(spread, part, columns, keep, forests, out))
    return both[0] if len(both) == 1 else both[0].unionByName(both[1])


def _by_linear(rows: DataFrame, part: str, columns: Sequence[str], keep: Sequence[str], fits: dict[tuple[int, str], LinearFit], out: str) -> DataFrame:
    """One short expression for all models: spelt out for each, those of a benchmark outgrew what Spark compiles."""
    table = [(p, name, float(f.beta[0]), f.terms()) for (p, name), f in fits.items()]
    models = rows.sparkSession.createDataFrame(table, "__part int, model string, __start double, __terms array<struct<i:int,gap:boolean,fill:double,mean:double,std:double,b:double>>")
    chosen = rows.select(*keep, F.col(part).cast("int").alias(part), F.array(*[F.col(c).cast("double") for c in columns]).alias("__x"))

    def added(margin: Column, t: Column) -> Column:
        x = F.get("__x", t["i"])
        return margin + (F.when(t["gap"], x.isNull().cast("double")).otherwise(F.coalesce(x, t["fill"])) - t["mean"]) / t["std"] * t["b"]

    margin = F.aggregate("__terms", F.col("__start"), added)
    return chosen.join(F.broadcast(models), F.col(part) == F.col("__part")).select(*keep, part, "model", (1 / (1 + F.exp(-margin))).alias(out))


def _by_forests(rows: DataFrame, part: str, columns: Sequence[str], keep: Sequence[str], forests: dict[int, list[tuple[str, Forest]]], out: str) -> DataFrame:
    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, some in frame.groupby("__part"):
                x = some[[f"__x_{i}" for i in range(len(columns))]].to_numpy(dtype=np.float64, na_value=np.nan)
                for name, fit in forests.get(int(p), []):
                    yield some[list(keep)].assign(__part=int(p), model=name, **{out: _sigmoid(fit.margin(x))})

    chosen = rows.select(*keep, F.col(part).cast("int").alias("__part"), *[F.col(c).cast("double").alias(f"__x_{i}") for i, c in enumerate(columns)])
    return chosen.mapInPandas(run, ", ".join([*fields, "__part int", "model string", f"{out} double"])).withColumnRenamed("__part", part)
