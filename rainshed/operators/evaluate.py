"""Probability scores, thresholds, clusters, bootstrap.

Everything starts from a score table: one row per distinct probability and key with counts of rows and
positives.  It is built with partial aggregation, so a hot key or a repeated score costs one row per map task,
and all ranked metrics come from running totals over it, cut into value ranges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainshed import policy
from rainshed.functions.rows import clip
from rainshed.operators.distributed import RANGES, running_totals, value_splits, weighted_quantile_grid, with_range
from rainshed.operators.windows import runs
from rainshed.sources.integrity import written

EPS = policy.PROBABILITY_CLIP


def score_table(pred: DataFrame, keys: Sequence[str], y: str, p: str, weight: Column | None = None) -> DataFrame:
    """(keys, p, n, pos) with p clipped to [1e-8, 1 - 1e-8]; rows without label or score are left out."""
    w = F.lit(1).cast("bigint") if weight is None else weight
    rows = pred.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    return rows.groupBy(*keys, clip(F.col(p).cast("double"), EPS, 1 - EPS).alias("p")).agg(
        F.sum(w).alias("n"), F.sum(F.when(F.col(y) == 1, w).otherwise(F.lit(0))).alias("pos")
    )


def metrics_from_scores(scores: DataFrame, keys: Sequence[str], splits: Sequence[float] | None = None) -> DataFrame:
    """Average precision (step sum, ties grouped), ROC AUC (average ranks), Brier score and log loss per key."""
    cum = running_totals(scores, keys, "p", ["n", "pos"], descending=True, splits=splits)
    p, n, pos = F.col("p"), F.col("n"), F.col("pos")
    neg = n - pos
    tot_neg = F.col("tot_n") - F.col("tot_pos")
    cum_neg = F.col("cum_n") - F.col("cum_pos")
    agg = cum.groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        F.sum("pos").alias("positives"),
        F.sum(pos * (F.col("cum_pos") / F.col("cum_n"))).alias("__ap"),
        F.sum(pos * ((tot_neg - cum_neg) + neg / 2)).alias("__auc"),
        F.sum(pos * F.pow(1 - p, 2) + neg * F.pow(p, 2)).alias("__brier"),
        F.sum(-(pos * F.log(p) + neg * F.log(1 - p))).alias("__ll"),
    )
    pp, nn = F.col("positives"), F.col("rows") - F.col("positives")
    return agg.select(
        *keys,
        "rows",
        "positives",
        F.when(pp > 0, F.col("__ap") / pp).alias("average_precision"),
        F.when((pp > 0) & (nn > 0), F.col("__auc") / (pp * nn)).alias("roc_auc"),
        (F.col("__brier") / F.col("rows")).alias("brier_score"),
        (F.col("__ll") / F.col("rows")).alias("log_loss"),
    )


def probability_metrics(pred: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    return metrics_from_scores(score_table(pred, keys, y, p), keys, value_splits(pred, p))


def macro_average_precision(pred: DataFrame, keys: Sequence[str], receptor: str, y: str, p: str) -> DataFrame:
    """Mean of the receptors' average precision, over receptors that have both classes."""
    per = probability_metrics(pred, [*keys, receptor], y, p)
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("rows"))
    ap = F.when(both, F.col("average_precision"))
    return per.groupBy(*keys).agg(F.avg(ap).alias("macro_average_precision"), F.count(ap).alias("receptors"))


def climatology_reference(pred: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """(keys, brier_score) of the share of positives over all rows as a forecast, from one aggregate."""
    per = pred.where(F.col(y).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("__pos"))
    whole = Window.partitionBy()  # a row a key
    c = clip(F.sum("__pos").over(whole) / F.sum("__n").over(whole), EPS, 1 - EPS)
    rows = per.select(*keys, "__n", "__pos", c.alias("__c"))
    n, pos, share = F.col("__n"), F.col("__pos"), F.col("__c")
    return rows.select(*keys, ((pos * F.pow(1 - share, 2) + (n - pos) * F.pow(share, 2)) / n).alias("brier_score"))


def brier_skill(model: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = reference.select(*keys, F.col("brier_score").alias("reference_brier"))
    j = model.join(r, list(keys)) if keys else model.withColumn("reference_brier", r.select("reference_brier").scalar())
    return j.withColumn(
        "brier_skill_score", F.when(F.col("reference_brier") > 0, 1 - F.col("brier_score") / F.col("reference_brier"))
    )


# ---- thresholds --------------------------------------------------------------------------------------------------
def contingency_scores(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    precision, recall = F.when(tp + fp > 0, tp / (tp + fp)), F.when(tp + fn > 0, tp / (tp + fn))
    return [
        precision.alias("precision"),
        recall.alias("recall"),
        F.when(tp + fp + fn > 0, tp / (tp + fp + fn)).alias("csi"),
        F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).alias("f1"),
        F.when(tn + fp > 0, tn / (tn + fp)).alias("specificity"),
    ]


def at_threshold(pred: DataFrame, keys: Sequence[str], y: str, p: str, threshold: Column) -> DataFrame:
    alarm, event = F.col(p) >= threshold, F.col(y) == 1
    c = pred.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys).agg(
        F.count_if(alarm & event).alias("tp"),
        F.count_if(alarm & ~event).alias("fp"),
        F.count_if(~alarm & event).alias("fn"),
        F.count_if(~alarm & ~event).alias("tn"),
    )
    return c.select("*", *contingency_scores(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]))


def threshold_sweep(pred: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """Contingency scores at 999 fixed levels and the 99 percentiles of the scores.

    The predictions are read once, into a score table.  Thresholds are merged into it as rows without counts; one descending
    running total then gives every threshold its counts.  No scores x thresholds product is formed.
    """
    keys = list(keys)
    rows = pred.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    scores = rows.groupBy(*keys, F.col(p).cast("double").alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("pos")
    )
    scores = written(scores, "scores")
    splits = value_splits(scores, "p")
    percentiles = weighted_quantile_grid(scores, keys, "p", "n", 100, splits=splits).select(*keys, F.col("quantile").alias("p"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(998)), lambda i: F.lit(0.001) + i * F.lit(0.998 / 998.0))
    levels = scores.select(*keys).distinct() if keys else percentiles.select(F.lit(1).alias("one")).distinct()
    levels = levels.select(*keys, F.explode(grid).alias("p")).unionByName(percentiles)
    zero = F.lit(0).cast("bigint")
    marks = levels.select(*keys, "p", zero.alias("n"), zero.alias("pos"), F.lit(1).alias("mark"))
    merged = (
        scores.withColumn("mark", F.lit(0))
        .unionByName(marks)
        .groupBy(*keys, "p")
        .agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.max("mark").alias("mark"))
    )
    cum = running_totals(merged, keys, "p", ["n", "pos"], descending=True, splits=splits).where("mark = 1")
    tp = F.col("cum_pos")
    fp = F.col("cum_n") - tp
    fn = F.col("tot_pos") - tp
    tn = F.col("tot_n") - F.col("cum_n") - fn
    counted = cum.select(*keys, F.col("p").alias("threshold"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    return counted.select("*", *contingency_scores(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]))


def choose_thresholds(sweep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MAX_CSI, and RECALL>=0.80 with the best precision (falls back to MAX_CSI), per key."""
    keys = list(keys)
    valid = sweep.where(F.col("csi").isNotNull())

    def worst_null(c: str) -> Column:
        return -F.coalesce(F.col(c), F.lit(-1.0))

    cols = [c for c in sweep.columns if c not in keys]
    row = F.struct(*cols)
    enough = (F.col("recall") >= policy.RECALL_TARGET) & F.col("precision").isNotNull()
    # Rows with a NULL ordering take no part in min_by, so one aggregate serves both rules.
    by_csi = F.struct(worst_null("csi"), worst_null("recall"), worst_null("precision"), F.col("threshold"))
    by_precision = F.when(enough, F.struct(-F.col("precision"), -F.col("csi"), -F.col("threshold")))
    best = valid.groupBy(*keys).agg(F.min_by(row, by_csi).alias("__m"), F.min_by(row, by_precision).alias("__r"))
    rules = F.array(
        F.struct(F.lit("MAX_CSI").alias("rule"), F.col("__m").alias("v")),
        F.struct(F.lit("RECALL80_MAX_PRECISION").alias("rule"), F.coalesce("__r", "__m").alias("v")),
    )
    return best.select(*keys, F.explode(rules).alias("e")).select(*keys, "e.rule", "e.v.*")


# ---- clusters ----------------------------------------------------------------------------------------------------
def cluster_metrics(pred: DataFrame, keys: Sequence[str], receptor: str, date: str, y: str, p: str, threshold: Column) -> DataFrame:
    """Hit rate of true issue-date clusters and false fraction of alert clusters.

    Clusters are runs of consecutive days, so the rows between a cluster's ends are exactly its own rows and
    the other flag can be read off them without an interval join.
    """
    ident = [*keys, receptor]
    rows = pred.withColumn("__true", F.coalesce(F.col(y) == 1, F.lit(False))).withColumn(
        "__alert", F.coalesce(F.col(p) >= threshold, F.lit(False))
    )
    true = runs(rows.where("__true"), ident, date, extra=[F.bool_or("__alert").alias("hit")])
    alert = runs(rows.where("__alert"), ident, date, extra=[F.bool_or("__true").alias("hit")])
    one = true.select(*keys, F.lit(1).alias("t"), F.col("hit").cast("int").alias("h"), F.lit(0).alias("a"), F.lit(0).alias("f"))
    two = alert.select(*keys, F.lit(0).alias("t"), F.lit(0).alias("h"), F.lit(1).alias("a"), (~F.col("hit")).cast("int").alias("f"))
    g = one.unionByName(two).groupBy(*keys).agg(
        F.sum("t").alias("true_clusters"), F.sum("h").alias("hit_clusters"), F.sum("a").alias("alert_clusters"), F.sum("f").alias("false_alert_clusters")
    )
    return g.select(
        "*",
        F.when(F.col("true_clusters") > 0, F.col("hit_clusters") / F.col("true_clusters")).alias("hit_rate"),
        F.when(F.col("alert_clusters") > 0, F.col("false_alert_clusters") / F.col("alert_clusters")).alias("false_alert_fraction"),
    )


# ---- block bootstrap ---------------------------------------------------------------------------------------------
def hash_draw(parts: Sequence[Column], n: Column) -> Column:
    """Reproducible integer in 0..n-1 from the md5 of the parts; the same on every engine and every retry."""
    text = F.concat_ws("|", *[c.cast("string") for c in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), n)


def numbered_blocks(pred: DataFrame, block: Sequence[str]) -> DataFrame:
    """Blocks with an index 0..n-1 in key order; blocks are receptor x year, a dimension."""
    w = Window.orderBy(*block)
    return pred.select(*block).distinct().select(*block, (F.row_number().over(w) - 1).alias("block_id"))


def _multiplicities(spark: SparkSession, blocks: int, replicates: Sequence[int], seed: int) -> np.ndarray:
    """(replicates, blocks): how often each block is drawn in each replicate (as many draws as blocks, with replacement)."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame["id"].tolist():
                text = [f"{r}|{b}|{seed}".encode() for b in range(blocks)]
                drawn = np.array([int.from_bytes(md5(t).digest()[:4], "big") for t in text], dtype=np.int64) % blocks
                out.append(np.bincount(drawn, minlength=blocks).astype("<i4").tobytes())
            yield pd.DataFrame({"replicate": frame["id"], "m": out})

    tasks = min(-(-len(replicates) * blocks // 32_768), len(replicates))
    parts = spark.range(min(replicates), max(replicates) + 1, 1, tasks).mapInPandas(draw, "replicate long, m binary")
    rows = sorted((r["replicate"], r["m"]) for r in parts.collect())  # of ``most_bytes``, see ``block_bootstrap``
    return np.stack([np.frombuffer(m, "<i4") for _, m in rows])


def _chunks(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows]


def _replicate_sums(scores: DataFrame, drawn: np.ndarray, ranges: int) -> np.ndarray:
    """(replicates, 6): rows, positives, and the sums behind the four metrics, of score tables weighted by the draws.

    Two passes with vectors over the replicates: totals of every score range; then, each range in descending order with
    the totals of the ranges above it, running totals and their sums.  A score row meets the draws of its block inside the
    task and never becomes a row a replicate.
    """
    sc = scores.sparkSession.sparkContext
    times = sc.broadcast(np.ascontiguousarray(drawn.T.astype(np.float64)))  # (blocks, replicates)
    many = drawn.shape[0]
    step = max((32 << 20) // (8 * many), 1)

    def totals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((ranges, 2, many))
        for f in _chunks(frames, step):
            w, at = times.value[f["block_id"].to_numpy()], f["range"].to_numpy()
            order = np.argsort(at, kind="stable")
            begin = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
            for i, c in enumerate(("n", "pos")):
                acc[at[order][begin], i] += np.add.reduceat((w * f[c].to_numpy()[:, None])[order], begin, axis=0)
        there = np.flatnonzero(acc[:, 0].any(axis=1))
        yield pd.DataFrame({"range": there, "v": [acc[r].tobytes() for r in there]})

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"range": [key[0]], "v": [sum(map(np.frombuffer, sorted(frame["v"]))).tobytes()]})

    got = scores.mapInPandas(totals, "range int, v binary").groupBy("range").applyInPandas(add, "range int, v binary")
    whole = np.zeros((ranges, 2, many))
    for r in got.collect():  # two numbers for each range and replicate
        whole[r["range"]] = np.frombuffer(r["v"]).reshape(2, many)
    above = sc.broadcast(whole[::-1].cumsum(axis=0)[::-1] - whole)
    total = sc.broadcast(whole.sum(axis=0))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, now, p_now, open_ = np.zeros((4, many)), -1, None, np.zeros((2, many))
        before = np.zeros((2, many))
        negatives = total.value[0] - total.value[1]

        def close(p: np.ndarray, n: np.ndarray, pos: np.ndarray, cum_n: np.ndarray, cum_pos: np.ndarray) -> None:
            neg = n - pos
            with np.errstate(divide="ignore", invalid="ignore"):
                out[0] += np.where(cum_n > 0, pos * cum_pos / cum_n, 0.0).sum(axis=0)
            out[1] += (pos * ((negatives - (cum_n - cum_pos)) + neg / 2)).sum(axis=0)
            out[2] += (pos * (1 - p) ** 2 + neg * p**2).sum(axis=0)
            out[3] -= (pos * np.log(p) + neg * np.log(1 - p)).sum(axis=0)

        def flush() -> None:
            nonlocal before, p_now, open_
            if p_now is not None:
                before = before + open_
                close(np.array([[p_now]]), open_[:1], open_[1:], before[:1], before[1:])
            p_now, open_ = None, np.zeros((2, many))

        for f in _chunks(frames, step):
            for r, some in f.groupby("range", sort=False):
                if r != now:
                    flush()
                    now, before = r, above.value[r].copy()
                w, p = times.value[some["block_id"].to_numpy()], some["p"].to_numpy()
                begin = np.flatnonzero(np.r_[True, np.diff(p) != 0])
                n, pos = (np.add.reduceat(w * some[c].to_numpy()[:, None], begin, axis=0) for c in ("n", "pos"))
                if p_now == p[0]:
                    n[0] += open_[0]
                    pos[0] += open_[1]
                else:
                    flush()
                cum_n, cum_pos = before[0] + n.cumsum(axis=0), before[1] + pos.cumsum(axis=0)
                close(p[begin][:-1, None], n[:-1], pos[:-1], cum_n[:-1], cum_pos[:-1])  # the last score may go on
                before = before + np.stack([n[:-1].sum(axis=0), pos[:-1].sum(axis=0)])
                p_now, open_ = p[-1], np.stack([n[-1], pos[-1]])
        flush()
        yield pd.DataFrame({"range": [0], "v": [out.tobytes()]})

    ordered = scores.repartition(ranges, "range").sortWithinPartitions("range", F.desc("p"))
    parts = ordered.mapInPandas(sums, "range int, v binary").collect()  # four numbers for each range and replicate
    found = sum((np.frombuffer(r["v"]).reshape(4, many) for r in parts), np.zeros((4, many)))
    return np.column_stack([total.value.T, found.T])


def block_bootstrap(pred: DataFrame, block: Sequence[str], y: str, p: str, replicates: int = policy.BOOTSTRAP_REPLICATES, seed: int = policy.SEED, most_bytes: int = 64 << 20) -> DataFrame:
    """Metrics of every replicate, from block score tables and, for each block, a vector of how often it is drawn.

    Draws go to the tasks for as many replicates at a time as fit ``most_bytes``.
    """
    spark = pred.sparkSession
    blocks = numbered_blocks(pred, block)
    scores = written(score_table(pred, block, y, p).join(blocks, list(block)).select("block_id", "p", "n", "pos"), "scores")
    ranges = min(max(scores.count() // 4096, 1), RANGES)  # for balance only
    splits = value_splits(scores, "p", ranges) if ranges > 1 else []
    named = with_range(scores, "p", splits).withColumnRenamed("__range", "range")
    many = blocks.count()
    size = max(most_bytes // max(8 * many, 1), 1)
    rows = []
    for at in range(1, replicates + 1, size):
        some = range(at, min(at + size, replicates + 1))
        if many:
            found = _replicate_sums(named, _multiplicities(spark, many, some, seed), len(splits) + 1)
            rows += [(r, *map(float, v)) for r, v in zip(some, found)]
    table = spark.createDataFrame(rows, "replicate int, rows double, positives double, ap double, auc double, brier double, ll double")
    n, pos = F.col("rows"), F.col("positives")
    return table.where(n > 0).select(
        "replicate",
        n.cast("bigint").alias("rows"),
        pos.cast("bigint").alias("positives"),
        F.when(pos > 0, F.col("ap") / pos).alias("average_precision"),
        F.when((pos > 0) & (n > pos), F.col("auc") / (pos * (n - pos))).alias("roc_auc"),
        (F.col("brier") / n).alias("brier_score"),
        (F.col("ll") / n).alias("log_loss"),
    )


METRICS = ("average_precision", "roc_auc", "brier_score", "log_loss")


def bootstrap_intervals(boot: DataFrame) -> DataFrame:
    """Mean and 2.5 / 97.5 % quantiles per metric over replicates (a fixed, small number of rows)."""
    long = boot.unpivot(["replicate"], list(METRICS), "metric", "value")
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return long.groupBy("metric").agg(F.count("value").alias("replicates"), F.avg("value").alias("mean"), q[0].alias("ci_low"), q[1].alias("ci_high"))


# ---- baselines, weights, selection -------------------------------------------------------------------------------
def fit_climatology(fit: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    return fit.where(F.col(y).isNotNull()).groupBy(*keys).agg(F.avg(y).alias("fit_climatology"), F.count(y).alias("fit_rows"))


def _with_total_key(keys: Sequence[str], *frames: DataFrame) -> tuple[list[str], list[DataFrame]]:
    """Without group keys, one constant key lets group totals be joined like any other."""
    if keys:
        return list(keys), list(frames)
    return ["__all"], [f.withColumn("__all", F.lit(1)) for f in frames]


def smoothed_climatology(fit: DataFrame, target: DataFrame, keys: Sequence[str], receptor: str, y: str, k: float) -> DataFrame:
    """Receptor frequency shrunk to the global one with strength k; unseen receptors get the global one."""
    keys, (fit, target) = _with_total_key(keys, fit, target)
    per = fit.where(F.col(y).isNotNull()).groupBy(*keys, receptor).agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
    total = per.groupBy(*keys).agg((F.sum("__s") / F.sum("__n")).alias("global_climatology"))
    probs = per.join(total, keys).select(
        *keys, receptor, ((F.col("__s") + F.col("global_climatology") * k) / (F.col("__n") + k)).alias("__p")
    )
    out = target.join(total, keys, "left").join(probs, [*keys, receptor], "left")
    return out.withColumn("probability", F.coalesce("__p", "global_climatology")).drop("__p", "__all")


def balance_weights(rows: DataFrame, keys: Sequence[str], receptor: str) -> DataFrame:
    """n / (receptors * rows of the receptor) per group: every receptor carries the same total weight.

    Counts come from an aggregate joined back, not from a window that would gather a group in one task.
    """
    keys, (rows,) = _with_total_key(keys, rows)
    per = rows.groupBy(*keys, receptor).agg(F.count(F.lit(1)).alias("__nr"))
    total = per.groupBy(*keys).agg(F.sum("__nr").alias("__n"), F.count(F.lit(1)).alias("__r"))
    w = per.join(total, keys).select(*keys, receptor, (F.col("__n") / (F.col("__r") * F.col("__nr"))).alias("weight"))
    return rows.join(w, [*keys, receptor]).drop("__all")


def top_bottom(df: DataFrame, group: Sequence[str], metric: str, tie: str, k: int = 5) -> DataFrame:
    """The k best and k worst rows per group by a metric; NULL metrics are left out."""
    known = df.where(F.col(metric).isNotNull())

    def side(order: Column, name: str) -> DataFrame:
        w = Window.partitionBy(*group).orderBy(order, tie)
        return known.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).withColumn("side", F.lit(name))

    return side(F.col(metric).desc(), "TOP").unionByName(side(F.col(metric).asc(), "BOTTOM"))


def select_candidates(metrics: DataFrame, horizon: str, config: str, ap: str, brier: str) -> DataFrame:
    """Selection rank per horizon over mean fold metrics: AP descending, Brier ascending, config as last key."""
    m = metrics.groupBy(horizon, config).agg(F.avg(ap).alias("mean_ap"), F.avg(brier).alias("mean_brier"), F.count(F.lit(1)).alias("folds"))
    # Means that differ only in the last bits of a sum are ties.
    ap_key, brier_key = F.round("mean_ap", 12), F.round("mean_brier", 12)
    w = Window.partitionBy(horizon).orderBy(ap_key.desc_nulls_last(), brier_key.asc_nulls_last(), config)
    return m.withColumn("selection_rank", F.row_number().over(w))


def family_importance(importance: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    v = F.col(value)
    return importance.groupBy(*by).agg(
        F.count(v).alias("predictors"),
        F.sum(v).alias("importance_sum"),
        F.sum(F.greatest(v, F.lit(0.0))).alias("positive_importance_sum"),
        F.avg(v).alias("importance_mean"),
        F.max(v).alias("importance_max"),
    )


# ---- events ------------------------------------------------------------------------------------------------------
def rank_events(events: DataFrame, daily: DataFrame, on: Sequence[str], date: str, a: str, b: str, a_pct: str, b_pct: str, high: float = 90.0) -> DataFrame:
    """Category, retrieval priority and score of each event from two daily series inside its window.

    ``events``: on + event_id, start_date, end_date.  Windows become days (an equi join); peaks take the first
    day on ties.
    """
    spread = events.withColumn(date, F.explode(F.sequence("start_date", "end_date")))
    j = spread.join(daily, [*on, date], "left")
    first_day = -F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    both = F.col(a_pct).isNotNull() & F.col(b_pct).isNotNull()
    joint = F.when(both, F.least(a_pct, b_pct))

    def peak_day(c: str) -> Column:
        return F.max_by(F.when(F.col(c).isNotNull(), F.col(date)), F.when(F.col(c).isNotNull(), F.struct(F.col(c), first_day)))

    both_high = both & (F.col(a_pct) >= high) & (F.col(b_pct) >= high)
    g = j.groupBy(*on, "event_id", "start_date", "end_date").agg(
        F.max(a_pct).alias("max_a"),
        F.max(b_pct).alias("max_b"),
        F.max(joint).alias("max_joint"),
        F.max_by(F.when(both, F.col(date)), F.when(both, F.struct(joint, first_day))).alias("joint_best_date"),
        F.coalesce(F.bool_or(both_high), F.lit(False)).alias("same_day_both_high"),
        peak_day(a).alias("a_peak_date"),
        peak_day(b).alias("b_peak_date"),
        F.count_if(F.col(a).isNull()).alias("a_missing_days"),
        F.count_if(F.col(b).isNull()).alias("b_missing_days"),
    )
    off = F.datediff("b_peak_date", "a_peak_date")
    ah, bh = F.coalesce(F.col("max_a") >= high, F.lit(False)), F.coalesce(F.col("max_b") >= high, F.lit(False))
    category = (
        F.when(ah & bh & (off == 0), "BOTH_HIGH_SAME_DAY_PEAK_CONTROL")
        .when(ah & bh & (off > 0), "BOTH_HIGH_SECOND_PEAK_LATER_DAILY")
        .when(ah & bh & (off < 0), "BOTH_HIGH_SECOND_PEAK_EARLIER_DAILY")
        .when(ah & bh, "BOTH_HIGH_DAILY_TIMING_UNRESOLVED")
        .when(ah, "FIRST_DOMINANT")
        .when(bh, "SECOND_DOMINANT")
        .otherwise("MIXED_BELOW_EVENT_MAX_THRESHOLD")
    )
    priority = (
        F.when(F.col("category").isin("BOTH_HIGH_SECOND_PEAK_LATER_DAILY", "BOTH_HIGH_SECOND_PEAK_EARLIER_DAILY"), 1)
        .when(F.col("category") == "BOTH_HIGH_SAME_DAY_PEAK_CONTROL", 2)
        .otherwise(3)
    )
    none = F.lit(-1.0)
    score = F.coalesce("max_joint", none) * 1000.0 + F.coalesce(F.greatest("max_a", "max_b"), none)
    ranked = g.withColumn("peak_offset_days", off).withColumn("category", category).withColumn("retrieval_priority", priority)
    return ranked.withColumn("ranking_score", score)
