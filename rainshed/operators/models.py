"""Models of the exceedance probabilities of all folds and horizons, their calibration, benchmark and importance.

A part is a fold and a horizon; rows carry its number.  All models of all parts are fitted together (``fitting``); only
fitted coefficients, trees, medians and candidate lists live on the driver, all rows stay in DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainshed import policy
from rainshed.functions.rows import logit, platt
from rainshed.operators import evaluate as E
from rainshed.operators import fitting
from rainshed.operators.distributed import running_totals

LOGIT_GRID = ((0.1, 0.0), (0.1, 0.5), (1.0, 0.0), (1.0, 0.5))  # C, l1 ratio
BOOST_GRID = ((0.05, 15), (0.05, 31), (0.10, 15), (0.10, 31))  # learning rate, leaves
WEIGHTINGS = ("NATURAL_ROW_WEIGHTING", "RECEPTOR_BALANCED_WEIGHTING")


def fit(
    rows: DataFrame, part: str, receptor: str, y: str, predictors: Sequence[str], models: Sequence[fitting.Logistic | fitting.Boosting]
) -> dict[tuple[int, str], fitting.LinearFit | fitting.Forest]:
    """Every model of every part from the part's FIT rows, by (part, name of the configuration).

    ``models`` name a configuration for each part they are fitted in: names are "part/configuration".  Weight column 0
    balances the receptors of the part.
    """
    known = rows.where(F.col(y).isNotNull()).select(part, receptor, y, *predictors)
    known = fitting.written(E.balance_weights(known, [part], receptor), "fit")
    blocks = fitting.written(fitting.pack(known, part, y, ["weight"], predictors), "blocks")
    linear = [m for m in models if isinstance(m, fitting.Logistic)]
    trees = [m for m in models if isinstance(m, fitting.Boosting)]
    found: dict[str, fitting.LinearFit | fitting.Forest] = {}
    if linear:
        found |= fitting.fit_logistics(blocks, fitting.scalings(known, blocks, part, predictors), linear)
    if trees:
        found |= fitting.fit_boostings(blocks, fitting.bin_cuts(known, part, predictors), trees)
    return {(int(k.split("/", 1)[0]), k.split("/", 1)[1]): v for k, v in found.items()}


def in_every_part(parts: Sequence[int], model: fitting.Logistic | fitting.Boosting) -> list:
    return [replace(model, name=f"{p}/{model.name}", part=p) for p in parts]


def score_with_flags(df: DataFrame, predictors: Sequence[str], p: str, max_csi: Column, recall80: Column) -> DataFrame:
    """Flags at both thresholds and the number of missing predictors of each row."""
    missing = F.lit(0)
    for c in predictors:
        missing = missing + F.col(c).isNull().cast("int")
    return df.select(
        "*",
        (F.col(p) >= max_csi).alias("flag_max_csi"),
        (F.col(p) >= recall80).alias("flag_recall80"),
        missing.alias("missing_predictors"),
    )


# ---- calibration -------------------------------------------------------------------------------------------------
def fit_platt(pred: DataFrame, y: str, p: str, c: float = 1e6) -> tuple[float | None, float | None]:
    """(intercept, slope) of a logistic fit on the logit of the scores; nothing to fit (None) with one class only."""
    rows = pred.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(F.col(y).cast("double").alias("y"), logit(F.col(p)).alias("z"))
    # Equal scores are merged: the fit needs one weighted row per distinct (score, label).
    merged = rows.groupBy("y", "z").agg(F.count(F.lit(1)).cast("double").alias("w")).persist()
    n, low, high = merged.agg(F.sum("w"), F.min("y"), F.max("y")).first()
    if low == high:
        merged.unpersist()
        return None, None
    x = VectorAssembler(inputCols=["z"], outputCol="features").transform(merged)
    m = LogisticRegression(labelCol="y", weightCol="w", regParam=1.0 / (c * n), standardization=False, maxIter=1000, tol=1e-9).fit(x)
    merged.unpersist()
    return float(m.intercept), float(m.coefficients[0])


def calibrate(pred: DataFrame, p: str, coefficients: tuple[float | None, float | None], out: str = "calibrated_probability") -> DataFrame:
    a, b = coefficients
    if a is None or b is None:
        return pred.withColumn(out, F.lit(None).cast("double"))
    return pred.withColumn(out, platt(F.col(p), a, b))


# ---- benchmark ---------------------------------------------------------------------------------------------------
def candidates(logit_grid: Sequence[tuple] = LOGIT_GRID, boost_grid: Sequence[tuple] = BOOST_GRID) -> list[tuple]:
    """(config id, family, weighting, parameters): three baselines, then each grid under both weightings."""
    out: list[tuple] = [("B1_GLOBAL", "BASELINE", "NOT_APPLICABLE", None)]
    out += [(f"B2_RECEPTOR_K{k}", "BASELINE", "NOT_APPLICABLE", k) for k in policy.CLIMATOLOGY_SHRINKAGE]
    for w, name in zip(("W1", "W2"), WEIGHTINGS):
        out += [(f"M1_LOGIT_{w}_C{c}_L1R{r}".replace(".", "p"), "LOGISTIC", name, (c, r)) for c, r in logit_grid]
        out += [(f"M2_BOOST_{w}_LR{lr}_LEAF{n}".replace(".", "p"), "BOOSTING", name, (lr, n)) for lr, n in boost_grid]
    return out


def specification(candidate: tuple, rounds: int = 200) -> fitting.Logistic | fitting.Boosting:
    name, family, weighting, params = candidate
    weight = 0 if weighting == WEIGHTINGS[1] else None
    if family == "LOGISTIC":
        return fitting.Logistic(name, 0, params[0], params[1], weight)
    return fitting.Boosting(name, 0, params[0], params[1], rounds, weight=weight)


def benchmark(rows: DataFrame, parts: Sequence[int], part: str, receptor: str, y: str, predictors: Sequence[str], configs: Sequence[tuple], rounds: int = 200) -> DataFrame:
    """Validation metrics of every candidate in every part, from one table of scores.

    ``rows``: (part, partition, receptor, y, predictors), a row for each part that it belongs to.
    """
    fits, val = rows.where("partition = 'FIT'"), rows.where("partition = 'VALIDATION'").where(F.col(y).isNotNull())
    keep = [part, "config_id", "family", receptor, y, "p"]
    tables = []
    for name, family, _, k in configs:
        if family == "BASELINE":
            if k is None:
                p = val.join(E.fit_climatology(fits, [part], y).select(part, F.col("fit_climatology").alias("p")), part)
            else:
                p = E.smoothed_climatology(fits, val, [part], receptor, y, float(k)).withColumnRenamed("probability", "p")
            tables.append(p.withColumns({"config_id": F.lit(name), "family": F.lit(family)}).select(*keep))
    specs = [specification(c, rounds) for c in configs if c[1] != "BASELINE"]
    if specs:
        found = fit(fits, part, receptor, y, predictors, [m for s in specs for m in in_every_part(parts, s)])
        family = F.when(F.col("model").startswith("M1"), "LOGISTIC").otherwise("BOOSTING")
        scores = fitting.scored(val, part, predictors, [receptor, y], found)
        tables.append(scores.withColumns({"config_id": F.col("model"), "family": family}).select(*keep))
    scores = tables[0]
    for t in tables[1:]:
        scores = scores.unionByName(t)
    scores = fitting.written(scores, "scores")
    keys = [part, "config_id", "family"]
    return E.probability_metrics(scores, keys, y, "p").join(E.macro_average_precision(scores, keys, receptor, y, "p"), keys, "left")


# ---- permutation importance --------------------------------------------------------------------------------------
def _hash_rank(df: DataFrame, key: Sequence[str], seed: int, name: str, within: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """Rank 1..n of rows, ``within`` groups, in the order of a seeded 60-bit hash of their key.

    Hashes are uniform, so equal cuts of the hash range balance the work and need no look at the data.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))
    h = df.select(*within, *key, F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint").alias("__h"), F.lit(1).alias("__one"))
    cuts = [float(i * 2**54) for i in range(1, 64)]
    ranked = running_totals(h, within, "__h", ["__one"], splits=cuts)
    return ranked.select(*within, *key, F.col("cum___one").alias(name), *([F.col("tot___one").alias(total)] if total else []))


def permute_rows(df: DataFrame, key: Sequence[str], column: str, seed: int) -> DataFrame:
    """The column's values moved along a random permutation of the rows, as a join of two hash orders."""
    a = _hash_rank(df, key, seed, "__rank")
    b = _hash_rank(df.select(*key), key, seed + 1, "__rank")
    donor = df.select(*key, F.col(column).alias("__v")).join(b, list(key)).select("__rank", "__v")
    moved = a.join(donor, "__rank").select(*key, F.col("__v").alias(column))
    return df.drop(column).join(moved, list(key)).select(*df.columns)


def permute_receptors(df: DataFrame, receptor: str, column: str, seed: int) -> DataFrame:
    """A static column's values exchanged between receptors; each receptor keeps one value."""
    values = df.groupBy(receptor).agg(F.first(column, ignorenulls=True).alias("__v"))
    a = _hash_rank(values, [receptor], seed, "__rank")
    b = values.join(_hash_rank(values.select(receptor), [receptor], seed + 1, "__rank"), receptor).select("__rank", "__v")
    moved = a.join(b, "__rank").select(receptor, F.col("__v").alias(column))
    return df.drop(column).join(moved, receptor).select(*df.columns)


def with_contributions(rows: DataFrame, part: str, columns: Sequence[str], keep: Sequence[str], fits: dict[int, fitting.LinearFit]) -> DataFrame:
    """(keep, part, margin, contributions): of the part's linear model, and what each predictor adds to its margin."""
    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]
    inputs = [f"__x_{i}" for i in range(len(columns))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, some in frame.groupby("__part"):
                if int(p) in fits:
                    each = fits[int(p)].contributions(some[inputs].to_numpy(dtype=np.float64, na_value=np.nan))
                    margin = fits[int(p)].beta[0] + each.sum(axis=1)
                    yield some[list(keep)].assign(__part=int(p), margin=margin, contributions=list(each))

    chosen = rows.select(*keep, F.col(part).cast("int").alias("__part"), *[F.col(c).cast("double").alias(x) for c, x in zip(columns, inputs)])
    out = chosen.mapInPandas(run, ", ".join([*fields, "__part int", "margin double", "contributions array<double>"]))
    return out.withColumnRenamed("__part", part)


def _donated(rows: DataFrame, part: str, ident: Sequence[str], places: Sequence[int], repeats: int, seed: int) -> DataFrame:
    """(part, ident, repeat, donor): the donor's contributions at ``places``.

    Rows stand in the order of a hash of their identity; in each repeat every row takes from the row a drawn number of
    places further on, around the end: a permutation, on every engine the same.
    """
    ranked = _hash_rank(rows.select(part, *ident), ident, seed, "__rank", [part], total="__n")
    r, n = F.col("__rank") - 1, F.col("__n")
    shift = F.when(n > 1, 1 + E.hash_draw([F.col("repeat"), F.lit(seed)], F.greatest(n - 1, F.lit(1)))).otherwise(0)
    taking = ranked.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    taking = taking.select(part, *ident, "repeat", F.pmod(r + shift, n).alias("__from"))
    values = rows.select(part, *ident, F.array(*[F.col("contributions")[i] for i in places]).alias("donor"))
    giving = values.join(ranked.select(part, *ident, r.alias("__from")), [part, *ident]).select(part, "__from", "donor")
    return taking.join(giving, [part, "__from"]).drop("__from")


def permutation_importance(
    val: DataFrame, part: str, key: Sequence[str], receptor: str, predictors: Sequence[str], static: Sequence[str], y: str, repeats: int = 5, seed: int = policy.SEED
) -> DataFrame:
    """Mean and std of the drop in average precision per part and predictor of a linear model, all in one plan.

    ``val``: key, part, y, margin, contributions (in the order of ``predictors``).  A permuted predictor changes a margin by
    the donor's contribution less the row's own, so no row is copied or scored again: a row meets one array of
    contributions a repeat, which becomes one margin a predictor.  Static predictors take a donor receptor's contribution.
    """
    val = val.where(F.col(y).isNotNull())
    tables = []
    for names, ident, source, s in (
        ([c for c in predictors if c not in static], list(key), val, seed),
        (list(static), [receptor], val.groupBy(part, receptor).agg(F.array(*[F.max(F.col("contributions")[i]) for i in range(len(predictors))]).alias("contributions")), seed + 1),
    ):
        if not names:
            continue
        places = [list(predictors).index(c) for c in names]
        met = val.select(part, *dict.fromkeys([*key, receptor]), y, "margin", "contributions").join(_donated(source, part, ident, places, repeats, s), [part, *ident])
        moved = [F.struct(F.lit(c).alias("predictor"), (F.col("margin") - F.col("contributions")[i] + F.col("donor")[k]).alias("m")) for k, (c, i) in enumerate(zip(names, places))]
        tables.append(met.select(part, "repeat", y, F.explode(F.array(*moved)).alias("e")).select(part, "repeat", y, "e.*"))
    every = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
    p = lambda m: 1 / (1 + F.exp(-F.col(m)))
    scores = fitting.written(E.score_table(every.withColumn("p", p("m")), [part, "predictor", "repeat"], y, "p"), "importance")
    ap = E.metrics_from_scores(scores, [part, "predictor", "repeat"])
    base = E.probability_metrics(val.withColumn("p", p("margin")), [part], y, "p").select(part, F.col("average_precision").alias("base"))
    drops = ap.join(base, part).withColumn("drop", F.col("base") - F.col("average_precision"))
    return drops.groupBy(part, "predictor").agg(F.avg("drop").alias("mean_ap_drop"), F.stddev_pop("drop").alias("std_ap_drop"), F.count("drop").alias("repeats"))
