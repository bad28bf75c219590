"""Model fits, calibration and importance on the labelled panel."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import functions as F

from rainshed.operators import evaluate as E
from rainshed.operators import fitting
from rainshed.operators import labels as L
from rainshed.operators import models as M
from rainshed.plans import bindings as B
from rainshed.plans.evaluation_queries import SQL_PRED, predictions, sql_metrics
from rainshed.plans.operation_queries import PREDICTORS, SQL_MASTER, master
from rainshed.plans.registry import query

FOLDS, HORIZONS = [f[0] for f in B.FOLDS], [24, 48, 72]
PARTS = {i: (fold, h) for i, (fold, h) in enumerate((fold, h) for fold in FOLDS for h in HORIZONS)}
STATIC = [p for p in PREDICTORS if p.startswith("static__")]


def parts(spark, sf):
    """Labelled rows of every fold and horizon, written once: part, partition, receptor, date, y and the predictors."""
    m = master(spark, sf)
    labels = F.array(*[F.struct(F.lit(h).alias("horizon_hours"), F.col(L.label_name(h)).cast("double").alias("y")) for h in HORIZONS])
    rows = m.select("fold_id", "partition", "receptor_id", "issue_date", *PREDICTORS, F.explode(labels).alias("l")).select("*", "l.*").drop("l")
    number = reduce(lambda c, p: F.when((F.col("fold_id") == p[1][0]) & (F.col("horizon_hours") == p[1][1]), p[0]).otherwise(c), PARTS.items(), F.lit(None).cast("int"))
    return fitting.written(rows.where("y IS NOT NULL AND partition IN ('FIT', 'VALIDATION')").withColumn("part", number), "parts")


def fitted(rows, *models):
    return M.fit(rows.where("partition = 'FIT'"), "part", "receptor_id", "y", PREDICTORS, [x for m in models for x in M.in_every_part(list(PARTS), m)])


def named(df):
    """fold_id and horizon_hours instead of the part's number."""
    pick = lambda k: reduce(lambda c, p: F.when(F.col("part") == p[0], p[1][k]).otherwise(c), PARTS.items(), F.lit(None))
    return df.withColumns({"fold_id": pick(0), "horizon_hours": pick(1)})


def scores(spark, sf, model):
    rows = parts(spark, sf)
    fits = fitted(rows, model)
    return named(fitting.scored(rows.where("partition = 'VALIDATION'"), "part", PREDICTORS, ["receptor_id", "issue_date", "y"], fits, "probability"))


LOGISTIC = fitting.Logistic("logistic", 0, 1.0, 0.5)
BOOSTING = fitting.Boosting("boosting", 0, 0.1, 15)


@query("E-03 E-21", "fold_id:s horizon_hours:i receptor_id:i issue_date:d y:i probability:f")
def logistic_scores(spark, sf):
    """Validation scores of the logistic model in every fold and horizon."""
    return scores(spark, sf, LOGISTIC)


@query("E-04 E-21", "fold_id:s horizon_hours:i receptor_id:i issue_date:d y:i probability:f")
def boosting_scores(spark, sf):
    """Validation scores of boosted trees in every fold and horizon."""
    return scores(spark, sf, BOOSTING)


SQL_FIT = f"""{SQL_MASTER}, fit AS (SELECT fold_id, receptor_id, issue_date, h, CAST(y AS DOUBLE) AS y, {', '.join(PREDICTORS)} FROM
    (SELECT *, unnest([24, 48, 72]) AS h, unnest([label_extreme_within_24h, label_extreme_within_48h, label_extreme_within_72h]) AS y FROM master WHERE partition = 'FIT') WHERE y IS NOT NULL)"""
SQL_CONFIGS = ", ".join(f"('{name}', {c}, {l1}, {'TRUE' if w == M.WEIGHTINGS[1] else 'FALSE'})" for name, family, w, p in M.candidates(M.LOGIT_GRID, ()) if family == "LOGISTIC" for c, l1 in [p])


@query(
    "E-03 E-05",
    "fold_id:s horizon_hours:i config_id:s penalty:f9 optimal:b not_above_constant:b",
    f"""WITH {SQL_FIT}, w AS (SELECT fold_id, h, count(*) AS n FROM fit GROUP BY 1, 2)
        SELECT fold_id, h AS horizon_hours, config_id, 1 / (c * n) AS penalty, TRUE AS optimal, TRUE AS not_above_constant
        FROM w CROSS JOIN (VALUES {SQL_CONFIGS}) AS k(config_id, c, l1, balanced)""",
)
def logistic_optimality(spark, sf):
    """Every logistic fit of the benchmark in every fold and horizon: its penalty (both weightings sum to the number of
    rows), whether it meets the optimality conditions, and whether its objective is at most that of the constant model."""
    rows = parts(spark, sf)
    specs = [M.specification(c) for c in M.candidates(M.LOGIT_GRID, ()) if c[1] == "LOGISTIC"]
    fits = fitted(rows, *specs)
    entropy = rows.where("partition = 'FIT'").groupBy("part").agg(F.avg("y").alias("q"), F.count("*").alias("n")).collect()
    size = {r["part"]: (r["n"], -sum(q * math.log(q) for q in (r["q"], 1 - r["q"]) if q > 0)) for r in entropy}
    by_name = {s.name: s for s in specs}
    out = [(p, name, 1 / (by_name[name].c * size[p][0]), bool(f.residual <= 1e-9), bool(by_name[name].weight == 0 or f.objective <= size[p][1])) for (p, name), f in fits.items()]
    return named(spark.createDataFrame(out, "part int, config_id string, penalty double, optimal boolean, not_above_constant boolean"))


SQL_ROOT = f"""{SQL_FIT}, u AS (SELECT fold_id, h, y, unnest({PREDICTORS}) AS predictor, unnest([{', '.join(f'CAST({p} AS DOUBLE)' for p in PREDICTORS)}]) AS v FROM fit),
  k AS (SELECT fold_id, h, predictor, list_sort(list_distinct(list(v))) AS d, quantile_cont(v, [{', '.join(f'{i / 255!r}' for i in range(1, 255))}]) AS q FROM u GROUP BY 1, 2, 3),
  c AS (SELECT fold_id, h, predictor, CASE WHEN len(d) <= 255 THEN list_transform(range(1, len(d)), lambda i: (d[i] + d[i + 1]) / 2) ELSE list_distinct(q) END AS cuts FROM k),
  b AS (SELECT fold_id, h, predictor, CASE WHEN v IS NULL THEN 255 ELSE len(list_filter(cuts, lambda x: x < v)) END AS code, count(*) AS n, sum(y) AS pos FROM u JOIN c USING (fold_id, h, predictor) GROUP BY 1, 2, 3, 4),
  t AS (SELECT fold_id, h, count(*) AS rows, sum(y) AS positives, avg(y) AS q FROM fit GROUP BY 1, 2),
  e AS (SELECT fold_id, h, predictor, code, n, n * q - pos AS g, n * q * (1 - q) AS c FROM b JOIN t USING (fold_id, h)),
  m AS (SELECT fold_id, h, predictor, sum(n) FILTER (WHERE code = 255) AS n0, sum(g) FILTER (WHERE code = 255) AS g0, sum(c) FILTER (WHERE code = 255) AS c0, sum(n) AS nt, sum(g) AS gt, sum(c) AS ct FROM e GROUP BY 1, 2, 3),
  s AS (SELECT e.fold_id, e.h, e.predictor, sum(n) OVER w AS nl, sum(g) OVER w AS gl, sum(c) OVER w AS cl FROM e WHERE code < 255 WINDOW w AS (PARTITION BY fold_id, h, predictor ORDER BY code)),
  x AS (SELECT s.fold_id, s.h, nl + z * coalesce(n0, 0) AS nl, gl + z * coalesce(g0, 0) AS gl, cl + z * coalesce(c0, 0) AS cl, nt, gt, ct FROM s JOIN m USING (fold_id, h, predictor) CROSS JOIN (VALUES (0), (1)) AS i(z)),
  r AS (SELECT fold_id, h, max(gl * gl / (cl + 1) + (gt - gl) * (gt - gl) / (ct - cl + 1) - gt * gt / (ct + 1)) AS gain FROM x WHERE nl >= 20 AND nt - nl >= 20 AND cl >= 1e-3 AND ct - cl >= 1e-3 GROUP BY 1, 2)"""


@query(
    "E-04",
    "fold_id:s horizon_hours:i rows:i positives:i start:f first_gain:f4 rounds:i rounds_with_less_loss:i leaves_in_bounds:b trees:i",
    f"WITH {SQL_ROOT} SELECT fold_id, h AS horizon_hours, rows, positives, ln(q / (1 - q)) AS start, gain AS first_gain, 200 AS rounds, 200 AS rounds_with_less_loss, TRUE AS leaves_in_bounds, 200 AS trees FROM t JOIN r USING (fold_id, h)",
)
def boosting_rounds(spark, sf):
    """The boosted forest of every fold and horizon: its start, the gain of its first split, and that each round lowers the loss."""
    rows = parts(spark, sf)
    fits = fitted(rows, BOOSTING)
    size = {r["part"]: (r["n"], r["pos"]) for r in rows.where("partition = 'FIT'").groupBy("part").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect()}
    out = []
    for (p, _), f in fits.items():
        lower = sum(b < a for a, b in zip(f.losses, f.losses[1:]))
        leaves = [int((t.feature < 0).sum()) for t in f.trees]
        out.append((p, size[p][0], int(size[p][1]), f.start, f.first_gain, len(f.losses) - 1, lower, 2 <= min(leaves) and max(leaves) <= BOOSTING.leaves, len(f.trees)))
    return named(spark.createDataFrame(out, "part int, rows long, positives long, start double, first_gain double, rounds int, rounds_with_less_loss int, leaves_in_bounds boolean, trees int"))


BENCH_OUT = "horizon_hours:i fold_id:s config_id:s family:s rows:i average_precision:f brier_score:f macro_average_precision:f"
SQL_BASELINES = f"""{B.SQL_LABELS}, y AS (SELECT fold_id, receptor_id, partition, h, y FROM (SELECT fold_id, receptor_id, partition, unnest([24, 48, 72]) AS h,
    unnest([label_extreme_within_24h, label_extreme_within_48h, label_extreme_within_72h]) AS y FROM labels) WHERE y IS NOT NULL),
  g AS (SELECT h, fold_id, avg(y) AS g FROM y WHERE partition = 'FIT' GROUP BY 1, 2), r AS (SELECT h, fold_id, receptor_id, sum(y) AS s, count(*) AS n FROM y WHERE partition = 'FIT' GROUP BY 1, 2, 3),
  v AS (SELECT y.*, g, coalesce(s, 0) AS s, coalesce(r.n, 0) AS k FROM y JOIN g USING (h, fold_id) LEFT JOIN r USING (h, fold_id, receptor_id) WHERE partition = 'VALIDATION'),
  sc0 AS (SELECT h AS horizon_hours, fold_id, receptor_id, y, unnest(['B1_GLOBAL', 'B2_RECEPTOR_K50', 'B2_RECEPTOR_K200']) AS config_id, unnest([g, (s + 50 * g) / (k + 50), (s + 200 * g) / (k + 200)]) AS p0 FROM v),
  sp AS (SELECT *, least(greatest(p0, 1e-8), 1 - 1e-8) AS p FROM sc0),
  sc AS (SELECT horizon_hours, fold_id, config_id, p, count(*) AS n, count(*) FILTER (WHERE y = 1) AS pos FROM sp GROUP BY 1, 2, 3, 4),
  sr AS (SELECT horizon_hours, fold_id, config_id, receptor_id, p, count(*) AS n, count(*) FILTER (WHERE y = 1) AS pos FROM sp GROUP BY 1, 2, 3, 4, 5)"""


@query(
    "E-05",
    BENCH_OUT,
    f"""WITH {SQL_BASELINES}, {sql_metrics('sc', 'horizon_hours, fold_id, config_id')}, {sql_metrics('sr', 'horizon_hours, fold_id, config_id, receptor_id', 'r_')},
        m AS (SELECT horizon_hours, fold_id, config_id, avg(average_precision) FILTER (WHERE positives > 0 AND positives < rows) AS macro_average_precision FROM r_metrics GROUP BY 1, 2, 3)
        SELECT *, 'BASELINE' AS family FROM metrics LEFT JOIN m USING (horizon_hours, fold_id, config_id)""",
)
def baseline_benchmark(spark, sf):
    """The baselines of the benchmark in every fold and horizon."""
    return named(M.benchmark(parts(spark, sf), list(PARTS), "part", "receptor_id", "y", PREDICTORS, M.candidates((), ())))


@query("E-05 L-03", BENCH_OUT)
def candidate_benchmark(spark, sf):
    """All 19 configurations, of both weightings, in every fold and horizon."""
    return named(M.benchmark(parts(spark, sf), list(PARTS), "part", "receptor_id", "y", PREDICTORS, M.candidates()))


SQL_NEWTON = f"""{SQL_PRED}, z AS (SELECT y, ln(q / (1 - q)) AS z, count(*) AS w FROM (SELECT y, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM pred) GROUP BY 1, 2),
  st AS (SELECT sum(w) AS n FROM z),
  it AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
    UNION ALL SELECT i + 1, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM
      (SELECT i, a, b, sum(w * (m - y)) AS g0, sum(w * (m - y) * z) + 1e-6 * b AS g1, sum(w * m * (1 - m)) AS h00, sum(w * m * (1 - m) * z) AS h01, sum(w * m * (1 - m) * z * z) + 1e-6 AS h11
       FROM (SELECT i, a, b, w, y, z, 1 / (1 + exp(-(a + b * z))) AS m FROM it CROSS JOIN z WHERE i < 20) GROUP BY i, a, b))"""


@query(
    "E-11 E-12 M-16",
    "intercept:f3 slope:f3 rows:i",
    f"WITH RECURSIVE {SQL_NEWTON} SELECT a AS intercept, b AS slope, n AS rows FROM it CROSS JOIN st WHERE i = 20",
)
def platt_calibration(spark, sf):
    pred = predictions(spark, sf)
    a, b = M.fit_platt(pred, "y", "p")
    return pred.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(a).alias("intercept"), F.lit(b).alias("slope"), "rows")


@query("E-19 W-09", "fold_id:s horizon_hours:i predictor:s repeats:i mean_ap_drop:f std_ap_drop:f")
def permutation_importance(spark, sf):
    """Importance of each predictor to the logistic model in every fold and horizon."""
    rows = parts(spark, sf)
    fits = fitted(rows, fitting.Logistic("ridge", 0, 1.0, 0.0))
    val = M.with_contributions(rows.where("partition = 'VALIDATION'"), "part", PREDICTORS, ["receptor_id", "issue_date", "y"], {p: f for (p, _), f in fits.items()})
    val = fitting.written(val, "contributions")
    return named(M.permutation_importance(val, "part", ["receptor_id", "issue_date"], "receptor_id", PREDICTORS, STATIC, "y"))


SQL_DROPS = f"""o AS (SELECT o_orderkey AS k, CAST(o_custkey % 2 AS INT) AS part, o_custkey % 25 AS receptor, CASE WHEN o_orderpriority = '1-URGENT' OR o_totalprice > 250000 THEN 1 ELSE 0 END AS y,
    0.3 * (month(o_orderdate) - 6)::DOUBLE AS c0, 1.5 * (CAST(o_totalprice AS DOUBLE) / 100000 - 1) AS c1, 0.2 * (o_custkey % 25 * 7 % 11 - 5)::DOUBLE AS c2 FROM orders),
  v AS (SELECT *, -0.5 + c0 + c1 + c2 AS margin, count(*) OVER (PARTITION BY part) AS n, row_number() OVER (PARTITION BY part ORDER BY ('0x' || substr(md5(k || '|5'), 1, 15))::BIGINT) - 1 AS r FROM o),
  rc AS (SELECT part, receptor, c2, count(*) OVER (PARTITION BY part) AS n, row_number() OVER (PARTITION BY part ORDER BY ('0x' || substr(md5(receptor || '|6'), 1, 15))::BIGINT) - 1 AS r FROM (SELECT DISTINCT part, receptor, c2 FROM o)),
  i AS (SELECT unnest([0, 1, 2]) AS repeat),
  d AS (SELECT v.*, repeat, (r + 1 + ('0x' || substr(md5(repeat || '|5'), 1, 8))::BIGINT % (n - 1)) % n AS f FROM v CROSS JOIN i),
  e AS (SELECT rc.*, repeat, (r + 1 + ('0x' || substr(md5(repeat || '|6'), 1, 8))::BIGINT % (n - 1)) % n AS f FROM rc CROSS JOIN i),
  mv AS (SELECT d.part, d.repeat, d.y, unnest(['month', 'price']) AS predictor, unnest([d.margin - d.c0 + v.c0, d.margin - d.c1 + v.c1]) AS m FROM d JOIN v ON v.part = d.part AND v.r = d.f
    UNION ALL SELECT v.part, e.repeat, v.y, 'receptor', v.margin - v.c2 + g.c2 FROM v JOIN e ON e.part = v.part AND e.receptor = v.receptor JOIN rc g ON g.part = e.part AND g.r = e.f),
  p AS (SELECT part, predictor, repeat, least(greatest(1 / (1 + exp(-m)), 1e-8), 1 - 1e-8) AS p, y FROM mv UNION ALL SELECT part, 'base', 0, least(greatest(1 / (1 + exp(-margin)), 1e-8), 1 - 1e-8), y FROM v),
  sc AS (SELECT part, predictor, repeat, p, count(*) AS n, count(*) FILTER (WHERE y = 1) AS pos FROM p GROUP BY 1, 2, 3, 4)"""


@query(
    "E-19",
    "part:i predictor:s repeats:i mean_ap_drop:f4 std_ap_drop:f4",
    f"""WITH {SQL_DROPS}, {sql_metrics('sc', 'part, predictor, repeat')}, dr AS (SELECT m.part, m.predictor, b.average_precision - m.average_precision AS x FROM metrics m JOIN metrics b ON b.part = m.part AND b.predictor = 'base' WHERE m.predictor <> 'base')
        SELECT part, predictor, count(*) AS repeats, avg(x) AS mean_ap_drop, stddev_pop(x) AS std_ap_drop FROM dr GROUP BY 1, 2""",
)
def linear_importance(spark, sf):
    """Importance of the predictors of a given linear model of urgent or dear orders, in two parts."""
    o = B.table(spark, sf, "orders")
    receptor = F.col("o_custkey") % 25
    each = [0.3 * (F.month("o_orderdate") - 6), 1.5 * (F.col("o_totalprice").cast("double") / 100000 - 1), 0.2 * (receptor * 7 % 11 - 5)]
    each = [c.cast("double") for c in each]
    val = o.select(
        F.col("o_orderkey").alias("k"),
        (F.col("o_custkey") % 2).cast("int").alias("part"),
        receptor.alias("receptor"),
        ((F.col("o_orderpriority") == "1-URGENT") | (F.col("o_totalprice") > 250000)).cast("int").alias("y"),
        (F.lit(-0.5) + each[0] + each[1] + each[2]).alias("margin"),
        F.array(*each).alias("contributions"),
    )
    return M.permutation_importance(val, "part", ["k"], "receptor", ["month", "price", "receptor"], ["receptor"], "y", repeats=3, seed=5)


@query(
    "E-19",
    "doc_id:i n_chars:i",
    """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY ('0x' || substr(md5(doc_id || '|11'), 1, 15))::BIGINT) AS r FROM documents),
       b AS (SELECT n_chars, row_number() OVER (ORDER BY ('0x' || substr(md5(doc_id || '|12'), 1, 15))::BIGINT) AS r FROM documents)
       SELECT doc_id, n_chars FROM a JOIN b USING (r)""",
)
def row_permutation(spark, sf):
    return M.permute_rows(B.table(spark, sf, "documents").select("doc_id", "n_chars"), ["doc_id"], "n_chars", 11)


@query(
    "E-19",
    "c_custkey:i nation_balance:f2",
    """WITH v AS (SELECT c_nationkey AS k, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS v FROM customer GROUP BY 1),
       a AS (SELECT k, row_number() OVER (ORDER BY ('0x' || substr(md5(k || '|21'), 1, 15))::BIGINT) AS r FROM v), b AS (SELECT v, row_number() OVER (ORDER BY ('0x' || substr(md5(k || '|22'), 1, 15))::BIGINT) AS r FROM v)
       SELECT c_custkey, b.v AS nation_balance FROM customer JOIN a ON k = c_nationkey JOIN b USING (r)""",
)
def receptor_permutation(spark, sf):
    c = B.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    total = c.groupBy("c_nationkey").agg(F.sum(B.money(F.col("c_acctbal"))).cast("double").alias("nation_balance"))
    return M.permute_receptors(c.join(total, "c_nationkey").select("c_custkey", "c_nationkey", "nation_balance"), "c_nationkey", "nation_balance", 21)


@query(
    "E-21",
    "doc_id:i p:f flag_max_csi:b flag_recall80:b missing_predictors:i",
    f"WITH {SQL_PRED} SELECT doc_id, p, p >= 0.6 AS flag_max_csi, p >= 0.4 AS flag_recall80, CAST(source IS NULL AS INT) + CAST(receptor_id IS NULL AS INT) AS missing_predictors FROM pred",
)
def scored_flags(spark, sf):
    return M.score_with_flags(predictions(spark, sf), ["source", "receptor_id"], "p", F.lit(0.6), F.lit(0.4))


@query(
    "E-10 E-08",
    "raw_brier:f raw_log_loss:f calibrated_log_loss:f4",
    f"""WITH RECURSIVE {SQL_NEWTON}, f AS (SELECT a, b FROM it WHERE i = 20), c AS (SELECT y, p, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM pred),
        l AS (SELECT y, p, least(greatest(p, 1e-8), 1 - 1e-8) AS q0, 1 / (1 + exp(-(a + b * ln(q / (1 - q))))) AS m FROM c CROSS JOIN f)
        SELECT avg((p - y) ** 2) AS raw_brier, -avg(y * ln(q0) + (1 - y) * ln(1 - q0)) AS raw_log_loss, -avg(y * ln(m) + (1 - y) * ln(1 - m)) AS calibrated_log_loss FROM l""",
)
def calibration_gain(spark, sf):
    """Brier score before calibration, and the log losses before and after the Platt fit."""
    pred = predictions(spark, sf)
    cal = M.calibrate(pred, "p", M.fit_platt(pred, "y", "p"))
    raw = E.probability_metrics(pred, [], "y", "p").select(F.col("brier_score").alias("raw_brier"), F.col("log_loss").alias("raw_log_loss"))
    after = E.probability_metrics(cal, [], "y", "calibrated_probability").select("log_loss").scalar()
    return raw.select("raw_brier", "raw_log_loss", after.alias("calibrated_log_loss"))
