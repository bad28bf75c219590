"""Scoring, thresholds, bootstrap, drift and selection on the provided tables.

Predictions: documents with a label; y is low quality, the receptor is the language, the block is language
and source, the probability a logistic curve in log length.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rainshed import policy
from rainshed.operators import evaluate as E
from rainshed.operators import labels as L
from rainshed.operators import quality as Q
from rainshed.operators import windows as W
from rainshed.operators.distributed import exact_quantiles
from rainshed.plans import bindings as B
from rainshed.plans.panel_queries import labels
from rainshed.plans.registry import query


def predictions(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = B.table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select(
        "doc_id",
        F.col("lang").alias("receptor_id"),
        "source",
        F.date_add(F.lit("1997-09-01").cast("date"), (F.col("doc_id") % 122).cast("int")).alias("issue_date"),
        (1 - F.col("quality")).alias("y"),
        (1500.0 / (F.col("n_chars") + 1500.0)).alias("p"),
    )


SQL_PRED = "pred AS (SELECT doc_id, lang AS receptor_id, source, DATE '1997-09-01' + CAST(doc_id % 122 AS INT) AS issue_date, 1 - quality AS y, 1500.0::DOUBLE / (n_chars + 1500.0::DOUBLE) AS p FROM documents JOIN labels USING (doc_id))"


def sql_metrics(source: str, keys: str, prefix: str = "") -> str:
    """Metric CTEs from (keys, p, n, pos) rows of ``source``."""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    cols = f"{keys}, " if keys else ""
    return f"""{prefix}cum AS (SELECT *, sum(n) OVER ({part} ORDER BY p DESC) AS cn, sum(pos) OVER ({part} ORDER BY p DESC) AS cp, sum(n) OVER ({part}) AS tn, sum(pos) OVER ({part}) AS tp FROM {source}),
  {prefix}metrics AS (SELECT {cols}CAST(sum(n) AS BIGINT) AS rows, CAST(sum(pos) AS BIGINT) AS positives, CASE WHEN sum(pos) > 0 THEN sum(pos * (cp / cn)) / sum(pos) END AS average_precision,
    CASE WHEN sum(pos) > 0 AND sum(n) > sum(pos) THEN sum(pos * ((tn - tp) - (cn - cp) + (n - pos) / 2)) / (sum(pos) * (sum(n) - sum(pos))) END AS roc_auc,
    sum(pos * pow(1 - p, 2) + (n - pos) * pow(p, 2)) / sum(n) AS brier_score, sum(-(pos * ln(p) + (n - pos) * ln(1 - p))) / sum(n) AS log_loss FROM {prefix}cum {group})"""


SQL_SCORES_R = f"{SQL_PRED}, sc AS (SELECT receptor_id, least(greatest(p, 1e-8), 1 - 1e-8) AS p, count(*) AS n, count(*) FILTER (WHERE y = 1) AS pos FROM pred GROUP BY 1, 2)"
SQL_SCORES = f"{SQL_PRED}, sc AS (SELECT least(greatest(p, 1e-8), 1 - 1e-8) AS p, count(*) AS n, count(*) FILTER (WHERE y = 1) AS pos FROM pred GROUP BY 1)"
METRIC_OUT = "rows:i positives:i average_precision:f roc_auc:f brier_score:f log_loss:f"


@query("E-06 E-07 E-08 D-14", METRIC_OUT, f"WITH {SQL_SCORES}, {sql_metrics('sc', '')} SELECT * FROM metrics")
def probability_metrics(spark, sf):
    return E.probability_metrics(predictions(spark, sf), [], "y", "p")


@query(
    "E-16 E-06 E-07 E-08",
    "receptor_id:s " + METRIC_OUT,
    f"WITH {SQL_SCORES_R}, {sql_metrics('sc', 'receptor_id')} SELECT * FROM metrics",
)
def metrics_by_receptor(spark, sf):
    return E.probability_metrics(predictions(spark, sf), ["receptor_id"], "y", "p")


SQL_SCORES_Y = f"{SQL_PRED}, sc AS (SELECT 1990 + doc_id % 11 AS year, least(greatest(p, 1e-8), 1 - 1e-8) AS p, count(*) AS n, count(*) FILTER (WHERE y = 1) AS pos FROM pred GROUP BY 1, 2)"


@query("E-16", "year:i " + METRIC_OUT, f"WITH {SQL_SCORES_Y}, {sql_metrics('sc', 'year')} SELECT * FROM metrics")
def metrics_by_year(spark, sf):
    """Scores by issue year; the documents' ids stand for years."""
    p = predictions(spark, sf).withColumn("year", 1990 + F.col("doc_id") % 11)
    return E.probability_metrics(p, ["year"], "y", "p")


@query(
    "E-09",
    "macro_average_precision:f receptors:i",
    f"WITH {SQL_SCORES_R}, {sql_metrics('sc', 'receptor_id')} SELECT avg(average_precision) FILTER (WHERE positives > 0 AND positives < rows) AS macro_average_precision, count(*) FILTER (WHERE positives > 0 AND positives < rows) AS receptors FROM metrics",
)
def macro_average_precision(spark, sf):
    return E.macro_average_precision(predictions(spark, sf), [], "receptor_id", "y", "p")


@query(
    "E-10 E-01",
    "receptor_id:s brier_score:f reference_brier:f brier_skill_score:f",
    f"""WITH {SQL_PRED}, g AS (SELECT avg(y) AS c FROM pred), m AS (SELECT receptor_id, avg((p - y) ** 2) AS brier_score, avg((c - y) ** 2) AS reference_brier FROM pred CROSS JOIN g GROUP BY 1)
        SELECT *, 1 - brier_score / reference_brier AS brier_skill_score FROM m""",
)
def brier_skill(spark, sf):
    pred = predictions(spark, sf)
    model = E.probability_metrics(pred, ["receptor_id"], "y", "p")
    return E.brier_skill(model, E.climatology_reference(pred, ["receptor_id"], "y"), ["receptor_id"])


@query(
    "E-13",
    "receptor_id:s tp:i fp:i fn:i tn:i precision:f recall:f csi:f f1:f specificity:f",
    f"""WITH {SQL_PRED}, c AS (SELECT receptor_id, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn FROM pred GROUP BY 1),
        r AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c)
        SELECT *, tp / nullif(tp + fp + fn, 0) AS csi, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1, tn / nullif(tn + fp, 0) AS specificity FROM r""",
)
def threshold_contingency(spark, sf):
    return E.at_threshold(predictions(spark, sf), ["receptor_id"], "y", "p", F.lit(0.5))


SQL_SWEEP = f"""{SQL_PRED}, lv AS (SELECT DISTINCT t FROM (SELECT 0.001::DOUBLE + i * (0.998::DOUBLE / 998.0) AS t FROM range(999) r(i)
    UNION ALL SELECT unnest(quantile_cont(p, [{', '.join(f'{i / 100}' for i in range(1, 100))}])) FROM pred)),
  cnt AS (SELECT t AS threshold, count(*) FILTER (WHERE p >= t AND y = 1) AS tp, count(*) FILTER (WHERE p >= t AND y = 0) AS fp, count(*) FILTER (WHERE p < t AND y = 1) AS fn, count(*) FILTER (WHERE p < t AND y = 0) AS tn FROM pred CROSS JOIN lv GROUP BY 1),
  sweep AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, tp / nullif(tp + fp + fn, 0) AS csi FROM cnt)"""


@query(
    "E-14",
    "threshold:f9 tp:i fp:i fn:i tn:i precision:f recall:f csi:f",
    f"WITH {SQL_SWEEP} SELECT * FROM sweep",
)
def threshold_sweep(spark, sf):
    return E.threshold_sweep(predictions(spark, sf), [], "y", "p")


@query(
    "E-15 L-04",
    "rule:s threshold:f9 tp:i fp:i precision:f recall:f csi:f",
    f"""WITH {SQL_SWEEP}, m AS (SELECT * FROM sweep WHERE csi IS NOT NULL ORDER BY csi DESC, recall DESC NULLS LAST, precision DESC NULLS LAST, threshold LIMIT 1),
        r AS (SELECT * FROM sweep WHERE recall >= 0.8 AND precision IS NOT NULL AND csi IS NOT NULL ORDER BY precision DESC, csi DESC, threshold DESC LIMIT 1)
        SELECT 'MAX_CSI' AS rule, * FROM m UNION ALL SELECT 'RECALL80_MAX_PRECISION', * FROM (SELECT * FROM r UNION ALL SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM r))""",
)
def threshold_selection(spark, sf):
    return E.choose_thresholds(E.threshold_sweep(predictions(spark, sf), [], "y", "p"), [])


def daily_predictions(spark, sf):
    return predictions(spark, sf).groupBy("receptor_id", "issue_date").agg(F.max("y").alias("y"), F.max("p").alias("p"))


def _sql_clusters(flag: str, other: str, name: str) -> str:
    return f"""{name}f AS (SELECT *, CASE WHEN date_diff('day', lag(issue_date) OVER (PARTITION BY receptor_id ORDER BY issue_date), issue_date) <= 1 THEN 0 ELSE 1 END AS new FROM dp WHERE {flag}),
  {name}r AS (SELECT *, sum(new) OVER (PARTITION BY receptor_id ORDER BY issue_date) AS rid FROM {name}f), {name} AS (SELECT receptor_id, rid, bool_or({other}) AS hit FROM {name}r GROUP BY 1, 2)"""


@query(
    "E-17",
    "true_clusters:i hit_clusters:i alert_clusters:i false_alert_clusters:i hit_rate:f false_alert_fraction:f",
    f"""WITH {SQL_PRED}, dp AS (SELECT receptor_id, issue_date, max(y) AS y, max(p) AS p FROM pred GROUP BY 1, 2), {_sql_clusters('y = 1', 'p >= 0.6', 'tc')}, {_sql_clusters('p >= 0.6', 'y = 1', 'ac')},
        c AS (SELECT (SELECT count(*) FROM tc) AS true_clusters, (SELECT count(*) FROM tc WHERE hit) AS hit_clusters, (SELECT count(*) FROM ac) AS alert_clusters, (SELECT count(*) FROM ac WHERE NOT hit) AS false_alert_clusters)
        SELECT *, hit_clusters / true_clusters AS hit_rate, false_alert_clusters / alert_clusters AS false_alert_fraction FROM c""",
)
def alert_clusters(spark, sf):
    return E.cluster_metrics(daily_predictions(spark, sf), [], "receptor_id", "issue_date", "y", "p", F.lit(0.6))


REPS = policy.BOOTSTRAP_REPLICATES
SQL_BOOT = f"""{SQL_PRED}, bl AS (SELECT receptor_id, source, row_number() OVER (ORDER BY receptor_id, source) - 1 AS block_id, count(*) OVER () AS nb FROM (SELECT DISTINCT receptor_id, source FROM pred)),
  dr AS (SELECT rep AS replicate, (('0x' || substr(md5(rep || '|' || block_id || '|' || {policy.SEED}), 1, 8))::BIGINT % nb) AS block_id FROM bl CROSS JOIN range(1, {REPS + 1}) t(rep)),
  mu AS (SELECT replicate, block_id, count(*) AS m FROM dr GROUP BY 1, 2),
  sc AS (SELECT receptor_id, source, least(greatest(p, 1e-8), 1 - 1e-8) AS p, count(*) AS n, count(*) FILTER (WHERE y = 1) AS pos FROM pred GROUP BY 1, 2, 3),
  wt AS (SELECT replicate, p, CAST(sum(n * m) AS BIGINT) AS n, CAST(sum(pos * m) AS BIGINT) AS pos FROM sc JOIN bl USING (receptor_id, source) JOIN mu USING (block_id) GROUP BY 1, 2), {sql_metrics('wt', 'replicate')}"""


@query("E-18", "replicate:i " + METRIC_OUT, f"WITH {SQL_BOOT} SELECT * FROM metrics")
def block_bootstrap(spark, sf):
    return E.block_bootstrap(predictions(spark, sf), ["receptor_id", "source"], "y", "p", REPS)


@query(
    "E-18",
    "metric:s replicates:i mean:f ci_low:f ci_high:f",
    f"""WITH {SQL_BOOT}, l AS (SELECT unnest(['average_precision', 'roc_auc', 'brier_score', 'log_loss']) AS metric, unnest([average_precision, roc_auc, brier_score, log_loss]) AS value FROM metrics)
        SELECT metric, count(value) AS replicates, avg(value) AS mean, quantile_cont(value, 0.025) AS ci_low, quantile_cont(value, 0.975) AS ci_high FROM l GROUP BY 1""",
)
def bootstrap_intervals(spark, sf):
    return E.bootstrap_intervals(E.block_bootstrap(predictions(spark, sf), ["receptor_id", "source"], "y", "p", REPS))


# ---- baselines and weights ---------------------------------------------------------------------------------------
@query(
    "E-01",
    "fold_id:s horizon_hours:i fit_climatology:f fit_rows:i",
    f"""WITH {B.SQL_LABELS}, long AS (SELECT fold_id, partition, receptor_id, unnest([24, 48, 72]) AS horizon_hours, unnest([label_extreme_within_24h, label_extreme_within_48h, label_extreme_within_72h]) AS label FROM labels)
        SELECT fold_id, horizon_hours, avg(label) AS fit_climatology, count(label) AS fit_rows FROM long WHERE partition = 'FIT' AND label IS NOT NULL GROUP BY 1, 2""",
)
def fit_climatology(spark, sf):
    long = L.long_labels(labels(spark, sf), ["fold_id", "partition", "receptor_id"])
    return E.fit_climatology(long.where("partition = 'FIT'"), ["fold_id", "horizon_hours"], "label")


@query(
    "E-02",
    "fold_id:s receptor_id:i issue_date:d probability:f",
    f"""WITH {B.SQL_LABELS}, f AS (SELECT fold_id, receptor_id, sum(label_extreme_within_72h) AS s, count(label_extreme_within_72h) AS n FROM labels WHERE partition = 'FIT' AND label_extreme_within_72h IS NOT NULL AND receptor_id <> 7 GROUP BY 1, 2),
        g AS (SELECT fold_id, sum(s) / sum(n) AS gp FROM f GROUP BY 1)
        SELECT l.fold_id, l.receptor_id, issue_date, coalesce((s + gp * 50) / (n + 50), gp) AS probability FROM labels l JOIN g USING (fold_id) LEFT JOIN f ON f.fold_id = l.fold_id AND f.receptor_id = l.receptor_id WHERE partition = 'VALIDATION'""",
)
def smoothed_climatology(spark, sf):
    lab = labels(spark, sf)
    fit = lab.where("partition = 'FIT' AND receptor_id <> 7")
    target = lab.where("partition = 'VALIDATION'").select("fold_id", "receptor_id", "issue_date")
    return E.smoothed_climatology(fit, target, ["fold_id"], "receptor_id", "label_extreme_within_72h", policy.CLIMATOLOGY_SHRINKAGE[0])


@query(
    "W-16",
    "fold_id:s receptor_id:i issue_date:d weight:f",
    f"""WITH {B.SQL_LABELS}, x AS (SELECT fold_id, receptor_id, issue_date FROM labels WHERE partition = 'FIT' AND label_extreme_within_72h IS NOT NULL)
        SELECT fold_id, receptor_id, issue_date, count(*) OVER (PARTITION BY fold_id) / (r * count(*) OVER (PARTITION BY fold_id, receptor_id)) AS weight FROM x JOIN (SELECT fold_id, count(DISTINCT receptor_id) AS r FROM x GROUP BY 1) USING (fold_id)""",
)
def receptor_balanced_weights(spark, sf):
    x = labels(spark, sf).where("partition = 'FIT' AND label_extreme_within_72h IS NOT NULL").select("fold_id", "receptor_id", "issue_date")
    return E.balance_weights(x, ["fold_id"], "receptor_id")


# ---- selection ---------------------------------------------------------------------------------------------------
@query(
    "L-02",
    "p_brand:s p_partkey:i revenue:f2 position:i side:s",
    """WITH g AS (SELECT p_brand, p_partkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY revenue DESC, p_partkey) AS d, row_number() OVER (PARTITION BY p_brand ORDER BY revenue, p_partkey) AS a FROM g)
       SELECT p_brand, p_partkey, revenue, d AS position, 'TOP' AS side FROM r WHERE d <= 5 UNION ALL SELECT p_brand, p_partkey, revenue, a, 'BOTTOM' FROM r WHERE a <= 5""",
)
def top_and_bottom(spark, sf):
    li = B.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum(B.money(F.col("l_extendedprice"))).cast("double").alias("revenue"))
    p = B.table(spark, sf, "part").select("p_partkey", "p_brand")
    return E.top_bottom(li.join(p, F.col("l_partkey") == F.col("p_partkey")), ["p_brand"], "revenue", "p_partkey")


@query(
    "L-03",
    "horizon:s config:i mean_ap:f mean_brier:f folds:i selection_rank:i",
    """WITH f AS (SELECT o_orderpriority AS horizon, o_custkey % 19 AS config, year(o_orderdate) AS fold, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS ap, avg(o_totalprice / 500000) AS brier FROM orders GROUP BY 1, 2, 3),
       m AS (SELECT horizon, config, avg(ap) AS mean_ap, avg(brier) AS mean_brier, count(*) AS folds FROM f GROUP BY 1, 2)
       SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY round(mean_ap, 12) DESC, round(mean_brier, 12), config) AS selection_rank FROM m""",
)
def candidate_selection(spark, sf):
    o = B.table(spark, sf, "orders")
    f = o.groupBy(
        F.col("o_orderpriority").alias("horizon"), (F.col("o_custkey") % 19).alias("config"), F.year("o_orderdate").alias("fold")
    ).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("ap"), F.avg(F.col("o_totalprice") / 500000).alias("brier"))
    return E.select_candidates(f, "horizon", "config", "ap", "brier")


@query(
    "E-20",
    "p_type:s predictors:i importance_sum:f2 positive_importance_sum:f2 importance_mean:f importance_max:f2",
    "SELECT p_type, count(*) AS predictors, sum(v) AS importance_sum, sum(greatest(v, 0)) AS positive_importance_sum, avg(v) AS importance_mean, max(v) AS importance_max FROM (SELECT p_type, p_retailprice - 950 AS v FROM part) GROUP BY 1",
)
def importance_by_family(spark, sf):
    p = B.table(spark, sf, "part").select("p_type", (F.col("p_retailprice") - 950).alias("v"))
    return E.family_importance(p, ["p_type"], "v")


# ---- drift -------------------------------------------------------------------------------------------------------
@query(
    "P-12",
    "receptor_id:i date:d value:f2",
    f"""WITH {B.SQL_DENSE}, q AS (SELECT receptor_id, quantile_cont(value, 0.9) AS q90 FROM dense GROUP BY 1)
        SELECT receptor_id, date, value FROM dense JOIN q USING (receptor_id) WHERE coalesce(value >= q90, false) OR (season_day - 1) % 14 = 0""",
)
def stress_sample(spark, sf):
    p = B.dense_panel(spark, sf)
    # A receptor has one row per day here; the quantile state is bounded by the calendar.
    q = p.groupBy("receptor_id").agg(F.percentile("value", F.lit(0.9)).alias("q90"))
    return p.join(q, "receptor_id").where(
        F.coalesce(F.col("value") >= F.col("q90"), F.lit(False)) | ((F.col("season_day") - 1) % 14 == 0)
    )


PROFILE_NAMES = [f"q{str(p)[2:]}" for p in Q.PROFILE_PROBS]


@query(
    "A-29",
    "l_returnflag:s n:i min:f2 max:f2 mean:f2 std:f2 iqr:f2 robust_scale:f2 " + " ".join(f"{n}:f2" for n in PROFILE_NAMES),
    "WITH p AS (SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS min, max(l_extendedprice) AS max, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS std, "
    + ", ".join(f"quantile_cont(l_extendedprice, {p}) AS {n}" for p, n in zip(Q.PROFILE_PROBS, PROFILE_NAMES))
    + " FROM lineitem GROUP BY 1) SELECT *, q75 - q25 AS iqr, (q75 - q25) / 1.349 AS robust_scale FROM p",
)
def distribution_profile(spark, sf):
    return Q.profile(B.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")


def current_and_history(spark, sf):
    p = B.dense_panel(spark, sf).select("receptor_id", "date", "season_year", "value")
    return p.where("season_year = 2000"), p.where("season_year < 2000")


SQL_COMPAT = f"""{B.SQL_DENSE}, h AS (SELECT receptor_id, value FROM dense WHERE season_year < 2000 AND value IS NOT NULL), c AS (SELECT receptor_id, date, value FROM dense WHERE season_year = 2000),
  pr AS (SELECT receptor_id, count(*) AS n, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM h GROUP BY 1),
  pc AS (SELECT c.receptor_id, c.date, c.value, CASE WHEN c.value IS NOT NULL THEN (count(*) FILTER (WHERE h.value < c.value) + count(*) FILTER (WHERE h.value <= c.value)) / (2.0 * count(*)) END AS percentile FROM c JOIN h USING (receptor_id) GROUP BY 1, 2, 3),
  st AS (SELECT pc.*, (value - med) / nullif(iqr / 1.349, 0) AS robust_z, CASE WHEN value IS NULL THEN 'CURRENT_MISSING' WHEN value < lo THEN 'BELOW_HISTORICAL_MIN' WHEN value > hi THEN 'ABOVE_HISTORICAL_MAX'
    WHEN percentile < 0.005 OR percentile > 1 - 0.005 THEN 'WITHIN_RANGE_EXTREME_TAIL' WHEN percentile < 0.01 OR percentile > 1 - 0.01 THEN 'WITHIN_RANGE_1PCT_TAIL' ELSE 'WITHIN_HISTORICAL_RANGE' END AS range_state FROM pc JOIN pr USING (receptor_id))"""


@query(
    "W-14 W-15 Q-08",
    "receptor_id:i date:d value:f2 percentile:f robust_z:f range_state:s",
    f"WITH {SQL_COMPAT} SELECT * FROM st",
)
def range_state_vs_history(spark, sf):
    cur, hist = current_and_history(spark, sf)
    return Q.compatibility(cur, hist, ["receptor_id"], ["receptor_id", "date"], "value")


@query(
    "Q-09",
    "receptor_id:i receptors:i missing:i outside:i extreme_tail:i one_percent_tail:i max_abs_robust_z:f compatibility_state:s",
    f"""WITH {SQL_COMPAT}, g AS (SELECT receptor_id, count(*) AS receptors, count(*) FILTER (WHERE range_state = 'CURRENT_MISSING') AS missing, count(*) FILTER (WHERE range_state IN ('BELOW_HISTORICAL_MIN', 'ABOVE_HISTORICAL_MAX')) AS outside,
        count(*) FILTER (WHERE range_state = 'WITHIN_RANGE_EXTREME_TAIL') AS extreme_tail, count(*) FILTER (WHERE range_state = 'WITHIN_RANGE_1PCT_TAIL') AS one_percent_tail, max(abs(robust_z)) AS max_abs_robust_z FROM st GROUP BY 1)
        SELECT *, CASE WHEN missing = receptors THEN 'CURRENTLY_UNAVAILABLE' WHEN outside > 0 THEN 'REVIEW_OUTSIDE_TRAINING_SUPPORT' WHEN extreme_tail > 0 OR one_percent_tail > 0 THEN 'REVIEW_TAIL' ELSE 'WITHIN_TRAINING_RANGE' END AS compatibility_state FROM g""",
)
def compatibility_rollup(spark, sf):
    cur, hist = current_and_history(spark, sf)
    return Q.compatibility_summary(Q.compatibility(cur, hist, ["receptor_id"], ["receptor_id", "date"], "value"), ["receptor_id"])


@query(
    "Q-09 A-27",
    "fold_id:s partition:s feature:s missing_fraction:f",
    f"""WITH {B.SQL_DENSE}, {B.SQL_FOLDS}, {B.sql_expand('dense')} SELECT fold_id, partition, unnest(['value', 'discount', 'late']) AS feature,
        unnest([avg(CAST(value IS NULL AS INT)), avg(CAST(discount IS NULL AS INT)), avg(CAST((CASE WHEN season_day > 14 THEN value END) IS NULL AS INT))]) AS missing_fraction FROM expanded GROUP BY fold_id, partition""",
)
def missingness_shift(spark, sf):
    p = B.dense_panel(spark, sf).withColumn("late", F.when(F.col("season_day") > 14, F.col("value")))
    return Q.missingness_shift(L.expand_folds(p, B.FOLDS), ["fold_id", "partition"], ["value", "discount", "late"])


@query(
    "A-30",
    "receptor_id:i common_n:i pearson:f mae:f bias:f rmse:f nrmse:f median_ratio:f angle_median:f angle_p90:f",
    f"""WITH {B.SQL_DENSE}, a AS (SELECT *, CASE WHEN value > 1 THEN peak / 1000 / value END AS ratio, abs((value * 7 % 360 - peak / 100 % 360 + 540) % 360 - 180) AS turn FROM dense)
        SELECT receptor_id, count(*) FILTER (WHERE value IS NOT NULL) AS common_n, corr(value, peak / 1000) AS pearson, avg(abs(peak / 1000 - value)) AS mae, avg(peak / 1000 - value) AS bias,
        sqrt(avg((peak / 1000 - value) ** 2)) AS rmse, sqrt(avg((peak / 1000 - value) ** 2)) / stddev_pop(value) AS nrmse,
        quantile_cont(ratio, 0.5) AS median_ratio, quantile_cont(turn, 0.5) AS angle_median, quantile_cont(turn, 0.9) AS angle_p90 FROM a GROUP BY 1""",
)
def series_agreement(spark, sf):
    """Agreement of two series, the median of their ratio, and median and p90 of the angle between two directions."""
    p = B.dense_panel(spark, sf)
    base = p.groupBy("receptor_id").agg(*Q.agreement(F.col("value"), F.col("peak") / 1000))
    turn = Q.angular_difference(F.col("value") * 7 % 360, F.col("peak") / 100 % 360)
    extra = p.select("receptor_id", Q.bounded_ratio(F.col("value"), F.col("peak") / 1000, 1.0).alias("ratio"), turn.alias("turn"))
    ratio = exact_quantiles(extra, ["receptor_id"], "ratio", [0.5], names=["median_ratio"])
    angle = exact_quantiles(extra, ["receptor_id"], "turn", [0.5, 0.9], names=["angle_median", "angle_p90"])
    return base.join(ratio, "receptor_id", "left").join(angle, "receptor_id", "left")


# ---- missing cells and gates -------------------------------------------------------------------------------------
RULES = (("prev1d", 2, "EXPECTED_SEASON_START_PREV1D", False), ("prev7d", 8, "EXPECTED_SEASON_START_PREV7D", False), ("value", 0, None, True))


def missing_cells(spark, sf):
    w = W.SeasonWindow(["receptor_id"])
    p = B.sparse_panel(spark, sf).select(
        "receptor_id", "date", "season_day", "value", w.lag("value").alias("prev1d"), w.previous("value", 7).alias("prev7d")
    )
    cells = p.unpivot(["receptor_id", "date", "season_day"], ["value", "prev1d", "prev7d"], "feature", "value")
    rules = spark.createDataFrame(RULES, "feature string, min_season_day int, edge_reason string, conditional boolean")
    in_season = F.col("season_day") <= 110
    return Q.classify_missing(cells, rules, in_season, (F.col("receptor_id") % 3).cast("double"))


SQL_CELLS = f"""{B.SQL_SPARSE}, h AS (SELECT receptor_id, date, season_day, value, max(value) OVER (PARTITION BY receptor_id, season_year ORDER BY date RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS prev1d,
    CASE WHEN count(value) OVER w7 = 7 THEN sum(value) OVER w7 END AS prev7d FROM sparse WINDOW w7 AS (PARTITION BY receptor_id, season_year ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
  cl AS (SELECT receptor_id, date, season_day, unnest(['value', 'prev1d', 'prev7d']) AS feature, unnest([value, prev1d, prev7d]) AS v FROM h),
  mc AS (SELECT receptor_id, date, feature, CASE WHEN v IS NOT NULL THEN 'PRESENT' WHEN season_day > 110 THEN 'EXPECTED_OUT_OF_SEASON' WHEN season_day < CASE feature WHEN 'prev1d' THEN 2 WHEN 'prev7d' THEN 8 ELSE 0 END THEN 'EXPECTED_STRUCTURAL_SEASON_EDGE'
    WHEN feature = 'value' AND receptor_id % 3 <= 0 THEN 'EXPECTED_CONDITIONAL_MEDSEA_NO_SUPPORT' ELSE 'UNEXPECTED_OPERATIONAL_MISSING' END AS missing_class FROM cl)"""


@query(
    "Q-07",
    "receptor_id:i date:d feature:s missing_class:s missing_reason:s",
    f"""WITH {SQL_CELLS} SELECT *, CASE missing_class WHEN 'EXPECTED_OUT_OF_SEASON' THEN 'CORE_APPLIES_SEP_DEC_ONLY' WHEN 'EXPECTED_STRUCTURAL_SEASON_EDGE' THEN 'EXPECTED_SEASON_START_' || upper(feature)
        WHEN 'EXPECTED_CONDITIONAL_MEDSEA_NO_SUPPORT' THEN 'BASELINE_MEDSEA_SUPPORT_FALSE' WHEN 'UNEXPECTED_OPERATIONAL_MISSING' THEN 'NOT_EXPLAINED_BY_FROZEN_MISSINGNESS_POLICY' ELSE '' END AS missing_reason FROM mc""",
)
def missing_cell_classes(spark, sf):
    return missing_cells(spark, sf)


@query(
    "P-09",
    "feature:s date:d gate_state:s",
    f"""WITH {SQL_CELLS}, g AS (SELECT feature, date, {', '.join(f"count(*) FILTER (WHERE missing_class = '{c}') AS {n}" for n, c in (('u', 'UNEXPECTED_OPERATIONAL_MISSING'), ('e', 'EXPECTED_STRUCTURAL_SEASON_EDGE'), ('s', 'EXPECTED_CONDITIONAL_MEDSEA_NO_SUPPORT'), ('o', 'EXPECTED_OUT_OF_SEASON')))} FROM mc GROUP BY 1, 2)
        SELECT feature, date, CASE WHEN u > 0 THEN 'BLOCK_UNEXPECTED_MISSING' WHEN e > 0 THEN 'ALLOW_EXPECTED_SEASON_EDGE_NAN' WHEN s > 0 THEN 'ALLOW_CONDITIONAL_MEDSEA_NAN' WHEN o > 0 THEN 'BLOCK_OUT_OF_SEASON' ELSE 'ALLOW_BETA_PRESENT' END AS gate_state FROM g""",
)
def feature_gate_states(spark, sf):
    m = F.col("missing_class")
    g = missing_cells(spark, sf).groupBy("feature", "date").agg(
        F.count_if(m == "UNEXPECTED_OPERATIONAL_MISSING").alias("u"),
        F.count_if(m == "EXPECTED_STRUCTURAL_SEASON_EDGE").alias("e"),
        F.count_if(m == "EXPECTED_CONDITIONAL_MEDSEA_NO_SUPPORT").alias("s"),
        F.count_if(m == "EXPECTED_OUT_OF_SEASON").alias("o"),
    )
    gate = Q.feature_gate(F.col("u"), F.col("e"), F.col("s"), F.col("o"), F.lit(0))
    return g.select("feature", "date", gate.alias("gate_state"))


SQL_EQUIVALENCE = "CASE receptor_id % 3 WHEN 0 THEN 'EXACT_LOCAL' WHEN 1 THEN 'PROXY_REQUIRES_VALIDATION' END"


@query(
    "P-09",
    "receptor_id:i date_month:i gate_state:s",
    f"""WITH {SQL_COMPAT}, g AS (SELECT receptor_id, month(date) AS date_month, count(*) AS n, count(*) FILTER (WHERE range_state = 'CURRENT_MISSING') AS missing, count(*) FILTER (WHERE range_state IN ('BELOW_HISTORICAL_MIN', 'ABOVE_HISTORICAL_MAX')) AS outside FROM st GROUP BY 1, 2)
        SELECT receptor_id, date_month, CASE WHEN missing = n THEN 'BLOCKED_MISSING_CURRENT' WHEN outside > 0 THEN 'REVIEW_OUTSIDE_TRAINING_SUPPORT' WHEN contains(coalesce({SQL_EQUIVALENCE}, ''), 'PROXY') THEN 'PROXY_RANGE_PLAUSIBLE_SEMANTIC_VALIDATION_PENDING' ELSE 'READY_RANGE_CHECK' END AS gate_state FROM g""",
)
def compatibility_gate_states(spark, sf):
    """Gate of the current values by range state and equivalence class, per receptor and month."""
    cur, hist = current_and_history(spark, sf)
    c = Q.compatibility(cur, hist, ["receptor_id"], ["receptor_id", "date"], "value")
    s = F.col("range_state")
    g = c.groupBy("receptor_id", F.month("date").alias("date_month")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s == "CURRENT_MISSING").alias("missing"), F.count_if(s.isin("BELOW_HISTORICAL_MIN", "ABOVE_HISTORICAL_MAX")).alias("outside")
    )
    gate = Q.compatibility_gate(F.col("missing"), F.col("n"), F.col("outside"), F.expr(SQL_EQUIVALENCE))
    return g.select("receptor_id", "date_month", gate.alias("gate_state"))


@query(
    "Q-10",
    "receptor_id:i unexpected:i verdict:s beta_allowed:b",
    f"""WITH {SQL_CELLS}, g AS (SELECT receptor_id, count(*) FILTER (WHERE missing_class = 'UNEXPECTED_OPERATIONAL_MISSING') AS unexpected, receptor_id % 7 <> 0 AS ok, receptor_id % 5 <> 0 AS seas FROM mc WHERE feature = 'value' GROUP BY 1)
        SELECT receptor_id, unexpected, CASE WHEN NOT ok THEN 'FAIL_BETA_GATE_STRUCTURE_OR_STATIC' WHEN NOT seas THEN 'PASS_BETA_GATE_LOGIC__OUT_OF_SEASON_BLOCKED' WHEN unexpected > 0 THEN 'PASS_BETA_GATE__UNEXPECTED_OPERATIONAL_MISSING_BLOCKED' ELSE 'PASS_PROSPECTIVE_BETA_ALLOWED__STRUCTURAL_NAN_ACCEPTED' END AS verdict,
          ok AND seas AND unexpected = 0 AS beta_allowed FROM g""",
)
def gate_verdict(spark, sf):
    g = missing_cells(spark, sf).where("feature = 'value'").groupBy("receptor_id").agg(
        F.count_if(F.col("missing_class") == "UNEXPECTED_OPERATIONAL_MISSING").alias("unexpected")
    )
    r = F.col("receptor_id")
    verdict, allowed = Q.final_gate(r % 7 != 0, r % 5 != 0, F.col("unexpected"))
    return g.select("receptor_id", "unexpected", verdict.alias("verdict"), allowed.alias("beta_allowed"))


@query(
    "Q-11 O-03",
    "unmatched_rows:i diff_balance:i diff_nation:i",
    """WITH b AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN s_acctbal + 1 ELSE s_acctbal + 1e-12 END AS balance, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_nationkey END AS nation FROM supplier WHERE s_suppkey % 10 <> 3)
       SELECT count(*) FILTER (WHERE b.s_suppkey IS NULL) AS unmatched_rows, count(*) FILTER (WHERE abs(b.balance - s_acctbal) > 0.5) AS diff_balance, count(*) FILTER (WHERE b.s_suppkey IS NOT NULL AND b.nation IS NULL) AS diff_nation
       FROM supplier s LEFT JOIN b ON b.s_suppkey = s.s_suppkey""",
)
def static_identity_check(spark, sf):
    s = B.table(spark, sf, "supplier")
    a = Q.require_columns(
        s.select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation")),
        ["s_suppkey", "balance", "nation"],
    )
    k = F.col("s_suppkey")
    b = a.where(k % 10 != 3).select(
        k, F.when(k % 9 == 0, F.col("balance") + 1).otherwise(F.col("balance") + 1e-12).alias("balance"), F.when(k % 11 != 0, F.col("nation")).alias("nation")
    )
    return Q.static_identity(a, b, ["s_suppkey"], ["balance", "nation"])


# ---- events ------------------------------------------------------------------------------------------------------
@query(
    "E-24 M-15",
    "receptor_id:i event_id:i start_date:d end_date:d max_a:f max_b:f max_joint:f joint_best_date:d same_day_both_high:b a_peak_date:d b_peak_date:d peak_offset_days:i category:s retrieval_priority:i ranking_score:f2 position:i",
    f"""WITH {B.SQL_DENSE}, pr AS (SELECT receptor_id, date, value, peak, CASE WHEN value IS NOT NULL THEN (rank() OVER (PARTITION BY receptor_id ORDER BY value NULLS LAST) + (count(*) OVER (PARTITION BY receptor_id, value) - 1) / 2.0) / count(value) OVER (PARTITION BY receptor_id) * 100 END AS ap,
          CASE WHEN peak IS NOT NULL THEN (rank() OVER (PARTITION BY receptor_id ORDER BY peak NULLS LAST) + (count(*) OVER (PARTITION BY receptor_id, peak) - 1) / 2.0) / count(peak) OVER (PARTITION BY receptor_id) * 100 END AS bp FROM dense),
        hd AS (SELECT receptor_id, date FROM pr WHERE ap >= 90 OR bp >= 90),
        f AS (SELECT *, CASE WHEN date_diff('day', lag(date) OVER (PARTITION BY receptor_id ORDER BY date), date) <= 2 THEN 0 ELSE 1 END AS new FROM hd), r AS (SELECT *, sum(new) OVER (PARTITION BY receptor_id ORDER BY date) - 1 AS event_id FROM f),
        ev AS (SELECT receptor_id, event_id, min(date) AS s, max(date) AS e FROM r GROUP BY 1, 2),
        g AS (SELECT ev.receptor_id, event_id, s AS start_date, e AS end_date, max(ap) AS max_a, max(bp) AS max_b, max(CASE WHEN ap IS NOT NULL AND bp IS NOT NULL THEN least(ap, bp) END) AS max_joint,
          (list(date ORDER BY CASE WHEN ap IS NOT NULL AND bp IS NOT NULL THEN least(ap, bp) END DESC NULLS LAST, date) FILTER (WHERE ap IS NOT NULL AND bp IS NOT NULL))[1] AS joint_best_date, coalesce(bool_or(ap >= 90 AND bp >= 90), false) AS same_day_both_high,
          (list(date ORDER BY value DESC NULLS LAST, date))[1] AS a_peak_date, (list(date ORDER BY peak DESC NULLS LAST, date))[1] AS b_peak_date FROM ev JOIN pr ON pr.receptor_id = ev.receptor_id AND pr.date BETWEEN s AND e GROUP BY 1, 2, 3, 4),
        o AS (SELECT *, date_diff('day', a_peak_date, b_peak_date) AS off FROM g),
        c AS (SELECT *, CASE WHEN max_a >= 90 AND max_b >= 90 THEN CASE WHEN off = 0 THEN 'BOTH_HIGH_SAME_DAY_PEAK_CONTROL' WHEN off > 0 THEN 'BOTH_HIGH_SECOND_PEAK_LATER_DAILY' ELSE 'BOTH_HIGH_SECOND_PEAK_EARLIER_DAILY' END WHEN max_a >= 90 THEN 'FIRST_DOMINANT' WHEN max_b >= 90 THEN 'SECOND_DOMINANT' ELSE 'MIXED_BELOW_EVENT_MAX_THRESHOLD' END AS category FROM o),
        p AS (SELECT *, off AS peak_offset_days, CASE WHEN category LIKE '%LATER_DAILY' OR category LIKE '%EARLIER_DAILY' THEN 1 WHEN category LIKE '%CONTROL' THEN 2 ELSE 3 END AS retrieval_priority, max_joint * 1000 + greatest(max_a, max_b) AS ranking_score FROM c)
        SELECT *, row_number() OVER (PARTITION BY receptor_id ORDER BY retrieval_priority, floor(ranking_score * 1000) DESC, event_id) AS position FROM p""",
)
def event_ranking(spark, sf):
    key = ["receptor_id"]
    p = B.dense_panel(spark, sf).select(
        "receptor_id", "date", "value", "peak", W.panel_percent_rank(key, "value").alias("ap"), W.panel_percent_rank(key, "peak").alias("bp")
    )
    events = W.runs(p.where("ap >= 90 OR bp >= 90"), ["receptor_id"], "date", merge_gap=1).select(
        "receptor_id", F.col("run_id").alias("event_id"), "start_date", "end_date"
    )
    ranked = E.rank_events(events, p, ["receptor_id"], "date", "value", "peak", "ap", "bp")
    w = Window.partitionBy("receptor_id").orderBy("retrieval_priority", F.floor(F.col("ranking_score") * 1000).desc(), "event_id")
    return ranked.withColumn("position", F.row_number().over(w))
