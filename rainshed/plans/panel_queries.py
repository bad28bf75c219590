"""Panel construction, history windows, folds and labels on the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainshed.operators import labels as L
from rainshed.operators import panel as P
from rainshed.operators import windows as W
from rainshed.operators.distributed import percent_rank_average
from rainshed.plans import bindings as B
from rainshed.plans.bindings import SQL_CAL, SQL_DENSE, SQL_FOLDS, SQL_LABELS, SQL_ORDERS_DAILY, SQL_SPARSE, sql_expand
from rainshed.plans.registry import query
from rainshed.sources.integrity import written

KEY = ["receptor_id"]


# ---- panel -------------------------------------------------------------------------------------------------------
@query(
    "J-14 R-03 F-02 P-01 D-05",
    "receptor_id:i date:d season_year:i season_day:i value:f2",
    f"WITH {SQL_SPARSE} SELECT * FROM sparse",
)
def dense_season_grid(spark, sf):
    return B.sparse_panel(spark, sf)


@query(
    "M-11 P-01",
    "o_orderkey:i season_year:i month:i day_of_year:i season_day:i",
    """SELECT o_orderkey, year(o_orderdate) AS season_year, month(o_orderdate) AS month, dayofyear(o_orderdate) AS day_of_year,
       date_diff('day', make_date(year(o_orderdate), 9, 1), CAST(o_orderdate AS DATE)) + 1 AS season_day
       FROM orders WHERE month(o_orderdate) BETWEEN 9 AND 12 AND year(o_orderdate) BETWEEN 1995 AND 2001""",
)
def calendar_keys(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return P.with_calendar(o.where(P.in_season(F.col("date"), B.FIRST_YEAR, B.LAST_YEAR)))


@query(
    "P-02",
    "l_orderkey:i l_linenumber:i day:d price:f2",
    """SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS price FROM lineitem
       WHERE l_shipdate IS NOT NULL AND l_extendedprice IS NOT NULL""",
)
def valid_rows(spark, sf):
    li = P.nan_to_null(
        B.table(spark, sf, "lineitem").select(
            "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"), F.col("l_extendedprice").alias("price")
        )
    )
    return li.where(F.col("day").isNotNull() & F.col("price").isNotNull())


@query("Q-03", "receptor_id:i season_year:i days:i", f"""WITH {SQL_CAL}, {SQL_ORDERS_DAILY}
       SELECT receptor_id, year(date) AS season_year, count(*) AS days FROM orders_daily GROUP BY 1, 2 HAVING count(*) <> 122""")
def incomplete_seasons(spark, sf):
    daily = B.orders_daily(spark, sf).withColumn("season_year", F.year("date"))
    return P.season_gaps(daily, KEY)


@query(
    "Q-01 D-16 O-02",
    "rows:i duplicate_keys:i receptors:i min_samples_per_day:i max_samples_per_day:i reasons:s status:s",
    f"""WITH {SQL_SPARSE}, d AS (SELECT receptor_id, date, count(*) AS n, count(value) AS v FROM sparse GROUP BY 1, 2),
       t AS (SELECT sum(n) AS rows, sum(n - 1) AS dup, count(DISTINCT receptor_id) AS receptors, min(n) AS lo, max(n) AS hi, sum(v) AS v FROM d)
       SELECT rows, dup AS duplicate_keys, receptors, lo AS min_samples_per_day, hi AS max_samples_per_day,
         CASE WHEN rows <> 18300 THEN 'rows=' || rows ELSE '' END AS reasons,
         CASE WHEN rows <> 18300 THEN 'FAIL' ELSE 'PASS' END AS status FROM t""",
)
def panel_audit(spark, sf):
    verdict = P.audit_panel(B.sparse_panel(spark, sf), KEY, "date", ["value"], expected_rows=18300, expected_receptors=25)
    return verdict.withColumn("reasons", F.array_join("reasons", ";"))


@query(
    "Q-01 O-02",
    "l_orderkey:i l_linenumber:i n:i",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_primary_keys(spark, sf):
    return P.duplicate_keys(B.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---- history windows ---------------------------------------------------------------------------------------------
def _frame(first: str, last: str) -> str:
    return f"OVER (PARTITION BY receptor_id, season_year ORDER BY date RANGE BETWEEN {first} AND {last})"


def _day(n: int, word: str = "PRECEDING") -> str:
    return f"INTERVAL {n} DAY {word}"


def _full(agg: str, col: str, first: str, last: str, n: int) -> str:
    f = _frame(first, last)
    return f"CASE WHEN count({col}) {f} = {n} THEN {agg}({col}) {f} END"


@query(
    "W-01 W-02",
    "receptor_id:i date:d value:f2 value_prev1d:f2 value_prev3d:f2 value_change_24h:f2",
    f"""WITH {SQL_DENSE} SELECT receptor_id, date, value, max(value) {_frame(_day(1), _day(1))} AS value_prev1d,
        max(value) {_frame(_day(3), _day(3))} AS value_prev3d, value - max(value) {_frame(_day(1), _day(1))} AS value_change_24h FROM dense""",
)
def strict_lag_and_change(spark, sf):
    w = W.SeasonWindow(KEY)
    return B.dense_panel(spark, sf).select(
        "receptor_id",
        "date",
        "value",
        w.lag("value").alias("value_prev1d"),
        w.lag("value", 3).alias("value_prev3d"),
        w.change("value").alias("value_change_24h"),
    )


@query(
    "W-05",
    "event_id:i " + " ".join(f"value_{h}h:f2" for h in (6, 12, 24, 48)),
    "WITH e AS (SELECT event_id, user_id, value, floor(epoch_us(ts) / 1000000) AS s FROM events) SELECT event_id, "
    + ", ".join(f"sum(value) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN {h * 3600 - 1} PRECEDING AND CURRENT ROW) AS value_{h}h" for h in (6, 12, 24, 48))
    + " FROM e",
)
def rolling_hours(spark, sf):
    return W.rolling_hours(B.table(spark, sf, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], "ts", "value", (6, 12, 24, 48))


@query(
    "W-03 W-04 W-05",
    "receptor_id:i date:d prev3_sum:f2 prev7_sum:f2 prev14_sum:f2 prev3_mean:f prev7_mean:f prev3_max:f2 incl3_sum:f2 incl7_sum:f2 incl3_mean:f partial7_sum:f2",
    f"""WITH {SQL_DENSE} SELECT receptor_id, date,
        {_full('sum', 'value', _day(3), _day(1), 3)} AS prev3_sum, {_full('sum', 'value', _day(7), _day(1), 7)} AS prev7_sum,
        {_full('sum', 'value', _day(14), _day(1), 14)} AS prev14_sum, {_full('avg', 'discount', _day(3), _day(1), 3)} AS prev3_mean,
        {_full('avg', 'discount', _day(7), _day(1), 7)} AS prev7_mean, {_full('max', 'peak', _day(3), _day(1), 3)} AS prev3_max,
        {_full('sum', 'value', _day(2), 'CURRENT ROW', 3)} AS incl3_sum, {_full('sum', 'value', _day(6), 'CURRENT ROW', 7)} AS incl7_sum,
        {_full('avg', 'discount', _day(2), 'CURRENT ROW', 3)} AS incl3_mean, sum(value) {_frame(_day(6), 'CURRENT ROW')} AS partial7_sum FROM dense""",
)
def rolling_history(spark, sf):
    w = W.SeasonWindow(KEY)
    return B.dense_panel(spark, sf).select(
        "receptor_id",
        "date",
        *[w.previous("value", n).alias(f"prev{n}_sum") for n in (3, 7, 14)],
        *[w.previous("discount", n, "mean").alias(f"prev{n}_mean") for n in (3, 7)],
        w.previous("peak", 3, "max").alias("prev3_max"),
        *[w.inclusive("value", n).alias(f"incl{n}_sum") for n in (3, 7)],
        w.inclusive("discount", 3, "mean").alias("incl3_mean"),
        w.partial("value", 7).alias("partial7_sum"),
    )


@query(
    "W-06",
    "receptor_id:i season_year:i days:i complete_prev1d:i complete_prev3d:i complete_prev7d:i complete_prev14d:i",
    f"""WITH {SQL_DENSE}, h AS (SELECT receptor_id, season_year,
        max(value) {_frame(_day(1), _day(1))} AS p1, max(discount) {_frame(_day(1), _day(1))} AS d1,
        {_full('sum', 'value', _day(3), _day(1), 3)} AS p3, {_full('avg', 'discount', _day(3), _day(1), 3)} AS d3,
        {_full('sum', 'value', _day(7), _day(1), 7)} AS p7, {_full('avg', 'discount', _day(7), _day(1), 7)} AS d7,
        {_full('sum', 'value', _day(14), _day(1), 14)} AS p14 FROM dense)
        SELECT receptor_id, season_year, count(*) AS days, count_if(p1 IS NOT NULL AND d1 IS NOT NULL) AS complete_prev1d,
          count_if(p3 IS NOT NULL AND d3 IS NOT NULL) AS complete_prev3d, count_if(p7 IS NOT NULL AND d7 IS NOT NULL) AS complete_prev7d,
          count_if(p14 IS NOT NULL) AS complete_prev14d FROM h GROUP BY 1, 2""",
)
def antecedent_completeness(spark, sf):
    w = W.SeasonWindow(KEY)
    h = B.dense_panel(spark, sf).select(
        "receptor_id",
        "season_year",
        w.lag("value").alias("p1"),
        w.lag("discount").alias("d1"),
        *[w.previous("value", n).alias(f"p{n}") for n in (3, 7, 14)],
        *[w.previous("discount", n, "mean").alias(f"d{n}") for n in (3, 7)],
    )
    return h.groupBy("receptor_id", "season_year").agg(
        F.count(F.lit(1)).alias("days"),
        *[F.count_if(W.complete(f"p{n}", f"d{n}")).alias(f"complete_prev{n}d") for n in (1, 3, 7)],
        F.count_if(W.complete("p14")).alias("complete_prev14d"),
    )


@query(
    "W-08",
    "receptor_id:i date:d value_pct_rank:f",
    f"""WITH {SQL_SPARSE} SELECT receptor_id, date, CASE WHEN value IS NOT NULL THEN
        (rank() OVER (ORDER BY value NULLS LAST) + (count(*) OVER (PARTITION BY value) - 1) / 2.0) / count(value) OVER () * 100 END AS value_pct_rank
        FROM sparse""",
)
def percentile_rank(spark, sf):
    p = written(B.sparse_panel(spark, sf), "panel")
    return percent_rank_average(p, [], "value", "value_pct_rank")


@query(
    "W-09 L-05",
    "nation:i priority:s revenue:f2 rank_desc:i rank_asc:i",
    """WITH g AS (SELECT c_nationkey AS nation, o_orderpriority AS priority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
         FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
       SELECT *, rank() OVER (PARTITION BY nation ORDER BY revenue DESC NULLS LAST) AS rank_desc,
         rank() OVER (PARTITION BY nation ORDER BY revenue ASC NULLS LAST) AS rank_asc FROM g""",
)
def metric_ranks(spark, sf):
    o, c = B.table(spark, sf, "orders"), B.table(spark, sf, "customer")
    g = (
        o.join(c, o.o_custkey == c.c_custkey)
        .groupBy(F.col("c_nationkey").alias("nation"), F.col("o_orderpriority").alias("priority"))
        .agg(F.sum(B.money(F.col("o_totalprice"))).cast("double").alias("revenue"))
    )
    return g.select(
        "*",
        W.metric_rank(["nation"], "revenue").alias("rank_desc"),
        W.metric_rank(["nation"], "revenue", descending=False).alias("rank_asc"),
    )


def _sql_runs(gap: int, source: str) -> str:
    return f"""f AS (SELECT receptor_id, date, CASE WHEN date_diff('day', lag(date) OVER w, date) <= {gap + 1} THEN 0 ELSE 1 END AS new
        FROM {source} WINDOW w AS (PARTITION BY receptor_id ORDER BY date)),
      r AS (SELECT receptor_id, date, sum(new) OVER (PARTITION BY receptor_id ORDER BY date) - 1 AS run_id FROM f)
      SELECT receptor_id, run_id, min(date) AS start_date, max(date) AS end_date, count(*) AS days FROM r GROUP BY 1, 2"""


@query(
    "W-10",
    "receptor_id:i run_id:i start_date:d end_date:d days:i",
    f"WITH {SQL_CAL}, {SQL_ORDERS_DAILY}, {_sql_runs(0, 'orders_daily')}",
)
def run_clusters(spark, sf):
    return W.runs(B.orders_daily(spark, sf), KEY, "date")


@query(
    "W-10",
    "receptor_id:i run_id:i start_date:d end_date:d days:i",
    f"WITH {SQL_CAL}, {SQL_ORDERS_DAILY}, {_sql_runs(1, 'orders_daily')}",
)
def run_events_merge_gap(spark, sf):
    return W.runs(B.orders_daily(spark, sf), KEY, "date", merge_gap=1)


@query(
    "W-11",
    "receptor_id:i date:d busy:b persistence:i",
    f"""WITH {SQL_DENSE}, f AS (SELECT receptor_id, season_year, date, coalesce(discount > 0.05, false) AS busy FROM dense),
        c AS (SELECT *, CASE WHEN busy IS NOT DISTINCT FROM lag(busy) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM f
          WINDOW w AS (PARTITION BY receptor_id, season_year ORDER BY date)),
        i AS (SELECT *, sum(ch) OVER (PARTITION BY receptor_id, season_year ORDER BY date) AS isl FROM c)
        SELECT receptor_id, date, busy, row_number() OVER (PARTITION BY receptor_id, season_year, isl ORDER BY date) AS persistence FROM i""",
)
def value_persistence(spark, sf):
    p = B.dense_panel(spark, sf).withColumn("busy", F.coalesce(F.col("discount") > 0.05, F.lit(False)))
    return W.persistence(["receptor_id", "season_year"], "date", "busy")(p)


@query(
    "W-12 F-01",
    "o_custkey:i o_orderkey:i o_orderpriority:s day:d",
    """SELECT o_custkey, o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) = 1""",
)
def first_by_priority(spark, sf):
    o = B.table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day")
    )
    return W.first_by(o, ["o_custkey"], [F.col("o_orderpriority"), F.col("day"), F.col("o_orderkey")])


@query(
    "W-13",
    "receptor_id:i date:d step:f2",
    f"""WITH {SQL_DENSE} SELECT receptor_id, date, value - lag(value) OVER (PARTITION BY receptor_id, season_year ORDER BY date) AS step FROM dense""",
)
def first_difference(spark, sf):
    return B.dense_panel(spark, sf).select("receptor_id", "date", W.SeasonWindow(KEY).difference("value").alias("step"))


@query(
    "W-17 L-01",
    "n_name:s revenue:f2 position:i",
    """SELECT n_name, revenue, row_number() OVER (ORDER BY revenue DESC, n_name) AS position FROM (
       SELECT n_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)""",
)
def ordinal_ranking(spark, sf):
    o, c, n = (B.table(spark, sf, t) for t in ("orders", "customer", "nation"))
    g = (
        o.join(c, o.o_custkey == c.c_custkey)
        .groupBy("c_nationkey")
        .agg(F.sum(B.money(F.col("o_totalprice"))).alias("r"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.sum("r").cast("double").alias("revenue"))
    )
    # One row per nation name: the global order is over a dimension-sized set.
    w = W.Window.orderBy(F.desc("revenue"), "n_name")
    return g.withColumn("position", F.row_number().over(w)).orderBy("position")


@query(
    "Q-02",
    "column_name:s null_rows:i expected_rows:i status:s",
    f"""WITH {SQL_DENSE}, z AS (SELECT receptor_id, season_year, date, coalesce(value, 0) AS value FROM dense),
        h AS (SELECT receptor_id, season_year, max(value) {_frame(_day(1), _day(1))} AS prev1,
          {_full('sum', 'value', _day(3), _day(1), 3)} AS prev3, {_full('sum', 'value', _day(7), _day(1), 7)} AS prev7,
          {_full('sum', 'value', _day(14), _day(1), 14)} AS prev14 FROM z),
        t AS (SELECT count(DISTINCT (receptor_id, season_year)) AS g, count_if(prev1 IS NULL) AS a, count_if(prev3 IS NULL) AS b,
          count_if(prev7 IS NULL) AS c, count_if(prev14 IS NULL) AS d FROM h),
        u AS (SELECT unnest(['prev1', 'prev3', 'prev7', 'prev14']) AS column_name, unnest([a, b, c, d]) AS null_rows,
          unnest([g, g * 3, g * 7, g * 14]) AS expected_rows FROM t)
        SELECT *, CASE WHEN null_rows = expected_rows THEN 'PASS' ELSE 'FAIL' END AS status FROM u""",
)
def season_edge_nulls(spark, sf):
    w = W.SeasonWindow(KEY)
    p = B.dense_panel(spark, sf).withColumn("value", F.coalesce("value", F.lit(0.0)))
    h = p.select(
        "receptor_id",
        "season_year",
        w.lag("value").alias("prev1"),
        *[w.previous("value", n).alias(f"prev{n}") for n in (3, 7, 14)],
    )
    return W.edge_null_audit(h, KEY, {"prev1": 1, "prev3": 3, "prev7": 7, "prev14": 14})


# ---- folds and labels --------------------------------------------------------------------------------------------
def labels(spark, sf, panel=None):
    p = B.sparse_panel(spark, sf) if panel is None else panel
    return L.label_panel(p, "receptor_id", "value", L.fold_thresholds(p, "receptor_id", "value", B.FOLDS), B.FOLDS)


@query(
    "J-10 F-05 D-10",
    "fold_id:s partition:s receptor_id:i days:i first_day:d last_day:d",
    f"""WITH {SQL_SPARSE}, {SQL_FOLDS}, {sql_expand('sparse')}
        SELECT fold_id, partition, receptor_id, count(*) AS days, min(date) AS first_day, max(date) AS last_day FROM expanded GROUP BY 1, 2, 3""",
)
def fold_partitions(spark, sf):
    e = L.expand_folds(B.sparse_panel(spark, sf), B.FOLDS)
    return e.groupBy("fold_id", "partition", "receptor_id").agg(
        F.count(F.lit(1)).alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day")
    )


@query(
    "F-04",
    "fold_id:s receptor_id:i fit_days:i q95_fit_threshold:f3 q975_fit_severity_threshold:f3",
    f"""WITH {SQL_LABELS} SELECT fold_id, receptor_id, fit_days, thr AS q95_fit_threshold, sev AS q975_fit_severity_threshold FROM thresholds""",
)
def fold_thresholds(spark, sf):
    return L.fold_thresholds(B.sparse_panel(spark, sf), "receptor_id", "value", B.FOLDS)


@query(
    "W-07 F-06 D-11",
    "fold_id:s receptor_id:i issue_date:d partition:s q95_fit_threshold:f3 label_extreme_within_24h:i label_extreme_within_48h:i label_extreme_within_72h:i",
    f"""WITH {SQL_LABELS} SELECT fold_id, receptor_id, issue_date, partition, thr AS q95_fit_threshold,
        label_extreme_within_24h, label_extreme_within_48h, label_extreme_within_72h FROM labels""",
)
def lookahead_labels(spark, sf):
    return labels(spark, sf)


SQL_LONG = """long AS (SELECT fold_id, partition, receptor_id, unnest([24, 48, 72]) AS horizon_hours,
  unnest([label_extreme_within_24h, label_extreme_within_48h, label_extreme_within_72h]) AS label FROM labels)"""


@query(
    "A-26",
    "fold_id:s partition:s horizon_hours:i receptor_id:i scope:s rows:i eligible:i positive:i negative:i unknown:i positive_fraction:f",
    f"""WITH {SQL_LABELS}, {SQL_LONG}
        SELECT fold_id, partition, horizon_hours, receptor_id, CASE WHEN grouping(receptor_id) = 1 THEN 'POOLED' ELSE 'RECEPTOR' END AS scope,
          count(*) AS rows, count(label) AS eligible, count(*) FILTER (WHERE label = 1) AS positive, count(*) FILTER (WHERE label = 0) AS negative,
          count(*) - count(label) AS unknown, count(*) FILTER (WHERE label = 1) / nullif(count(label), 0) AS positive_fraction
        FROM long GROUP BY GROUPING SETS ((fold_id, partition, horizon_hours, receptor_id), (fold_id, partition, horizon_hours))""",
)
def label_support(spark, sf):
    return L.label_support(labels(spark, sf), "receptor_id")


@query(
    "F-07",
    "fold_id:s partition:s receptor_id:i eligible:i positive_days:i positive_clusters:i sparse_positive:b",
    f"""WITH {SQL_LABELS}, pos AS (SELECT fold_id, partition, receptor_id, issue_date,
          CASE WHEN date_diff('day', lag(issue_date) OVER (PARTITION BY fold_id, partition, receptor_id ORDER BY issue_date), issue_date) <= 1 THEN 0 ELSE 1 END AS new
          FROM labels WHERE label_extreme_within_72h = 1),
        c AS (SELECT fold_id, partition, receptor_id, count(*) AS days, sum(new) AS clusters FROM pos GROUP BY 1, 2, 3),
        e AS (SELECT fold_id, partition, receptor_id, count(label_extreme_within_72h) AS eligible FROM labels GROUP BY 1, 2, 3)
        SELECT fold_id, partition, receptor_id, eligible, coalesce(days, 0) AS positive_days, coalesce(clusters, 0) AS positive_clusters,
          coalesce(days, 0) < 3 AS sparse_positive FROM e LEFT JOIN c USING (fold_id, partition, receptor_id)""",
)
def positive_support(spark, sf):
    return L.positive_support(labels(spark, sf), "receptor_id", 72)


@query(
    "J-14 M-11 W-01 W-03 F-04 J-10 W-07",
    "fold_id:s receptor_id:i issue_date:d partition:s value:f2 value_prev1d:f2 value_prev3d_sum:f2 label_extreme_within_24h:i label_extreme_within_48h:i label_extreme_within_72h:i",
    f"""WITH {SQL_LABELS}, h AS (SELECT receptor_id, date, max(value) {_frame(_day(1), _day(1))} AS value_prev1d,
          {_full('sum', 'value', _day(3), _day(1), 3)} AS value_prev3d_sum FROM sparse)
        SELECT l.fold_id, l.receptor_id, l.issue_date, l.partition, l.value, h.value_prev1d, h.value_prev3d_sum,
          label_extreme_within_24h, label_extreme_within_48h, label_extreme_within_72h
        FROM labels l JOIN h ON h.receptor_id = l.receptor_id AND h.date = l.issue_date""",
)
def labelled_features(spark, sf):
    """Flagship: history features and look-ahead labels from one dense panel, one season layout."""
    w = W.SeasonWindow(KEY)
    p = B.sparse_panel(spark, sf)
    featured = p.select("*", w.lag("value").alias("value_prev1d"), w.previous("value", 3).alias("value_prev3d_sum"))
    thresholds = L.fold_thresholds(p, "receptor_id", "value", B.FOLDS)
    lab = L.label_panel(
        featured, "receptor_id", "value", thresholds, B.FOLDS, carry=("value", "value_prev1d", "value_prev3d_sum")
    )
    return lab
