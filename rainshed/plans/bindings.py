"""The provided tables seen as panels, stations, fields and predictions (Spark and SQL side by side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainshed.operators import panel as P

FIRST_YEAR, LAST_YEAR = 1995, 2001  # every season the tables touch; the last one is not complete
FOLDS = (
    ("F1", 1996, 1997, 1997, 1998, 1998),
    ("F2", 1997, 1998, 1998, 1999, 1999),
    ("F3", 1998, 1999, 1999, 2000, 2000),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c):
    """Exact decimal sums: equal on every engine and for every shuffle order."""
    return c.cast("decimal(18,2)")


def orders_daily(spark, sf_dir) -> DataFrame:
    """Order value per (nation of the customer, day)."""
    o = table(spark, sf_dir, "orders").where(P.season_span(F.col("o_orderdate"), FIRST_YEAR, LAST_YEAR))
    o = o.select("o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("date"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("receptor_id"))
    return (
        o.where(P.in_season(F.col("date"), FIRST_YEAR, LAST_YEAR))
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("receptor_id", "date")
        .agg(F.sum(money(F.col("o_totalprice"))).cast("double").alias("value"))
    )


def nations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("receptor_id"))


def sparse_panel(spark, sf_dir) -> DataFrame:
    return P.densify(orders_daily(spark, sf_dir), nations(spark, sf_dir), ["value"], FIRST_YEAR, LAST_YEAR)


def ship_daily(spark, sf_dir) -> DataFrame:
    """Shipped quantity per (region of the supplier, day); suppliers are pre-aggregated before the join."""
    li = table(spark, sf_dir, "lineitem").where(P.season_span(F.col("l_shipdate"), FIRST_YEAR, LAST_YEAR))
    li = li.select(
        "l_suppkey",
        F.col("l_shipdate").cast("date").alias("date"),
        money(F.col("l_quantity")).alias("q"),
        money(F.col("l_discount")).alias("d"),
        money(F.col("l_extendedprice")).alias("p"),
    )
    by_supplier = (
        li.where(P.in_season(F.col("date"), FIRST_YEAR, LAST_YEAR))
        .groupBy("l_suppkey", "date")
        .agg(F.sum("q").alias("q"), F.sum("d").alias("d"), F.count(F.lit(1)).alias("n"), F.max("p").alias("p"))
    )
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("receptor_id"))
    return (
        by_supplier.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("receptor_id", "date")
        .agg(
            F.sum("q").cast("double").alias("value"),
            (F.sum("d").cast("double") / F.sum("n")).alias("discount"),
            F.max("p").cast("double").alias("peak"),
        )
    )


def regions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("receptor_id"))


def dense_panel(spark, sf_dir) -> DataFrame:
    return P.densify(
        ship_daily(spark, sf_dir), regions(spark, sf_dir), ["value", "discount", "peak"], FIRST_YEAR, LAST_YEAR
    )


SQL_CAL = """cal AS (SELECT CAST(g.d AS DATE) AS date FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY) g(d)
  WHERE month(g.d) BETWEEN 9 AND 12)"""
SQL_ORDERS_DAILY = """orders_daily AS (SELECT c_nationkey AS receptor_id, CAST(o_orderdate AS DATE) AS date,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE month(o_orderdate) BETWEEN 9 AND 12 AND year(o_orderdate) BETWEEN 1995 AND 2001 GROUP BY 1, 2)"""
SQL_SPARSE = f"""{SQL_CAL}, {SQL_ORDERS_DAILY},
sparse AS (SELECT n_nationkey AS receptor_id, cal.date, year(cal.date) AS season_year,
  date_diff('day', make_date(year(cal.date), 9, 1), cal.date) + 1 AS season_day, v.value
  FROM nation CROSS JOIN cal LEFT JOIN orders_daily v ON v.receptor_id = n_nationkey AND v.date = cal.date)"""
SQL_SHIP_DAILY = """ship_daily AS (SELECT n_regionkey AS receptor_id, CAST(l_shipdate AS DATE) AS date,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS value,
  CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS discount,
  CAST(max(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS peak
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  WHERE month(l_shipdate) BETWEEN 9 AND 12 AND year(l_shipdate) BETWEEN 1995 AND 2001 GROUP BY 1, 2)"""
SQL_DENSE = f"""{SQL_CAL}, {SQL_SHIP_DAILY},
dense AS (SELECT r_regionkey AS receptor_id, cal.date, year(cal.date) AS season_year,
  date_diff('day', make_date(year(cal.date), 9, 1), cal.date) + 1 AS season_day, v.value, v.discount, v.peak
  FROM region CROSS JOIN cal LEFT JOIN ship_daily v ON v.receptor_id = r_regionkey AND v.date = cal.date)"""
SQL_FOLDS = """folds(fold_id, fit_end, val_start, val_end, test_start, test_end) AS (VALUES
  ('F1', 1996, 1997, 1997, 1998, 1998), ('F2', 1997, 1998, 1998, 1999, 1999), ('F3', 1998, 1999, 1999, 2000, 2000))"""


def sql_expand(source: str, name: str = "expanded") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT s.*, fold_id,
  CASE WHEN season_year <= fit_end THEN 'FIT' WHEN season_year BETWEEN val_start AND val_end THEN 'VALIDATION'
       WHEN season_year BETWEEN test_start AND test_end THEN 'TEST' END AS partition
  FROM {source} s CROSS JOIN folds) WHERE partition IS NOT NULL)"""


def sql_future(h: int, thr: str = "thr") -> str:
    f = f"(PARTITION BY fold_id, receptor_id, season_year ORDER BY date RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL {h} DAY FOLLOWING)"
    return f"CASE WHEN max(value) OVER {f} >= {thr} THEN 1 WHEN count(value) OVER {f} = {h} AND {thr} IS NOT NULL THEN 0 END"


SQL_LABELS = f"""{SQL_SPARSE}, {SQL_FOLDS}, {sql_expand('sparse')},
thresholds AS (SELECT fold_id, receptor_id, quantile_cont(value, 0.95) AS thr, quantile_cont(value, 0.975) AS sev, count(value) AS fit_days
  FROM expanded WHERE partition = 'FIT' AND value IS NOT NULL GROUP BY 1, 2),
labels AS (SELECT fold_id, receptor_id, e.date AS issue_date, e.season_year, e.partition, thr, sev, value,
  {sql_future(1)} AS label_extreme_within_24h, {sql_future(2)} AS label_extreme_within_48h, {sql_future(3)} AS label_extreme_within_72h
  FROM expanded e LEFT JOIN thresholds t USING (fold_id, receptor_id))"""
