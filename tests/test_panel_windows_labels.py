"""Dense panels, strict-history windows and look-ahead labels on literal frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rainshed.operators import labels as L
from rainshed.operators import panel as P
from rainshed.operators import windows as W


def day(n, year=2000):
    return dt.date(year, 9, 1) + dt.timedelta(days=n)


def panel(spark, values, year=2000):
    rows = [("a", day(i, year), year, i + 1, v) for i, v in enumerate(values) if v != "gap"]
    return spark.createDataFrame(rows, "receptor_id string, date date, season_year int, season_day int, value double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def test_densify_is_complete_and_keeps_values(spark):
    daily = spark.createDataFrame([("a", day(3), 5.0), ("a", dt.date(2000, 3, 1), 9.0), ("b", day(0), 1.0)], "k string, date date, value double")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    out = P.densify(daily, keys, ["value"], 2000, 2001)
    assert out.count() == 3 * 2 * 122
    assert P.season_gaps(out, ["k"]).count() == 0
    got = {(r.k, r.date, r.season_day): r.value for r in out.where("value IS NOT NULL").collect()}
    assert got == {("a", day(3), 4): 5.0, ("b", day(0), 1): 1.0}


def test_nan_becomes_null(spark):
    df = P.nan_to_null(spark.createDataFrame([(1, float("nan")), (2, 1.0)], "k int, v double"))
    assert df.agg(F.count("v"), F.sum("v")).first() == (1, 1.0)


def test_lag_does_not_jump_gaps_or_seasons(spark):
    p = panel(spark, [1.0, "gap", 3.0, 4.0]).unionByName(panel(spark, [9.0], 2001))
    w = W.SeasonWindow(["receptor_id"])
    out = p.select("date", w.lag("value").alias("l"), w.difference("value").alias("d"))
    assert column(out, "l") == [None, None, 3.0, None]
    assert column(out, "d") == [None, 2.0, 1.0, None]


def test_full_window_counts_values_not_rows(spark):
    p = panel(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0])
    w = W.SeasonWindow(["receptor_id"])
    out = p.select("date", w.previous("value", 3).alias("p"), w.inclusive("value", 3, "mean").alias("i"), w.partial("value", 3).alias("q"))
    assert column(out, "p") == [None, None, None, None, None, None, 15.0]
    assert column(out, "i") == [None, None, None, None, None, 5.0, 6.0]
    assert column(out, "q") == [1.0, 3.0, 3.0, 6.0, 9.0, 15.0, 18.0]


def test_edge_null_audit(spark):
    p = panel(spark, [1.0] * 122)
    w = W.SeasonWindow(["receptor_id"])
    h = p.select("receptor_id", "season_year", w.lag("value").alias("l"), w.previous("value", 7).alias("s"))
    rows = {r.column_name: (r.null_rows, r.status) for r in W.edge_null_audit(h, ["receptor_id"], {"l": 1, "s": 3}).collect()}
    assert rows == {"l": (1, "PASS"), "s": (7, "FAIL")}


@pytest.mark.parametrize(
    "future,expected",
    [
        ([1.0, 1.0], 0),
        ([1.0, 5.0], 1),
        ([None, 5.0], 1),
        ([None, 1.0], None),
        ([1.0, None], None),
        ([5.0], 1),
        ([1.0], None),
        ([], None),
    ],
)
def test_label_truth_table(spark, future, expected):
    p = panel(spark, [0.0, *future])
    w = W.SeasonWindow(["receptor_id"])
    lab = L.three_valued(F.col("m"), F.col("n"), F.lit(5.0), 2)
    out = p.select("date", w.future("value", 2).alias("m"), w.future_count("value", 2).alias("n")).select("date", lab.alias("y"))
    assert column(out, "y")[0] == expected


def test_thresholds_use_fit_rows_only(spark):
    folds = (("F", 2000, 2001, 2001, 2002, 2002),)
    p = panel(spark, [float(i) for i in range(101)], 2000).unionByName(panel(spark, [1e6] * 10, 2001))
    t = L.fold_thresholds(p, "receptor_id", "value", folds).first()
    assert (t.fit_days, t.q95_fit_threshold, t.q975_fit_severity_threshold) == (101, 95.0, 97.5)
    parts = L.expand_folds(p.unionByName(panel(spark, [1.0], 2009)), folds).groupBy("partition").count().collect()
    assert {r.partition: r["count"] for r in parts} == {"FIT": 101, "VALIDATION": 10}


def test_runs_and_merge_gap(spark):
    p = panel(spark, [1.0, 1.0, "gap", 1.0, "gap", "gap", 1.0])
    assert [(r.start_date, r.days) for r in W.runs(p, ["receptor_id"], "date").orderBy("run_id").collect()] == [(day(0), 2), (day(3), 1), (day(6), 1)]
    assert [(r.run_id, r.days) for r in W.runs(p, ["receptor_id"], "date", 1).orderBy("run_id").collect()] == [(0, 3), (1, 1)]


def test_persistence(spark):
    p = panel(spark, [1.0, 1.0, 2.0, None, None, 2.0])
    out = W.persistence(["receptor_id"], "date", "value")(p)
    assert column(out, "persistence") == [1, 2, 1, 1, 2, 1]


def test_rolling_hours(spark):
    t0 = dt.datetime(2000, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=h), 1.0) for h in (0, 1, 2, 9)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    out = W.rolling_hours(df, ["k"], "ts", "v", [2, 6]).orderBy("ts").collect()
    assert [(r.v_2h, r.v_6h) for r in out] == [(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (1.0, 1.0)]


def test_validated_join_rejects_repeated_keys(spark):
    left = spark.createDataFrame([(1, "x")], "k int, a string")
    right = spark.createDataFrame([(1, "p"), (1, "q")], "k int, b string")
    with pytest.raises(P.CardinalityError):
        P.validated_join(left, right, ["k"])
    assert P.validated_join(right, left, ["k"]).count() == 2


def test_panel_audit_reports_reasons(spark):
    p = panel(spark, [1.0, 2.0]).withColumn("empty", F.lit(None).cast("double"))
    p = p.unionByName(p.limit(1))
    v = P.audit_panel(p, ["receptor_id"], "date", ["value", "empty"], expected_rows=5).first()
    assert v.status == "FAIL" and v.reasons == ["duplicate_keys=1", "all_null=empty", "rows=3"]


def test_reconcile(spark):
    a = spark.createDataFrame([(1, None), (2, 2.0), (3, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, None), (2, 9.0), (4, 4.0)], "k int, v double")
    s = P.reconcile_summary(P.reconcile(a, b, ["k"], ["v"]), ["v"]).first()
    assert (s.both_rows, s.left_only_rows, s.right_only_rows, s.diff_v) == (2, 1, 1, 1)
