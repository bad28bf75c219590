"""Daily upserts, overlays, gates and admission rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rainshed.operators import master as M
from rainshed.operators import operate as O
from rainshed.operators import quality as Q
from rainshed.streaming import daily as D

KEYS = ["receptor_id", "issue_date"]
SCHEMA = "receptor_id string, issue_date string, run_id int, v double"


def rows(df):
    return sorted(tuple(r) for r in df.select("receptor_id", "issue_date", "run_id", "v").collect())


def test_upsert_replaces_and_appends(spark):
    cache = spark.createDataFrame([("a", "d1", 1, 1.0), ("b", "d1", 1, 2.0)], SCHEMA)
    batch = spark.createDataFrame([("a", "d1", 2, 9.0), ("a", "d2", 2, 3.0)], SCHEMA)
    once = O.upsert(cache, batch, KEYS)
    assert rows(once) == [("a", "d1", 2, 9.0), ("a", "d2", 2, 3.0), ("b", "d1", 1, 2.0)]
    assert rows(O.upsert(once, batch, KEYS)) == rows(once)


def test_schema_alignment(spark):
    schema = T.StructType([T.StructField("b", T.DoubleType()), T.StructField("a", T.StringType())])
    out = O.align_schema(spark.createDataFrame([("x", 1)], "a string, gone int"), schema)
    assert out.columns == ["b", "a"] and out.first() == (None, "x")


def test_partitioned_upsert_is_idempotent_and_touches_only_its_days(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", "d1", 1, 1.0), ("b", "d1", 1, 2.0), ("a", "d2", 1, 5.0)], SCHEMA)
    second = spark.createDataFrame([("a", "d1", 2, 9.0), ("c", "d3", 2, 4.0)], SCHEMA)
    O.upsert_partitions(first, path, KEYS, "issue_date")
    untouched = {f.name for f in (tmp_path / "t" / "issue_date=d2").iterdir()}
    for _ in range(2):
        O.upsert_partitions(second, path, KEYS, "issue_date")
    want = [("a", "d1", 2, 9.0), ("a", "d2", 1, 5.0), ("b", "d1", 1, 2.0), ("c", "d3", 2, 4.0)]
    assert rows(spark.read.parquet(path)) == want
    assert {f.name for f in (tmp_path / "t" / "issue_date=d2").iterdir()} == untouched


def test_overlay_reads_two_weeks_only(spark):
    days = [dt.date(2000, 10, 1) + dt.timedelta(days=i) for i in range(40)]
    cache = spark.createDataFrame([("a", d, float(i)) for i, d in enumerate(days)], "receptor_id string, date date, v double")
    issue = F.lit(days[-1])
    snap = cache.where(F.col("date") == issue).withColumn("prev14", F.lit(-1.0))
    out = O.overlay_features(cache, snap, ["receptor_id"], "date", issue, {"prev14": ("sum", "v", 14), "lag": ("lag", "v", 1)}).first()
    assert out.prev14 == sum(range(25, 39)) and out.lag == 38.0
    assert O.season_slice(cache, "date", issue).count() == 15


def test_missing_classes_in_order(spark):
    cells = spark.createDataFrame(
        [("p", 1.0, 1), ("p", None, 1), ("p", None, 50), ("q", None, 50), ("p", None, 130)], "feature string, value double, season_day int"
    )
    rules = spark.createDataFrame([("p", 2, "EDGE", False), ("q", 0, None, True)], "feature string, min_season_day int, edge_reason string, conditional boolean")
    out = Q.classify_missing(cells, rules, F.col("season_day") <= 122, F.lit(0.0))
    got = sorted((r.feature, r.season_day, r.missing_class) for r in out.collect())
    assert got == sorted([
        ("p", 1, "PRESENT"),
        ("p", 1, "EXPECTED_STRUCTURAL_SEASON_EDGE"),
        ("p", 50, "UNEXPECTED_OPERATIONAL_MISSING"),
        ("q", 50, "EXPECTED_CONDITIONAL_MEDSEA_NO_SUPPORT"),
        ("p", 130, "EXPECTED_OUT_OF_SEASON"),
    ])


def test_range_states(spark):
    hist = spark.createDataFrame([("a", float(i)) for i in range(1, 1001)], "k string, v double")
    cur = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.5, 2.0, 8.0, 500.0, 1001.0, None])], "k string, i int, v double")
    for bounded in (True, False):
        out = Q.compatibility(cur, hist, ["k"], ["k", "i"], "v", bounded).orderBy("i").collect()
        assert [r.range_state for r in out] == [
            "BELOW_HISTORICAL_MIN",
            "WITHIN_RANGE_EXTREME_TAIL",
            "WITHIN_RANGE_1PCT_TAIL",
            "WITHIN_HISTORICAL_RANGE",
            "ABOVE_HISTORICAL_MAX",
            "CURRENT_MISSING",
        ]
        assert out[3].percentile == pytest.approx((499 + 500) / 2000)
        assert out[3].robust_z == pytest.approx((500 - 500.5) / (499.5 / 1.349))


def test_bounded_and_ranged_profiles_agree(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_extendedprice")
    a = Q.profile(df, ["l_returnflag"], "l_extendedprice").orderBy("l_returnflag").toPandas()
    b = Q.profile(df, ["l_returnflag"], "l_extendedprice", bounded=True).orderBy("l_returnflag").toPandas()
    assert ((a.set_index("l_returnflag") - b.set_index("l_returnflag")).abs() < 1e-6).all().all()


def test_schema_gate(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert Q.require_columns(df, ["a", "b"]) is df
    with pytest.raises(Q.SchemaOrderError):
        Q.require_columns(df, ["b", "a"])


def test_leakage_stops_the_master(spark):
    lab = spark.createDataFrame([("a", "d", 1)], "receptor_id string, issue_date string, y int")
    dyn = spark.createDataFrame([("a", "d", 1.0)], "receptor_id string, date string, future_flow double")
    stat = spark.createDataFrame([("a", 1.0)], "receptor_id string, area double")
    with pytest.raises(M.LeakageError):
        M.build_master(lab, dyn, stat, "receptor_id", ["future_flow"], ["area"])


def test_ambiguous_names(spark):
    can = spark.createDataFrame([("static__area",), ("static__slope",)], "name string")
    cols = spark.createDataFrame([("area",), ("AREA",), ("x_slope",), ("y_slope",)], "col string")
    none = spark.createDataFrame([], "name string, col string")
    got = {r.canonical: r.method for r in M.map_names(can, cols, none).collect()}
    assert got == {"static__area": "AMBIGUOUS", "static__slope": "UNRESOLVED"}


def test_target_series_takes_the_first_source(spark):
    d = spark.createDataFrame(
        [("a", "d1", 2, "s2", "ARPAL", 1.0, 9.0), ("a", "d1", 1, "s1", "ARPAL", 2.0, None), ("b", "d1", 1, "s3", "X", 3.0, 8.0)],
        "receptor_id string, date string, source_priority int, source_series_id string, provider string, daily_value double, daily_max double",
    )
    assert {r.receptor_id: r.target_observed_value for r in M.target_series(d).collect()} == {"a": 2.0, "b": 3.0}


def test_stream_in_several_batches_equals_one(spark, tmp_path):
    src = tmp_path / "in"
    t0 = dt.datetime(2024, 1, 1)
    for i in range(3):
        part = [("s", "PRECIP_MM", t0 + dt.timedelta(hours=8 * i + h), 1.0) for h in range(8)]
        part += [("s", "PRECIP_MM", t0 + dt.timedelta(days=1, hours=8 * i + h), 2.0) for h in range(8)]
        spark.createDataFrame(part, "s string, code string, ts timestamp, v double").coalesce(1).write.mode("append").parquet(str(src))
    stream = (
        spark.readStream.schema("s string, code string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(src))
    )
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for _ in range(2):  # a restart with the same checkpoint finds nothing new and leaves the table alone
        D.keep_daily_table(D.daily_stream(stream, ["s"], "code", "ts", "v"), out, ck, ["s", "code", "date_model"], "date_model")
    got = sorted((str(r.date_model), r.observed_count, r.daily_value) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-01", 24, 24.0), ("2024-01-02", 24, 48.0)]


def test_late_rows_are_counted_and_repaired(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "s string, code string, ts timestamp, v double"
    t0 = dt.datetime(2024, 1, 1)
    for day, n in ((20, 3), (20, 1), (20, 1), (1, 2)):  # the last file is far behind the watermark
        part = [("s", "PRECIP_MM", t0 + dt.timedelta(days=day, hours=h), 1.0) for h in range(n)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    D.keep_daily_table(D.daily_stream(stream, ["s"], "code", "ts", "v"), out, str(tmp_path / "ck"), ["s", "code", "date_model"], "date_model")
    landed = spark.read.parquet(src)
    late = D.repair_late_days(landed, out, ["s"], "code", "ts", "v").collect()
    assert [(str(r.date_model), r.late_rows) for r in late] == [("2024-01-02", 2)]
    got = sorted((str(r.date_model), r.observed_count, r.daily_value) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-02", 2, 2.0), ("2024-01-21", 5, 5.0)]
    assert D.repair_late_days(landed, out, ["s"], "code", "ts", "v").count() == 0


def test_scratch_folders(spark):
    from rainshed.sources import integrity as I

    assert I.scratch_dir(spark, "x") != I.scratch_dir(spark, "x")
    I.refuse_local("file:/tmp/a", "local[8]")
    I.refuse_local("hdfs://n/tmp/a", "yarn")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            I.refuse_local("file:/tmp/a", master)


def test_platt_needs_two_classes(spark):
    from rainshed.operators import models

    p = spark.createDataFrame([(1.0, 0.2), (1.0, 0.7)], "y double, p double")
    assert models.fit_platt(p, "y", "p") == (None, None)
    assert [r.calibrated_probability for r in models.calibrate(p, "p", (None, None)).collect()] == [None, None]


def test_sniffing_ignores_quoted_marks(spark, tmp_path):
    from rainshed.sources import tables

    (tmp_path / "a.csv").write_text('id;name\n1;"a, b, c"\n2;"x"\n\n3;"p, q"\n')
    assert tables.sniff_delimiter(spark, str(tmp_path / "a.csv")) == ";"


def test_hourly_sums_of_one_long_series(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("k", t0 + dt.timedelta(hours=h), float(h % 7)) for h in range(0, 300) if h % 11]
    d = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    from rainshed.operators import windows

    got = {r.ts: (r.v_6h, r.v_48h) for r in windows.rolling_hours(d, ["k"], "ts", "v", (6, 48)).collect()}
    for _, t, _ in rows:
        want = tuple(sum(v for _, u, v in rows if t - dt.timedelta(hours=n) < u <= t) for n in (6, 48))
        assert got[t] == want
