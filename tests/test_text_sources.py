"""Parsing helpers and file scans on small literal files."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from rainshed.functions import parse, text
from rainshed.operators import discovery as D
from rainshed.sources import integrity as I
from rainshed.sources import tables as S
from rainshed.sources import text_formats as X


def values(spark, items, fn):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x")).alias("y")).collect()]


def test_normalisation(spark):
    assert values(spark, ["  Umidità   RELATIVA ", None, "Éàü"], text.ascii_norm) == ["umidita relativa", "", "eau"]
    assert values(spark, ["Sant'Àlba (2)", ""], text.slug) == ["sant_alba_2", "unknown"]
    assert values(spark, ["a/b c.csv", "//"], text.safe_name) == ["a_b_c.csv", "series"]
    assert values(spark, ["l'Aquila-3"], text.norm_key) == ["L AQUILA 3"]


def test_timestamps(spark):
    got = values(spark, ["1/9/2001", "2001-09-01 7:05", ' "01/09/2001T23:59" ', "31/02/2001", "2001/09/01", "", None, "1/9/2001 25:00"], parse.parse_timestamp)
    assert got == [dt.datetime(2001, 9, 1), dt.datetime(2001, 9, 1, 7, 5), dt.datetime(2001, 9, 1, 23, 59), None, None, None, None, None]


def test_numbers(spark):
    items = ["1.234,5", "1,234.5", "12,5", "12.5", " -3 ", "1 000", "", "n.d.", "--", "abc", "1,2,3", "1e3", "inf", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    got = [(r.status, r.value) for r in parse.with_number(df, "x").orderBy("i").collect()]
    assert got[:6] == [("numeric", v) for v in (1234.5, 1234.5, 12.5, 12.5, -3.0, 1000.0)]
    assert [g[0] for g in got[6:]] == ["missing", "missing", "missing", "invalid", "invalid", "numeric", "missing", "missing"]


def test_row_metric_prefers_numeric_over_invalid(spark):
    df = spark.createDataFrame([("x", "5"), ("x", ""), ("", "")], "a string, b string")
    got = [(r.status, r.value, r.column_name) for r in parse.with_row_metric(df, ["a", "b"]).collect()]
    assert got == [("numeric", 5.0, "b"), ("invalid", None, "a"), ("missing", None, "")]


def test_codes(spark):
    assert values(spark, [" A | B;A,, C "], text.split_codes) == [["A", "B", "C"]]
    assert values(spark, ["X|Y|Z"], lambda c: text.remap_codes(text.split_codes(c), {"X": "Z"})) == [["Z", "Y"]]
    assert values(spark, ["si", "Sì ", "NO", None], text.to_bool) == [True, True, False, False]
    assert values(spark, ["a__label", "label_x", "labelled", "x_q95", "era5__season_year", "precip_prev3d"], text.forbidden_name) == [True, True, False, True, True, False]
    assert values(spark, ["{'a': 2}", "broken", None], lambda c: parse.count_of(parse.parse_counts(c), "a")) == [2, 0, 0]


def test_variable_codes(spark):
    items = ["Portata max", "Livello idrometrico", "Umidità relativa", "Pioggia", "Pippo Pluto"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    out = text.with_variable_code(df, F.col("x"), F.lit(""), F.lit(""), "code").orderBy("i").collect()
    assert [r.code for r in out] == ["DISCHARGE_MAX_M3_S", "RIVER_STAGE_M", "REL_HUMIDITY_PCT", "PRECIP_MM", "OTHER__pippo_pluto"]


def test_blended_climatology_wraps_the_year(spark):
    monthly = spark.createDataFrame([(m, float(m)) for m in range(1, 13)], "month int, value double")
    days = spark.createDataFrame([(dt.date(2000, 1, 1),), (dt.date(2000, 9, 15),), (dt.date(2000, 12, 31),)], "d date")
    got = [r.c for r in D.blend_monthly(days, "d", monthly, "month", "value", "c").orderBy("d").collect()]
    assert got == pytest.approx([12 * (14 / 31) + 1 * (17 / 31), 9.0, 12 * (15 / 31) + 1 * (16 / 31)])


def test_interval_lines(spark, tmp_path):
    raw = (
        "Stazione: Località\n"
        '01/09/2001 00:00,01/09/2001 01:00,"1,5",ok,à\n'
        "01/09/2001 01:00,01/09/2001 02:00,2.5,ok,x\n"
        "01/09/2001 02:00,01/09/2001 03:00,n.d.,ok,x\n"
        "01/09/2001 03:00,01/09/2001 04:00,3\n"
        "bad,01/09/2001 04:00,3,ok,x\n"
    )
    (tmp_path / "a.txt").write_bytes(raw.encode("cp1252"))
    rows = X.parse_interval_lines(X.scan_lines(spark, str(tmp_path))).orderBy("start").collect()
    assert [(r.start.hour, r.end.hour, r.value, r.value_raw) for r in rows] == [(0, 1, 1.5, "1,5"), (1, 2, 2.5, "2.5")]


def test_hourly_files(spark, tmp_path):
    raw = "Stazione: Aosta – piazza\nQuota: 580\n\nlibera\n2001-09-01 00:00;1,5\n2001-09-01 01:00;\nNota: non intestazione\n2001-09-01 02:00:00;x\n"
    (tmp_path / "a.csv").write_bytes(raw.encode("cp1252"))
    rows, header = X.parse_hourly(X.scan_lines(spark, str(tmp_path)))
    assert [(r.ts.hour, r.status, r.value) for r in rows.orderBy("ts").collect()] == [(0, "numeric", 1.5), (1, "missing", None), (2, "invalid", None)]
    assert {r.key: r.value for r in header.collect()} == {"Stazione": "Aosta – piazza", "Quota": "580"}


@pytest.mark.parametrize(
    "payload,encoding",
    [
        ("perché no, anche così".encode("utf-8"), "utf-8"),
        (b"\xef\xbb\xbfciao a tutti quanti", "utf-8-sig"),
        ("perché no".encode("cp1252"), "cp1252"),
        (b"\xff\xfe" + "ciao".encode("utf-16-le"), "utf-16-le-bom"),
        ("una riga abbastanza lunga".encode("utf-16-le"), "utf-16-le"),
        ("una riga abbastanza lunga".encode("utf-16-be"), "utf-16-be"),
    ],
)
def test_encodings(spark, payload, encoding):
    df = spark.createDataFrame([(bytearray(payload),)], "content binary")
    r = X.decode_files(df).first()
    codec = {"utf-16-le-bom": "utf-16"}.get(encoding, encoding)
    assert (r.encoding, r.text) == (encoding, payload.decode(codec))


def test_delimiter_sniffing_and_fallback(spark, tmp_path):
    for name, sep in (("a", ";"), ("b", "\t"), ("c", ",")):
        (tmp_path / f"{name}.csv").write_text(f"k{sep}v\n1{sep}2.5\n2{sep}3.5\n")
        assert S.scan_any(spark, str(tmp_path / f"{name}.csv"), "k int, v double").agg(F.sum("v")).first()[0] == 6.0
    assert S.scan_table(spark, str(tmp_path / "c"), "k int, v double").count() == 2


def test_checksums_verify(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    (tmp_path / "y.bin").write_bytes(b"def")
    files = I.checksums(spark, str(tmp_path))
    reg = spark.createDataFrame(
        [("x.bin", hashlib.sha256(b"abc").hexdigest()), ("y.bin", "0" * 64), ("z.bin", "0" * 64)], "file string, sha256 string"
    )
    assert {r.file: r.status for r in I.verify(reg, files).collect()} == {"x.bin": "OK", "y.bin": "HASH_MISMATCH", "z.bin": "MISSING"}


def test_seal_and_latest_run(spark, tmp_path):
    I.seal(spark, str(tmp_path / "s"), "first")
    with pytest.raises(I.AlreadyOpenedError):
        I.seal(spark, str(tmp_path / "s"), "second")
    runs = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "a")], "run_id string, file string")
    assert I.latest_run(runs, ["a", "b"]).first().run_id == "r1"


def test_restart_skips_finished_units(spark, tmp_path):
    m = str(tmp_path / "m")
    done = spark.createDataFrame([("u1", "PASS", "f1"), ("u2", "FAIL", "f2"), ("u3", "PASS", "old")], "unit string, status string, fp string")
    I.append_manifest(done, m)
    want = spark.createDataFrame([("u1", "f1"), ("u2", "f2"), ("u3", "f3"), ("u4", "f4")], "unit string, fp string")
    left = I.missing_units(want, spark.read.parquet(m), ["unit"], ["fp"])
    assert sorted(r.unit for r in left.collect()) == ["u2", "u3", "u4"]


def test_written_lines_are_one_file_a_name(spark, tmp_path):
    rows = [(f"u-{i % 300}", i, f"{i};à") for i in range(3000)] + [("u-x", 1, None)]
    X.write_lines(spark.createDataFrame(rows, "file string, n long, line string").repartition(7), str(tmp_path / "w"), "n")
    files = {p.name: p.read_bytes().decode("latin-1") for p in (tmp_path / "w").rglob("*") if p.is_file()}
    assert files.pop("u-x") == "\n"
    assert files == {f"u-{k}": "".join(f"{i};à\n" for i in range(k, 3000, 300)) for k in range(300)}
    got = X.scan_lines(spark, str(tmp_path / "w")).collect()
    assert sorted((r.path.rsplit("/")[-1], r.line) for r in got) == sorted((f, x) for f, _, x in rows if x)
    X.write_lines(spark.createDataFrame([], "file string, n long, line string"), str(tmp_path / "none"), "n")
    assert X.scan_lines(spark, str(tmp_path / "none")).count() == 0


def test_scanned_lines_keep_every_byte(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"\x80uro \xe0\r\n\n  \nlast \xff\xfe\x01end")
    assert sorted(r.line for r in X.scan_lines(spark, str(tmp_path)).collect()) == ["last ÿþ\x01end", "€uro à"]
    (tmp_path / "a").write_bytes("perché\n".encode() + b"\xff\n")
    assert sorted(r.line for r in X.scan_lines(spark, str(tmp_path), cp1252=False).collect()) == ["perché", "�"]


def test_an_interval_line_is_parsed_once(spark, tmp_path):
    (tmp_path / "a").write_text("01/09/2001 00:00,01/09/2001 01:00,1,ok,x\n")
    plan = X.parse_interval_lines(X.scan_lines(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv") == 1


@pytest.mark.parametrize("name", ["hourly_file_scan", "interval_file_scan", "file_integrity"])
def test_file_queries_open_no_writer_for_each_key(spark, sf, monkeypatch, name):
    from pyspark.sql import DataFrameWriter

    from rainshed.plans.catalog import REGISTRY

    monkeypatch.setattr(DataFrameWriter, "partitionBy", lambda *_: pytest.fail("a writer for each key"))
    assert REGISTRY[name].run(spark, sf).count() > 0


def test_gathered_lines_are_those_of_one_scan_in_few_tasks(spark, tmp_path, monkeypatch):
    rows = [(f"u-{i % 300}", i, f"{i};à") for i in range(3000)]
    path = str(tmp_path / "w")
    files = X.write_lines(spark.createDataFrame(rows, "file string, n long, line string").repartition(7), path, "n")
    assert files == 300
    planned, scan = [], X.scan_lines

    def recorded(*args):
        lines = scan(*args)
        planned.append(len(lines.inputFiles()))
        return lines

    monkeypatch.setattr(X, "scan_lines", recorded)
    got = X.gathered_lines(spark, path, files, most=60)
    assert sum(planned) == 300 and max(planned) <= 120 and len(planned) >= 5
    assert len(got.inputFiles()) <= 4 * spark.sparkContext.defaultParallelism * len(planned)
    each = {}
    for r in sorted(got.collect(), key=lambda r: r.line_no):
        each.setdefault(r.path.rsplit("/")[-1], []).append(r.line)
    assert each == {f"u-{k}": [f"{i};à" for i in range(k, 3000, 300)] for k in range(300)}
    (tmp_path / "none").mkdir()
    assert X.gathered_lines(spark, str(tmp_path / "none"), 0).count() == 0


def test_hourly_scan_opens_each_file_once_and_keeps_null_users(spark, tmp_path):
    from rainshed.plans.catalog import REGISTRY

    stamp = "timestamp_ntz'2024-01-01 10:00:00'"
    e = spark.range(1, 41).selectExpr("id AS event_id", f"{stamp} AS ts", "CASE WHEN id % 5 > 0 THEN id % 5 END AS user_id", "IF(id % 2 = 0, 'click', 'buy') AS event_type", "CAST(id AS DOUBLE) AS value", "'' AS props")
    e.write.parquet(str(tmp_path / "events.parquet"))
    found = REGISTRY["hourly_file_scan"].run(spark, str(tmp_path))
    assert all(f.endswith(".parquet") for f in found.inputFiles())
    got = {r.user_id: (r.station, r.rows, r.numeric_rows, r.total) for r in found.collect()}
    odd = {k: [i for i in range(1, 41) if i % 5 == k and i % 2] for k in range(5)}
    assert got == {k or None: (f"Stazione {k}" if k else None, 8, 4, float(sum(v))) for k, v in odd.items()}
