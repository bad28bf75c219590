"""Sources, sinks and streams: tables are written in a foreign format and read back through the scans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rainshed.plans import bindings as B
from rainshed.plans.registry import query
from rainshed.plans.station_queries import POLICIES, SQL_DAILY
from rainshed.sources import integrity as I
from rainshed.sources import tables as S
from rainshed.sources import text_formats as X
from rainshed.streaming import daily as D


@query(
    "S-01 S-15 S-09",
    "c_custkey:i c_mktsegment:s c_acctbal:f2",
    "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer",
)
def csv_scan(spark, sf):
    path = I.scratch_dir(spark, "csv")
    B.table(spark, sf, "customer").write.option("header", True).option("compression", "gzip").csv(path)
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return S.scan_csv(spark, path, schema, ["c_custkey", "c_mktsegment", "c_acctbal"])


@query("S-02 S-15", "s_suppkey:i s_name:s", "SELECT s_suppkey, s_name FROM supplier")
def parquet_or_csv_scan(spark, sf):
    path = I.scratch_dir(spark, "fallback")
    S.write_results(B.table(spark, sf, "supplier").select("s_suppkey", "s_name"), f"{path}/supplier.csv", "csv")
    return S.scan_table(spark, f"{path}/supplier", "s_suppkey bigint, s_name string")


@query("S-03", "o_orderkey:i o_orderstatus:s price:f2", "SELECT o_orderkey, o_orderstatus, o_totalprice AS price FROM orders")
def sniffed_csv_scan(spark, sf):
    path = I.scratch_dir(spark, "sniff")
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    o.write.option("header", True).option("sep", ";").csv(path)
    return S.scan_any(spark, path, "o_orderkey bigint, o_orderstatus string, price double")


def file_of(kind, *keys):
    """File name of the keys; a null key is named as well."""
    return F.concat_ws("-", F.lit(kind), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])


@query(
    "S-04",
    "user_id:i intervals:i total:f2",
    "SELECT user_id, count(*) AS intervals, sum(value) AS total FROM events WHERE event_type <> 'view' GROUP BY 1",
)
def interval_file_scan(spark, sf):
    """Files per user of start,end,value lines; views are written as malformed lines and must drop out."""
    path = I.scratch_dir(spark, "interval")
    e = B.table(spark, sf, "events")
    stamp = F.date_format("ts", "dd/MM/yyyy HH:mm")
    value = F.concat(F.lit('"'), F.replace(F.format_string("%.2f", F.col("value")), F.lit("."), F.lit(",")), F.lit('"'))
    good = F.concat_ws(",", stamp, stamp, value, F.lit("località"), F.col("user_id").cast("string"))
    bad = F.when(F.col("event_id") % 2 == 0, F.concat_ws(",", stamp, stamp, F.lit("n.d."), F.lit("x"), F.lit("1"))).otherwise(
        F.concat_ws(",", stamp, value)
    )
    line = F.when(F.col("event_type") == "view", bad).otherwise(good)
    X.write_lines(e.select(file_of("u", "user_id").alias("file"), "event_id", line.alias("line")), path, "event_id")
    rows = X.parse_interval_lines(X.scan_lines(spark, path))
    user = F.regexp_extract("path", r"/u-(\d+)$", 1).cast("bigint")
    return rows.groupBy(user.alias("user_id")).agg(F.count(F.lit(1)).alias("intervals"), F.sum("value").alias("total"))


@query(
    "S-05",
    "user_id:i station:s rows:i numeric_rows:i total:f2",
    "SELECT user_id, 'Stazione ' || user_id AS station, count(*) AS rows, count(*) FILTER (WHERE event_type <> 'click') AS numeric_rows, sum(value) FILTER (WHERE event_type <> 'click') AS total FROM events GROUP BY 1",
)
def hourly_file_scan(spark, sf):
    """Files per user: a header block, then timestamp;value lines (clicks without a value).

    A file holds at most a million consecutive events, so a busy user is written by several tasks.
    """
    path = I.scratch_dir(spark, "hourly")
    e = B.table(spark, sf, "events")
    part = F.floor(F.col("event_id") / 1_000_000)
    data = e.select(
        "user_id",
        part.alias("part"),
        F.col("event_id").alias("n"),
        F.concat_ws(";", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("event_type") == "click", "").otherwise(F.format_string("%.2f", F.col("value")))).alias("line"),
    )
    head = e.select("user_id", part.alias("part")).distinct().select(
        "user_id",
        "part",
        F.posexplode(F.array(F.concat(F.lit("Stazione: Stazione "), F.col("user_id")), F.lit("Unità: °C"), F.lit("Data;Valore"))).alias("i", "line"),
    ).select("user_id", "part", (F.col("i") - 10).cast("bigint").alias("n"), "line")
    lines = data.unionByName(head).select(file_of("u", "user_id", "part").alias("file"), "n", "line")
    files = X.write_lines(lines, path, "n")
    rows, header = X.parse_hourly(X.gathered_lines(spark, path, files))
    station = header.where("key = 'Stazione'").select("path", F.col("value").alias("station"))
    user = F.regexp_extract("path", r"/u-(-?\d+)-[^/]*$", 1).try_cast("bigint")  # NULL where the name has "null"
    return (
        rows.join(station.hint("merge"), "path", "left")
        .groupBy(user.alias("user_id"), "station")
        .agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("numeric_rows"), F.sum("value").alias("total"))
    )


@query(
    "S-06",
    "doc_id:i encoding:s same_text:b",
    """SELECT doc_id, CASE WHEN doc_id % 4 < 2 AND length(text) < 10 THEN CASE WHEN strlen(text) = length(text) THEN 'utf-8' ELSE 'cp1252' END
         ELSE ['utf-16-le', 'utf-16-be', 'utf-16-le-bom', 'utf-8-sig'][1 + doc_id % 4] END AS encoding, doc_id % 4 > 1 OR length(text) >= 10 OR text = '' AS same_text FROM documents""",
)
def encoding_detection(spark, sf):
    """Whole texts encoded in four ways, then detected and decoded.  UTF-16 without a mark is not recognised below
    twenty bytes, as the zero-byte rule has it."""
    d = B.table(spark, sf, "documents").select("doc_id", F.col("text").alias("original"))
    k, t = F.col("doc_id") % 4, F.col("original")
    content = (
        F.when(k == 0, F.encode(t, "UTF-16LE"))
        .when(k == 1, F.encode(t, "UTF-16BE"))
        .when(k == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(t, "UTF-16LE")))
        .otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode(t, "UTF-8")))
    )
    out = X.decode_files(d.withColumn("content", content))
    return out.select("doc_id", "encoding", (F.col("text") == F.col("original")).alias("same_text"))


@query(
    "S-07",
    "p_partkey:i source_column:s value_raw:s value_numeric:f",
    """SELECT p_partkey, unnest(['p_size', 'p_brand']) AS source_column, unnest([CAST(p_size AS VARCHAR), p_brand]) AS value_raw, unnest([CAST(p_size AS DOUBLE), TRY_CAST(p_brand AS DOUBLE)]) AS value_numeric FROM part""",
)
def melted_series(spark, sf):
    return S.melt_series(B.table(spark, sf, "part"), ["p_partkey"], ["p_size", "p_brand"])


@query(
    "S-08",
    "source_file:s rows:i with_segment:i",
    "SELECT 'customer.parquet' AS source_file, count(*) AS rows, count(c_mktsegment) AS with_segment FROM customer UNION ALL SELECT 'supplier.parquet', count(*), 0 FROM supplier",
)
def union_with_provenance(spark, sf):
    u = S.scan_union(spark, [f"{sf}/customer.parquet", f"{sf}/supplier.parquet"])
    # a table may be a folder of part files: its name is the last part of the path that names a table
    name = F.regexp_extract("source_file", r"/(\w+\.parquet)(?:/[^/]*)?$", 1)
    return u.groupBy(name.alias("source_file")).agg(F.count(F.lit(1)).alias("rows"), F.count("c_mktsegment").alias("with_segment"))


@query(
    "S-10 S-11",
    "year:i month:i",
    """SELECT DISTINCT year(o_orderdate) AS year, month(o_orderdate) AS month FROM orders
       WHERE (year(o_orderdate), month(o_orderdate)) NOT IN (SELECT (year(o_orderdate), month(o_orderdate)) FROM orders GROUP BY year(o_orderdate), month(o_orderdate)
         HAVING count(*) >= (SELECT avg(n) FROM (SELECT count(*) AS n FROM orders GROUP BY year(o_orderdate), month(o_orderdate))))""",
)
def units_to_recompute(spark, sf):
    """Months are units; a month passes with the mean month's orders.  The manifest is appended twice, as after a restart."""
    path = I.scratch_dir(spark, "manifest")
    units = B.table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("rows"))
    mean = F.avg("rows").over(Window.partitionBy())  # one row a month
    rows = units.withColumn("status", F.when(F.col("rows") >= mean, "PASS").otherwise("FAIL"))
    I.append_manifest(rows.where("year < 1998"), path)
    I.append_manifest(rows, path)
    return I.missing_units(units.select("year", "month"), spark.read.parquet(path), ["year", "month"])


@query(
    "S-12",
    "run_id:i",
    "SELECT max(u) AS run_id FROM (SELECT user_id AS u FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'signup') > 0 AND count(*) FILTER (WHERE event_type = 'error') > 0)",
)
def latest_complete_run(spark, sf):
    e = B.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("file"))
    return I.latest_run(e, ["signup", "error"])


@query("E-23 S-10", "run_id:s opened:i", "SELECT '2000' AS run_id, count(*) AS opened FROM orders WHERE year(o_orderdate) = 2000")
def one_shot_seal(spark, sf):
    """Opens the holdout of a year once; its rows can be read only with the seal written."""
    path = I.scratch_dir(spark, "seal")
    I.seal(spark, path, "2000")
    opened = spark.read.json(path).select(F.col("note").alias("run_id"))
    held = B.table(spark, sf, "orders").select(F.year("o_orderdate").cast("string").alias("run_id"))
    return held.join(opened, "run_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("opened"))


@query("S-14", "file:s bytes:i sha256:s", "SELECT CAST(page_id AS VARCHAR) AS file, strlen(html) AS bytes, sha256(html) AS sha256 FROM pages")
def artifact_checksums(spark, sf):
    """The pages as artifacts: size and checksum of each content."""
    return I.content_checksums(B.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("file"), F.col("html").cast("binary").alias("content")))


@query(
    "S-13",
    "file:s status:s",
    """SELECT CAST(page_id AS VARCHAR) AS file, CASE WHEN page_id % 7 = 0 THEN 'HASH_MISMATCH' ELSE 'OK' END AS status FROM pages
       UNION ALL SELECT 'gone-' || page_id, 'MISSING' FROM pages WHERE page_id % 11 = 0""",
)
def integrity_check(spark, sf):
    """The pages' registry with altered and absent entries."""
    files = artifact_checksums(spark, sf)
    altered = F.col("file").cast("bigint") % 7 == 0
    registry = files.withColumn("sha256", F.when(altered, F.reverse("sha256")).otherwise(F.col("sha256")))
    gone = files.where(F.col("file").cast("bigint") % 11 == 0).withColumn("file", F.concat(F.lit("gone-"), "file"))
    return I.verify(registry.unionByName(gone), files)


@query(
    "S-13 S-14",
    "file:s bytes:i status:s",
    """SELECT 's=' || s_suppkey AS file, CASE WHEN s_suppkey % 11 <> 0 THEN strlen(s_name || '|' || s_nationkey || CASE WHEN s_suppkey % 7 = 0 THEN '!' ELSE '' END) + 1 END AS bytes,
       CASE WHEN s_suppkey % 11 = 0 THEN 'MISSING' WHEN s_suppkey % 7 = 0 THEN 'HASH_MISMATCH' ELSE 'OK' END AS status FROM supplier""",
)
def file_integrity(spark, sf):
    """Files of suppliers, some altered and some never written, against a registry of what they should hold."""
    path = I.scratch_dir(spark, "files")
    k = F.col("s_suppkey")
    s = B.table(spark, sf, "supplier").select(k, F.concat_ws("|", "s_name", F.col("s_nationkey").cast("string")).alias("line"))
    registry = s.select(F.concat(F.lit("s="), k).alias("file"), F.sha2(F.concat("line", F.lit("\n")).cast("binary"), 256).alias("sha256"))
    held = s.where(k % 11 != 0).select(F.concat(F.lit("s="), k).alias("file"), F.when(k % 7 == 0, F.concat("line", F.lit("!"))).otherwise(F.col("line")).alias("line"))
    X.write_lines(held, path, "line", "UTF-8")
    files = I.checksums(spark, path)
    return I.verify(registry, files).join(files.select("file", "bytes"), "file", "left")


# ---- streams -----------------------------------------------------------------------------------------------------
STREAM_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query(
    "R-05 R-01 A-08",
    "user_id:i event_type:s date_model:d observed_count:i daily_value:f",
    f"WITH {SQL_DAILY} SELECT user_id, event_type, date_model, observed_count, daily_value FROM daily",
)
def streamed_daily_layer(spark, sf):
    """The daily layer built by a stream and an idempotent keyed sink equals the batch layer."""
    events = spark.readStream.schema(STREAM_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = D.daily_stream(events, ["user_id"], "event_type", "ts", "value", POLICIES)
    path = I.scratch_dir(spark, "daily")
    D.keep_daily_table(stream, path, I.scratch_dir(spark, "offsets"), ["user_id", "event_type", "date_model"], "date_model")
    return spark.read.parquet(path)


@query(
    "R-05 R-01",
    "user_id:i event_type:s date_model:d observed_count:i daily_value:f",
    f"WITH {SQL_DAILY} SELECT user_id, event_type, date_model, observed_count, daily_value FROM daily",
)
def repaired_daily_layer(spark, sf):
    """Files out of time order, a micro-batch each: rows behind the watermark reach the table through the repair."""
    landed, table = I.scratch_dir(spark, "landed"), I.scratch_dir(spark, "daily")
    B.table(spark, sf, "events").repartition(4, "event_id").write.parquet(landed)
    events = spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", 1).parquet(landed)
    stream = D.daily_stream(events, ["user_id"], "event_type", "ts", "value", POLICIES)
    D.keep_daily_table(stream, table, I.scratch_dir(spark, "offsets"), ["user_id", "event_type", "date_model"], "date_model")
    D.repair_late_days(spark.read.parquet(landed), table, ["user_id"], "event_type", "ts", "value", POLICIES)
    return spark.read.parquet(table)
