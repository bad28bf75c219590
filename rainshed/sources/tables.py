"""Tabular scans and sinks: CSV, Parquet with CSV fallback, unknown delimiter, multi-file union."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = (",", ";", "\t")


def scan_csv(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV (also gzip) with a declared schema; only the asked columns are parsed.

    Gzip files cannot be split: land them once as Parquet before repeated use.
    """
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*columns) if columns else df


def scan_table(spark: SparkSession, stem: str, schema: str | T.StructType) -> DataFrame:
    """``<stem>.parquet`` when it exists, else ``<stem>.csv``."""
    try:
        return spark.read.parquet(f"{stem}.parquet")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return scan_csv(spark, f"{stem}.csv", schema)


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Delimiter that splits the lines into the most columns, the same number on every line; quoted parts do not count.

    One aggregate over all lines.  A quoted line feed is not foreseen.
    """
    bare = F.regexp_replace("value", '"[^"]*"', "")
    lines = spark.read.text(path).where(F.trim("value") != "").select(*[F.size(F.split(bare, re.escape(d))).alias(f"n{i}") for i, d in enumerate(DELIMITERS)])
    low_high = lines.agg(*[f(f"n{i}") for i in range(len(DELIMITERS)) for f in (F.min, F.max)]).first()
    columns = [low if low is not None and low == high else 1 for low, high in zip(low_high[::2], low_high[1::2])]
    return max(DELIMITERS, key=lambda d: (columns[DELIMITERS.index(d)], -DELIMITERS.index(d)))


def scan_any(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sniff_delimiter(spark, path)).csv(path)


def scan_union(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files with the same meaning but differing columns, by name, each row with its source file."""
    out: DataFrame | None = None
    for p in paths:
        df = spark.read.parquet(p).select("*", F.col("_metadata.file_path").alias("source_file"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def melt_series(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide daily file to long rows: raw text, number when it is one, and the column it came from."""
    long = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        list(ids), list(columns), "source_column", "value_raw"
    )
    return long.withColumn("value_numeric", F.col("value_raw").try_cast("double"))


def write_results(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Spark's commit protocol publishes a result only when every task has finished."""
    w = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
