"""Structured Streaming: daily station statistics and the keyed daily table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainshed import policy
from rainshed.functions.clock import utc_date, utc_instant
from rainshed.operators.operate import upsert_partitions
from rainshed.operators.stations import circular_angle, policy_of
from rainshed.sources.integrity import prepare_checkpoints


def _primary_sums(v: Column) -> list[Column]:
    r = F.radians(F.pmod(v, F.lit(360.0)))
    return [
        F.count(F.lit(1)).alias("observed_count"),
        F.avg(v).alias("__m"),
        F.min(v).alias("__lo"),
        F.max(v).alias("__hi"),
        F.sum(v).alias("__total"),
        F.avg(F.sin(r)).alias("__s"),
        F.avg(F.cos(r)).alias("__c"),
    ]


def _primary(code: Column, policies: dict[str, str]) -> Column:
    p = policy_of(code, policies)
    return (
        F.when(p == "SUM", F.col("__total"))
        .when(p == "MIN", F.col("__lo"))
        .when(p == "MAX", F.col("__hi"))
        .when(p == "CIRCULAR_MEAN", circular_angle(F.col("__s"), F.col("__c")))
        .otherwise(F.col("__m"))
    )


def _instants(events: DataFrame, ts: str, value: str) -> DataFrame:
    if dict(events.dtypes)[ts] == "timestamp_ntz":
        events = events.withColumn(ts, utc_instant(F.col(ts)))
    return events.where(F.col(value).isNotNull())


def daily_stream(events: DataFrame, series: Sequence[str], code: str, ts: str, value: str, policies: dict[str, str] = policy.STATION_POLICY, late: str = "1 day") -> DataFrame:
    """Event-time form of the daily station layer: one-day tumbling windows.

    Rows later than ``late`` miss their window; ``repair_late_days`` counts them and brings them in.  Days are UTC days;
    a timestamp without zone is read as UTC.  State is one row of sums per open (series, code, day).
    """
    rows = _instants(events, ts, value).withWatermark(ts, late)
    agg = rows.groupBy(F.window(ts, "1 day"), *series, code).agg(*_primary_sums(F.col(value).cast("double")))
    day = utc_date(F.col("window.start")).alias("date_model")
    return agg.select(*series, code, day, "observed_count", _primary(F.col(code), policies).alias("daily_value"))


def daily_batch(events: DataFrame, series: Sequence[str], code: str, ts: str, value: str, policies: dict[str, str] = policy.STATION_POLICY) -> DataFrame:
    """The same rows from landed events."""
    agg = _instants(events, ts, value).groupBy(utc_date(F.col(ts)).alias("date_model"), *series, code).agg(*_primary_sums(F.col(value).cast("double")))
    return agg.select(*series, code, "date_model", "observed_count", _primary(F.col(code), policies).alias("daily_value"))


def repair_late_days(landed: DataFrame, path: str, series: Sequence[str], code: str, ts: str, value: str, policies: dict[str, str] = policy.STATION_POLICY) -> DataFrame:
    """Recomputes from the landed events every (series, code, day) whose count differs from the table's, and upserts it.

    Returns (series, code, date_model, late_rows): the rows that the stream had left out.  A second run finds none.
    ``landed`` may be restricted to the days of interest.
    """
    spark = landed.sparkSession
    keys = [*series, code, "date_model"]
    prepare_checkpoints(spark)
    had = spark.read.parquet(path).select(*keys, F.col("observed_count").alias("__had"))
    full = daily_batch(landed, series, code, ts, value, policies).join(had, keys, "left")
    late = full.withColumn("late_rows", F.col("observed_count") - F.coalesce("__had", F.lit(0))).where("late_rows <> 0").drop("__had").checkpoint()
    upsert_partitions(late.drop("late_rows"), path, keys, "date_model")
    return late.select(*keys, "late_rows")


def keep_daily_table(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], partition: str) -> None:
    """Run a stream over what is available now, upserting every micro-batch into a day-partitioned table.

    The sink is idempotent: a batch that is replayed after a failure rewrites the same keys.
    """

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        upsert_partitions(batch, path, keys, partition)
        batch.unpersist()

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
