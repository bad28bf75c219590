"""What the operators share: words, learning folds, written intermediates, running totals and components."""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainshed.sources.integrity import prepare_checkpoints, scratch_dir

WORD = r"[^\x20\x09-\x0D]+"
MOST_BROADCAST = 500_000  #: rows


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def word_list(text: str | None) -> list[bytes]:
    """UTF-8 words of a text with A-Z lower-cased; ``bytes`` methods know exactly the white space and letters meant."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text modulo ``parts``; a null id has fold 0 by definition."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Deletes the files of a table of ``written`` whose successor is written."""
    sc = table.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of about so many rows, as a side of a join that is merged if they are many.

    Spark goes by the bytes of the files: ids take a few bytes each there, but tens in a table that is broadcast.
    """
    return df.hint("merge") if rows > MOST_BROADCAST else df


def checkpointed(df: DataFrame) -> DataFrame:
    prepare_checkpoints(df.sparkSession)
    return df.checkpoint()


def share(key: Column) -> Column:
    """A number in [0, 1) from a hash of the key: who is in a sample is the same on every run and machine."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 31)) / F.lit(float(1 << 31))


def labelled(labels: DataFrame, label: str, parts: int, held: int) -> DataFrame:
    """(doc_id, label) of the documents outside the held-out fold; one with labels of both classes has the smaller one."""
    known = labels.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != held))
    return known.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label")).where("label IS NOT NULL")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, parts: int, held: int, most: int) -> DataFrame:
    """(id, text, label, part): about ``most`` labelled documents of each class, none of them from the held-out fold.

    Chosen by hash on the narrow label table, so that documents are only filtered, not exchanged: the chosen labels are
    at most about ``most`` a class and are therefore safe to broadcast.  ``part`` in [0, 1) splits the sample again.
    A document with labels of both classes counts with the smaller one; null ids and null labels teach nothing.
    """
    one = labelled(labels, label, parts, held)
    rate = F.lit(0.0)
    for value, n in one.groupBy("label").count().collect():
        rate = F.when(F.col("label") == value, most / max(n, 1)).otherwise(rate)
    chosen = one.where(share(F.col("doc_id")) < rate).select(F.col("doc_id").alias("id"), "label")
    texts = documents.select(F.col("doc_id").alias("id"), "text")
    return texts.join(F.broadcast(chosen), "id").withColumn("part", F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(1000)) / 1000.0)


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Cut the batches that go to Python workers by bytes as well as by rows: memory stays bounded with long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def running_before(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the earlier rows of the key, in the order (bucket, order).

    Two levels: totals of (key, bucket) are summed over buckets, rows only inside their bucket, so a hot key is split.
    """
    keys = list(keys)
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, bucket, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, bucket]])
    left = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = left.alias("l").join(base.alias("r"), same)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("r._base") + F.col("l._in")).alias(out))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the links (a, b), for every node that has one.

    Alternates large-star and small-star steps, each a grouped minimum and a join back, until no link changes.
    Every step is written to the shared folder.  Links stay distributed; only two counters reach the driver.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        n = edges.count()
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(sized(low, n), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(sized(least, n), "u")
        small = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, "links")
        changed = new.join(sized(edges, n), ["u", "v"], "left_anti").limit(1).count() or edges.join(sized(new, n), ["u", "v"], "left_anti").limit(1).count()
        edges = new
        if not changed:
            leaf = edges.groupBy("u").agg(F.min("v").alias("component"))
            of = leaf.select(F.col("u").alias("node"), "component").unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
            return sized(of, n)
