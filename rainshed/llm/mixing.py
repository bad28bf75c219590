"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled by the md5 of their id and laid end to end; that stream is cut into blocks of
``Params.block`` words.  The mix is a list of slots.  Slot k has the golden-ratio point frac(k * phi), which falls into
one source's interval of the cumulative weights; the slots of a source are ranked, and rank r takes block
``r mod blocks`` in pass ``r div blocks``.  A source's quota of words is its target, so its last slot may take a part
of a block only.  Where the points leave a source short of its quota, the missing slots follow at the end.

Everything is DataFrame functions on narrow rows (no text is shuffled).  Ranks and running sums have two levels, so a
source with a third of all rows is split over buckets; windows without a key see one row for each source.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainshed.llm.common import WORD, running_before, written

GOLDEN = 2654435769  # 2^32 / golden ratio, odd
CELLS = 4096
SPAN = 1 << 16


@dataclass(frozen=True)
class Params:
    weights: tuple[int, ...] = (5, 2, 1)
    most_passes: int = 3
    block: int = 256


@dataclass(frozen=True)
class Mix:
    sources: DataFrame
    schedule: DataFrame
    documents: DataFrame


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, params: Params) -> DataFrame:
    """(source, source_size, sid, target) from (source, source_size), one row a source.

    Weights repeat in code point order of the source, null last.  The level that weights are multiplied by is found in
    one pass over the sources in order of limit / weight: a source stops at its limit exactly if the level that the
    sources from it on would share is at least its own limit / weight.
    """
    whole = Window.partitionBy()
    numbered = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.get(F.array(*[F.lit(float(x)) for x in params.weights]), F.col("sid") % len(params.weights))
    s = numbered.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * params.most_passes)
    s = s.withColumn("r", F.col("cap") / F.col("w"))
    earlier = Window.orderBy("r", "sid").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        F.sum("source_size").over(whole).cast("double").alias("all"),
        F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)).alias("caps"),
        F.sum("w").over(whole).alias("ws"),
        F.coalesce(F.sum("w").over(earlier), F.lit(0.0)).alias("w0"),
    )
    s = s.withColumn("level", (F.col("all") - F.col("caps")) / (F.col("ws") - F.col("w0")))
    s = s.withColumn("stops", F.col("level") >= F.col("r"))
    s = s.withColumn("free", F.min(F.when(~F.col("stops"), F.struct("r", "sid", "level")).otherwise(F.lit(None))).over(whole))
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.col("w") * F.col("free.level"))
    return s.select("source", "source_size", "sid", F.round(target, 6).alias("target"))


def plan(sources: DataFrame, params: Params) -> DataFrame:
    """Per source: quota in words, blocks in a pass, slots in all, and its interval [lo, hi) of the cumulative slots."""
    size = F.col("source_size")
    s = sources.withColumn("quota", F.least(F.round("target").cast("long"), size * params.most_passes))
    s = s.where(F.col("quota") > 0).withColumn("blocks", F.ceil(size / F.lit(params.block)).cast("long"))
    s = s.withColumn("rest", F.col("quota") % size)
    s = s.withColumn("slots", F.expr("quota div source_size") * F.col("blocks") + F.ceil(F.col("rest") / F.lit(params.block)).cast("long"))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum("slots").over(Window.partitionBy()).cast("double")
    s = s.withColumn("hi", F.sum("slots").over(upto) / n)
    return s.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0.0)))


def schedule(planned: DataFrame, params: Params) -> DataFrame:
    """(slot, sid, rank, pass, block, words): what is read in which order.  Order by (slot, sid)."""
    spark = planned.sparkSession
    n = planned.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    u = ((F.col("id") % (1 << 31)) * F.lit(GOLDEN) % (1 << 32)) / F.lit(float(1 << 32))
    points = spark.range(n).select(F.col("id").alias("slot"), u.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    last_cell = F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1))
    cells = planned.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), last_cell)).alias("cell"))
    placed = points.join(cells, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "sid")
    placed = written(placed.withColumn("span", F.expr(f"slot div {SPAN}")).withColumn("one", F.lit(1).cast("long")), "slots")
    ranked = running_before(placed, ["sid"], "span", ["slot"], "one", "rank").select("slot", "sid", "rank")
    had = placed.groupBy("sid").agg(F.count("*").alias("had"))
    short = planned.join(had, "sid", "left").select("sid", "slots", F.coalesce("had", F.lit(0).cast("long")).alias("had"))
    more = short.where("had < slots").select("sid", F.explode(F.sequence("had", F.col("slots") - 1)).alias("rank"))
    ranks = ranked.unionByName(more.select((F.col("rank") + n).alias("slot"), "sid", "rank"))
    out = ranks.join(planned.select("sid", "slots", "blocks", "rest", "source_size"), "sid").where(F.col("rank") < F.col("slots"))
    out = out.withColumn("pass", F.expr("rank div blocks")).withColumn("block", F.col("rank") % F.col("blocks"))
    length = F.least(F.lit(params.block).cast("long"), F.col("source_size") - F.col("block") * params.block)
    partial = (F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0)
    taken = F.when(partial, F.col("rest") - F.col("block") * params.block).otherwise(length)
    return out.select("slot", "sid", "rank", "pass", "block", taken.alias("words"), (taken < length).alias("part"))


def mix(documents: DataFrame, params: Params = Params(), carry: Sequence[str] = ("doc_id",)) -> Mix:
    """Targets of the sources, the schedule, and for every row of ``documents`` how many of its words the mix takes.

    documents of the result: the ``carry`` columns, size, source_size, target, taken.  A null or empty text has size 0
    and taken 0; a null source is a source of its own; repeated rows are rows of their own and, where a pass ends
    between them, either may be the one that is taken.  Without any word all targets are 0.  Other columns are ignored.
    """
    names = {f"c{i}": c for i, c in enumerate(carry)}
    narrow = documents.select(
        *[F.col(c).alias(k) for k, c in names.items()],
        "source",
        words(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
    )
    rows = written(narrow, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(targets(sizes, params), "targets")
    planned = written(plan(sources, params), "quotas")
    slots = written(schedule(planned, params), "schedule")
    known = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop("source")
    placed = running_before(
        known.where("size > 0").withColumn("bucket", F.substring("key", 1, 3)), ["sid"], "bucket", ["key", *names, "size"], "size", "start"
    )
    b = params.block
    pieces = placed.withColumn("block", F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))))
    pieces = pieces.withColumn("from", F.greatest("start", F.col("block") * b)).withColumn("to", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b))
    reads = slots.groupBy("sid", "block").agg(
        F.sum((~F.col("part")).cast("long")).alias("full"), F.max(F.when(F.col("part"), F.col("words")).otherwise(F.lit(0))).alias("head")
    )
    upto = F.least(F.col("to"), F.col("block") * b + F.col("head"))
    got = F.coalesce(F.col("full") * (F.col("to") - F.col("from")) + F.greatest(F.lit(0), upto - F.col("from")), F.lit(0))
    whole = ["sid", "start", *names, "size", "source_size", "target"]
    # Merged at every size: the schedule's files are small for the number of its blocks.
    taken = pieces.join(reads.hint("merge"), ["sid", "block"], "left").groupBy(*whole).agg(F.sum(got).alias("taken"))
    out = taken.drop("sid", "start").unionByName(known.where("size = 0").select(*names, "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))
    return Mix(sources, slots, out.select(*[F.col(k).alias(c) for k, c in names.items()], "size", "source_size", "target", "taken"))


def mixed(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """The documents of the mix, with the columns of ``documents``: a row for each pass in which the mix reads its start.

    A document without words is in no mix.
    """
    key = Window.partitionBy("_llm_k").orderBy("_llm_k")
    keyed = documents.withColumn("_llm_k", F.xxhash64("doc_id", "text", "source")).withColumn("_llm_n", F.row_number().over(key))
    takes = mix(keyed, params, ["_llm_k", "_llm_n"]).documents.where("taken > 0")
    copies = takes.select("_llm_k", "_llm_n", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("_llm_copies"))
    out = keyed.join(copies, ["_llm_k", "_llm_n"])
    return out.withColumn("_llm_c", F.explode(F.sequence(F.lit(1), F.col("_llm_copies")))).select(*[F.col(c) for c in documents.columns])
