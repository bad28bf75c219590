"""URL verdicts: host and path rules, and a logistic regression on hashed character n-grams for the urls that no rule fits.

Everything is DataFrame and SQL functions.  The fit reads a small labelled table of at most ``Params.most_rows`` urls;
each step is one grouped sum over its n-grams, and only the weight vector (``Params.width`` numbers) visits the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainshed.llm.common import ascii_lower, checkpointed

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Params:
    gram: int = 3
    width: int = 4096
    most_rows: int = 4000
    steps: int = 25
    rate: float = 4.0
    ridge: float = 1e-3


@dataclass(frozen=True)
class Model:
    params: Params
    bias: float
    weights: tuple[float, ...]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null and for no ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_struct(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none.  Of equally long rules the first by text wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def buckets(host: Column, path: Column, p: Params) -> Column:
    """Hashed n-grams of ``^host$`` and ``^path$``, in one array; linear in the length of the url."""

    def of(part: Column, tag: str) -> Column:
        grams = F.regexp_extract_all(F.concat(F.lit("^"), part, F.lit("$")), F.lit(f"(?s)(?=(.{{1,{p.gram}}}))"), 1)
        return F.transform(grams, lambda g: F.pmod(F.xxhash64(F.lit(tag), g), F.lit(p.width)).cast("int"))

    return F.concat(of(host, "h"), of(path, "p"))


def margin(grams: Column, model: Model) -> Column:
    """Log odds of allow: bias plus the mean-scaled sum of the n-grams' weights."""
    w = F.split(F.lit(",".join(repr(x) for x in model.weights)), ",").cast("array<double>")
    total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.get(w, g))
    return F.lit(model.bias) + total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))


def fit(labelled: DataFrame, params: Params = Params()) -> Model:
    """Logistic regression from (host, path, verdict); distinct urls with the smallest hashes, ``most_rows`` at most.

    A url with both verdicts counts as blocked.  With one class only, the bias alone decides; with no rows it is zero
    and every url is allowed.
    """
    one = labelled.groupBy("host", "path").agg(F.min((F.col("verdict") == ALLOW).cast("double")).alias("y"))
    few = one.orderBy(F.xxhash64("host", "path"), "host", "path").limit(params.most_rows)
    rows = checkpointed(few.select("y", buckets(F.col("host"), F.col("path"), params).alias("g")))
    n, allowed = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    weights, speed, bias = [0.0] * params.width, [0.0] * params.width, 0.0
    if n == 0:
        return Model(params, 0.0, tuple(weights))
    rate = min(max(allowed / n, 1e-3), 1 - 1e-3)
    bias, push = math.log(rate / (1 - rate)), 0.0
    if 0 < allowed < n:
        for _ in range(params.steps):
            ahead = Model(params, bias + 0.9 * push, tuple(w + 0.9 * s for w, s in zip(weights, speed)))
            left = F.col("y") - 1 / (1 + F.exp(-margin(F.col("g"), ahead)))
            step = rows.select(left.alias("r"), "g").select("r", (F.col("r") / F.sqrt(F.size("g").cast("double"))).alias("s"), "g")
            sums = step.select("s", F.explode("g").alias("k")).groupBy("k").agg(F.sum("s").alias("s"))
            grad = [0.0] * params.width
            for k, s in sums.collect():
                grad[k] = s / n
            total = step.agg(F.sum("r")).first()[0] / n
            push = 0.9 * push + 0.1 * params.rate * total
            bias += push
            for k in range(params.width):
                speed[k] = 0.9 * speed[k] + 0.1 * params.rate * (grad[k] - params.ridge * ahead.weights[k])
                weights[k] += speed[k]
    return Model(params, bias, tuple(weights))


def judge(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, params: Params = Params()) -> DataFrame:
    """(page_id, host, path, rule, score, verdict) of every row of pages, repeated rows included.

    ``labelled`` is (host, path, verdict); without it the urls that the rules decide teach the model.  score is the
    model's probability of allow, with or without a rule.  A null, empty or broken url has an empty host and path, no
    rule unless one has an empty host, and the model's verdict.  An empty table gives an empty result.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("r", rule_struct(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = ruled.where(F.col("r").isNotNull()).select("host", "path", F.col("r.verdict").alias("verdict"))
    model = fit(labelled, params)
    score = 1 / (1 + F.exp(-margin(buckets(F.col("host"), F.col("path"), params), model)))
    scored = ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("_v"), score.alias("score"))
    by_model = F.when(F.col("score") >= 0.5, ALLOW).otherwise(BLOCK)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_v", by_model).alias("verdict"), "score")
