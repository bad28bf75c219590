"""Finding columns, units and time conventions; code dictionaries; monthly climatology overlay."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainshed.functions import rows, text
from rainshed.functions.parse import parse_timestamp

# Canonical unit per variable code.
CANONICAL_UNITS = {
    "PRECIP_MM": "mm",
    "RIVER_STAGE_M": "m",
    "DISCHARGE_M3_S": "m3/s",
    "DISCHARGE_MIN_M3_S": "m3/s",
    "DISCHARGE_MAX_M3_S": "m3/s",
    "AIR_TEMP_C": "degC",
    "REL_HUMIDITY_PCT": "%",
    "WIND_SPEED_M_S": "m/s",
    "WIND_DIR_DEG": "deg",
    "AIR_PRESSURE_HPA": "hPa",
    "SNOW_DEPTH_CM": "cm",
    "SOLAR_RAD_W_M2": "W/m2",
    "REFLECTED_SOLAR_RAD_W_M2": "W/m2",
    "SUNSHINE_DURATION_MIN": "min",
    "LEAF_WETNESS_DURATION_S": "s",
    "LEAF_WETNESS_LOWER_PCT": "%",
    "LEAF_WETNESS_UPPER_PCT": "%",
}

# Meaning of a value by (code, provider); provider NULL is the code's default.
VALUE_SEMANTICS = (
    ("PRECIP_MM", "ARPAL", "interval_accumulation"),
    ("PRECIP_MM", "ARPA_PIEMONTE", "daily_accumulation"),
    ("PRECIP_MM", None, "source_parameter_precipitation"),
    ("RIVER_STAGE_M", "ARPAL", "interval_mean_stage"),
    ("RIVER_STAGE_M", "ARPA_PIEMONTE", "daily_mean_stage"),
    ("RIVER_STAGE_M", None, "source_parameter_stage"),
    ("DISCHARGE_M3_S", "ARPA_PIEMONTE", "daily_mean_discharge"),
    ("DISCHARGE_M3_S", None, "source_parameter_discharge"),
    ("DISCHARGE_MIN_M3_S", None, "source_parameter_min_discharge"),
    ("DISCHARGE_MAX_M3_S", None, "source_parameter_max_discharge"),
)
DEFAULT_SEMANTICS = "source_parameter_value"

# Time convention per provider.
TIME_POLICIES = {
    "ARPA_PIEMONTE": ("DAILY_SOURCE_DATE", "DATE_ONLY"),
    "CENTRO_FUNZIONALE_RAVDA": ("UTC", "UTC"),
    "ARPAL": ("UTC", "UTC"),
}


def canonical_unit(code: Column, source_unit: Column) -> Column:
    units = F.create_map(*[F.lit(x) for kv in CANONICAL_UNITS.items() for x in kv])
    return F.coalesce(F.element_at(units, code), F.trim(F.coalesce(source_unit, F.lit(""))))


def value_semantics(code: Column, provider: Column) -> Column:
    out = None
    for c, p, meaning in VALUE_SEMANTICS:
        hit = (code == c) if p is None else (code == c) & (provider == p)
        out = F.when(hit, meaning) if out is None else out.when(hit, meaning)
    return out.otherwise(DEFAULT_SEMANTICS)


def with_time_policy(df: DataFrame) -> DataFrame:
    """Adds the provider's time basis, zone and effective timestamp (UTC, without zone)."""
    provider = F.col("provider")
    effective = (
        F.when(provider == "ARPA_PIEMONTE", F.col("date_source").cast("timestamp_ntz"))
        .when(provider == "CENTRO_FUNZIONALE_RAVDA", F.col("timestamp_source").cast("timestamp_ntz"))
        .when(provider == "ARPAL", F.coalesce(F.col("timestamp_utc"), F.col("timestamp_source")).cast("timestamp_ntz"))
    )
    policies = F.create_map(
        *[v for p, (basis, zone) in TIME_POLICIES.items() for v in (F.lit(p), F.struct(F.lit(basis).alias("basis"), F.lit(zone).alias("zone")))]
    )
    policy = F.element_at(policies, provider)
    return df.select(
        "*",
        policy["basis"].alias("time_basis"),
        policy["zone"].alias("effective_timezone"),
        effective.alias("timestamp_effective"),
    )


def variable_dictionary(df: DataFrame, codes: str, member: str, group: str) -> DataFrame:
    """Distinct codes of a pipe list with their members and sorted groups."""
    exploded = df.select(F.explode(text.split_codes(F.col(codes))).alias("code"), member, group)
    # Two steps keep one row per (code, member) out of the final task of a frequent code.
    distinct = exploded.groupBy("code", group).agg(F.countDistinct(member).alias("m"))
    return (
        distinct.groupBy("code")
        .agg(F.sum("m").alias("members"), F.array_sort(F.collect_set(group)).alias("groups"))
        .orderBy("code")
    )


def _plain(name: str) -> str:
    s = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return re.sub(r"[^A-Z0-9]+", "", s.upper())


def metric_columns(columns: Sequence[str], include: Sequence[str], exclude: Sequence[str] = ()) -> list[str]:
    """Column names whose normalised form matches a pattern; reads the schema only."""
    hits = [
        c
        for c in columns
        if any(re.search(p, _plain(c)) for p in include) and not any(re.search(p, _plain(c)) for p in exclude)
    ]
    return sorted(hits)


def active_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric value count of every candidate in one aggregate; active when it has any."""
    counts = df.agg(*[F.count(F.col(c).try_cast("double")).alias(c) for c in columns])
    long = counts.unpivot([], list(columns), "column_name", "numeric_values")
    return long.withColumn("active", F.col("numeric_values") > 0)


DATE_WORDS, HOUR_WORDS = ("date", "data"), ("hour", "ora", "time")


def detect_timestamp_pair(df: DataFrame, columns: Sequence[str], minimum: float = 0.5) -> DataFrame:
    """Parsable share of each date column joined to each hour column, by their names; the first good pair is chosen.

    For tables of which no single column parses.  A good pair parses in ``minimum`` of the rows and in two at least.
    """
    named = lambda words: [c for c in columns if any(w in c.lower() for w in words)]
    pairs = [(d, h) for d in named(DATE_WORDS) for h in named(HOUR_WORDS) if d != h]
    joined = {f"{d}+{h}": F.concat_ws(" ", F.trim(F.col(d).cast("string")), F.trim(F.col(h).cast("string"))) for d, h in pairs}
    return detect_timestamp_column(df.select(*[v.alias(k) for k, v in joined.items()]), list(joined), minimum, first=True)


def detect_timestamp_column(df: DataFrame, columns: Sequence[str], minimum: float = 0.5, first: bool = False) -> DataFrame:
    """Parsable share per candidate; of those at or above ``minimum``, and of two values at least, the best one is
    chosen, or the first one."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__n"), *[F.count(parse_timestamp(F.col(f"`{c}`"))).alias(c) for c in columns]
    )
    col = lambda c: F.col(f"`{c}`")
    least = F.greatest(F.lit(2), F.floor(F.col("__n") * minimum))
    best = F.greatest(*[col(c) for c in columns], F.lit(0))
    first_best = F.coalesce(*[F.when((col(c) >= least) if first else ((col(c) == F.col("__best")) & (col(c) >= least)), F.lit(c)) for c in columns])
    marked = counts.withColumn("__best", best).withColumn("__first", first_best)
    long = marked.unpivot(["__n", "__best", "__first"], [f"`{c}`" for c in columns], "column_name", "parsed")
    fraction = F.try_divide(F.col("parsed"), F.col("__n"))
    return long.select(
        "column_name",
        "parsed",
        fraction.alias("fraction"),
        F.coalesce(F.col("column_name") == F.col("__first"), F.lit(False)).alias("chosen"),
    )


def blend_monthly(df: DataFrame, date: str, monthly: DataFrame, month: str, value: str, out: str) -> DataFrame:
    """Attach a monthly climatology, blended linearly between the two anchors (day 15) around each date.

    The climatology has twelve rows, so it is folded into one map and attached once.
    """
    d = F.col(date)
    this = F.date_add(F.trunc(d, "MM"), 14)
    before = F.date_add(F.add_months(F.trunc(d, "MM"), -1), 14)
    after = F.date_add(F.add_months(F.trunc(d, "MM"), 1), 14)
    late = F.dayofmonth(d) >= 15
    lookup = monthly.agg(F.map_from_entries(F.collect_list(F.struct(month, value))).alias("m")).scalar()
    prev_anchor, next_anchor = F.when(late, this).otherwise(before), F.when(late, after).otherwise(this)
    marked = df.select("*", prev_anchor.alias("__p"), next_anchor.alias("__q"), lookup.alias("__m"))
    pick = [F.element_at(F.col("__m"), F.month(c)) for c in ("__p", "__q")]
    blended = rows.monthly_blend(d, pick[0], pick[1], F.col("__p"), F.col("__q"))
    return marked.select(*df.columns, blended.alias(out))
