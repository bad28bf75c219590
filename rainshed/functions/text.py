"""Text normalisation, codes and lists as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fold_table(first: int = 0x00A0, last: int = 0x024F) -> tuple[str, str]:
    """Accented letters and their base letter, derived from Unicode compatibility decomposition."""
    src, dst = [], []
    for code in range(first, last + 1):
        ch = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if plain != ch and len(plain) == 1:
            src.append(ch)
            dst.append(plain)
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _fold_table()


def strip_accents(s: Column) -> Column:
    return F.regexp_replace(F.translate(s, _ACCENTED, _PLAIN), "[̀-ͯ]", "")


def ascii_norm(s: Column) -> Column:
    """Lower case, no accents, single spaces; NULL becomes the empty string."""
    return F.regexp_replace(strip_accents(F.lower(F.trim(F.coalesce(s, F.lit(""))))), r"\s+", " ")


def norm_key(s: Column) -> Column:
    """Upper-case words of letters and digits."""
    up = F.upper(strip_accents(F.coalesce(s, F.lit(""))))
    return F.trim(F.regexp_replace(up, "[^A-Z0-9]+", " "))


def _or(c: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(fallback))


def slug(s: Column, fallback: str = "unknown") -> Column:
    dashed = F.regexp_replace(ascii_norm(s), "[^a-z0-9]+", "_")
    return _or(F.trim(dashed, F.lit("_")), fallback)


def safe_name(s: Column, fallback: str = "series") -> Column:
    kept = F.regexp_replace(strip_accents(F.coalesce(s, F.lit(""))), "[^A-Za-z0-9._-]+", "_")
    return _or(F.trim(kept, F.lit("_")), fallback)


# Tokens read as true.
TRUE_TOKENS = ("true", "1", "yes", "y", "si", "sì")


def to_bool(s: Column) -> Column:
    return F.lower(F.trim(F.coalesce(s.cast("string"), F.lit("")))).isin(*TRUE_TOKENS)


def split_codes(s: Column, separators: str = "|,;") -> Column:
    """Trimmed, non-empty, distinct items in order."""
    pattern = "[" + re.escape(separators) + "]+"
    items = F.transform(F.split(F.coalesce(s, F.lit("")), pattern), lambda x: F.trim(x))
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def remap_codes(codes: Column, mapping: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.array_distinct(F.transform(codes, lambda x: F.coalesce(F.element_at(pairs, x), x)))


def resolve_columns(declared: Column, header: Column) -> Column:
    """Declared names that exist in the header, in declared order; a single exact name also resolves."""
    inner = F.regexp_replace(F.trim(declared), r"^[\[\]\(\)\{\}]+|[\[\]\(\)\{\}]+$", "")
    names = F.transform(F.split(inner, r"[|;,]+"), lambda x: F.trim(F.trim(x), F.lit("'\"")))
    hits = F.array_distinct(F.filter(names, lambda x: F.array_contains(header, x)))
    whole = F.when(F.array_contains(header, F.trim(declared)), F.array(F.trim(declared)))
    return F.when(F.size(hits) > 0, hits).otherwise(F.coalesce(whole, F.array().cast("array<string>")))


# Variable rules in order; text must hold one word of each group.
VARIABLE_RULES: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...] = (
    ("DISCHARGE_MAX_M3_S", (("portata", "discharge"), ("max",))),
    ("DISCHARGE_MIN_M3_S", (("portata", "discharge"), ("min",))),
    ("DISCHARGE_M3_S", (("portata", "discharge"),)),
    (
        "RIVER_STAGE_M",
        (("livello idrometrico", "altezza idrometrica", "livello medio del torrente", "river level", "stage"),),
    ),
    ("PRECIP_MM", (("precipitazione", "precipitation", "pioggia", "rain"),)),
    ("AIR_TEMP_C", (("temperatura", "temperature"),)),
    ("REL_HUMIDITY_PCT", (("umidita relativa", "relative humidity"),)),
    ("WIND_SPEED_M_S", (("velocita vento", "wind speed"),)),
    ("WIND_DIR_DEG", (("direzione vento", "wind direction"),)),
    ("AIR_PRESSURE_HPA", (("pressione", "pressure"),)),
    ("SNOW_DEPTH_CM", (("altezza neve", "snow depth", "neve al suolo"),)),
    ("SOLAR_RAD_W_M2", (("radiazione totale", "radiazione globale", "solar radiation"),)),
    ("SUNSHINE_DURATION_MIN", (("insolazione", "sunshine"),)),
    ("EVAPORATION_SOURCE_UNIT", (("evapor",),)),
    ("SOIL_MOISTURE_SOURCE_UNIT", (("umidita suolo", "soil moisture"),)),
)


def with_variable_code(df: DataFrame, parameter: Column, unit: Column, extra: Column, out: str) -> DataFrame:
    """Adds the variable code of free text; the first matching rule wins, else ``OTHER__`` plus a slug."""
    text = F.col("__text")
    code: Column | None = None
    for name, groups in VARIABLE_RULES:
        hit = F.lit(True)
        for words in groups:
            hit = hit & text.rlike("|".join(re.escape(w) for w in words))
        code = F.when(hit, name) if code is None else code.when(hit, name)
    parts = [F.nullif(ascii_norm(c), F.lit("")) for c in (parameter, unit, extra)]
    other = F.concat(F.lit("OTHER__"), slug(F.coalesce(F.nullif(parameter, F.lit("")), extra)))
    staged = df.withColumn("__text", F.concat_ws(" ", *parts)).withColumn("__other", other)
    return staged.select(*df.columns, code.otherwise(F.col("__other")).alias(out))


# Roles of variable codes.
ANCILLARY_CODES = ("LEAF_WETNESS_DURATION_S", "LEAF_WETNESS_LOWER_PCT", "LEAF_WETNESS_UPPER_PCT", "REFLECTED_SOLAR_RAD_W_M2")
CORE_CODES = (
    "PRECIP_MM",
    "RIVER_STAGE_M",
    "DISCHARGE_M3_S",
    "DISCHARGE_MIN_M3_S",
    "DISCHARGE_MAX_M3_S",
    "AIR_TEMP_C",
    "REL_HUMIDITY_PCT",
    "WIND_SPEED_M_S",
    "WIND_DIR_DEG",
    "AIR_PRESSURE_HPA",
    "SNOW_DEPTH_CM",
    "SOLAR_RAD_W_M2",
    "SUNSHINE_DURATION_MIN",
    "SOIL_MOISTURE_SOURCE_UNIT",
    "EVAPORATION_SOURCE_UNIT",
)
CODE_REMAP = {
    "OTHER__bagnatura_fogliare": "LEAF_WETNESS_DURATION_S",
    "OTHER__radiazione_riflessa": "REFLECTED_SOLAR_RAD_W_M2",
    "OTHER__bagnatura_foglia_inferiore": "LEAF_WETNESS_LOWER_PCT",
    "OTHER__bagnatura_foglia_superiore": "LEAF_WETNESS_UPPER_PCT",
}


def code_role(code: Column) -> Column:
    return (
        F.when(code.isin(*ANCILLARY_CODES), "ANCILLARY")
        .when(code.isin(*CORE_CODES), "CORE")
        .when(code.startswith("OTHER__"), "UNRESOLVED")
        .otherwise("SECONDARY")
    )


def roles_for_codes(codes: Column) -> Column:
    return F.array_distinct(F.transform(codes, code_role))


def human_label(code: Column, prefixes: Sequence[str] = ()) -> Column:
    bare = code
    if prefixes:
        bare = F.regexp_replace(code, "^(?:" + "|".join(re.escape(p) for p in prefixes) + ")", "")
    return F.initcap(F.regexp_replace(bare, "_", " "))


def probability_bucket(p: Column) -> Column:
    return (
        F.when(p.isNull(), "NA")
        .when(p < 0.05, "<5%")
        .when(p < 0.15, "5-15%")
        .when(p < 0.30, "15-30%")
        .when(p < 0.50, "30-50%")
        .otherwise(">=50%")
    )


# Predictor names that would leak the target.
FORBIDDEN_PATTERNS = (
    r"(^|__)label($|__|_)",
    r"(^|__)target($|__|_)",
    r"future",
    r"q95",
    r"q975",
    r"threshold",
    r"current_target",
    r"official",
    r"season_year",
)


def forbidden_name(name: Column) -> Column:
    return F.lower(name).rlike("|".join(FORBIDDEN_PATTERNS))


def station_key(provider: Column, target: Column, station_id: Column, series_id: Column, by_target: str = "ARPAL") -> Column:
    """Identity of a station: provider plus the first identifier present (target first for one provider)."""

    def clean(c: Column) -> Column:
        return F.nullif(F.trim(c), F.lit(""))

    ident = F.coalesce(F.when(provider == by_target, clean(target)), clean(station_id), clean(target), clean(series_id))
    return F.concat(provider, F.lit("::"), F.coalesce(ident, F.lit("")))
