"""Scalar functions on the provided tables: text, parsing, angles, row-wise statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainshed.functions import geo, parse, rows, text
from rainshed.operators import discovery as D
from rainshed.plans import bindings as B
from rainshed.plans.registry import query


def sql_slug(x: str, fallback: str = "unknown") -> str:
    return f"coalesce(nullif(trim(regexp_replace({sql_ascii(x)}, '[^a-z0-9]+', '_', 'g'), '_'), ''), '{fallback}')"


def sql_ascii(x: str) -> str:
    return f"regexp_replace(strip_accents(lower(trim({x}))), '\\s+', ' ', 'g')"


@query("T-01", "doc_id:i normalised:s", f"SELECT doc_id, {sql_ascii('text')} AS normalised FROM documents")
def ascii_normalise(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", text.ascii_norm(F.col("text")).alias("normalised"))


@query(
    "T-02 T-03",
    "page_id:i url_key:s url_slug:s url_file:s",
    f"""SELECT page_id, trim(regexp_replace(upper(strip_accents(url)), '[^A-Z0-9]+', ' ', 'g')) AS url_key, {sql_slug('url')} AS url_slug,
        coalesce(nullif(trim(regexp_replace(strip_accents(url), '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'series') AS url_file FROM pages""",
)
def keys_and_slugs(spark, sf):
    u = F.col("url")
    return B.table(spark, sf, "pages").select(
        "page_id", text.norm_key(u).alias("url_key"), text.slug(u).alias("url_slug"), text.safe_name(u).alias("url_file")
    )


_TS_TOKEN = """CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 2 THEN ' ' || strftime(o_orderdate, '%d/%m/%Y') || ' 7:05 ' WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T13:45'
  WHEN 4 THEN '31/02/' || year(o_orderdate) ELSE o_orderpriority END"""


@query(
    "T-04",
    "o_orderkey:i day:d minute_of_day:i",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN CAST(o_orderdate AS DATE) END AS day,
       CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 425 WHEN 3 THEN 825 END AS minute_of_day FROM orders""",
)
def multi_format_dates(spark, sf):
    d = F.col("o_orderdate")
    dmy, ymd = F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "yyyy-MM-dd")
    k = F.col("o_orderkey") % 6
    token = (
        F.when(k == 0, dmy)
        .when(k == 1, ymd)
        .when(k == 2, F.concat(F.lit(" "), dmy, F.lit(" 7:05 ")))
        .when(k == 3, F.concat(ymd, F.lit("T13:45")))
        .when(k == 4, F.concat(F.lit("31/02/"), F.year(d)))
        .otherwise(F.col("o_orderpriority"))
    )
    ts = parse.parse_timestamp(token)
    return B.table(spark, sf, "orders").select(
        "o_orderkey", ts.cast("date").alias("day"), (F.hour(ts) * 60 + F.minute(ts)).alias("minute_of_day")
    )


def _number_tokens(spark, sf):
    """Prices of orders written in the notations the sources use."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole, frac = F.floor(cents / 100).cast("bigint"), F.lpad((cents % 100).cast("string"), 2, "0")
    head, tail = F.floor(whole / 1000).cast("string"), F.lpad((whole % 1000).cast("string"), 3, "0")
    k = F.col("o_orderkey") % 8
    token = (
        F.when(k == 0, F.concat_ws("", head, F.lit("."), tail, F.lit(","), frac))
        .when(k == 1, F.concat_ws("", head, F.lit(","), tail, F.lit("."), frac))
        .when(k == 2, F.concat_ws("", F.lit(" "), whole.cast("string"), F.lit(","), frac, F.lit(" ")))
        .when(k == 3, F.concat_ws("", whole.cast("string"), F.lit("."), frac))
        .when(k == 4, F.lit("n.d."))
        .when(k == 5, F.lit("  "))
        .when(k == 6, F.col("o_orderstatus"))
        .otherwise(F.concat_ws("", F.lit("-"), head, F.lit(" "), tail))
    )
    return B.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", token.alias("raw"), whole.alias("whole"))


@query(
    "T-05",
    "o_orderkey:i status:s value:f2",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (4, 5) THEN 'missing' WHEN o_orderkey % 8 = 6 THEN 'invalid' ELSE 'numeric' END AS status,
       CASE WHEN o_orderkey % 8 < 4 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) WHEN o_orderkey % 8 = 7 THEN -floor(CAST(o_totalprice AS DECIMAL(18,2))) END AS value
       FROM orders""",
)
def locale_numbers(spark, sf):
    return parse.with_number(_number_tokens(spark, sf), "raw")


@query(
    "T-17",
    "o_orderkey:i status:s value:f2 column_name:s",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0,1,2,3,7) THEN 'numeric' ELSE 'invalid' END AS status,
       CASE WHEN o_orderkey % 8 < 4 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) WHEN o_orderkey % 8 = 7 THEN -floor(CAST(o_totalprice AS DECIMAL(18,2))) END AS value,
       CASE WHEN o_orderkey % 8 IN (0,1,2,3,7) THEN 'raw' ELSE 'o_orderpriority' END AS column_name FROM orders""",
)
def first_valid_metric(spark, sf):
    return parse.with_row_metric(_number_tokens(spark, sf), ["o_orderpriority", "raw"])


@query(
    "T-06",
    "c_custkey:i flag:b",
    """SELECT c_custkey, c_custkey % 7 IN (0, 1, 2, 3) AS flag FROM customer""",
)
def boolean_tokens(spark, sf):
    tokens = F.array(*[F.lit(x) for x in (" TRUE", "Sì", "si ", "1", "no", "0", "")])
    return B.table(spark, sf, "customer").select(
        "c_custkey", text.to_bool(F.get(tokens, (F.col("c_custkey") % 7).cast("int"))).alias("flag")
    )


@query(
    "T-07 T-08 T-11",
    "p_partkey:i codes:s remapped:s roles:s",
    """WITH c AS (SELECT p_partkey, list_filter([trim(x) FOR x IN string_split_regex(' ' || p_type || ' | ' || p_brand || ';;' || p_type || ', PRECIP_MM |', '[|,;]+')], lambda x: x <> '') AS raw FROM part),
       d AS (SELECT p_partkey, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS codes FROM c),
       m AS (SELECT *, [CASE x WHEN 'ECONOMY' THEN 'PRECIP_MM' WHEN 'PROMO' THEN 'OTHER__promo' ELSE x END FOR x IN codes] AS mm FROM d),
       r AS (SELECT p_partkey, codes, list_filter(mm, lambda x, i: list_position(mm, x) = i) AS mapped FROM m),
       o AS (SELECT *, [CASE WHEN x = 'PRECIP_MM' THEN 'CORE' WHEN x LIKE 'OTHER\\_\\_%' ESCAPE '\\' THEN 'UNRESOLVED' ELSE 'SECONDARY' END FOR x IN mapped] AS ro FROM r)
       SELECT p_partkey, array_to_string(codes, '|') AS codes, array_to_string(mapped, '|') AS remapped,
         array_to_string(list_filter(ro, lambda x, i: list_position(ro, x) = i), '|') AS roles FROM o""",
)
def code_lists(spark, sf):
    raw = F.concat(
        F.lit(" "), F.col("p_type"), F.lit(" | "), F.col("p_brand"), F.lit(";;"), F.col("p_type"), F.lit(", PRECIP_MM |")
    )
    codes = text.split_codes(raw)
    mapped = text.remap_codes(codes, {"ECONOMY": "PRECIP_MM", "PROMO": "OTHER__promo"})
    return B.table(spark, sf, "part").select(
        "p_partkey",
        F.array_join(codes, "|").alias("codes"),
        F.array_join(mapped, "|").alias("remapped"),
        F.array_join(text.roles_for_codes(mapped), "|").alias("roles"),
    )


@query(
    "T-09",
    "o_orderpriority:s resolved:s n:i",
    """SELECT o_orderpriority, CASE WHEN o_orderpriority < '3' THEN 'o_totalprice|o_orderdate' ELSE 'o_custkey' END AS resolved, count(*) AS n
       FROM orders GROUP BY 1, 2""",
)
def resolve_declared_columns(spark, sf):
    o = B.table(spark, sf, "orders")
    header = F.array(*[F.lit(c) for c in o.columns])
    declared = F.when(F.col("o_orderpriority") < "3", "['o_totalprice', 'nope'; \"o_orderdate\"| 'o_totalprice']").otherwise(
        " o_custkey "
    )
    r = o.select("o_orderpriority", F.array_join(text.resolve_columns(declared, header), "|").alias("resolved"))
    return r.groupBy("o_orderpriority", "resolved").agg(F.count(F.lit(1)).alias("n"))


# Parameter texts by part size; a size beyond the list has no parameter text.
PHRASES = (
    "Portata MAX",
    "Portata MIN giornaliera",
    "Portata",
    "Livello idrometrico",
    "Pioggia cumulata",
    "Temperatura aria",
    "Umidità relativa",
    "Velocità vento",
    "Direzione  vento",
    "Pressione",
    "Altezza neve",
    "Radiazione globale",
    "Insolazione",
    "Evaporazione",
    "Umidità suolo",
    "Visibilità",
)
PHRASE_CODES = [c for c, _ in text.VARIABLE_RULES]


@query(
    "T-10 T-11",
    "p_partkey:i code:s role:s",
    "WITH c AS (SELECT p_partkey, CASE p_size % 17 "
    + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(PHRASE_CODES))
    + f""" WHEN 15 THEN 'OTHER__visibilita' ELSE 'OTHER__' || {sql_slug('p_name')} END AS code FROM part)
      SELECT *, CASE WHEN code LIKE 'OTHER%' THEN 'UNRESOLVED' ELSE 'CORE' END AS role FROM c""",
)
def classify_variables(spark, sf):
    phrase = F.coalesce(
        F.get(F.array(*[F.lit(x) for x in PHRASES]), (F.col("p_size") % 17).cast("int")), F.lit("")
    )
    p = text.with_variable_code(B.table(spark, sf, "part"), phrase, F.lit(""), F.col("p_name"), "code")
    return p.withColumn("role", text.code_role(F.col("code")))


@query(
    "T-12",
    "code:s parts:i brands:s",
    """WITH x AS (SELECT unnest([p_type, p_brand]) AS code, p_partkey, p_brand FROM part)
       SELECT code, count(DISTINCT p_partkey) AS parts, array_to_string(list_sort(list_distinct(list(p_brand))), '|') AS brands FROM x GROUP BY 1""",
)
def variable_dictionary(spark, sf):
    p = B.table(spark, sf, "part").withColumn("codes", F.concat_ws("|", "p_type", "p_brand"))
    return D.variable_dictionary(p, "codes", "p_partkey", "p_brand").select(
        "code", F.col("members").alias("parts"), F.array_join("groups", "|").alias("brands")
    )


@query(
    "T-13",
    "event_type:s k_total:i missing_total:i rows:i",
    """SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_total, 0 AS missing_total, count(*) AS rows FROM events GROUP BY 1""",
)
def dict_lookup(spark, sf):
    m = parse.parse_counts(F.col("props"))
    e = B.table(spark, sf, "events").select(
        "event_type", parse.count_of(m, "k").alias("k"), parse.count_of(m, "absent").alias("z")
    )
    return e.groupBy("event_type").agg(
        F.sum("k").alias("k_total"), F.sum("z").alias("missing_total"), F.count(F.lit(1)).alias("rows")
    )


@query(
    "T-14",
    "p_partkey:i unit:s semantics:s",
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'mm' WHEN 'STANDARD' THEN 'm' ELSE lower(p_brand) END AS unit,
       CASE WHEN p_type = 'ECONOMY' THEN CASE p_size % 3 WHEN 0 THEN 'interval_accumulation' WHEN 1 THEN 'daily_accumulation' ELSE 'source_parameter_precipitation' END
            WHEN p_type = 'STANDARD' THEN CASE p_size % 3 WHEN 0 THEN 'interval_mean_stage' WHEN 1 THEN 'daily_mean_stage' ELSE 'source_parameter_stage' END
            ELSE 'source_parameter_value' END AS semantics FROM part""",
)
def units_and_semantics(spark, sf):
    code = F.when(F.col("p_type") == "ECONOMY", "PRECIP_MM").when(F.col("p_type") == "STANDARD", "RIVER_STAGE_M").otherwise(F.col("p_type"))
    provider = F.get(
        F.array(*[F.lit(x) for x in ("ARPAL", "ARPA_PIEMONTE", "CENTRO_FUNZIONALE_RAVDA")]), (F.col("p_size") % 3).cast("int")
    )
    p = B.table(spark, sf, "part").select("p_partkey", code.alias("code"), provider.alias("provider"), F.lower("p_brand").alias("unit_source"))
    return p.select(
        "p_partkey",
        D.canonical_unit(F.col("code"), F.col("unit_source")).alias("unit"),
        D.value_semantics(F.col("code"), F.col("provider")).alias("semantics"),
    )


@query(
    "T-15",
    "event_id:i provider:s effective_day:d time_basis:s",
    """WITH e AS (SELECT *, ['ARPA_PIEMONTE', 'CENTRO_FUNZIONALE_RAVDA', 'ARPAL'][1 + user_id % 3] AS provider FROM events)
       SELECT event_id, provider, CASE provider WHEN 'ARPAL' THEN CAST(ts - INTERVAL 1 HOUR AS DATE) ELSE CAST(ts AS DATE) END AS effective_day,
         CASE provider WHEN 'ARPA_PIEMONTE' THEN 'DAILY_SOURCE_DATE' ELSE 'UTC' END AS time_basis FROM e""",
)
def provider_time_policy(spark, sf):
    names = F.array(*[F.lit(x) for x in ("ARPA_PIEMONTE", "CENTRO_FUNZIONALE_RAVDA", "ARPAL")])
    e = B.table(spark, sf, "events").select(
        "event_id",
        F.get(names, (F.col("user_id") % 3).cast("int")).alias("provider"),
        F.to_date("ts").alias("date_source"),
        F.col("ts").alias("timestamp_source"),
        F.expr("ts - INTERVAL 1 HOUR").alias("timestamp_utc"),
    )
    return D.with_time_policy(e).select("event_id", "provider", F.to_date("timestamp_effective").alias("effective_day"), "time_basis")


@query(
    "T-16",
    "c_custkey:i station_key:s",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'ARPAL::' || c_mktsegment WHEN c_custkey % 3 = 1 THEN 'RAVDA::' || c_name
       ELSE 'PIEMONTE::' || CAST(c_custkey AS VARCHAR) END AS station_key FROM customer""",
)
def station_keys(spark, sf):
    k = F.col("c_custkey") % 3
    provider = F.when(k == 0, "ARPAL").when(k == 1, "RAVDA").otherwise("PIEMONTE")
    target = F.when(k == 0, F.col("c_mktsegment")).otherwise(" ")
    station = F.when(k < 2, F.col("c_name"))
    key = text.station_key(provider, target, station, F.col("c_custkey").cast("string"))
    return B.table(spark, sf, "customer").select("c_custkey", key.alias("station_key"))


@query(
    "T-18 S-07",
    "column_name:s values_n:i total:f2",
    """SELECT column_name, count(*) AS values_n, CAST(sum(v) AS DOUBLE) AS total FROM (
         SELECT unnest(['l_extendedprice', 'l_discount']) AS column_name, unnest([CAST(l_extendedprice AS DECIMAL(18,2)), CAST(l_discount AS DECIMAL(18,2))]) AS v FROM lineitem)
       GROUP BY 1""",
)
def metric_columns_melted(spark, sf):
    li = B.table(spark, sf, "lineitem")
    cols = D.metric_columns(li.columns, include=[r"PRICE", r"^LDISC"], exclude=[r"CLASS"])
    long = li.select("l_orderkey", *[B.money(F.col(c)).alias(c) for c in cols]).unpivot(
        ["l_orderkey"], cols, "column_name", "v"
    )
    return long.groupBy("column_name").agg(F.count("v").alias("values_n"), F.sum("v").cast("double").alias("total"))


@query(
    "T-19",
    "column_name:s numeric_values:i active:b",
    """WITH s AS (SELECT * FROM lineitem WHERE month(l_shipdate) BETWEEN 9 AND 12)
       SELECT 'l_quantity' AS column_name, count(l_quantity) AS numeric_values, count(l_quantity) > 0 AS active FROM s
       UNION ALL SELECT 'l_returnflag', count(TRY_CAST(l_returnflag AS DOUBLE)), count(TRY_CAST(l_returnflag AS DOUBLE)) > 0 FROM s
       UNION ALL SELECT 'l_linestatus', count(TRY_CAST(l_linestatus AS DOUBLE)), count(TRY_CAST(l_linestatus AS DOUBLE)) > 0 FROM s""",
)
def active_columns(spark, sf):
    li = B.table(spark, sf, "lineitem")
    season = F.month("l_shipdate").between(9, 12)
    return D.active_columns(li.where(season), ["l_quantity", "l_returnflag", "l_linestatus"])


@query(
    "T-20",
    "p_partkey:i predictor:s forbidden:b",
    f"""SELECT p_partkey, {sql_slug('p_brand')} || CASE p_size % 6 WHEN 0 THEN '__label' WHEN 1 THEN '_future_flow' WHEN 2 THEN '__target_value'
        WHEN 3 THEN '_q95' WHEN 4 THEN '_targeted' ELSE '_mean' END AS predictor, p_size % 6 < 4 AS forbidden FROM part""",
)
def leakage_guard(spark, sf):
    tails = F.array(*[F.lit(x) for x in ("__label", "_future_flow", "__target_value", "_q95", "_targeted", "_mean")])
    p = B.table(spark, sf, "part").select(
        "p_partkey", F.concat(text.slug(F.col("p_brand")), F.get(tails, (F.col("p_size") % 6).cast("int"))).alias("predictor")
    )
    return p.withColumn("forbidden", text.forbidden_name(F.col("predictor")))


@query(
    "T-21",
    "n_nationkey:i label:s",
    """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN substr(n_name, 8) ELSE 'Area ' || substr(n_name, 8) END AS label FROM nation WHERE n_name LIKE 'NATION%'""",
)
def human_labels(spark, sf):
    """Codes with a known prefix lose it, others keep theirs as a word."""
    code = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.regexp_replace("n_name", "^NATION_", "AREA_"))
    return B.table(spark, sf, "nation").select("n_nationkey", text.human_label(code, ["NATION_"]).alias("label"))


@query(
    "T-21",
    "bucket:s docs:i",
    """WITH p AS (SELECT CASE WHEN source IS NULL THEN NULL ELSE (n_chars % 1000) / 1000.0 END AS p FROM documents)
       SELECT CASE WHEN p IS NULL THEN 'NA' WHEN p < 0.05 THEN '<5%' WHEN p < 0.15 THEN '5-15%' WHEN p < 0.30 THEN '15-30%' WHEN p < 0.50 THEN '30-50%' ELSE '>=50%' END AS bucket,
         count(*) AS docs FROM p GROUP BY 1""",
)
def probability_buckets(spark, sf):
    d = B.table(spark, sf, "documents").select(text.probability_bucket((F.col("n_chars") % 1000) / 1000.0).alias("bucket"))
    return d.groupBy("bucket").agg(F.count(F.lit(1)).alias("docs"))


@query(
    "T-22",
    "column_name:s parsed:i fraction:f chosen:b",
    """SELECT 'o_orderdate' AS column_name, count(*) AS parsed, 1.0 AS fraction, true AS chosen FROM orders
       UNION ALL SELECT 'o_orderpriority', 0, 0.0, false FROM orders HAVING count(*) > 0
       UNION ALL SELECT 'o_orderstatus', 0, 0.0, false FROM orders HAVING count(*) > 0""",
)
def timestamp_column_detection(spark, sf):
    o = B.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "dd/MM/yyyy HH:mm").alias("o_orderdate"), "o_orderpriority", "o_orderstatus"
    )
    return D.detect_timestamp_column(o, o.columns)


@query(
    "T-22",
    "column_name:s parsed:i fraction:f chosen:b",
    """SELECT 'order_date+order_hour' AS column_name, count(*) FILTER (WHERE o_orderkey % 4 <> 0) AS parsed, count(*) FILTER (WHERE o_orderkey % 4 <> 0) / count(*) AS fraction, true AS chosen FROM orders
       UNION ALL SELECT 'order_date+ship_time', 0, 0.0, false FROM orders HAVING count(*) > 0""",
)
def timestamp_pair_detection(spark, sf):
    """No single column holds a time; a date column and an hour column do together."""
    o = B.table(spark, sf, "orders")
    hour = F.when(F.col("o_orderkey") % 4 != 0, F.format_string("%02d:30", F.col("o_orderkey") % 24)).otherwise("n.d.")
    d = o.select(F.concat(F.lit(" "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" ")).alias("order_date"), hour.alias("order_hour"), F.col("o_orderpriority").alias("ship_time"))
    return D.detect_timestamp_pair(d, d.columns)


# ---- angles and geometry -----------------------------------------------------------------------------------------
def sql_mod(a: str, b: str) -> str:
    return f"((({a}) % {b}) + {b}) % {b}"


_BEAR = sql_mod("degrees(atan2(e, n)) + 360", "360")


@query(
    "M-01 M-02 M-03 M-04 M-05 M-06 M-07",
    "vec_id:i pair:i bearing:f from_dir:f turn:f sector:s dir_sin:f dir_cos:f low:i high:i frac:f nearest:f",
    f"""WITH p AS (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 2)) AS pair FROM embeddings),
        v AS (SELECT vec_id, pair, CAST(embedding[2 * pair + 1] AS DOUBLE) AS e, CAST(embedding[2 * pair + 2] AS DOUBLE) AS n FROM p),
        b AS (SELECT *, {_BEAR} AS bearing, {sql_mod('degrees(atan2(-e, -n)) + 360', '360')} AS from_dir FROM v)
        SELECT vec_id, pair, bearing, from_dir, abs({sql_mod('bearing - 90 + 180', '360')} - 180) AS turn,
          ['N-Tramontana','NE-Grecale','E-Levante','SE-Scirocco','S-Ostro','SW-Libeccio','W-Ponente','NW-Maestrale'][1 + CAST(floor({sql_mod('bearing + 22.5', '360')} / 45) AS INT)] AS sector,
          sin(radians(bearing)) AS dir_sin, cos(radians(bearing)) AS dir_cos, CAST(floor(bearing / 22.5) AS INT) % 16 AS low,
          (CAST(floor(bearing / 22.5) AS INT) + 1) % 16 AS high, bearing / 22.5 - floor(bearing / 22.5) AS frac,
          (round_even(bearing / 22.5, 0) * 22.5) % 360 AS nearest FROM b""",
)
def vector_directions(spark, sf):
    """Every two elements of a vector are the components of a direction."""
    pairs = F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1)
    p = B.table(spark, sf, "embeddings").where(F.size("embedding") > 1).select("vec_id", "embedding", F.explode(pairs).alias("pair"))
    e, n = (F.get("embedding", F.col("pair") * 2 + i).cast("double") for i in (0, 1))
    b = p.select("vec_id", "pair", geo.bearing_toward(e, n).alias("bearing"), geo.wind_from(e, n).alias("from_dir"))
    d = F.col("bearing")
    return b.select(
        "*",
        geo.angular_difference(d, F.lit(90.0)).alias("turn"),
        geo.compass_sector(d).alias("sector"),
        geo.dir_sin(d).alias("dir_sin"),
        geo.dir_cos(d).alias("dir_cos"),
        geo.sector_low(d).alias("low"),
        geo.sector_high(d).alias("high"),
        geo.sector_fraction(d).alias("frac"),
        geo.sector_nearest(d).alias("nearest"),
    )


# ---- row-wise ----------------------------------------------------------------------------------------------------
@query(
    "M-12 M-13 M-14 M-15",
    "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i scaled:f interaction:f2 mean_present:f min_strict:f",
    """WITH x AS (SELECT *, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_discount END AS d, CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_tax END AS t FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 1000 AS scaled, d * l_extendedprice AS interaction,
         (coalesce(d, 0) + coalesce(t, 0)) / nullif(CAST(d IS NOT NULL AS INT) + CAST(t IS NOT NULL AS INT), 0) AS mean_present,
         CASE WHEN d IS NOT NULL AND t IS NOT NULL THEN least(d, t) END AS min_strict FROM x""",
)
def row_statistics(spark, sf):
    d = F.when(F.col("l_returnflag") != "A", F.col("l_discount"))
    t = F.when(F.col("l_linestatus") != "O", F.col("l_tax"))
    return B.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        (F.col("l_quantity") / 1000).alias("scaled"),
        (d * F.col("l_extendedprice")).alias("interaction"),
        rows.row_mean([d, t]).alias("mean_present"),
        rows.row_min_strict(d, t).alias("min_strict"),
    )


@query(
    "M-16",
    "doc_id:i logit_p:f platt_p:f",
    """WITH p AS (SELECT doc_id, least(greatest(1 / (1 + exp(-(n_chars - 1500) / 1000.0)), 1e-6), 1 - 1e-6) AS p FROM documents)
       SELECT doc_id, ln(p / (1 - p)) AS logit_p, 1 / (1 + exp(-(0.4879 + 0.7498 * ln(p / (1 - p))))) AS platt_p FROM p""",
)
def platt_application(spark, sf):
    p = 1 / (1 + F.exp(-(F.col("n_chars") - 1500) / 1000.0))
    return B.table(spark, sf, "documents").select(
        "doc_id", rows.logit(p).alias("logit_p"), rows.platt(p, 0.4879, 0.7498).alias("platt_p")
    )


@query(
    "M-17 E-22",
    "o_orderkey:i s24:s s48:s s72:s overall:s",
    """WITH p AS (SELECT o_orderkey, o_orderstatus <> 'P' AS sci, o_totalprice / 500000 AS p24, o_totalprice / 400000 AS p48, o_totalprice / 300000 AS p72 FROM orders),
       s AS (SELECT o_orderkey, CASE WHEN NOT sci THEN 0 WHEN p24 >= 0.8 THEN 3 WHEN p24 >= 0.5 THEN 2 ELSE 1 END AS a,
         CASE WHEN NOT sci THEN 0 WHEN p48 >= 0.8 THEN 3 WHEN p48 >= 0.5 THEN 2 ELSE 1 END AS b,
         CASE WHEN NOT sci THEN 0 WHEN p72 >= 0.8 THEN 3 WHEN p72 >= 0.5 THEN 2 ELSE 1 END AS c FROM p)
       SELECT o_orderkey, ['GRAY','GREEN','YELLOW','RED'][1 + a] AS s24, ['GRAY','GREEN','YELLOW','RED'][1 + b] AS s48,
         ['GRAY','GREEN','YELLOW','RED'][1 + c] AS s72, ['GRAY','GREEN','YELLOW','RED'][1 + greatest(a, b, c)] AS overall FROM s""",
)
def severity_states(spark, sf):
    sci = F.col("o_orderstatus") != "P"
    o = B.table(spark, sf, "orders").select(
        "o_orderkey",
        *[
            rows.horizon_state(F.col("o_totalprice") / d, F.lit(0.5), F.lit(0.8), sci).alias(f"s{h}")
            for h, d in ((24, 500000), (48, 400000), (72, 300000))
        ],
    )
    return o.withColumn("overall", rows.severity_max([F.col("s24"), F.col("s48"), F.col("s72")]))


@query(
    "M-18",
    "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i day:d climatology:f",
    """WITH m AS (SELECT month(l_shipdate) AS month, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS v FROM lineitem GROUP BY 1),
       x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS day, date_trunc('month', l_shipdate)::DATE AS m0 FROM lineitem),
       a AS (SELECT *, CASE WHEN day(day) >= 15 THEN m0 ELSE (m0 - INTERVAL 1 MONTH)::DATE END + 14 AS p0, CASE WHEN day(day) >= 15 THEN (m0 + INTERVAL 1 MONTH)::DATE ELSE m0 END + 14 AS p1 FROM x)
       SELECT a.* EXCLUDE (m0, p0, p1), u.v * (1 - date_diff('day', p0, day) / date_diff('day', p0, p1)) + w.v * (date_diff('day', p0, day) / date_diff('day', p0, p1)) AS climatology
       FROM a JOIN m u ON u.month = month(p0) JOIN m w ON w.month = month(p1)""",
)
def blended_climatology(spark, sf):
    li = B.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("day"), "l_quantity"
    )
    monthly = li.groupBy(F.month("day").alias("month")).agg(
        (F.sum(B.money(F.col("l_quantity"))).cast("double") / F.count(F.lit(1))).alias("value")
    )
    return D.blend_monthly(li, "day", monthly, "month", "value", "climatology")
