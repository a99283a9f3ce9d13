"""Batch queries: cleaning, projections, scalar functions, profiling, sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions.json import json_literal, json_object_of_strings, json_unescape
from tarmac.functions.labels import delay_label_name, threshold_label, weekday_name
from tarmac.functions.text import city_name, city_state
from tarmac.functions.times import delay_minutes, hhmm_to_minutes
from tarmac.operators import clean as C
from tarmac.operators import profile as P
from tarmac.operators.sampling import limit_rows
from tarmac.registry import register
from tarmac.registry.sql import CLEAN_COLUMN_NAMES, with_views
from tarmac.schema import (CITY_STATE_PARTS, CLEAN_COLUMNS, CLEAN_SCHEMA, CLUSTER_NUMERIC_FEATURES,
                           CORRELATION_FEATURES, DELAY_THRESHOLD_CHARTS, DELAY_THRESHOLD_STREAM, WEEKDAY_NAMES)
from tarmac.sources.fixtures import flights_clean, flights_raw

T15, T5 = DELAY_THRESHOLD_CHARTS, DELAY_THRESHOLD_STREAM


def _prepared(spark, sf):
    """Clean pipeline without the final null removal."""
    raw = flights_raw(spark, sf)
    return C.trim_headers(C.merge_city_state(C.derive_times(C.drop_columns(raw))))


def _labelled(spark, sf, threshold=T5):
    return flights_clean(spark, sf).withColumn("Tem_ArrDelay", threshold_label("ArrDelay", threshold))


def _sql_cols(cols):
    return ", ".join(cols)


# ---------------------------------------------------------------- end-to-end clean
@register("clean_flights", with_views("SELECT * FROM flights_clean", "flights_clean"))
def q_clean_flights(spark, sf):
    return flights_clean(spark, sf)


# ---------------------------------------------------------------- projections
@register("drop_columns", with_views(
    "SELECT * EXCLUDE (FlightDate, Cancelled, Diverted, CancellationCode) FROM flights_raw",
    "flights_raw"))
def q_drop_columns(spark, sf):
    return C.drop_columns(flights_raw(spark, sf))


@register("trim_headers", with_views("SELECT * FROM flights_raw", "flights_raw"))
def q_trim_headers(spark, sf):
    # the raw CSV header of the airline column ends in a blank
    raw = flights_raw(spark, sf).withColumnRenamed("Operating_Airline", "Operating_Airline ")
    return C.trim_headers(raw)


@register("derive_times", with_views("SELECT * FROM flights_derived", "flights_derived"))
def q_derive_times(spark, sf):
    return C.derive_times(C.drop_columns(flights_raw(spark, sf)))


@register("select_columns", with_views(
    f"SELECT {_sql_cols(CLEAN_COLUMNS)} FROM flights_clean", "flights_clean"))
def q_select_columns(spark, sf):
    return flights_clean(spark, sf).select(*CLEAN_COLUMNS)


@register("null_rows", with_views("SELECT * FROM flights_raw WHERE DepTime IS NULL", "flights_raw"))
def q_null_rows(spark, sf):
    return C.null_rows(flights_raw(spark, sf), "DepTime")


@register("filter_delayed", with_views(
    f"SELECT * FROM flights_clean WHERE ArrDelay > {T15}", "flights_clean"))
def q_filter_delayed(spark, sf):
    return flights_clean(spark, sf).filter(F.col("ArrDelay") > T15)


# raw columns that the dismissed list leaves
_RAW_KEPT = CLEAN_COLUMN_NAMES[:-2] + [p for pair in CITY_STATE_PARTS.values() for p in pair]


@register("dropna_any", with_views(
    "SELECT * EXCLUDE (FlightDate, Cancelled, Diverted, CancellationCode) FROM flights_raw WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in _RAW_KEPT), "flights_raw"))
def q_dropna_any(spark, sf):
    return C.dropna_any(C.drop_columns(flights_raw(spark, sf)))


@register("label_delay15", with_views(f"""
SELECT flight_id, DepDelay, ArrDelay,
       CASE WHEN DepDelay > {T15} THEN 1 ELSE 0 END AS Tem_DepDelay,
       CASE WHEN ArrDelay > {T15} THEN 1 ELSE 0 END AS Tem_ArrDelay
FROM flights_derived""", "flights_derived"))
def q_label_delay15(spark, sf):
    d = C.derive_times(flights_raw(spark, sf))
    return d.select("flight_id", "DepDelay", "ArrDelay",
                    threshold_label("DepDelay", T15).alias("Tem_DepDelay"),
                    threshold_label("ArrDelay", T15).alias("Tem_ArrDelay"))


@register("label_delay5", with_views(f"""
SELECT flight_id, ArrDelay, CASE WHEN ArrDelay > {T5} THEN 1 ELSE 0 END AS Tem_ArrDelay
FROM flights_derived""", "flights_derived"))
def q_label_delay5(spark, sf):
    d = C.derive_times(flights_raw(spark, sf))
    return d.select("flight_id", "ArrDelay", threshold_label("ArrDelay", T5).alias("Tem_ArrDelay"))


@register("typed_cast", with_views("SELECT * FROM flights_clean", "flights_clean"))
def q_typed_cast(spark, sf):
    # every column as the text a CSV export / the stream payload carries ("545.0" for numbers)
    clean = flights_clean(spark, sf)
    as_text = clean.select(*[
        (F.col(f.name).cast("double").cast("string") if f.name in CLEAN_COLUMNS
         and f.dataType.typeName() in ("integer", "long", "double") else F.col(f.name).cast("string")
         ).alias(f.name) for f in clean.schema.fields])
    return C.typed_select(as_text, CLEAN_SCHEMA).withColumn("flight_id", F.col("flight_id").cast("long"))


# ---------------------------------------------------------------- scalar functions
_M = "cast(floor({c} / 100) * 60 + {c} % 100 AS int)"


@register("hhmm_to_minutes", with_views(
    "SELECT flight_id, " + ", ".join(f"{_M.format(c=c)} AS {c}" for c in
                                     ["DepTime", "CRSDepTime", "ArrTime", "CRSArrTime"])
    + " FROM flights_raw", "flights_raw"))
def q_hhmm_to_minutes(spark, sf):
    raw = flights_raw(spark, sf)
    return raw.select("flight_id", *[hhmm_to_minutes(c).cast("int").alias(c)
                                     for c in ["DepTime", "CRSDepTime", "ArrTime", "CRSArrTime"]])


@register("recompute_delays", with_views(
    "SELECT flight_id, DepTime, CRSDepTime, ArrTime, CRSArrTime, DepDelay, ArrDelay FROM flights_derived",
    "flights_derived"))
def q_recompute_delays(spark, sf):
    raw = flights_raw(spark, sf)
    m = {c: hhmm_to_minutes(c).cast("int") for c in ["DepTime", "CRSDepTime", "ArrTime", "CRSArrTime"]}
    return raw.select("flight_id", *[e.alias(c) for c, e in m.items()],
                      delay_minutes(m["DepTime"], m["CRSDepTime"]).alias("DepDelay"),
                      delay_minutes(m["ArrTime"], m["CRSArrTime"]).alias("ArrDelay"))


@register("city_name", with_views(
    "SELECT flight_id, split_part(OriginCityName, ',', 1) AS OriginCity, "
    "split_part(DestCityName, ',', 1) AS DestCity FROM flights_raw", "flights_raw"))
def q_city_name(spark, sf):
    raw = flights_raw(spark, sf)
    return raw.select("flight_id", city_name("OriginCityName").alias("OriginCity"),
                      city_name("DestCityName").alias("DestCity"))


@register("city_state", with_views(
    "SELECT flight_id, OriginCityNameState, DestCityNameState FROM flights_prepared", "flights_prepared"))
def q_city_state(spark, sf):
    raw = flights_raw(spark, sf)
    return raw.select("flight_id",
                      city_state("OriginCityName", "OriginStateName").alias("OriginCityNameState"),
                      city_state("DestCityName", "DestStateName").alias("DestCityNameState"))


# ---------------------------------------------------------------- aggregations
@register("row_count", with_views("SELECT count(*) AS rows FROM flights_clean", "flights_clean"))
def q_row_count(spark, sf):
    return P.row_count(flights_clean(spark, sf))


@register("duplicate_count", with_views("""
SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT Year, Month, Operating_Airline
                                                FROM flights_clean) d) AS distinct_rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT Year, Month, Operating_Airline
                                         FROM flights_clean) d) AS duplicates
FROM flights_clean""", "flights_clean"))
def q_duplicate_count(spark, sf):
    return P.duplicate_count(flights_clean(spark, sf), ["Year", "Month", "Operating_Airline"])


@register("drop_duplicates", with_views(
    "SELECT DISTINCT Year, Month, Operating_Airline FROM flights_clean", "flights_clean"))
def q_drop_duplicates(spark, sf):
    return P.drop_duplicates(flights_clean(spark, sf).select("Year", "Month", "Operating_Airline"))


@register("null_counts", with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM flights_prepared"
    for c in CLEAN_COLUMN_NAMES), "flights_prepared"))
def q_null_counts(spark, sf):
    return P.null_counts(_prepared(spark, sf))


@register("delay_distribution", with_views(f"""
SELECT CASE WHEN ArrDelay > {T5} THEN 1 ELSE 0 END AS Tem_ArrDelay, count(*) AS count
FROM flights_clean GROUP BY 1""", "flights_clean"))
def q_delay_distribution(spark, sf):
    return P.group_count(_labelled(spark, sf), "Tem_ArrDelay")


@register("delays_by_weekday", with_views(f"""
SELECT DayOfWeek, count(*) AS count FROM flights_clean WHERE ArrDelay > {T5} GROUP BY DayOfWeek""",
                                          "flights_clean"))
def q_delays_by_weekday(spark, sf):
    return P.group_count(_labelled(spark, sf).filter(F.col("Tem_ArrDelay") == 1), "DayOfWeek")


@register("group_avg", with_views("""
SELECT Operating_Airline, round(avg(DepDelay), 6) AS "avg(DepDelay)", round(avg(ArrDelay), 6) AS "avg(ArrDelay)"
FROM flights_clean GROUP BY Operating_Airline""", "flights_clean"))
def q_group_avg(spark, sf):
    return P.group_avg(flights_clean(spark, sf), "Operating_Airline", ["DepDelay", "ArrDelay"])


@register("arr_delays_by_weekday", with_views(f"""
SELECT DayOfWeek, count(*) AS QtdAtrasos FROM flights_clean WHERE ArrDelay > {T15} GROUP BY DayOfWeek""",
                                              "flights_clean"))
def q_arr_delays_by_weekday(spark, sf):
    return P.count_above_by(flights_clean(spark, sf), "ArrDelay", T15, "DayOfWeek")


@register("dep_delays_by_weekday", with_views(f"""
SELECT DayOfWeek, count(*) AS QtdAtrasos FROM flights_clean WHERE DepDelay > {T15} GROUP BY DayOfWeek""",
                                              "flights_clean"))
def q_dep_delays_by_weekday(spark, sf):
    return P.count_above_by(flights_clean(spark, sf), "DepDelay", T15, "DayOfWeek")


def _box_sql(value: str) -> str:
    quart = f"""
SELECT DayOfWeek, count(*) AS n, min({value}) AS min, max({value}) AS max,
       quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
       quantile_cont({value}, 0.75) AS q3
FROM flights_clean WHERE {value} IS NOT NULL GROUP BY DayOfWeek"""
    fences = """
SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM box_q"""
    final = f"""
SELECT f.DayOfWeek, f.n, f.min, f.max, round(f.q1, 6) AS q1, round(f.median, 6) AS median,
       round(f.q3, 6) AS q3, round(f.iqr, 6) AS iqr, round(f.lower_fence, 6) AS lower_fence,
       round(f.upper_fence, 6) AS upper_fence,
       cast(min(CASE WHEN c.{value} >= f.lower_fence AND c.{value} <= f.upper_fence THEN c.{value} END) AS double) AS whisker_low,
       cast(max(CASE WHEN c.{value} >= f.lower_fence AND c.{value} <= f.upper_fence THEN c.{value} END) AS double) AS whisker_high,
       count(*) FILTER (WHERE c.{value} < f.lower_fence OR c.{value} > f.upper_fence) AS outliers
FROM box_f f JOIN flights_clean c ON c.DayOfWeek = f.DayOfWeek AND c.{value} IS NOT NULL
GROUP BY f.DayOfWeek, f.n, f.min, f.max, f.q1, f.median, f.q3, f.iqr, f.lower_fence, f.upper_fence"""
    return with_views(final, "flights_clean", [("box_q", quart), ("box_f", fences)])


@register("arr_delay_box", _box_sql("ArrDelay"))
def q_arr_delay_box(spark, sf):
    return P.box_summary(flights_clean(spark, sf), "DayOfWeek", "ArrDelay")


@register("dep_delay_box", _box_sql("DepDelay"))
def q_dep_delay_box(spark, sf):
    return P.box_summary(flights_clean(spark, sf), "DayOfWeek", "DepDelay")


_CORR_COLS = [c for c in CORRELATION_FEATURES if c in CLEAN_COLUMN_NAMES]


def _corr_sql() -> str:
    aggs, alias = [], {}
    for i, a in enumerate(_CORR_COLS):
        for j in range(i, len(_CORR_COLS)):
            b = _CORR_COLS[j]
            aggs.append(f"corr({a}, {b}) AS c{i}_{j}")
            alias[(a, b)] = alias[(b, a)] = f"c{i}_{j}"
    cm = "SELECT " + ", ".join(aggs) + " FROM flights_clean"
    final = "\nUNION ALL\n".join(
        f"SELECT '{a}' AS \"row\", '{b}' AS col, round({alias[(a, b)]}, 6) AS r FROM cm"
        for a in _CORR_COLS for b in _CORR_COLS)
    return with_views(final, "flights_clean", [("cm", cm)])


@register("corr_matrix", _corr_sql())
def q_corr_matrix(spark, sf):
    return P.corr_matrix(flights_clean(spark, sf), CORRELATION_FEATURES)


_PROFILE_COLS = [c for c in CLUSTER_NUMERIC_FEATURES if c in CLEAN_COLUMN_NAMES and c != "DistanceGroup"]


def _profile_sql() -> str:
    glob = "SELECT " + ", ".join(f"avg({c}) AS g_{c}" for c in _PROFILE_COLS) + " FROM flights_clean"
    grp = ("SELECT DistanceGroup, " + ", ".join(f"avg({c}) AS a_{c}" for c in _PROFILE_COLS)
           + " FROM flights_clean GROUP BY DistanceGroup")
    final = "\nUNION ALL\n".join(
        f"SELECT DistanceGroup, '{c}' AS feature, round(a_{c} - g_{c}, 6) AS diff FROM prof_g, prof_all"
        for c in _PROFILE_COLS)
    return with_views(final, "flights_clean", [("prof_all", glob), ("prof_g", grp)])


@register("group_profile", _profile_sql())
def q_group_profile(spark, sf):
    return P.group_profile(flights_clean(spark, sf), "DistanceGroup", CLUSTER_NUMERIC_FEATURES)


# ---------------------------------------------------------------- sorts / limits
@register("top_delay_groups", with_views(f"""
SELECT CASE WHEN ArrDelay > {T5} THEN 1 ELSE 0 END AS Tem_ArrDelay, count(*) AS count
FROM flights_clean GROUP BY 1 ORDER BY count DESC, Tem_ArrDelay LIMIT 20""", "flights_clean"))
def q_top_delay_groups(spark, sf):
    return P.top_groups(_labelled(spark, sf), "Tem_ArrDelay", 20)


def _order_sql(first: list[str], cols: list[str], desc: bool) -> str:
    keys = list(first) + [c for c in cols if c not in first]
    return ", ".join(f"{c} DESC NULLS LAST" if desc else f"{c} ASC NULLS FIRST" for c in keys)


@register("last_rows", with_views(
    f"SELECT * FROM flights_clean ORDER BY {_order_sql(['flight_id'], CLEAN_COLUMN_NAMES, True)} LIMIT 10",
    "flights_clean"))
def q_last_rows(spark, sf):
    return P.last_rows(flights_clean(spark, sf), 10, ["flight_id"])


@register("preview", with_views(
    f"SELECT * FROM flights_clean ORDER BY {_order_sql([], CLEAN_COLUMN_NAMES, False)} LIMIT 20",
    "flights_clean"))
def q_preview(spark, sf):
    return P.preview(flights_clean(spark, sf), 20)


#: the cap as a share of the table: the reference's caps are millions of rows
FIRST_ROWS = 3  # a third


@register("limit_rows", with_views(
    f"SELECT * FROM flights_clean ORDER BY {_order_sql([], CLEAN_COLUMN_NAMES, False)} "
    f"LIMIT (SELECT count(*) // {FIRST_ROWS} FROM flights_clean)", "flights_clean"))
def q_limit_rows(spark, sf):
    clean = flights_clean(spark, sf)
    return limit_rows(clean, clean.count() // FIRST_ROWS)


# ---------------------------------------------------------------- code -> names
@register("label_names", with_views(f"""
SELECT CASE WHEN ArrDelay > {T5} THEN 'Sim' ELSE 'Não' END AS Tem_ArrDelay, count(*) AS count
FROM flights_clean GROUP BY 1""", "flights_clean"))
def q_label_names(spark, sf):
    top = P.top_groups(_labelled(spark, sf), "Tem_ArrDelay", 20)
    return top.select(delay_label_name("Tem_ArrDelay").alias("Tem_ArrDelay"), "count")


_WEEKDAY_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in WEEKDAY_NAMES.items())


@register("weekday_names", with_views(f"""
SELECT CASE DayOfWeek {_WEEKDAY_CASES} END AS DayOfWeek, count(*) AS count
FROM flights_clean WHERE ArrDelay > {T5} GROUP BY flights_clean.DayOfWeek""", "flights_clean"))
def q_weekday_names(spark, sf):
    byday = P.group_count(_labelled(spark, sf).filter(F.col("Tem_ArrDelay") == 1), "DayOfWeek")
    return byday.select(weekday_name("DayOfWeek").alias("DayOfWeek"), "count")


# ---------------------------------------------------------------- JSON payloads
# members in the clean table's column order: the row id, then the 26 clean columns
PAYLOAD_MEMBERS = ["flight_id"] + CLEAN_COLUMNS
_STRUCT_DUCK = "to_json(struct_pack(" + ", ".join(
    f"{c} := cast({c} AS varchar)" for c in PAYLOAD_MEMBERS) + "))::varchar"
_PAYLOAD_DUCK = f"to_json({_STRUCT_DUCK})::varchar"


@register("publish_json", with_views(
    f"SELECT flight_id, {_PAYLOAD_DUCK} AS value FROM flights_clean", "flights_clean"))
def q_publish_json(spark, sf):
    clean = flights_clean(spark, sf)
    return clean.select("flight_id", json_literal(json_object_of_strings(clean.columns)).alias("value"))


@register("json_unescape", with_views(
    f"SELECT flight_id, {_STRUCT_DUCK} AS jsonvalue FROM flights_clean", "flights_clean"))
def q_json_unescape(spark, sf):
    clean = flights_clean(spark, sf)
    payload = json_literal(json_object_of_strings(clean.columns))
    return clean.select("flight_id", json_unescape(payload).alias("jsonvalue"))
