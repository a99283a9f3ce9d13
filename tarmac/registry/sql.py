"""Oracle SQL fragments (DuckDB dialect) shared by the registered queries.

``FLIGHTS_RAW`` is the portable view of FIXTURES.md §3; the other views follow
the cleaning and scoring steps. Each oracle statement is ``with_views(...)``
+ a final SELECT.
"""

from __future__ import annotations

FLIGHTS_RAW = """
SELECT
  l_orderkey * 10 + l_linenumber AS flight_id,
  cast(l_shipdate AS date) AS FlightDate,
  cast(year(l_shipdate) AS int) AS Year,
  cast(quarter(l_shipdate) AS int) AS Quarter,
  cast(month(l_shipdate) AS int) AS Month,
  cast((l_orderkey + l_linenumber) % 7 + 1 AS int) AS DayOfWeek,
  concat('P', cast(l_suppkey % 4 AS string)) AS Operated_or_Branded_Code_Share_Partners,
  concat('A', cast(l_suppkey % 10 AS string)) AS Operating_Airline,
  cast(l_partkey % 6000 AS int) AS Flight_Number_Operating_Airline,
  concat('O', cast(l_orderkey % 40 AS string)) AS Origin,
  concat('D', cast(l_partkey % 40 AS string)) AS Dest,
  concat('City', cast(l_orderkey % 40 AS string), ', S', cast(l_orderkey % 8 AS string)) AS OriginCityName,
  concat('State', cast(l_orderkey % 8 AS string)) AS OriginStateName,
  concat('City', cast(l_partkey % 40 AS string), ', S', cast(l_partkey % 8 AS string)) AS DestCityName,
  concat('State', cast(l_partkey % 8 AS string)) AS DestStateName,
  cast(((l_orderkey * 7) % 24) * 100 + l_partkey % 60 AS int) AS CRSDepTime,
  cast(CASE WHEN (l_orderkey + l_partkey) % 50 = 0 THEN NULL
       ELSE floor((dep_m % 1440) / 60) * 100 + (dep_m % 1440) % 60 END AS double) AS DepTime,
  cast(taxi_out AS double) AS TaxiOut,
  cast(floor(((dep_m + taxi_out) % 1440) / 60) * 100 + ((dep_m + taxi_out) % 1440) % 60 AS int) AS WheelsOff,
  cast(floor(((arr_m - taxi_in) % 1440) / 60) * 100 + ((arr_m - taxi_in) % 1440) % 60 AS int) AS WheelsOn,
  cast(taxi_in AS double) AS TaxiIn,
  cast(floor((arrs_m % 1440) / 60) * 100 + (arrs_m % 1440) % 60 AS int) AS CRSArrTime,
  cast(CASE WHEN (l_orderkey + l_partkey) % 50 = 0 THEN NULL
       ELSE floor((arr_m % 1440) / 60) * 100 + (arr_m % 1440) % 60 END AS double) AS ArrTime,
  cast(60 + l_partkey % 240 AS double) AS CRSElapsedTime,
  cast(60 + l_partkey % 240 + l_linenumber AS double) AS ActualElapsedTime,
  cast(60 + l_partkey % 240 + l_linenumber - taxi_out - taxi_in AS double) AS AirTime,
  cast(200 + l_partkey % 2000 AS double) AS Distance,
  cast(floor((200 + l_partkey % 2000) / 250) + 1 AS int) AS DistanceGroup,
  l_returnflag = 'R' AS Cancelled,
  false AS Diverted,
  CASE WHEN l_returnflag = 'R' THEN 'B' ELSE NULL END AS CancellationCode,
  cast(CASE WHEN l_orderkey % 2 = 1 THEN dep_m - crs - 1440 END AS double) AS DepDelay,
  cast(CASE WHEN l_partkey % 2 = 1 THEN dep_m - crs - 1440 END AS double) AS ArrDelay
FROM (
  SELECT *, d AS dep_m, d + 60 + l_partkey % 240 + l_linenumber AS arr_m,
         crs + 60 + l_partkey % 240 AS arrs_m,
         cast(round(l_discount * 100) AS bigint) + 5 AS taxi_out,
         cast(round(l_tax * 100) AS bigint) + 3 AS taxi_in
  FROM (SELECT *, crs + cast(l_quantity AS bigint) - 10 + 1440 AS d
        FROM (SELECT *, ((l_orderkey * 7) % 24) * 60 + l_partkey % 60 AS crs FROM lineitem) a) b
) c
"""

# hhmm -> minutes, as integers (input already integral)
_M = "cast(floor({c} / 100) * 60 + {c} % 100 AS int)"

# raw flights with converted clocks and recomputed delays (no null handling)
FLIGHTS_DERIVED = f"""
SELECT flight_id, Year, Quarter, Month, DayOfWeek, Operated_or_Branded_Code_Share_Partners,
       Operating_Airline, Flight_Number_Operating_Airline, Origin, Dest,
       OriginCityName, OriginStateName, DestCityName, DestStateName,
       {_M.format(c='CRSDepTime')} AS CRSDepTime,
       {_M.format(c='DepTime')} AS DepTime,
       TaxiOut, WheelsOff, WheelsOn, TaxiIn,
       {_M.format(c='CRSArrTime')} AS CRSArrTime,
       {_M.format(c='ArrTime')} AS ArrTime,
       CRSElapsedTime, ActualElapsedTime, AirTime, Distance, DistanceGroup,
       {_M.format(c='DepTime')} - {_M.format(c='CRSDepTime')} AS DepDelay,
       {_M.format(c='ArrTime')} - {_M.format(c='CRSArrTime')} AS ArrDelay
FROM flights_raw
"""

CLEAN_COLUMNS_SQL = """flight_id, Year, Quarter, Month, DayOfWeek, Operated_or_Branded_Code_Share_Partners,
       Operating_Airline, Flight_Number_Operating_Airline, Origin, Dest, CRSDepTime, DepTime,
       TaxiOut, WheelsOff, WheelsOn, TaxiIn, CRSArrTime, ArrTime, CRSElapsedTime,
       ActualElapsedTime, AirTime, Distance, DistanceGroup, DepDelay, ArrDelay,
       OriginCityNameState, DestCityNameState"""

# converted clocks + merged city/state, before null handling (26 clean columns + id)
FLIGHTS_PREPARED = f"""
SELECT {CLEAN_COLUMNS_SQL}
FROM (
  SELECT *,
         concat_ws(',', split_part(OriginCityName, ',', 1), OriginStateName) AS OriginCityNameState,
         concat_ws(',', split_part(DestCityName, ',', 1), DestStateName) AS DestCityNameState
  FROM flights_derived
) t
"""

CLEAN_COLUMN_NAMES = [c.strip() for c in CLEAN_COLUMNS_SQL.replace("\n", " ").split(",")]

FLIGHTS_CLEAN = "SELECT * FROM flights_prepared WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in CLEAN_COLUMN_NAMES)

PREDICTIONS = """
SELECT flight_id, DayOfWeek, cast(DepDelay AS double) AS score,
       CASE WHEN DepDelay > 10 THEN 1.0 ELSE 0.0 END :: double AS prediction,
       CASE WHEN ArrDelay > 5 THEN 1.0 ELSE 0.0 END :: double AS label
FROM flights_clean
"""

_VIEWS = [
    ("flights_raw", FLIGHTS_RAW),
    ("flights_derived", FLIGHTS_DERIVED),
    ("flights_prepared", FLIGHTS_PREPARED),
    ("flights_clean", FLIGHTS_CLEAN),
    ("predictions", PREDICTIONS),
]


def with_views(select: str, upto: str = "predictions", extra: list[tuple[str, str]] = ()) -> str:
    """Prefix ``select`` with the view chain up to and including ``upto``, then ``extra`` views."""
    parts = []
    for name, body in _VIEWS:
        parts.append(f"{name} AS ({body})")
        if name == upto:
            break
    parts += [f"{name} AS ({body})" for name, body in extra]
    return "WITH " + ",\n".join(parts) + "\n" + select
