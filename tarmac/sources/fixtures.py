"""Flight-shaped views over the driver's tables.

``flights_raw`` re-expresses the portable view of FIXTURES.md §3 with the
DataFrame API: every column is a pure function of one ``lineitem`` row, so the
view is a single narrow projection over the parquet scan (column pruning keeps
only the lineitem columns it needs; nothing shuffles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators.clean import clean_flights
from tarmac.session import compiled_plans

LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_discount", "l_tax", "l_returnflag", "l_shipdate"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hhmm(minutes: Column) -> Column:
    """Minutes (any day) -> hhmm clock of the same time of day."""
    m = minutes % 1440
    return F.floor(m / 60) * 100 + m % 60


def flights_from_lineitem(lineitem: DataFrame) -> DataFrame:
    li = lineitem.select(*LINEITEM_COLUMNS)
    ok, pk, sk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    # shared intermediates in their own projection: each is referenced several
    # times below, so Catalyst keeps it computed once instead of inlining copies
    crs = ((ok * 7) % 24) * 60 + pk % 60
    base = li.select(
        "*",
        crs.alias("_crs"),
        (crs + F.col("l_quantity").cast("bigint") - 10 + 1440).alias("_dep_m"),
        (F.round(F.col("l_discount") * 100).cast("bigint") + 5).alias("_taxi_out"),
        (F.round(F.col("l_tax") * 100).cast("bigint") + 3).alias("_taxi_in"),
        ((ok + pk) % 50 == 0).alias("_missing"),
        (F.col("l_returnflag") == "R").alias("_cancelled"),
    )
    dep_m, taxi_out, taxi_in = F.col("_dep_m"), F.col("_taxi_out"), F.col("_taxi_in")
    arr_m = dep_m + 60 + pk % 240 + ln
    arrs_m = F.col("_crs") + 60 + pk % 240
    missing, cancelled = F.col("_missing"), F.col("_cancelled")

    def s(prefix: str, c: Column) -> Column:
        return F.concat(F.lit(prefix), c.cast("string"))

    return base.select(
        (ok * 10 + ln).alias("flight_id"),
        F.col("l_shipdate").cast("date").alias("FlightDate"),
        F.year("l_shipdate").cast("int").alias("Year"),
        F.quarter("l_shipdate").cast("int").alias("Quarter"),
        F.month("l_shipdate").cast("int").alias("Month"),
        ((ok + ln) % 7 + 1).cast("int").alias("DayOfWeek"),
        s("P", sk % 4).alias("Operated_or_Branded_Code_Share_Partners"),
        s("A", sk % 10).alias("Operating_Airline"),
        (pk % 6000).cast("int").alias("Flight_Number_Operating_Airline"),
        s("O", ok % 40).alias("Origin"),
        s("D", pk % 40).alias("Dest"),
        F.concat(s("City", ok % 40), s(", S", ok % 8)).alias("OriginCityName"),
        s("State", ok % 8).alias("OriginStateName"),
        F.concat(s("City", pk % 40), s(", S", pk % 8)).alias("DestCityName"),
        s("State", pk % 8).alias("DestStateName"),
        (((ok * 7) % 24) * 100 + pk % 60).cast("int").alias("CRSDepTime"),
        F.when(~missing, _hhmm(dep_m)).cast("double").alias("DepTime"),
        taxi_out.cast("double").alias("TaxiOut"),
        _hhmm(dep_m + taxi_out).cast("int").alias("WheelsOff"),
        _hhmm(arr_m - taxi_in).cast("int").alias("WheelsOn"),
        taxi_in.cast("double").alias("TaxiIn"),
        _hhmm(arrs_m).cast("int").alias("CRSArrTime"),
        F.when(~missing, _hhmm(arr_m)).cast("double").alias("ArrTime"),
        (60 + pk % 240).cast("double").alias("CRSElapsedTime"),
        (60 + pk % 240 + ln).cast("double").alias("ActualElapsedTime"),
        (60 + pk % 240 + ln - taxi_out - taxi_in).cast("double").alias("AirTime"),
        (200 + pk % 2000).cast("double").alias("Distance"),
        (F.floor((200 + pk % 2000) / 250) + 1).cast("int").alias("DistanceGroup"),
        cancelled.alias("Cancelled"),
        F.lit(False).alias("Diverted"),
        F.when(cancelled, F.lit("B")).alias("CancellationCode"),
        # the delays as recorded, often missing; cleaning recomputes them from the clocks
        F.when(ok % 2 == 1, F.col("_dep_m") - F.col("_crs") - 1440).cast("double").alias("DepDelay"),
        F.when(pk % 2 == 1, F.col("_dep_m") - F.col("_crs") - 1440).cast("double").alias("ArrDelay"),
    )


def flights_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw flight rows (hhmm clocks, nullable times, recorded delays, city and state apart)."""
    return flights_from_lineitem(read_table(compiled_plans(spark), sf_dir, "lineitem"))


def flights_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned flights: :func:`tarmac.operators.clean.clean_flights` over the raw rows."""
    return clean_flights(flights_raw(spark, sf_dir))


def predictions_view(clean: DataFrame) -> DataFrame:
    """Deterministic scores/predictions over clean flights (FIXTURES.md §4)."""
    return clean.select(
        "flight_id", "DayOfWeek",
        F.col("DepDelay").cast("double").alias("score"),
        F.when(F.col("DepDelay") > 10, 1.0).otherwise(0.0).alias("prediction"),
        F.when(F.col("ArrDelay") > 5, 1.0).otherwise(0.0).alias("label"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions_view(flights_clean(spark, sf_dir))
