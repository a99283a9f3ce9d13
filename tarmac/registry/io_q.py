"""Source/sink queries: write to the shared folder, read back, compare with the source rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.registry import register
from tarmac.registry.sql import with_views
from tarmac.session import shared_path
from tarmac.sources import files as FI
from tarmac.sources.fixtures import flights_clean, flights_raw

_CLEAN = with_views("SELECT * FROM flights_clean", "flights_clean")


@register("scan_csv", _CLEAN)
def q_scan_csv(spark, sf):
    path = FI.write_csv(flights_clean(spark, sf), shared_path(spark, "clean-csv"))
    return FI.scan_csv(spark, path)


@register("scan_csv_infer", _CLEAN)
def q_scan_csv_infer(spark, sf):
    path = FI.write_csv(flights_clean(spark, sf), shared_path(spark, "clean-csv"))
    return FI.scan_csv(spark, path, infer=True)


@register("sink_csv_parts", _CLEAN)
def q_sink_csv_parts(spark, sf):
    # the stream feed: the whole clean table in files of at most 20 000 rows, overwrite
    path = FI.write_csv(flights_clean(spark, sf), shared_path(spark, "feed-csv"), mode="overwrite",
                        rows_per_file=20_000)
    return FI.scan_csv(spark, path)


@register("sink_parquet", _CLEAN)
def q_sink_parquet(spark, sf):
    path = FI.write_parquet(flights_clean(spark, sf), shared_path(spark, "clean-parquet"))
    return FI.read_parquet(spark, path)


# a folder of files by months: one header ends in an unnamed column, one has blanks around its names, another order
# and no TaxiOut, and one has rows that break off after two fields
_DRIFT = {"flight_id": T.LongType(), "Year": T.IntegerType(), "Month": T.IntegerType(), "Origin": T.StringType(),
          "OriginCityName": T.StringType(), "DepTime": T.DoubleType(), "TaxiOut": T.DoubleType()}
_BREAKS = "Month % 3 = 2 AND flight_id % 19 = 0"


@register("scan_csv_drift", with_views(f"""
SELECT {", ".join(f"CASE WHEN NOT ({_BREAKS}) THEN {c} END AS {c}" for c in _DRIFT if c != "TaxiOut")},
       CASE WHEN NOT ({_BREAKS}) AND Month % 3 <> 1 THEN TaxiOut END AS TaxiOut,
       CASE WHEN {_BREAKS} THEN concat(flight_id, ',', Year) END AS broken_row
FROM flights_raw""", "flights_raw"))
def q_scan_csv_drift(spark, sf):
    rows = flights_raw(spark, sf).select(*_DRIFT)
    folder = shared_path(spark, "drifting-csv")
    FI.write_csv(rows.where("Month % 3 = 0").withColumn(" ", F.lit(None).cast("string")), f"{folder}/a")
    FI.write_csv(rows.where("Month % 3 = 1").select(*[F.col(c).alias(f" {c} ") for c in reversed(_DRIFT) if c != "TaxiOut"]), f"{folder}/b")
    FI.write_csv(rows.where("Month % 3 = 2").where(f"NOT ({_BREAKS})"), f"{folder}/c")
    torn = rows.where(_BREAKS).select(F.concat_ws(",", "flight_id", "Year").alias(",".join(_DRIFT)))
    torn.write.option("header", True).option("sep", "\x01").csv(f"{folder}/d")
    return FI.scan_csv_folder(spark, folder, T.StructType([T.StructField(c, t) for c, t in _DRIFT.items()]))
