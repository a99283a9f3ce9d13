"""Indexing of string columns by a dictionary that is a table, for columns with any number of values.

``StringIndexer`` keeps every value on the driver and sends all of them to each task. Here the dictionary is
a stored table (column, value, index): made by grouped counts and ranked by ranges, joined in, and
broadcast only behind a count of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.session import broadcast_if_small, stored

#: values of a column up to which its part of the dictionary is broadcast
BROADCAST_VALUES = 200_000


def value_index(df: DataFrame, cols: list[str]) -> DataFrame:
    """``column, value, n, index`` of every value of ``cols``: the most frequent has index 0, ties by value.

    Values are counted in one pass, dealt to ranges of (column, frequency, value) and written; a range
    ranks its own, after the values that the ranges before it hold of the column. NULL is no value. The
    driver gets a number a range and column, never values.
    """
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, value string, n bigint, index bigint")
    rows = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).unpivot([], [F.col(f"`{c}`") for c in cols], "column", "value")
    counts = rows.where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.asc("value")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(counts.repartitionByRange(ranges, F.col("column"), *order).withColumn("_range", F.spark_partition_id()), "values")
    sizes = dealt.groupBy("column", "_range").agg(F.count(F.lit(1)).alias("c")).orderBy("column", "_range").collect()
    before, seen = [], {}
    for r in sizes:
        before.append((r["column"], r["_range"], seen.get(r["column"], 0)))
        seen[r["column"]] = seen.get(r["column"], 0) + r["c"]
    offsets = spark.createDataFrame(before, "column string, _range int, _before bigint")
    place = F.row_number().over(Window.partitionBy("column", "_range").orderBy(*order))
    return stored(dealt.join(F.broadcast(offsets), ["column", "_range"])  # at most a row a range and column
                  .select("column", "value", "n", (F.col("_before") + place - 1).alias("index")), "dictionary")


def indexed(df: DataFrame, index: DataFrame, cols: list[str], suffix: str = " Index") -> DataFrame:
    """``df`` with the index of each of ``cols`` as a double; a value that the (stored) dictionary does not
    hold, or NULL, gets the number of the column's values."""
    sizes = {r["column"]: r["c"] for r in index.groupBy("column").agg(F.count(F.lit(1)).alias("c")).collect()}
    for c in cols:
        side = broadcast_if_small(index.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("index").alias("_index")),
                                  BROADCAST_VALUES)
        df = (df.join(side, F.col(f"`{c}`").cast("string") == F.col("_value"), "left")
              .withColumn(c + suffix, F.coalesce("_index", F.lit(sizes.get(c, 0))).cast("double")).drop("_value", "_index"))
    return df
