"""Catalog helpers: list, reset and query named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def list_tables(spark: SparkSession) -> DataFrame:
    """Tables and views of the current database as a DataFrame (``SHOW TABLES``)."""
    return spark.sql("SHOW TABLES")


def reset_table(spark: SparkSession, name: str) -> None:
    """Forget a named table or temporary view so that a new run starts empty."""
    spark.catalog.dropTempView(name)
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def register_path(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Expose the files at ``path`` as the temporary view ``name``."""
    df = spark.read.format(fmt).load(path)
    df.createOrReplaceTempView(name)
    return df


def read_sink(spark: SparkSession, name: str, raw_envelope: bool = False) -> DataFrame:
    """Rows of a sink table; ``raw_envelope`` keeps only the message text, topic and timestamp."""
    if raw_envelope:
        return spark.sql(f"SELECT CAST(value AS STRING) AS value, topic, timestamp FROM `{name}`")
    return spark.sql(f"SELECT * FROM `{name}`")
