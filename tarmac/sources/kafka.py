"""Kafka source and sink.

The Kafka connector is an optional Spark package: it is not on the classpath of
this environment, so only the option maps are exercised in tests. The payload
logic (:mod:`tarmac.streaming.decode`) accepts any streaming or batch DataFrame
with a ``value`` column, which is how tests drive it through a file stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spark's Kafka record layout (fixed by the connector)
ENVELOPE_COLUMNS = ["key", "value", "topic", "partition", "offset", "timestamp", "timestampType", "headers"]


def kafka_source_options(brokers: str, topic: str, starting_offsets: str = "earliest",
                         include_headers: bool = True, **extra: str) -> dict[str, str]:
    opts = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topic,
        "includeHeaders": str(include_headers).lower(),
        "startingOffsets": starting_offsets,
    }
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def kafka_available(spark: SparkSession) -> bool:
    jvm = spark.sparkContext._jvm
    try:
        jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider")
        return True
    except Exception:
        return False


def read_kafka_stream(spark: SparkSession, brokers: str, topic: str, **opts: str) -> DataFrame:
    """Unbounded stream of a topic's records (from the earliest offset by default)."""
    return spark.readStream.format("kafka").options(**kafka_source_options(brokers, topic, **opts)).load()


def read_kafka_batch(spark: SparkSession, brokers: str, topic: str, **opts: str) -> DataFrame:
    """The records a topic holds now, as a bounded DataFrame (earliest to latest)."""
    o = kafka_source_options(brokers, topic, **opts)
    o.setdefault("endingOffsets", "latest")
    return spark.read.format("kafka").options(**o).load()


def write_kafka(df: DataFrame, brokers: str, topic: str, value: Column | str = "value",
                key: Column | str | None = None) -> None:
    """Publish rows (a ``value`` text column, optional key) to a topic in one parallel write."""
    cols = [F.col(value).cast("string").alias("value") if isinstance(value, str) else value.alias("value")]
    if key is not None:
        cols.append((F.col(key) if isinstance(key, str) else key).cast("string").alias("key"))
    (df.select(*cols).write.format("kafka").option("kafka.bootstrap.servers", brokers)
     .option("topic", topic).save())


def envelope_view(df: DataFrame) -> DataFrame:
    """Message text with topic/partition/offset, the value decoded one level (a consumer's printout)."""
    from tarmac.functions.json import json_unescape

    return df.select("topic", "partition", "offset", F.col("key").cast("string").alias("key"),
                     json_unescape(F.col("value").cast("string")).alias("value"))
