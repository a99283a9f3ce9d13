"""Streaming queries.

Each one publishes the clean flights as message files (in ``ROUNDS`` folders) in the
shared folder, runs a Structured Streaming query over them to completion
(``availableNow``), and returns what the sink holds -- so a stream is checked
against the batch answer for the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.operators.profile import last_rows
from tarmac.registry import register
from tarmac.registry.batch import _PAYLOAD_DUCK, _STRUCT_DUCK
from tarmac.registry.ml import line_search, line_sql
from tarmac.registry.sql import with_views
from tarmac.schema import CLEAN_COLUMNS, CLEAN_SCHEMA, DELAY_THRESHOLD_STREAM
from tarmac.session import shared_path
from tarmac.sources import catalog as CA
from tarmac.sources.fixtures import flights_clean, read_table
from tarmac.sources.kafka import envelope_view
from tarmac.streaming import queries as SQ
from tarmac.streaming import rounds as RO
from tarmac.streaming.decode import decode_flights, decode_paths
from tarmac.streaming.publish import PACKED_SINK, envelope, write_message_files

T5 = DELAY_THRESHOLD_STREAM
_LABEL_SQL = f"CASE WHEN ArrDelay > {T5} THEN 1 ELSE 0 END"
_DECODED_SQL = with_views(
    f"SELECT {', '.join(CLEAN_COLUMNS)}, {_LABEL_SQL} AS Tem_ArrDelay FROM flights_clean", "flights_clean")


def _name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:10]}"


ROUNDS = 4  # message folders, and about as many micro-batches


def _feed(spark, sf) -> str:
    """Message files of the clean flights (every column, id included), in ``ROUNDS`` folders by id."""
    path = shared_path(spark, "feed")
    write_message_files(flights_clean(spark, sf), path, batches=ROUNDS, order="flight_id", packed=True)
    return path


def _stream(spark, path):
    """The feed as a stream of several micro-batches; ``batch`` is the folder a message lies in."""
    files = len(spark.read.parquet(path).inputFiles())
    return SQ.message_file_stream(spark, path, max(1, files // ROUNDS), packed=True)


def _run_append(spark, df, prefix):
    name = _name(prefix)
    out, ckpt = shared_path(spark, f"{prefix}-out"), shared_path(spark, f"{prefix}-ckpt")
    q = SQ.start_append(df, name, out, ckpt)
    q.awaitTermination()
    return spark.read.parquet(out)


def _run_complete(spark, df, prefix):
    name = _name(prefix)
    q = SQ.start_complete(df, name, shared_path(spark, f"{prefix}-ckpt"))
    q.awaitTermination()
    return spark.table(name)


@register("stream_source", with_views(f"SELECT {_PAYLOAD_DUCK} AS value FROM flights_clean", "flights_clean"))
def q_stream_source(spark, sf):
    return _run_append(spark, _stream(spark, _feed(spark, sf)).select("value"), "source")


@register("decode_stream", _DECODED_SQL)
def q_decode_stream(spark, sf):
    return _run_append(spark, decode_flights(_stream(spark, _feed(spark, sf))), "decode")


@register("json_fields", with_views(
    "SELECT " + ", ".join(f"cast({c} AS varchar) AS {c}" for c in CLEAN_COLUMNS) + " FROM flights_clean",
    "flights_clean"))
def q_json_fields(spark, sf):
    # the 26 single-path extractions over the published messages (batch read of the feed)
    msgs = spark.read.parquet(_feed(spark, sf)).select("value")
    return decode_paths(msgs)


@register("stream_append_table", _DECODED_SQL)
def q_stream_append_table(spark, sf):
    name = _name("flights_live")
    out = shared_path(spark, "live")
    q = SQ.start_append(decode_flights(_stream(spark, _feed(spark, sf))), name, out,
                        shared_path(spark, "live-ckpt"))
    q.awaitTermination()
    CA.register_path(spark, name, out)
    return CA.read_sink(spark, name)


@register("stream_count", with_views("SELECT count(*) AS count FROM flights_clean", "flights_clean"))
def q_stream_count(spark, sf):
    return _run_complete(spark, SQ.running_count(decode_flights(_stream(spark, _feed(spark, sf)))), "count")


@register("stream_delay_distribution", with_views(
    f"SELECT {_LABEL_SQL} AS Tem_ArrDelay, count(*) AS count FROM flights_clean GROUP BY 1", "flights_clean"))
def q_stream_delay_distribution(spark, sf):
    stream = decode_flights(_stream(spark, _feed(spark, sf)))
    return _run_complete(spark, SQ.delay_distribution(stream), "dist")


@register("stream_delays_by_weekday", with_views(
    f"SELECT DayOfWeek, count(*) AS count FROM flights_clean WHERE ArrDelay > {T5} GROUP BY DayOfWeek",
    "flights_clean"))
def q_stream_delays_by_weekday(spark, sf):
    stream = decode_flights(_stream(spark, _feed(spark, sf)))
    return _run_complete(spark, SQ.delays_by_weekday(stream), "byday")


@register("stream_score", line_sql(
    f"SELECT {', '.join(CLEAN_COLUMNS[:4])}, ArrDelay, Tem_ArrDelay, prediction FROM scored"))
def q_stream_score(spark, sf):
    # live rows scored by a search model that was saved and loaded
    scored = SQ.score_stream(decode_flights(_stream(spark, _feed(spark, sf))), line_search(spark, sf))
    return _run_append(spark, scored.select(*CLEAN_COLUMNS[:4], "ArrDelay", "Tem_ArrDelay", "prediction"), "score")


@register("prediction_vs_truth", line_sql(
    "SELECT flight_id AS offset, prediction, ArrDelay, Tem_ArrDelay FROM scored "
    "ORDER BY flight_id DESC, ArrDelay DESC, Tem_ArrDelay DESC, prediction DESC LIMIT 10"))
def q_prediction_vs_truth(spark, sf):
    # the last rows by arrival: records carry their offset from the topic's envelope to the sink
    path = shared_path(spark, "topic")
    records = envelope(flights_clean(spark, sf))
    records.write.options(**PACKED_SINK).parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    stream = (spark.readStream.schema(records.schema).option("maxFilesPerTrigger", str(max(1, files // ROUNDS))).parquet(path))
    scored = SQ.score_stream(decode_flights(stream, keep=["partition", "offset"]), line_search(spark, sf))
    sink = _run_append(spark, scored.select("offset", "prediction", "ArrDelay", "Tem_ArrDelay"), "pvt")
    return last_rows(sink, 10, ["offset", "ArrDelay", "Tem_ArrDelay", "prediction"])


@register("stream_report", line_sql(
    f"SELECT cast(flight_id % {ROUNDS} AS int) AS batch, DayOfWeek, count(*) AS rows, count(*) FILTER (WHERE Tem_ArrDelay = 1) AS delayed, "
    "count(*) FILTER (WHERE prediction = 1.0) AS predicted_delayed, "
    "count(*) FILTER (WHERE (Tem_ArrDelay = 1) = (prediction = 1.0)) AS correct FROM scored GROUP BY 1, 2"))
def q_stream_report(spark, sf):
    # one table per micro-batch and message folder; a folder's files may come in several micro-batches
    stream = decode_flights(_stream(spark, _feed(spark, sf)), keep=["batch"])
    out = shared_path(spark, "report")
    q = SQ.start_report(SQ.score_stream(stream, line_search(spark, sf)), out, shared_path(spark, "report-ckpt"),
                        _name("report"), by=["batch"])
    q.awaitTermination()
    sums = [F.sum(c).alias(c) for c in ("rows", "delayed", "predicted_delayed", "correct")]
    return spark.read.parquet(out).groupBy("batch", "DayOfWeek").agg(*sums)


_MARKS = ("SELECT flight_id % {0} AS round, 'count' AS kind, 'all' AS key, Tem_ArrDelay AS y, prediction AS p FROM scored UNION ALL "
          "SELECT flight_id % {0}, 'label', cast(Tem_ArrDelay AS varchar), Tem_ArrDelay, prediction FROM scored UNION ALL "
          "SELECT flight_id % {0}, 'weekday', cast(DayOfWeek AS varchar), Tem_ArrDelay, prediction FROM scored").format(ROUNDS)
_KEYS = ", ".join(f"('{k}', '{v}')" for k, v in RO.KEYS)


@register("stream_rounds", line_sql(f"""
SELECT r.round, k.kind, k.key, count(m.round) AS rows, count(*) FILTER (WHERE y = 1) AS delayed,
       count(*) FILTER (WHERE p = 1.0) AS predicted_delayed, count(*) FILTER (WHERE (y = 1) = (p = 1.0)) AS correct
FROM range({ROUNDS}) r(round) CROSS JOIN (VALUES {_KEYS}) k(kind, key)
LEFT JOIN ({_MARKS}) m ON m.round <= r.round AND m.kind = k.kind AND m.key = k.key GROUP BY ALL"""))
def q_stream_rounds(spark, sf):
    # each round is published, then read by the query, which is started again from its checkpoint
    clean, model = flights_clean(spark, sf), line_search(spark, sf)
    feed, out, checkpoint = (shared_path(spark, x) for x in ("rounds-feed", "rounds", "rounds-ckpt"))
    for i in range(ROUNDS):
        write_message_files(clean.where(F.col("flight_id") % ROUNDS == i), f"{feed}/{i}")
        scored = SQ.score_stream(decode_flights(SQ.message_file_stream(spark, f"{feed}/*/*")), model)
        RO.start_rounds(scored, out, checkpoint, _name("rounds")).awaitTermination()
    return spark.read.parquet(out)


@register("stream_delay_job", line_sql("""
SELECT 'count' AS tbl, 'all' AS key, count(*) AS n FROM scored UNION ALL
SELECT 'distribution', cast(Tem_ArrDelay AS varchar), count(*) FROM scored GROUP BY ALL UNION ALL
SELECT 'weekdays', cast(DayOfWeek AS varchar), count(*) FROM scored WHERE Tem_ArrDelay = 1 GROUP BY ALL UNION ALL
SELECT 'scores', cast(flight_id AS varchar), cast(prediction AS bigint) FROM scored UNION ALL
SELECT 'rows', cast(flight_id AS varchar), cast(Distance AS bigint) FROM scored"""))
def q_stream_delay_job(spark, sf):
    feed, out = shared_path(spark, "job-feed"), shared_path(spark, "job")
    clean = flights_clean(spark, sf)
    write_message_files(clean, feed, batches=ROUNDS, order="flight_id", packed=True)
    # the payload has the 26 columns of the record; its id comes with it in this feed
    schema = T.StructType([T.StructField("flight_id", T.LongType()), *CLEAN_SCHEMA.fields])
    scored = SQ.score_stream(decode_flights(_stream(spark, feed), schema=schema), line_search(spark, sf))
    shown = ["flight_id", "DayOfWeek", "Distance", "ArrDelay", "Tem_ArrDelay", "prediction"]
    RO.start_delay_job(scored.select(*shown), out, shared_path(spark, "job-ckpt"), _name("job")).awaitTermination()
    table = lambda t, key, n: RO.job_table(spark, out, t).select(
        F.lit(t).alias("tbl"), key.cast("string").alias("key"), F.col(n).cast("bigint").alias("n"))
    return (table("count", F.lit("all"), "n").unionByName(table("distribution", F.col("Tem_ArrDelay"), "n"))
            .unionByName(table("weekdays", F.col("DayOfWeek"), "n")).unionByName(table("scores", F.col("flight_id"), "prediction"))
            .unionByName(table("rows", F.col("flight_id"), "Distance")))


# ---------------------------------------------------------------- envelope / catalog
_ENVELOPE_TS = "strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(flight_id), '%Y-%m-%d %H:%M:%S')"


@register("sql_read_sink", with_views(
    f"SELECT {_PAYLOAD_DUCK} AS value, 'flights' AS topic, {_ENVELOPE_TS} AS timestamp FROM flights_clean",
    "flights_clean"))
def q_sql_read_sink(spark, sf):
    name = _name("flight")
    path = shared_path(spark, "envelope")
    envelope(flights_clean(spark, sf)).write.options(**PACKED_SINK).parquet(path)
    CA.register_path(spark, name, path)
    return CA.read_sink(spark, name, raw_envelope=True).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@register("read_envelope", with_views(
    "SELECT 'flights' AS topic, cast(flight_id % 3 AS int) AS partition, flight_id AS offset, "
    f"cast(NULL AS varchar) AS key, {_STRUCT_DUCK} AS value FROM flights_clean",
    "flights_clean"))
def q_read_envelope(spark, sf):
    return envelope_view(envelope(flights_clean(spark, sf)))


# ---------------------------------------------------------------- events table
_EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


@register("events_json_fields", "SELECT event_id, event_type, "
          "CAST(json_extract_string(props, '$.k') AS bigint) AS k FROM events")
def q_events_json_fields(spark, sf):
    ev = read_table(spark, sf, "events")
    return ev.select("event_id", "event_type",
                     F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@register("events_stream_counts", "SELECT event_type, count(*) AS count, "
          "round(sum(value), 6) AS value FROM events GROUP BY event_type")
def q_events_stream_counts(spark, sf):
    # the driver's events table read as a stream of parquet files, counted per type
    stream = (spark.readStream.schema(_EVENT_SCHEMA).option("pathGlobFilter", "events.parquet")
              .parquet(sf))
    agg = stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("count"),
                                           F.round(F.sum("value"), 6).alias("value"))
    return _run_complete(spark, agg, "events")
