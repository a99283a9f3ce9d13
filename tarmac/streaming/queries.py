"""Structured Streaming jobs over flight messages: sinks, running aggregates, scoring, control.

Aggregates are streaming state (complete mode): each micro-batch updates the
counts incrementally instead of re-reading the whole history. Row sinks are
parquet folders with a checkpoint in the shared folder, so a restarted query
resumes without duplicates; the in-memory sink is kept for small aggregate
results and tests only (it lives in the driver).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarmac.schema import STREAM_HIDDEN_COLUMNS
from tarmac.streaming.publish import PACKED_SINK


def message_file_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                        packed: bool = False) -> DataFrame:
    """Streaming DataFrame of message lines (``value``) from text files arriving in ``path``, or from
    ``packed`` ones (parquet)."""
    r = spark.readStream.format("parquet").schema("value string") if packed else spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def _trigger(writer, available_now: bool, processing_time: str | None):
    if available_now:
        return writer.trigger(availableNow=True)
    if processing_time:
        return writer.trigger(processingTime=processing_time)
    return writer


def start_append(df: DataFrame, name: str, path: str | None, checkpoint: str,
                 available_now: bool = True, processing_time: str | None = None,
                 fmt: str = "parquet") -> StreamingQuery:
    """Append every new row to a sink. ``fmt='memory'`` keeps rows in the driver as the
    table ``name`` (tests / small streams); otherwise files at ``path``, parquet ones packed by zstd."""
    w = df.writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint)
    w = _trigger(w, available_now, processing_time)
    if fmt == "memory":
        return w.format("memory").start()
    return (w.options(**PACKED_SINK) if fmt == "parquet" else w).format(fmt).start(path)


def start_complete(df: DataFrame, name: str, checkpoint: str, available_now: bool = True,
                   processing_time: str | None = None) -> StreamingQuery:
    """Keep a (small) aggregate as the in-memory table ``name``, rewritten after each batch."""
    w = (df.writeStream.queryName(name).outputMode("complete").format("memory")
         .option("checkpointLocation", checkpoint))
    return _trigger(w, available_now, processing_time).start()


def running_count(stream: DataFrame) -> DataFrame:
    """Rows received so far (one row)."""
    return stream.groupBy().agg(F.count(F.lit(1)).alias("count"))


def delay_distribution(stream: DataFrame, label: str = "Tem_ArrDelay") -> DataFrame:
    """Rows so far per delay label."""
    return stream.groupBy(label).count()


def delays_by_weekday(stream: DataFrame, label: str = "Tem_ArrDelay") -> DataFrame:
    """Delayed rows so far per weekday."""
    return stream.filter(F.col(label) == 1).groupBy("DayOfWeek").count()


def score_stream(stream: DataFrame, model, hidden: list[str] = STREAM_HIDDEN_COLUMNS,
                 keep: list[str] = ("ArrDelay", "Tem_ArrDelay")) -> DataFrame:
    """Apply a fitted model to live rows, the answer columns hidden from it.

    The truth columns in ``keep`` are carried through the same plan, so every
    prediction stays next to its own row's truth.
    """
    truth = [F.col(c).alias(f"_truth_{c}") for c in keep if c in stream.columns]
    visible = stream.select("*", *truth).drop(*hidden)
    scored = model.transform(visible)
    for c in keep:
        if f"_truth_{c}" in scored.columns:
            scored = scored.withColumnRenamed(f"_truth_{c}", c)
    return scored


def batch_report(label: str = "Tem_ArrDelay", by: list[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """Per-micro-batch table of scored rows by weekday: rows, delayed, predicted delayed, correct. The
    running count, the label distribution and the weekday table of a round are sums of it."""
    def summarise(batch: DataFrame) -> DataFrame:
        y = F.col(label) == 1
        p = F.col("prediction") == 1.0
        return batch.groupBy(*by, "DayOfWeek").agg(
            F.count(F.lit(1)).alias("rows"),
            F.count(F.when(y, 1)).alias("delayed"),
            F.count(F.when(p, 1)).alias("predicted_delayed"),
            F.count(F.when(y == p, 1)).alias("correct"))
    return summarise


def start_report(scored: DataFrame, path: str, checkpoint: str, name: str = "report",
                 available_now: bool = True, processing_time: str | None = None,
                 by: list[str] = ()) -> StreamingQuery:
    """``foreachBatch`` report: the table of each micro-batch appended to parquet at ``path``.

    The batch id is part of each row; a retried batch rewrites its own rows
    (dynamic partition overwrite by ``batch_id``), so reports stay exactly-once.
    """
    summarise = batch_report(by=by)

    def write(batch: DataFrame, batch_id: int) -> None:
        (summarise(batch).withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(path))

    w = scored.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write)
    return _trigger(w, available_now, processing_time).start()


def report_rounds(report: DataFrame, by: str = "batch_id") -> DataFrame:
    """A dashboard's numbers after each round: rows so far, delayed so far and correct so far."""
    per = report.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("rows", "delayed", "predicted_delayed", "correct")])
    so_far = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)  # one row for each round
    return per.select(by, *[F.sum(c).over(so_far).alias(c) for c in ("rows", "delayed", "predicted_delayed", "correct")])


def query_status(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Status of one streaming query (the one given, not just the first active one)."""
    st = query.status
    row = (query.name, str(query.id), str(query.runId), bool(query.isActive), st.get("message"),
           bool(st.get("isDataAvailable")), bool(st.get("isTriggerActive")))
    schema = ("name string, id string, run_id string, active boolean, message string, "
              "data_available boolean, trigger_active boolean")
    return spark.createDataFrame([row], schema)


def stop(query: StreamingQuery) -> None:
    query.stop()


def await_termination(query: StreamingQuery, timeout: float | None = None) -> bool | None:
    return query.awaitTermination(timeout) if timeout is not None else query.awaitTermination()
