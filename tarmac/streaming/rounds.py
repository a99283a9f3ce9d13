"""A dashboard's tables after each round of a stream, and one job that keeps all of them.

A round is a micro-batch. Its tables (rows so far, rows by label, delayed rows by weekday) are running
totals: arbitrary state kept for each of a few keys and carried by the checkpoint, so they go on
where they stood after a restart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarmac.streaming.queries import _trigger

LABEL = "Tem_ArrDelay"
MEASURES = ["rows", "delayed", "predicted_delayed", "correct"]
#: the keys of a round's tables: all rows, each label, each weekday
KEYS = [("count", "all"), ("label", "0"), ("label", "1"), *[("weekday", str(d)) for d in range(1, 8)]]
_SUMS = "kind string, key string, " + ", ".join(f"{m} bigint" for m in MEASURES)
_STATE = ", ".join(f"{m} bigint" for m in MEASURES)


def _increments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a task's rows add to each key: a row for each key, zeros too, so that every key gets a round."""
    sums = {k: [0, 0, 0, 0] for k in KEYS}
    for pdf in batches:
        y, p = pdf["label"] == 1, pdf["prediction"] == 1.0
        marks = pd.DataFrame({"rows": 1, "delayed": y, "predicted_delayed": p, "correct": y == p}, index=pdf.index).astype("int64")
        found = {("count", "all"): marks.sum()}
        for kind, column in (("label", pdf["label"]), ("weekday", pdf["weekday"])):
            found |= {(kind, str(int(k))): v for k, v in marks.groupby(column).sum().iterrows()}
        for key, values in found.items():
            if key in sums:
                sums[key] = [a + int(b) for a, b in zip(sums[key], values)]
    yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["kind", "key", *MEASURES])


def _totals(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Add a round's increments, a row from each task, to the key's totals."""
    totals = list(state.get) if state.exists else [0, 0, 0, 0]
    for pdf in parts:
        totals = [t + int(s) for t, s in zip(totals, pdf[MEASURES].sum())]
    state.update(tuple(totals))
    yield pd.DataFrame([(*key, *totals)], columns=["kind", "key", *MEASURES])


def running_totals(scored: DataFrame, label: str = LABEL) -> DataFrame:
    """Streaming rows (``DayOfWeek``, ``label``, ``prediction``) -> kind, key and totals so far, once a
    round for each of ``KEYS``. Rows are added up in their own tasks first, so a key's state task gets
    one row from each, however many rows the round has."""
    rows = scored.select(F.col("DayOfWeek").cast("int").alias("weekday"), F.col(label).cast("int").alias("label"), "prediction")
    sums = rows.mapInPandas(_increments, _SUMS)
    return sums.groupBy("kind", "key").applyInPandasWithState(_totals, _SUMS, _STATE, "update", GroupStateTimeout.NoTimeout)


def _write_round(df: DataFrame, batch_id: int, path: str) -> None:
    """A table's rows of one round; a round that runs again replaces its own."""
    (df.withColumn("round", F.lit(batch_id).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("round").parquet(path))


def start_rounds(scored: DataFrame, path: str, checkpoint: str, name: str = "rounds", label: str = LABEL,
                 available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Write ``round, kind, key`` and the totals so far after each round below ``path``."""
    w = (running_totals(scored, label).writeStream.queryName(name).outputMode("update")
         .option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: _write_round(df, i, path)))
    return _trigger(w, available_now, processing_time).start()


#: the tables of the live job that are made from a round's stored rows
TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "count": lambda rows: rows.groupBy().agg(F.count(F.lit(1)).alias("n")),
    "distribution": lambda rows: rows.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n")),
    "weekdays": lambda rows: rows.where(F.col(LABEL) == 1).groupBy("DayOfWeek").agg(F.count(F.lit(1)).alias("n")),
    "scores": lambda rows: rows.select("flight_id", "ArrDelay", LABEL, "prediction"),
}


def start_delay_job(scored: DataFrame, path: str, checkpoint: str, name: str = "delay-job",
                    available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """The live job as one query: each micro-batch is decoded and scored once and stored below
    ``path/rows``; ``count``, ``distribution``, ``weekdays`` and ``scores`` are made from what is stored.

    Every table holds its micro-batch's share under its number, and a micro-batch that runs again replaces
    its shares, so all five are exactly-once. ``job_table`` adds them up.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        _write_round(batch, batch_id, f"{path}/rows")
        rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/rows/round={batch_id}")
        for table, make in TABLES.items():
            _write_round(make(rows), batch_id, f"{path}/{table}")

    w = scored.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write)
    return _trigger(w, available_now, processing_time).start()


def job_table(spark, path: str, table: str) -> DataFrame:
    """One of the job's tables over all rounds: sums of ``n``, or the rows themselves."""
    rows = spark.read.parquet(f"{path}/{table}").drop("round")
    if table in ("rows", "scores"):
        return rows
    return rows.groupBy(*[c for c in rows.columns if c != "n"]).agg(F.sum("n").alias("n"))
