"""Spark session helpers: a tuned local session for tests/bench and the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "tarmac", shuffle_partitions: int = 8,
                  extra: dict | None = None, driver_memory: str | None = None) -> SparkSession:
    """Session used by tests and the bench. On a cluster, pass your own builder instead."""
    builder = (
        SparkSession.builder.master(master or "local[8]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory or os.environ.get("TARMAC_DRIVER_MEMORY", "8g"))
        # wide flight rows make generated methods exceed HotSpot's 8 KB JIT limit
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.executor.extraJavaOptions", "-XX:-DontCompileHugeMethods")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: bytecode of a method beyond which HotSpot leaves it to the interpreter, unless told otherwise at its start
JIT_LIMIT = 8000
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def compiled_plans(spark: SparkSession) -> SparkSession:
    """``spark``, told to give up generated methods that the JVM would only interpret.

    A stage over wide flight rows is one method of more than ``JIT_LIMIT`` bytes; past the limit Spark runs
    the stage operator by operator, in methods that are compiled. A smaller limit that is set stays.
    """
    if int(spark.conf.get(METHOD_LIMIT, "65535")) > JIT_LIMIT:
        spark.conf.set(METHOD_LIMIT, str(JIT_LIMIT))
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (one that every executor sees).

    Only a session whose executors are threads of the driver (``local[...]``) may leave it
    unset, as in tests: it gets a folder of its own.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
            base = tempfile.mkdtemp(prefix="tarmac-ckpt-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """``df`` written once as parquet in the shared folder and read back, for jobs of several passes, in
    files of at most ``rows_per_file`` rows (0: one per partition)."""
    path = shared_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: rows of a stored file that a fit reads as one task; a fit keeps its rows as objects, far larger than in the file
FIT_ROWS = 200_000
_PACKING = {"spark.sql.files.openCostInBytes": "128MB", "spark.sql.files.maxPartitionBytes": "128MB"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Actions inside run with ``values`` set; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def file_a_task(spark: SparkSession):
    """Actions inside read every stored file as a task of its own: files cost as much to open as a task may read."""
    return settings(spark, _PACKING)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast when a *stored* side has at most ``rows`` rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
