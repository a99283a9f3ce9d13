"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.session import shared_path

#: rows up to which a (key, value) side of two longs may be broadcast: about 64 MB once hashed
BROADCAST_ROWS = 1_000_000
#: edges of a graph that one file, and so one task of a round, holds
EDGES_A_FILE = 250_000
#: shuffle files go as soon as the rows they led to are written, and not when the driver collects garbage
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: cuts the lineage,
    and a lost executor rereads files instead of computing again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when a *stored* side has at most ``rows`` rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(col):
    """Lower-case A-Z only; on pure ASCII, which is told by its length in bytes, ``lower`` does that."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node is either one edge's larger end or only a smaller end."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return (ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
            .where("up > 1 OR up > 0 AND down > 0").isEmpty())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distributed union-find: ``(node, component)`` for every node of an edge, component = its
    smallest reachable node.

    Alternating large-star and small-star rounds: a node links its larger neighbours to its
    smallest one, then its smaller neighbours to the smallest of these. Each half is a grouped
    minimum (combined before the shuffle) joined back to the edges; a hub with many edges is a
    skewed join that the adaptive planner splits. Both halves are written to the shared folder;
    the loop ends when only stars are left.
    """
    def kept(df: DataFrame, rows: int) -> DataFrame:
        return stored(df.coalesce(max(8, rows // EDGES_A_FILE)), "edges")

    first = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = stored(first.distinct(), "edges")
    while not _is_forest_of_stars(e):
        rows = e.count()
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = kept(both.join(low, "u").where(F.col("v") > F.col("u"))
                     .select(F.col("v").alias("u"), F.col("m").alias("v")), rows)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = kept(small, rows)
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))))


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names do no harm."""
    return df.select(*[F.col(f"`{n}`") for n in names])
