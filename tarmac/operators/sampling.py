"""Row caps, Bernoulli samples and random splits, all repeatable.

Spark's sampling is per partition and seeded by partition index, so a sample
only repeats when the input partitioning repeats. Where repeatability matters
the operators here derive the random draw from the row's own values, its
occurrence number among rows with equal values, and the seed: independent of
file layout and of task retries, and drawn apart for equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators.profile import total_order
from tarmac.session import stored

#: rows that a top-k keeps in each task and merges in one
TOP_ROWS = 10_000
#: repeated keys (one long each) up to which they may be broadcast
BROADCAST_KEYS = 1_000_000


def _draw(keys: list[str], nth: Column, seed: int) -> Column:
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys],
                       nth.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(2 ** 32)


def with_draw(df: DataFrame, seed: int, keys: list[str] | None = None, name: str = "_draw") -> DataFrame:
    """``df`` with a uniform draw in [0, 1): the first 32 bits of the MD5 of ``keys`` (default: all
    columns), the row's occurrence number among rows that agree on them, and ``seed``.

    Key hashes are counted first (one long a row, added up before the shuffle) and those that occur
    twice are written. All other rows are their key's first and are drawn in the scan; only rows with a
    repeated hash are sorted for their number.
    """
    keys = keys or df.columns
    hashed = F.xxhash64(*[F.col(k) for k in keys])
    twice = stored(df.select(hashed.alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
                   .where("_n > 1").select("_key"), "repeated-keys")
    n = twice.limit(BROADCAST_KEYS + 1).count()
    first = _draw(keys, F.lit(1), seed).alias(name)
    if n == 0:
        return df.select("*", first)
    side = F.broadcast(twice) if n <= BROADCAST_KEYS else twice
    same = Window.partitionBy(*keys).orderBy(*total_order(df, keys))
    alone = df.join(side, hashed == F.col("_key"), "left_anti").select("*", first)
    several = df.join(side, hashed == F.col("_key"), "left_semi").select("*", F.row_number().over(same).alias("_nth"))
    return alone.unionByName(several.withColumn(name, _draw(keys, F.col("_nth"), seed)).drop("_nth"))


def limit_rows(df: DataFrame, n: int, order: list[str] = ()) -> DataFrame:
    """The first ``n`` rows in a total order (``order`` first, then every column), for any ``n``.

    Up to ``TOP_ROWS`` rows are a top-k (``TakeOrderedAndProject``). More are cut out of the table: rows
    are dealt to ranges of the order and written once, ranges are counted (one number a range comes to
    the driver), those below the cut stay whole, and only the range that holds the cut is ranked. So
    no task gets more than a range; rows equal in every column share one.
    """
    keys = total_order(df, order)
    if n <= TOP_ROWS:
        return df.orderBy(*keys).limit(n)
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("c")).orderBy("_range").collect()
    below, left = -1, n
    for r in counts:
        if r["c"] > left:
            break
        below, left = r["_range"], left - r["c"]
    else:
        return dealt.drop("_range")
    cut = next(r["_range"] for r in counts if r["_range"] > below)
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    inside = dealt.where(F.col("_range") == cut).withColumn("_rank", rank).where(F.col("_rank") <= left).drop("_rank")
    return dealt.where(F.col("_range") <= below).unionByName(inside).drop("_range")


def sample_rows(df: DataFrame, fraction: float = 0.05, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """Bernoulli sample that comes back the same whatever the partitioning (see :func:`with_draw`)."""
    return with_draw(df, seed, keys).filter(F.col("_draw") < fraction).drop("_draw")


def with_split(df: DataFrame, weights: list[float] = (0.7, 0.3), seed: int = 42, keys: list[str] | None = None,
               name: str = "split") -> DataFrame:
    """``df`` with the number of the part each row falls into: the draw of :func:`with_draw` cut at the
    cumulative weights. One pass over the rows."""
    total, acc, bounds = float(sum(weights)), 0.0, []
    for w in weights[:-1]:
        acc += w
        bounds.append(acc / total)
    part = sum([(F.col("_draw") >= b).cast("int") for b in bounds], F.lit(0))
    return with_draw(df, seed, keys).withColumn(name, part).drop("_draw")


def random_split(df: DataFrame, weights: list[float] = (0.7, 0.3), seed: int = 42,
                 keys: list[str] | None = None) -> list[DataFrame]:
    """Disjoint, complete random split: the parts of :func:`with_split` as tables of their own."""
    parts = with_split(df, weights, seed, keys, "_split")
    return [parts.where(F.col("_split") == i).drop("_split") for i in range(len(weights))]
