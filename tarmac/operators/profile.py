"""Profiling operators: counts, nulls, duplicates, group statistics, box plots, correlation.

Each operator is one Spark job that reads the input once. Aggregations are
hash aggregates with a map-side partial step, so a hot key (one weekday or one
airline holding a third of all rows) is collapsed to one row per map task
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.session import broadcast_if_small, stored

ROUND = 6
#: distinct values of a group that one task may sort
SORTED_VALUES = 100_000
#: values at which a band that holds more is cut
CUTS = 64
#: rows (one a group and share) up to which bands and their cuts are broadcast
CUT_ROWS = 20_000


def _r(c: Column, digits: int | None = ROUND) -> Column:
    return F.round(c, digits) if digits is not None else c


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def duplicate_count(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row: rows, distinct rows (over ``cols`` or all columns), and their difference."""
    cols = cols or df.columns
    # one shuffle: copies collapse map-side (partial aggregation), then both counts
    # come from the per-row-value groups
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.sum("_n").cast("long").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"))
            .withColumn("duplicates", F.col("rows") - F.col("distinct_rows")))


def drop_duplicates(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates(cols) if cols else df.dropDuplicates()


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) for every column, from a single pass over the data."""
    wide = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column", "nulls")


def group_count(df: DataFrame, keys: list[str] | str, order: bool = True) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else keys
    out = df.groupBy(*keys).count()
    return out.orderBy(*keys) if order else out


def top_groups(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """Largest groups first (ties by key), first ``n``."""
    return df.groupBy(key).count().orderBy(F.desc("count"), F.asc(key)).limit(n)


def group_avg(df: DataFrame, key: str, cols: list[str], digits: int | None = ROUND) -> DataFrame:
    """Per-group means, named ``avg(col)`` as a dict-style ``agg`` would name them."""
    return df.groupBy(key).agg(*[_r(F.avg(c), digits).alias(f"avg({c})") for c in cols])


def count_above_by(df: DataFrame, value: str, threshold: float, key: str,
                   name: str = "QtdAtrasos") -> DataFrame:
    """Rows with ``value > threshold`` counted per ``key`` (e.g. delayed flights per weekday)."""
    return (df.filter(F.col(value) > threshold).groupBy(key)
            .agg(F.count(F.lit(1)).alias(name)).orderBy(key))


def _band_rows(hist: DataFrame, bands: DataFrame, key: str, value: str) -> DataFrame:
    """Histogram rows inside the bands of their group, once a band."""
    rows = hist.withColumnsRenamed({key: "_g", value: "_v"}).join(bands, "_g")
    return rows.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _narrowed(hist: DataFrame, bands: DataFrame, key: str, value: str) -> DataFrame:
    """Bands cut at ``CUTS`` sketched values, as low as the two ranks allow: rows are counted exactly
    between the cuts, and the pieces that hold the ranks make the new band."""
    inside = _band_rows(hist, bands, key, value)
    shares = F.array(*[F.lit(i / (CUTS + 1)) for i in range(1, CUTS + 1)])
    cuts = stored(inside.groupBy("_g", "_p").agg(F.percentile_approx("_v", shares, F.lit(100 * CUTS)).alias("_cuts")), "cuts")
    piece = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    pieces = (inside.join(broadcast_if_small(cuts, CUT_ROWS), ["_g", "_p"])
              .groupBy("_g", "_p", "_below", "_low", "_high", piece.alias("_piece"))
              .agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    before = F.col("_below") + F.sum("_n").over(Window.partitionBy("_g", "_p").orderBy("_piece")) - F.col("_n")
    holds = (F.col("_low") < F.col("_start") + F.col("_n")) & (F.col("_high") >= F.col("_start"))
    return stored(pieces.withColumn("_start", before).where(holds).groupBy("_g", "_p", "_low", "_high")
                  .agg(F.min("_start").alias("_below"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")), "bands")


def quantiles_by(hist: DataFrame, key: str, value: str, shares: list[float], most: int = SORTED_VALUES) -> DataFrame:
    """Exact linear quantiles of a weighted histogram ``(key, value, _n)``, as ``(key, _share, _quantile)``.

    Selection by ranks: each group and share has a band of values that holds its two neighbouring ranks.
    As long as a band holds more than ``most`` distinct values, it is cut at sketched values, counted
    exactly and narrowed; then its values are ranked. So no task sorts more than ``most`` distinct
    values of a group and share, however many the group has.
    """
    ends = hist.groupBy(F.col(key).alias("_g")).agg(F.sum("_n").alias("_all"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = (F.col("_all") - 1) * F.element_at(F.array(*map(F.lit, shares)), F.col("_p") + 1)
    bands = stored(ends.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(len(shares) - 1))))
                   .select("_g", "_p", F.lit(0).cast("long").alias("_below"), F.floor(at).alias("_low"),
                           F.ceil(at).alias("_high"), "_lo", "_hi", at.alias("_at")), "bands")
    targets = bands.select("_g", "_p", "_at")
    bands = bands.drop("_at")
    while True:
        side = broadcast_if_small(bands, CUT_ROWS)
        wide = (_band_rows(hist, side, key, value).groupBy("_g", "_p").agg(F.count(F.lit(1)).alias("_values"))
                .agg(F.max("_values")).first()[0])
        if (wide or 0) <= most:
            break
        bands = _narrowed(hist, side, key, value)
    done = F.col("_below") + F.sum("_n").over(Window.partitionBy("_g", "_p").orderBy("_v"))
    ranked = (_band_rows(hist, side, key, value).withColumn("_end", done).groupBy("_g", "_p")
              .agg(F.min(F.when(F.col("_end") > F.col("_low"), F.col("_v"))).alias("_v0"),
                   F.min(F.when(F.col("_end") > F.col("_high"), F.col("_v"))).alias("_v1")))
    part = F.col("_at") - F.floor("_at")
    return ranked.join(targets, ["_g", "_p"]).select(
        F.col("_g").alias(key), F.element_at(F.array(*map(F.lit, shares)), F.col("_p") + 1).alias("_share"),
        (F.col("_v0") * (1 - part) + F.col("_v1") * part).alias("_quantile"))


def box_summary(df: DataFrame, key: str, value: str, whis: float = 1.5,
                digits: int | None = ROUND, most: int = SORTED_VALUES) -> DataFrame:
    """Box-plot numbers per group: exact linear quartiles, fences, whiskers, outliers.

    First a histogram ``(key, value) -> n`` (partial aggregation), written once; then exact quartiles
    weighted by ``n`` (:func:`quantiles_by`: rank selection, no task holds a group's distinct values) and
    one join of the histogram with the per-group quartiles for the whiskers. Rows whose key is NULL
    belong to no group.
    """
    hist = stored(df.filter(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(key, value)
                  .agg(F.count(F.lit(1)).alias("_n")), "histogram")
    shares = [0.25, 0.5, 0.75]
    found = quantiles_by(hist, key, value, shares, most).groupBy(key).agg(
        *[F.max(F.when(F.col("_share") == s, F.col("_quantile"))).alias(q) for s, q in zip(shares, ("q1", "median", "q3"))])
    quart = hist.groupBy(key).agg(F.sum("_n").alias("n"), F.min(value).alias("min"), F.max(value).alias("max")).join(found, key)
    quart = stored(quart.withColumns({
        "iqr": F.col("q3") - F.col("q1"),
        "lower_fence": F.col("q1") - whis * (F.col("q3") - F.col("q1")),
        "upper_fence": F.col("q3") + whis * (F.col("q3") - F.col("q1")),
    }), "quartiles")
    inside = (F.col(value) >= F.col("lower_fence")) & (F.col(value) <= F.col("upper_fence"))
    whiskers = (hist.join(broadcast_if_small(quart.select(key, "lower_fence", "upper_fence"), CUT_ROWS), key)
                .groupBy(key).agg(
                    F.min(F.when(inside, F.col(value))).alias("whisker_low"),
                    F.max(F.when(inside, F.col(value))).alias("whisker_high"),
                    F.sum(F.when(~inside, F.col("_n")).otherwise(0)).alias("outliers")))
    out = quart.join(whiskers, key)
    return out.select(
        key, "n", "min", "max",
        *[_r(F.col(c).cast("double"), digits).alias(c)
          for c in ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence"]],
        F.col("whisker_low").cast("double").alias("whisker_low"),
        F.col("whisker_high").cast("double").alias("whisker_high"),
        F.col("outliers").cast("long").alias("outliers"),
    ).orderBy(key)


def present_columns(df: DataFrame, names: list[str]) -> list[str]:
    """The requested names that exist in ``df``, in request order."""
    have = set(df.columns)
    return [c for c in names if c in have]


def corr_matrix(df: DataFrame, cols: list[str], digits: int | None = ROUND) -> DataFrame:
    """Pearson correlation of every pair of ``cols`` as long rows (row, col, r).

    A row becomes one vector: its standardised values (0 where NULL), their squares, and a mask of the
    values that are there. The Gram matrix of these vectors, which Spark ML adds up in the JVM by partition and
    as a tree, holds for each pair of columns the count, sums, squares and cross-products of the rows
    where both are there. The columns are written once for the passes; the driver gets matrices of (3k)^2 numbers, never rows.
    A NULL takes its row out of its own column's pairs only; a constant column or a pair with fewer than
    two rows gives NULL.
    """
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation, Summarizer

    cols = present_columns(df, cols)
    k = len(cols)
    num = stored(df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]), "correlated")
    facts = num.agg(F.count(F.lit(1)).alias("rows"), *[f(f"x{i}").alias(f"{f.__name__}{i}") for i in range(k)
                                                       for f in (F.avg, F.stddev_pop, F.min, F.max)]).first()
    r = np.full((k, k), np.nan)
    if k and facts["rows"] > 1:
        values, masks = [], []
        for i in range(k):
            low, flat = facts[f"min{i}"], facts[f"min{i}"] == facts[f"max{i}"]
            shift, scale = (low, 1.0) if flat or low is None else (facts[f"avg{i}"], facts[f"stddev_pop{i}"])
            values.append(F.coalesce((F.col(f"x{i}") - F.lit(shift)) / F.lit(scale), F.lit(0.0)))
            masks.append(F.col(f"x{i}").isNotNull().cast("double"))
        vectors = num.select(array_to_vector(F.array(*values, *[v * v for v in values], *masks)).alias("z"))
        spread = Correlation.corr(vectors, "z").first()[0].toArray()
        mean, std = (np.asarray(v) for v in vectors.select(Summarizer.metrics("mean", "std").summary(F.col("z")).alias("s"))
                     .select("s.mean", "s.std").first())
        rows = facts["rows"]
        gram = np.nan_to_num(spread) * np.outer(std, std) * (rows - 1) + rows * np.outer(mean, mean)
        x, square, there = slice(0, k), slice(k, 2 * k), slice(2 * k, 3 * k)
        n, s1, s2, cross = np.rint(gram[there, there]), gram[x, there], gram[square, there], gram[x, x]
        with np.errstate(divide="ignore", invalid="ignore"):
            own = s2 - s1 * s1 / n
            own[own <= 1e-11 * s2] = np.nan  # constant where both are there
            r = (cross - s1 * s1.T / n) / np.sqrt(own * own.T)
        r[n < 2] = np.nan
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            v = float(r[i, j])
            v = None if not np.isfinite(v) else (round(v, digits) if digits is not None else v)
            rows.append((a, b, v))
    return df.sparkSession.createDataFrame(rows, "row string, col string, r double")


def group_profile(df: DataFrame, key: str, cols: list[str], digits: int | None = ROUND) -> DataFrame:
    """Mean of each feature per group minus its overall mean, as (key, feature, diff).

    Sums and counts per group come from one aggregation; the overall means are
    recomputed from those per-group rows (one row per group), never from a second
    scan or a cross join with the data.
    """
    cols = [c for c in present_columns(df, cols) if c != key]
    per = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.col(c).cast("double")).alias(f"_s{i}") for i, c in enumerate(cols)],
        *[F.count(c).alias(f"_k{i}") for i, c in enumerate(cols)])
    # The window spans the per-group rows only (one row per cluster / distance
    # group), never the data rows.
    everyone = Window.partitionBy()
    diffs = {
        c: (F.col(f"_s{i}") / F.col(f"_k{i}"))
        - F.sum(f"_s{i}").over(everyone) / F.sum(f"_k{i}").over(everyone)
        for i, c in enumerate(cols)
    }
    wide = per.select(key, *[e.alias(c) for c, e in diffs.items()])
    return (wide.unpivot([key], cols, "feature", "diff")
            .withColumn("diff", _r(F.col("diff"), digits)))


def schema_table(df: DataFrame) -> DataFrame:
    """(position, name, type, nullable) of ``df``'s columns."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    schema = "position int, name string, type string, nullable boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def kind_of(dtype: T.DataType) -> str:
    """'numeric', 'temporal', 'boolean' or 'categorical', by type family."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.DatetimeType, T.TimestampNTZType)):
        return "temporal"
    return "boolean" if isinstance(dtype, T.BooleanType) else "categorical"


def column_kinds(df: DataFrame) -> DataFrame:
    """(name, kind) of every column."""
    return df.sparkSession.createDataFrame([(f.name, kind_of(f.dataType)) for f in df.schema.fields],
                                           "name string, kind string")


def columns_of_kind(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in kinds]


def total_order(df: DataFrame, first: list[str] = (), descending: bool = False) -> list[Column]:
    """Sort keys that make an order total: ``first`` then every other column."""
    rest = [c for c in df.columns if c not in first]
    keys = list(first) + rest
    if descending:
        return [F.col(c).desc_nulls_last() for c in keys]
    return [F.col(c).asc_nulls_first() for c in keys]


def preview(df: DataFrame, n: int = 20, order: list[str] = ()) -> DataFrame:
    """First ``n`` rows in a repeatable order (top-k: partial sort per task, one merge)."""
    return df.orderBy(*total_order(df, order)).limit(n)


def last_rows(df: DataFrame, n: int = 10, order: list[str] = ()) -> DataFrame:
    """Last ``n`` rows of the arrival order ``order`` (a tail without moving the table)."""
    return df.orderBy(*total_order(df, order, descending=True)).limit(n)
