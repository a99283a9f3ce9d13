"""Feature stages (Spark ML transformers/estimators) used by the models."""

from __future__ import annotations

from pyspark.ml.feature import (OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel,
                                VectorAssembler)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_stage(cols: list[str], handle_invalid: str = "keep", suffix: str = "_Index") -> StringIndexer:
    """One multi-column StringIndexer: most frequent value -> 0.0, ties by value.

    ``keep`` maps unseen values and NULL to one extra last index; ``skip`` drops
    such rows; ``error`` fails.
    """
    return StringIndexer(inputCols=list(cols), outputCols=[c + suffix for c in cols],
                         handleInvalid=handle_invalid, stringOrderType="frequencyDesc")


def one_hot_stage(index_cols: list[str], suffix: str = " OHE", drop_last: bool = True,
                  handle_invalid: str = "error") -> OneHotEncoder:
    out = [c[: -len(" Index")] + suffix if c.endswith(" Index") else c + suffix for c in index_cols]
    return OneHotEncoder(inputCols=list(index_cols), outputCols=out, dropLast=drop_last,
                         handleInvalid=handle_invalid)


def assemble_stage(cols: list[str], out: str = "features", handle_invalid: str = "error") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=handle_invalid)


def scale_stage(inp: str = "features_unscaled", out: str = "features", with_mean: bool = True,
                with_std: bool = True) -> StandardScaler:
    return StandardScaler(inputCol=inp, outputCol=out, withMean=with_mean, withStd=with_std)


def fitted_index(df: DataFrame, categorical: list[str], max_bins: int | None = None,
                 handle_invalid: str = "keep", suffix: str = "_Index") -> StringIndexerModel:
    """The fitted indexer (one pass). With ``max_bins`` it fails early when a column has more values
    than a tree can split on: they must cover every category plus the 'keep' bucket."""
    model = index_stage(categorical, handle_invalid, suffix).fit(df)
    if max_bins is not None:
        check_max_bins(model, categorical, max_bins)
    return model


def check_max_bins(indexer: StringIndexerModel, categorical: list[str], max_bins: int) -> dict[str, int]:
    counts = dict(zip(categorical, map(len, indexer.labelsArray)))
    too_many = {c: n for c, n in counts.items() if n + 1 > max_bins}
    if too_many:
        raise ValueError(f"maxBins={max_bins} is below the category count (+1) of {too_many}")
    return counts


def vector_column(c: str, digits: int | None = None) -> F.Column:
    """ML vector -> array<double> (optionally rounded) so results can be compared and stored."""
    from pyspark.ml.functions import vector_to_array

    arr = vector_to_array(F.col(c))
    return F.transform(arr, lambda x: F.round(x, digits)) if digits is not None else arr
