"""End-to-end ML jobs on flight tables: delay classifiers, linear SVM, clustering, feature relevance.

Every job returns DataFrames (predictions, reports); metrics come from
:mod:`tarmac.operators.metrics`, so nothing is collected row by row. Inputs that
several passes read are written once to the shared folder: a lost executor rereads
files, and no cache outlives the job.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions.labels import threshold_label
from tarmac.operators import metrics as M
from tarmac.operators.clean import dropna_any
from tarmac.operators.profile import columns_of_kind, group_avg, group_profile, present_columns
from tarmac.operators.sampling import random_split, sample_rows
from tarmac.plans import encode as EN
from tarmac.plans import features as FE
from tarmac.plans import models as MO
from tarmac.plans.search import grid_search
from tarmac.session import FIT_ROWS, file_a_task, shared_path, stored
from tarmac.schema import (CATEGORICAL_FEATURES, CLASSIFIER_NUMERIC_FEATURES, CLUSTER_INDEXED_FEATURES,
                           CLUSTER_NUMERIC_FEATURES, DELAY_THRESHOLD_CHARTS, DELAY_THRESHOLD_STREAM,
                           RELEVANCE_NUMERIC_FEATURES, SVM_DROPPED_COLUMNS)

LABEL = "Tem_ArrDelay"


def classifier_features() -> list[str]:
    return CLASSIFIER_NUMERIC_FEATURES + [c + "_Index" for c in CATEGORICAL_FEATURES]


def classifier_pipeline(estimator, indexer=None) -> Pipeline:
    """Index the six categorical columns ('keep' invalid; or an indexer fitted before), assemble with
    the numeric ones, then fit."""
    return Pipeline(stages=[indexer or FE.index_stage(CATEGORICAL_FEATURES, "keep"),
                            FE.assemble_stage(classifier_features()), estimator])


@dataclass
class TrainResult:
    model: object
    predictions: DataFrame
    report: DataFrame
    grid: DataFrame | None = None
    importances: DataFrame | None = None
    extra: dict = field(default_factory=dict)


def report_table(pred: DataFrame, label: str = LABEL, score: str | None = "score") -> DataFrame:
    """(metric, value): accuracy, weighted P/R/F1, per-class P/R/F1, AUC -- DataFrame aggregations."""
    spark = pred.sparkSession
    data = pred.select(F.col(label).cast("double").alias("label"), "prediction",
                       *([F.col(score).alias("score")] if score else []))
    data = stored(data, "scores")
    w = M.weighted_metrics(data).first()
    rows = [("accuracy", w["accuracy"]), ("weighted_precision", w["weighted_precision"]),
            ("weighted_recall", w["weighted_recall"]), ("weighted_f1", w["weighted_f1"])]
    for r in M.per_class_metrics(data).where("label IS NOT NULL").collect():  # one row per class
        k = int(r["label"])
        rows += [(f"precision_{k}", r["precision"]), (f"recall_{k}", r["recall"]), (f"f1_{k}", r["f1"])]
    if score:
        rows.append(("auc", M.auc_rank(data).first()["auc"]))
    return spark.createDataFrame([(m, float(v) if v is not None else None) for m, v in rows],
                                 "metric string, value double")


def positive_score(col: str = "probability") -> F.Column:
    """Score of class 1 from a probability / rawPrediction vector."""
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(col))[1]


def train_delay_classifier(clean: DataFrame, kind: str = "rf", threshold: float = DELAY_THRESHOLD_STREAM,
                           grid: dict | None = None, train_ratio: float = MO.TRAIN_RATIO,
                           parallelism: int = 2, seed: int = 42, keys: list[str] | None = None) -> TrainResult:
    """Label, index, assemble, grid-search (train/validation split), refit the best, score, report.

    ``kind``: "rf" (forest), "lr" (logistic regression) or "line" (``models.delay_line_stages``). ``keys``
    are the columns that the split is drawn from (default: all).

    As in the reference analysis the scored set is the whole input (training rows
    included); pass held-out rows to :func:`report_table` for an unbiased figure.
    """
    spark = clean.sparkSession
    data = stored(clean.withColumn(LABEL, threshold_label("ArrDelay", threshold)), "labelled")
    columns = ["features"]
    if kind == "line":
        prepare, (line, cut) = MO.delay_line_stages(threshold)
        est, columns = Pipeline(stages=[line, cut]), ["ArrDelay", "late_vector"]
        maps = MO.param_grid(cut, MO.LINE_GRID if grid is None else grid)
    elif kind in ("rf", "lr"):
        prepare = [FE.fitted_index(data, CATEGORICAL_FEATURES, MO.RF_MAX_BINS if kind == "rf" else None),
                   FE.assemble_stage(classifier_features())]
        est = MO.rf_classifier(LABEL, seed=seed) if kind == "rf" else MO.logistic_regression(LABEL)
        maps = MO.param_grid(est, grid if grid is not None else MO.RF_GRID if kind == "rf" else MO.LR_GRID)
    else:
        raise ValueError(f"unknown classifier {kind}")
    found = grid_search(data, prepare, est, maps, LABEL, columns, train_ratio, seed, keys, parallelism)
    model = found.model
    pred = model.transform(data).withColumn("score", F.col("expected") if kind == "line" else positive_score())
    best = model.bestModel.stages[-1]
    importances = (MO.importance_table(spark, classifier_features(), best.featureImportances)
                   if hasattr(best, "featureImportances") else None)
    report = report_table(pred)
    return TrainResult(model, pred, report, found.grid, importances)


def svm_delay_job(flights: DataFrame, threshold: float = DELAY_THRESHOLD_CHARTS, seed: int = 42,
                  max_iter: int = MO.SVC_MAX_ITER, reg: float = MO.SVC_REG, output: str | None = None,
                  keys: list[str] | None = None) -> TrainResult:
    """Linear SVM on every usable column: strings one-hot encoded, numbers as they are.

    Columns that give the label away and dates are left out. Strings of any number of values are
    indexed by a dictionary table of the training part (``extra["values"]``) and become sparse vectors; a value that it
    lacks has none of them. Rows with a NULL in a column used, or without a label, cannot be assembled: they go first,
    and the report counts them as ``rows_with_null``. 70/30 random split. Both parts, with their indexes, are
    written as parquet: below ``output`` if it is given, where the dictionary, the unfitted pipeline and the fitted
    model are saved as well.
    """
    data = stored(flights.withColumn("Delay", F.when(F.col("ArrDelay").isNotNull(), threshold_label("ArrDelay", threshold)))
                  .drop(*SVM_DROPPED_COLUMNS), "svm-input")
    cat = columns_of_kind(data, "categorical")
    num = [c for c in columns_of_kind(data, "numeric", "boolean") if c != "Delay"]
    usable = stored(dropna_any(data, [*cat, *num, "Delay"]), "svm-rows")
    skipped = data.count() - usable.count()
    spark = flights.sparkSession
    train, val = random_split(usable, [0.7, 0.3], seed, keys)
    values = EN.value_index(train, cat)
    output_parts = output or shared_path(spark, "svm-parts")
    for part, rows in (("train", train), ("validation", val)):
        EN.indexed(rows, values, cat).write.mode("overwrite").parquet(f"{output_parts}/{part}")
    train, val = (spark.read.parquet(f"{output_parts}/{part}") for part in ("train", "validation"))
    stages = [FE.one_hot_stage([c + " Index" for c in cat], handle_invalid="keep"),
              FE.assemble_stage([c + " OHE" for c in cat] + num), MO.linear_svc("Delay", max_iter, reg)]
    pipeline = Pipeline(stages=stages if cat else stages[1:])
    model = pipeline.fit(train)
    if output:
        values.write.mode("overwrite").parquet(f"{output}/values")
        MO.save(pipeline, f"{output}/pipeline")
        MO.save(model, f"{output}/model")
    pred = model.transform(val).withColumn("score", positive_score("rawPrediction"))
    report = report_table(pred, label="Delay").unionByName(
        spark.createDataFrame([("rows_with_null", float(skipped))], "metric string, value double"))
    return TrainResult(model, pred, report, extra={"pipeline": pipeline, "values": values, "rows_with_null": skipped})


def cluster_pipeline(df: DataFrame, k: int = MO.KMEANS_K, seed: int = MO.KMEANS_SEED) -> Pipeline:
    cats = present_columns(df, CATEGORICAL_FEATURES)
    feats = present_columns(df, CLUSTER_NUMERIC_FEATURES) + [
        c for c in CLUSTER_INDEXED_FEATURES if c[: -len("_Index")] in cats]
    return Pipeline(stages=[FE.index_stage(cats, "keep"),
                            FE.assemble_stage(feats, "features_unscaled"),
                            FE.scale_stage("features_unscaled", "features"),
                            MO.kmeans(k, seed)])


def cluster_job(clean: DataFrame, k: int = MO.KMEANS_K, seed: int = MO.KMEANS_SEED,
                profile_fraction: float | None = None) -> TrainResult:
    """Standardised KMeans over numeric + indexed features; mean delays and feature profile per cluster.

    The profile uses every row by default (it is one distributed aggregation);
    ``profile_fraction`` reproduces a sampled profile.
    """
    clean = stored(clean, "cluster-input", FIT_ROWS)
    with file_a_task(clean.sparkSession):
        model = cluster_pipeline(clean, k, seed).fit(clean)
    clustered = model.transform(clean)
    avg = group_avg(clustered, "cluster", ["DepDelay", "ArrDelay"])
    feats = model.stages[1].getInputCols()
    src = sample_rows(clustered.select(*feats, "cluster"), profile_fraction) if profile_fraction else clustered
    profile = group_profile(src, "cluster", feats)
    return TrainResult(model, clustered, avg, extra={"profile": profile})


def relevance_job(clean: DataFrame, label: str = "DepDelay", num_trees: int = MO.RELEVANCE_TREES,
                  seed: int = MO.RELEVANCE_SEED, max_bins: int = MO.RELEVANCE_MAX_BINS) -> DataFrame:
    """Random-forest regression of a delay; returns the ranked feature importances."""
    feats = RELEVANCE_NUMERIC_FEATURES + [c + "_Index" for c in CATEGORICAL_FEATURES]
    clean = stored(clean, "relevance-input", FIT_ROWS)
    with file_a_task(clean.sparkSession):
        pipe = Pipeline(stages=[FE.fitted_index(clean, CATEGORICAL_FEATURES, max_bins), FE.assemble_stage(feats),
                                MO.rf_regressor(label, num_trees, seed, max_bins)])
        model: PipelineModel = pipe.fit(clean)
    return MO.importance_table(clean.sparkSession, feats, model.stages[-1].featureImportances)
