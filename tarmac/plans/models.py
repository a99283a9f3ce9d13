"""Models, tuning and persistence (Spark ML).

Defaults are the reference analysis' settings; the grids are parameters so a
caller can run a smaller search.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Binarizer, SQLTransformer, VectorAssembler
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplitModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: the reference's model settings and search grids ---------------
KMEANS_K, KMEANS_SEED = 5, 1
RELEVANCE_TREES, RELEVANCE_SEED, RELEVANCE_MAX_BINS = 40, 42, 400
RF_MAX_BINS = 512
RF_GRID = {"numTrees": [20, 50], "maxDepth": [10, 15]}
LR_GRID = {"regParam": [0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]}
SVC_MAX_ITER, SVC_REG = 10, 0.1
TRAIN_RATIO = 0.8
#: expected minutes late from which a flight is called delayed, searched
LINE_GRID = {"threshold": [0.3, 2.6, 5.2, 7.9, 10.4]}


def kmeans(k: int = KMEANS_K, seed: int = KMEANS_SEED, features: str = "features",
           prediction: str = "cluster") -> KMeans:
    return KMeans(k=k, seed=seed, featuresCol=features, predictionCol=prediction)


def rf_regressor(label: str, num_trees: int = RELEVANCE_TREES, seed: int = RELEVANCE_SEED,
                 max_bins: int = RELEVANCE_MAX_BINS, features: str = "features") -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=num_trees, seed=seed,
                                 maxBins=max_bins)


def rf_classifier(label: str, max_bins: int = RF_MAX_BINS, seed: int | None = 42,
                  features: str = "features", **params) -> RandomForestClassifier:
    # the node of each row is remembered and written every few levels, so a deep tree is not walked again
    rf = RandomForestClassifier(labelCol=label, featuresCol=features, maxBins=max_bins, cacheNodeIds=True, **params)
    if seed is not None:
        rf.setSeed(seed)
    return rf


def logistic_regression(label: str, features: str = "features", **params) -> LogisticRegression:
    return LogisticRegression(labelCol=label, featuresCol=features, **params)


def linear_svc(label: str, max_iter: int = SVC_MAX_ITER, reg: float = SVC_REG,
               features: str = "features") -> LinearSVC:
    return LinearSVC(maxIter=max_iter, regParam=reg, labelCol=label, featuresCol=features)


def delay_line_stages(threshold: float = 5.0, label: str = "ArrDelay") -> tuple[list, list]:
    """A delay classifier in closed form: the arrival delay as a line through the minutes a flight left late
    (least squares by the normal equations), and the class as ``expected > threshold``.

    Returned as the stages that only rewrite rows and those that are fitted. It reads clocks that are
    known live, learns two coefficients from one pass, and comes out the same from every file layout.
    """
    late = SQLTransformer(statement="SELECT *, CAST(DepTime - CRSDepTime AS double) AS late FROM __THIS__")
    return ([late, VectorAssembler(inputCols=["late"], outputCol="late_vector", handleInvalid="keep")],
            [LinearRegression(featuresCol="late_vector", labelCol=label, predictionCol="expected", solver="normal"),
             Binarizer(inputCol="expected", outputCol="prediction", threshold=threshold)])


def param_grid(estimator, grid: dict[str, list]) -> list:
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(estimator.getParam(name), list(values))
    return b.build()


def accuracy_evaluator(label: str, metric: str = "accuracy") -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName=metric)


def grid_table(spark: SparkSession, tvs_model: TrainValidationSplitModel) -> DataFrame:
    """(params, metric, best) for every grid point of a fitted search."""
    maps = tvs_model.getEstimatorParamMaps()
    metrics = list(tvs_model.validationMetrics)
    larger = tvs_model.getEvaluator().isLargerBetter()
    best = max(range(len(metrics)), key=lambda i: metrics[i] if larger else -metrics[i])
    rows = [(", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda kv: kv[0].name)),
             float(metrics[i]), i == best) for i, m in enumerate(maps)]
    return spark.createDataFrame(rows, "params string, metric double, best boolean")


def importance_table(spark: SparkSession, names: list[str], importances) -> DataFrame:
    """(feature, importance, rank) sorted by importance (rank 1 = most important)."""
    vals = importances.toArray() if hasattr(importances, "toArray") else list(importances)
    rows = [(n, float(v)) for n, v in zip(names, vals)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("importance"), F.asc("feature"))  # one row per feature
    return df.withColumn("rank", F.row_number().over(w))


def top_importances(table: DataFrame, n: int = 10) -> DataFrame:
    return table.where(F.col("rank") <= n)


def save(obj, path: str) -> str:
    obj.write().overwrite().save(path)
    return path


def load_pipeline_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_tvs_model(path: str) -> TrainValidationSplitModel:
    return TrainValidationSplitModel.load(path)
