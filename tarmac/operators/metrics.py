"""Classification metrics computed as DataFrame aggregations.

Everything starts from the confusion cells ``(label, prediction) -> n``: one
partial + final hash aggregation over the predictions, whose output has at most
(#classes)^2 rows. The derived metrics are arithmetic on those few rows, so no
prediction ever reaches the driver (no ``collect`` + ``zip``, no RDD).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators.profile import ROUND


def _r(c: Column, digits: int | None = ROUND) -> Column:
    return F.round(c, digits) if digits is not None else c


def confusion_cells(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, count) for every pair that occurs."""
    return (pred.groupBy(F.col(label).cast("double").alias("label"),
                         F.col(prediction).cast("double").alias("prediction"))
            .agg(F.count(F.lit(1)).alias("count")))


def prediction_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows per (prediction, label) pair, named as the input columns."""
    return pred.groupBy(prediction, label).count()


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     classes: list[float] = (0.0, 1.0)) -> DataFrame:
    """A row for each class, and for each other true label that occurs; columns ``pred_<c>`` and
    ``pred_other`` (another class, or NULL). Missing cells are 0."""
    p = F.col(prediction).cast("double")
    known = p.isin(*[float(c) for c in classes])
    found = pred.groupBy(F.col(label).cast("double").alias("label")).agg(
        *[F.count(F.when(p == float(c), 1)).alias(f"pred_{int(c)}") for c in classes],
        F.count(F.when(known, None).otherwise(1)).alias("pred_other"))
    names = found.columns[1:]
    every = pred.sparkSession.createDataFrame([(float(c), *([0] * len(names))) for c in classes],
                                              "label double, " + ", ".join(f"{n} bigint" for n in names))
    return (found.unionByName(every).groupBy("label").agg(*[F.sum(n).alias(n) for n in names]).orderBy("label"))


def binary_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                   positive: float = 1.0, digits: int | None = ROUND) -> DataFrame:
    """TP/TN/FP/FN and accuracy, precision, recall, specificity, F1 (NULL where a ratio is 0/0).
    ``unjudged`` counts the rows whose label or prediction is NULL, which are in no cell."""
    y = F.col(label).cast("double") == positive
    p = F.col(prediction).cast("double") == positive
    cells = pred.agg(
        F.count(F.when(y & p, 1)).alias("tp"), F.count(F.when(~y & ~p, 1)).alias("tn"),
        F.count(F.when(~y & p, 1)).alias("fp"), F.count(F.when(y & ~p, 1)).alias("fn"),
        F.count(F.when(y.isNull() | p.isNull(), 1)).alias("unjudged"))
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    precision = F.try_divide(tp, tp + fp)
    recall = F.try_divide(tp, tp + fn)
    return cells.select(
        "tp", "tn", "fp", "fn", "unjudged",
        _r(F.try_divide(tp + tn, tp + tn + fp + fn), digits).alias("accuracy"),
        _r(precision, digits).alias("precision"),
        _r(recall, digits).alias("recall"),
        _r(F.try_divide(tn, tn + fp), digits).alias("specificity"),
        _r(F.try_divide(2 * precision * recall, precision + recall), digits).alias("f1"),
    )


def distinct_labels(pred: DataFrame, label: str = "label") -> DataFrame:
    return pred.select(F.col(label).cast("double").alias("label")).distinct().orderBy("label")


def per_class_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                      digits: int | None = ROUND) -> DataFrame:
    """Precision, recall and F1 of each true class (a 0/0 ratio counts as 0, as mllib does)."""
    cells = confusion_cells(pred, label, prediction)
    actual = cells.groupBy("label").agg(
        F.sum("count").alias("support"),
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)).alias("tp"))
    predicted = cells.groupBy(F.col("prediction").alias("label")).agg(F.sum("count").alias("predicted"))
    j = actual.join(predicted, "label", "left").fillna(0, ["predicted"])
    tp, sup, prd = (F.col(c).cast("double") for c in ("tp", "support", "predicted"))
    precision = F.when(prd == 0, 0.0).otherwise(tp / prd)
    recall = F.when(sup == 0, 0.0).otherwise(tp / sup)
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return j.select(
        "label", F.col("support").cast("long").alias("support"), F.col("tp").cast("long").alias("tp"),
        F.col("predicted").cast("long").alias("predicted"),
        _r(precision, digits).alias("precision"), _r(recall, digits).alias("recall"),
        _r(f1, digits).alias("f1")).orderBy("label")


def weighted_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     digits: int | None = ROUND) -> DataFrame:
    """Per-class metrics weighted by true-class support, plus accuracy (one row)."""
    pc = per_class_metrics(pred, label, prediction, digits=None)
    n = F.sum("support").cast("double")
    return pc.agg(
        _r(F.sum(F.col("precision") * F.col("support")) / n, digits).alias("weighted_precision"),
        _r(F.sum(F.col("recall") * F.col("support")) / n, digits).alias("weighted_recall"),
        _r(F.sum(F.col("f1") * F.col("support")) / n, digits).alias("weighted_f1"),
        _r(F.sum("tp") / n, digits).alias("accuracy"))


def evaluator_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                      names: tuple[str, ...] = ("accuracy", "f1", "weightedPrecision", "weightedRecall"),
                      digits: int | None = ROUND) -> DataFrame:
    """The same numbers from Spark ML's ``MulticlassClassificationEvaluator`` as (metric, value).

    The rows are read once, for the confusion cells; the evaluator gets these (at most
    classes^2 rows) weighted by their counts."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    spark = pred.sparkSession
    cells = confusion_cells(pred, label, prediction).dropna().select(
        "label", "prediction", F.col("count").cast("double").alias("weight")).collect()
    data = spark.createDataFrame(cells, "label double, prediction double, weight double").coalesce(1)
    rows = []
    for name in names:
        ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName=name,
                                               weightCol="weight")
        v = float(ev.evaluate(data))
        rows.append((name, round(v, digits) if digits is not None else v))
    return pred.sparkSession.createDataFrame(rows, "metric string, value double")


def auc(pred: DataFrame, label: str = "label", score: str = "score", num_bins: int = 0,
        digits: int | None = ROUND) -> DataFrame:
    """Area under the ROC curve (one row).

    Spark ML's ``BinaryClassificationEvaluator`` does the distributed sort and the
    per-partition cumulative counts. ``num_bins=0`` keeps every distinct score
    (exact: equals the rank statistic with ties counted 1/2); a positive value
    down-samples the curve like the evaluator's default of 1000.
    """
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    data = pred.select(F.col(label).cast("double").alias("label"),
                       F.col(score).cast("double").alias("rawPrediction"))
    ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction",
                                       metricName="areaUnderROC", numBins=num_bins)
    v = float(ev.evaluate(data))
    return pred.sparkSession.createDataFrame([(round(v, digits) if digits is not None else v,)],
                                             "auc double")


def auc_rank(pred: DataFrame, label: str = "label", score: str = "score",
             digits: int | None = ROUND) -> DataFrame:
    """Exact area under the ROC curve as a DataFrame job: the rank statistic with ties 1/2.

    1. Histogram ``score -> (pos, neg)`` (partial aggregation: a score shared by a third of all
       rows is one row per map task before the shuffle), dealt out by ranges of the score to the
       session's shuffle partitions and written once with its range's number.
    2. Negatives below each score = negatives in earlier ranges (a prefix sum over one row per
       range, at most as many as partitions) + negatives earlier in its range (a window per range).

    NULL on one-class or empty data; rows with a NULL label or score are left out.
    """
    from tarmac.session import stored

    spark = pred.sparkSession
    y = F.col(label).cast("double") == 1.0
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hist = pred.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count(F.when(y, 1)).alias("pos"), F.count(F.when(~y, 1)).alias("neg")).where("s IS NOT NULL")
    binned = stored(hist.repartitionByRange(ranges, "s").withColumn("b", F.spark_partition_id()), "auc-histogram")
    before = F.sum("range_neg").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = binned.groupBy("b").agg(F.sum("neg").alias("range_neg")).select(
        "b", F.coalesce(before, F.lit(0)).alias("neg_before"))
    within = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    cum = (binned.join(F.broadcast(offsets), "b")
           .withColumn("neg_below", F.col("neg_before") + F.coalesce(F.sum("neg").over(within), F.lit(0))))
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    area = F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg")))
    return cum.agg(_r(F.try_divide(area, pos * neg), digits).alias("auc"))
