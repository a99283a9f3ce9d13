"""Metric queries over the deterministic predictions view (FIXTURES.md §4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import metrics as M
from tarmac.registry import register
from tarmac.registry.sql import with_views
from tarmac.sources.fixtures import predictions


@register("cast_scores", with_views(
    "SELECT flight_id, cast(prediction AS float) AS prediction, cast(label AS float) AS label FROM predictions"))
def q_cast_scores(spark, sf):
    p = predictions(spark, sf)
    return p.select("flight_id", F.col("prediction").cast("float").alias("prediction"),
                    F.col("label").cast("float").alias("label"))


@register("prediction_counts", with_views(
    "SELECT prediction, label, count(*) AS count FROM predictions GROUP BY prediction, label"))
def q_prediction_counts(spark, sf):
    return M.prediction_counts(predictions(spark, sf))


@register("confusion_matrix", with_views("""
SELECT label, count(*) FILTER (WHERE prediction = 0.0) AS pred_0,
       count(*) FILTER (WHERE prediction = 1.0) AS pred_1,
       count(*) FILTER (WHERE prediction IS NULL OR prediction NOT IN (0.0, 1.0)) AS pred_other
FROM predictions GROUP BY label"""))
def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(predictions(spark, sf))


_BIN_CELLS = """
SELECT count(*) FILTER (WHERE label = 1.0 AND prediction = 1.0) AS tp,
       count(*) FILTER (WHERE label <> 1.0 AND prediction <> 1.0) AS tn,
       count(*) FILTER (WHERE label <> 1.0 AND prediction = 1.0) AS fp,
       count(*) FILTER (WHERE label = 1.0 AND prediction <> 1.0) AS fn,
       count(*) FILTER (WHERE label IS NULL OR prediction IS NULL) AS unjudged
FROM predictions"""
_BIN_RATIOS = """
SELECT *, tp::double / NULLIF(tp + fp, 0) AS precision, tp::double / NULLIF(tp + fn, 0) AS recall
FROM bin_cells"""


@register("binary_metrics", with_views("""
SELECT tp, tn, fp, fn, unjudged,
       round((tp + tn)::double / NULLIF(tp + tn + fp + fn, 0), 6) AS accuracy,
       round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(tn::double / NULLIF(tn + fp, 0), 6) AS specificity,
       round(2 * precision * recall / NULLIF(precision + recall, 0), 6) AS f1
FROM bin_ratios""", extra=[("bin_cells", _BIN_CELLS), ("bin_ratios", _BIN_RATIOS)]))
def q_binary_metrics(spark, sf):
    return M.binary_metrics(predictions(spark, sf))


@register("distinct_labels", with_views("SELECT DISTINCT label FROM predictions"))
def q_distinct_labels(spark, sf):
    return M.distinct_labels(predictions(spark, sf))


_CLASS_VIEWS = [
    ("cells", "SELECT label, prediction, count(*) AS n FROM predictions GROUP BY label, prediction"),
    ("act", "SELECT label, sum(n) AS support, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp "
            "FROM cells GROUP BY label"),
    ("prd", "SELECT prediction AS label, sum(n) AS predicted FROM cells GROUP BY prediction"),
    ("pc0", """SELECT a.label, a.support, a.tp, coalesce(p.predicted, 0) AS predicted,
       CASE WHEN coalesce(p.predicted, 0) = 0 THEN 0.0 ELSE a.tp::double / p.predicted END AS precision,
       CASE WHEN a.support = 0 THEN 0.0 ELSE a.tp::double / a.support END AS recall
FROM act a LEFT JOIN prd p ON a.label = p.label"""),
    ("pc", """SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                    ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pc0"""),
]


@register("per_class_metrics", with_views("""
SELECT label, cast(support AS bigint) AS support, cast(tp AS bigint) AS tp, cast(predicted AS bigint) AS predicted,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM pc""", extra=_CLASS_VIEWS))
def q_per_class_metrics(spark, sf):
    return M.per_class_metrics(predictions(spark, sf))


_WEIGHTED = """
SELECT round(sum(precision * support) / sum(support), 6) AS weighted_precision,
       round(sum(recall * support) / sum(support), 6) AS weighted_recall,
       round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
       round(sum(tp)::double / sum(support), 6) AS accuracy
FROM pc"""


@register("weighted_metrics", with_views(_WEIGHTED, extra=_CLASS_VIEWS))
def q_weighted_metrics(spark, sf):
    return M.weighted_metrics(predictions(spark, sf))


@register("evaluator_metrics", with_views("""
SELECT 'accuracy' AS metric, accuracy AS value FROM w
UNION ALL SELECT 'f1', weighted_f1 FROM w
UNION ALL SELECT 'weightedPrecision', weighted_precision FROM w
UNION ALL SELECT 'weightedRecall', weighted_recall FROM w""", extra=_CLASS_VIEWS + [("w", _WEIGHTED)]))
def q_evaluator_metrics(spark, sf):
    return M.evaluator_metrics(predictions(spark, sf))


_AUC_VIEWS = [
    ("h", "SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM predictions GROUP BY score"),
    ("c", "SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING "
          "AND 1 PRECEDING), 0) AS neg_below FROM h"),
]


@register("auc", with_views(
    "SELECT round(sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc FROM c",
    extra=_AUC_VIEWS))
def q_auc(spark, sf):
    return M.auc(predictions(spark, sf))


@register("auc_rank", with_views(
    "SELECT round(sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc FROM c",
    extra=_AUC_VIEWS))
def q_auc_rank(spark, sf):
    return M.auc_rank(predictions(spark, sf))
