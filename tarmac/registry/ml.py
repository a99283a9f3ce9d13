"""Spark ML queries: feature stages (with oracles), models, tuning, persistence, sampling."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tarmac.functions.labels import threshold_label
from tarmac.operators.sampling import sample_rows, with_split
from tarmac.plans import features as FE
from tarmac.plans import jobs as J
from tarmac.plans import models as MO
from tarmac.operators.clean import derive_times, drop_columns
from tarmac.registry import register
from tarmac.registry.sql import CLEAN_COLUMN_NAMES, with_views
from tarmac.schema import (CATEGORICAL_FEATURES, CLASSIFIER_NUMERIC_FEATURES, DELAY_THRESHOLD_CHARTS,
                           DELAY_THRESHOLD_STREAM)
from tarmac.session import shared_path
from tarmac.sources.fixtures import flights_clean, flights_raw

CATS = CATEGORICAL_FEATURES


# ---------------------------------------------------------------- oracle helpers
def _index_views(cols: list[str], source: str) -> list[tuple[str, str]]:
    """Per column: value -> index by count desc, then value (NULLs are not values)."""
    return [(f"ix_{c}", f"SELECT {c} AS v, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS i "
                        f"FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}") for c in cols]


def _indexed_sql(cols: list[str], source: str, select: str, where: str = "") -> str:
    joins = " ".join(f"LEFT JOIN ix_{c} ON t.{c} = ix_{c}.v" for c in cols)
    return f"SELECT {select} FROM {source} t {joins} {where}"


# ---------------------------------------------------------------- feature stages
@register("string_index_keep", with_views(
    _indexed_sql(CATS, "flights_clean", "t.flight_id, " + ", ".join(
        f"cast(coalesce(ix_{c}.i, (SELECT count(*) FROM ix_{c})) AS double) AS {c}_Index" for c in CATS)),
    "flights_clean", _index_views(CATS, "flights_clean")))
def q_string_index_keep(spark, sf):
    clean = flights_clean(spark, sf)
    model = FE.index_stage(CATS, "keep").fit(clean)
    return model.transform(clean).select("flight_id", *[c + "_Index" for c in CATS])


_SKIP_COLS = ["Operating_Airline", "CancellationCode"]


@register("string_index_skip", with_views(
    _indexed_sql(_SKIP_COLS, "flights_raw", "t.flight_id, " + ", ".join(
        f"cast(ix_{c}.i AS double) AS \"{c} Index\"" for c in _SKIP_COLS),
        "WHERE " + " AND ".join(f"t.{c} IS NOT NULL" for c in _SKIP_COLS)),
    "flights_raw", _index_views(_SKIP_COLS, "flights_raw")))
def q_string_index_skip(spark, sf):
    # the cancellation code is NULL for flights that were not cancelled: 'skip' drops them
    raw = flights_raw(spark, sf).select("flight_id", *_SKIP_COLS)
    model = FE.index_stage(_SKIP_COLS, "skip", " Index").fit(raw)
    return model.transform(raw).select("flight_id", *[c + " Index" for c in _SKIP_COLS])


def _ohe_sql() -> str:
    sel = ["t.flight_id"]
    for c in CATS:
        size = f"((SELECT count(*) FROM ix_{c}) - 1)"
        sel.append(f"cast({size} AS int) AS \"{c} OHE_size\"")
        sel.append(f"cast(CASE WHEN ix_{c}.i < {size} THEN ix_{c}.i END AS int) AS \"{c} OHE_index\"")
    return with_views(_indexed_sql(CATS, "flights_clean", ", ".join(sel)), "flights_clean",
                      _index_views(CATS, "flights_clean"))


@register("one_hot", _ohe_sql())
def q_one_hot(spark, sf):
    clean = flights_clean(spark, sf)
    idx = [c + " Index" for c in CATS]
    model = Pipeline(stages=[FE.index_stage(CATS, "skip", " Index"), FE.one_hot_stage(idx)]).fit(clean)
    # the vector's width is the fitted encoder's, its one position the index itself (the last category
    # is all zeros): no dense array is made (tests compare with the vector)
    out = model.stages[0].transform(clean)
    cols = ["flight_id"]
    for c, categories in zip(CATS, model.stages[1].categorySizes):
        width = int(categories) - 1
        cols += [F.lit(width).alias(f"{c} OHE_size"),
                 F.when(F.col(f"{c} Index") < width, F.col(f"{c} Index")).cast("int").alias(f"{c} OHE_index")]
    return out.select(*cols)


_FEATS = J.classifier_features()


@register("assemble_features", with_views(
    _indexed_sql(CATS, "flights_clean", "t.flight_id, [" + ", ".join(
        [f"cast(t.{c} AS double)" for c in CLASSIFIER_NUMERIC_FEATURES]
        + [f"cast(coalesce(ix_{c}.i, (SELECT count(*) FROM ix_{c})) AS double)" for c in CATS]) + "] AS features"),
    "flights_clean", _index_views(CATS, "flights_clean")))
def q_assemble_features(spark, sf):
    clean = flights_clean(spark, sf)
    model = Pipeline(stages=[FE.index_stage(CATS, "keep"), FE.assemble_stage(_FEATS)]).fit(clean)
    return model.transform(clean).select("flight_id", vector_to_array("features").alias("features"))


_SCALE = CLASSIFIER_NUMERIC_FEATURES


@register("standard_scale", with_views(
    "SELECT flight_id, [" + ", ".join(f"round((t.{c} - s.m_{c}) / s.s_{c}, 6)" for c in _SCALE)
    + "] AS features FROM flights_clean t, st s", "flights_clean",
    [("st", "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _SCALE)
      + " FROM flights_clean")]))
def q_standard_scale(spark, sf):
    clean = flights_clean(spark, sf)
    model = Pipeline(stages=[FE.assemble_stage(_SCALE, "features_unscaled"),
                             FE.scale_stage("features_unscaled", "features")]).fit(clean)
    return model.transform(clean).select("flight_id", FE.vector_column("features", 6).alias("features"))


# ---------------------------------------------------------------- draws
SPLIT_KEYS = ["flight_id", "Flight_Number_Operating_Airline", "CRSDepTime", "DepTime", "Year", "Month"]
_DRAW_ORDER = ", ".join(f"{c} ASC NULLS FIRST" for c in SPLIT_KEYS + [c for c in CLEAN_COLUMN_NAMES if c not in SPLIT_KEYS])
_DRAWN = ("SELECT *, ('0x' || substr(md5(concat_ws('|', " + ", ".join(f"cast({c} AS varchar)" for c in SPLIT_KEYS)
          + f", cast(row_number() OVER (PARTITION BY {', '.join(SPLIT_KEYS)} ORDER BY {_DRAW_ORDER}) AS varchar), '42')), 1, 8))"
          "::bigint / 4294967296.0 AS draw FROM flights_clean")


# ---------------------------------------------------------------- models (rows-only checks)
def _scored(pred, label=J.LABEL):
    return pred.select("flight_id", F.col(label).alias("label"), "prediction",
                       J.positive_score().alias("score"))


_RESULTS: dict[tuple, J.TrainResult] = {}


def _once(spark, sf, name, job) -> J.TrainResult:
    """One fit per session and folder, shared by the queries that report on it. What is kept are plans
    and small model objects; the rows lie in the shared folder."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"), name)
    if key not in _RESULTS:
        _RESULTS[key] = job(flights_clean(spark, sf))
    return _RESULTS[key]


def _clusters(spark, sf) -> J.TrainResult:
    return _once(spark, sf, "clusters", J.cluster_job)


@register("kmeans_clusters")
def q_kmeans_clusters(spark, sf):
    return _clusters(spark, sf).predictions.select("flight_id", "cluster", "DepDelay", "ArrDelay")


@register("cluster_delay_avg")
def q_cluster_delay_avg(spark, sf):
    return _clusters(spark, sf).report


@register("cluster_profile")
def q_cluster_profile(spark, sf):
    return _clusters(spark, sf).extra["profile"]


@register("rf_relevance_dep")
def q_rf_relevance_dep(spark, sf):
    return J.relevance_job(flights_clean(spark, sf), "DepDelay")


@register("rf_relevance_arr")
def q_rf_relevance_arr(spark, sf):
    return J.relevance_job(flights_clean(spark, sf), "ArrDelay")


def _forest(spark, sf) -> J.TrainResult:
    """The full 2 x 2 forest search, label ArrDelay > 5."""
    return _once(spark, sf, "forest", lambda clean: J.train_delay_classifier(clean, kind="rf", keys=SPLIT_KEYS))


@register("rf_classifier")
def q_rf_classifier(spark, sf):
    return _scored(_forest(spark, sf).predictions)


@register("train_report")
def q_train_report(spark, sf):
    return _forest(spark, sf).report


@register("importance_ranking")
def q_importance_ranking(spark, sf):
    return MO.top_importances(_forest(spark, sf).importances, 10)


def _logistic(spark, sf) -> J.TrainResult:
    """The 2 x 3 logistic-regression search with a label of its own, ArrDelay > 15."""
    return _once(spark, sf, "logistic", lambda clean: J.train_delay_classifier(
        clean, kind="lr", threshold=DELAY_THRESHOLD_CHARTS, keys=SPLIT_KEYS))


@register("logistic_regression")
def q_logistic_regression(spark, sf):
    return _scored(_logistic(spark, sf).predictions)


@register("logistic_report")
def q_logistic_report(spark, sf):
    return _logistic(spark, sf).report


@register("grid_search")
def q_grid_search(spark, sf):
    return _logistic(spark, sf).grid


def _svm_input(spark, sf):
    return derive_times(drop_columns(flights_raw(spark, sf)))


def _svm(spark, sf) -> J.TrainResult:
    return _once(spark, sf, "svm", lambda _: J.svm_delay_job(
        _svm_input(spark, sf), output=shared_path(spark, "svm"), keys=SPLIT_KEYS))


@register("linear_svc")
def q_linear_svc(spark, sf):
    return _svm(spark, sf).predictions.select("flight_id", "Delay", "prediction", "score")


@register("svm_report")
def q_svm_report(spark, sf):
    return _svm(spark, sf).report


# ---------------------------------------------------------------- saved pipelines and models
# the delay line (models.delay_line_stages) is fitted in closed form, so SQL repeats what it learns: the
# threshold by its accuracy on the validating rows, and both coefficients from all rows
_LABEL_SQL = f"CASE WHEN ArrDelay > {DELAY_THRESHOLD_STREAM} THEN 1 ELSE 0 END"
_LINE = "regr_intercept(ArrDelay, late) AS a, regr_slope(ArrDelay, late) AS b"
LINE_VIEWS = [
    ("drawn", _DRAWN),
    ("timed", f"SELECT *, DepTime - CRSDepTime AS late, {_LABEL_SQL} AS Tem_ArrDelay FROM drawn"),
    ("tried", f"SELECT unnest({MO.LINE_GRID['threshold']}) :: double AS threshold"),
    ("trained", f"SELECT {_LINE} FROM timed WHERE draw < {MO.TRAIN_RATIO}"),
    ("searched", "SELECT threshold, avg(CASE WHEN (a + b * late > threshold) = (Tem_ArrDelay = 1) THEN 1.0 ELSE 0.0 END) AS metric, "
     f"count(*) AS validation_rows FROM timed, trained, tried WHERE draw >= {MO.TRAIN_RATIO} GROUP BY threshold"),
    ("chosen", "SELECT threshold FROM searched ORDER BY metric DESC, threshold LIMIT 1"),
    ("line", f"SELECT {_LINE} FROM timed"),
    ("scored", "SELECT timed.*, CASE WHEN a + b * late > chosen.threshold THEN 1.0 ELSE 0.0 END :: double AS prediction "
     "FROM timed, line, chosen")]


def line_sql(select: str) -> str:
    return with_views(select, "flights_clean", LINE_VIEWS)


def _line(spark, sf) -> J.TrainResult:
    return _once(spark, sf, "line", lambda clean: J.train_delay_classifier(clean, kind="line", keys=SPLIT_KEYS))


def line_search(spark, sf):
    """The searched delay line, saved and loaded."""
    return MO.load_tvs_model(MO.save(_line(spark, sf).model, shared_path(spark, "search")))


def _labelled(spark, sf):
    return flights_clean(spark, sf).withColumn(J.LABEL, threshold_label("ArrDelay", DELAY_THRESHOLD_STREAM))


def _ruled(pred):
    return pred.select("flight_id", F.col(J.LABEL).alias("label"), "prediction")


@register("line_search", line_sql(
    f"SELECT 'threshold=' || threshold AS params, metric, threshold = (SELECT threshold FROM chosen) AS best, "
    f"(SELECT count(*) FROM timed WHERE draw < {MO.TRAIN_RATIO}) AS train_rows, validation_rows FROM searched"))
def q_line_search(spark, sf):
    return _line(spark, sf).grid


@register("batch_score", line_sql("SELECT flight_id, Tem_ArrDelay AS label, prediction FROM scored"))
def q_batch_score(spark, sf):
    return _ruled(line_search(spark, sf).transform(_labelled(spark, sf)))


_DEFAULT_LINE = line_sql(f"SELECT flight_id, Tem_ArrDelay AS label, CASE WHEN a + b * late > {DELAY_THRESHOLD_STREAM} THEN 1.0 "
                         "ELSE 0.0 END :: double AS prediction FROM timed, line")


def line_pipeline() -> Pipeline:
    before, after = MO.delay_line_stages(DELAY_THRESHOLD_STREAM)
    return Pipeline(stages=[*before, *after])


@register("pipeline_save_load", _DEFAULT_LINE)
def q_pipeline_save_load(spark, sf):
    data = _labelled(spark, sf)
    path = MO.save(line_pipeline(), shared_path(spark, "pipeline"))
    return _ruled(Pipeline.load(path).fit(data).transform(data))


@register("model_save_load", _DEFAULT_LINE)
def q_model_save_load(spark, sf):
    data = _labelled(spark, sf)
    path = MO.save(line_pipeline().fit(data), shared_path(spark, "model"))
    return _ruled(MO.load_pipeline_model(path).transform(data))


# ---------------------------------------------------------------- sampling
@register("sample_rows", with_views("SELECT * EXCLUDE (draw) FROM drawn WHERE draw < 0.05", "flights_clean",
                                    [("drawn", _DRAWN)]))
def q_sample_rows(spark, sf):
    return sample_rows(flights_clean(spark, sf), 0.05, 42, SPLIT_KEYS)


@register("random_split", with_views("SELECT * EXCLUDE (draw), CASE WHEN draw < 0.7 THEN 0 ELSE 1 END AS split FROM drawn",
                                     "flights_clean", [("drawn", _DRAWN)]))
def q_random_split(spark, sf):
    return with_split(flights_clean(spark, sf), [0.7, 0.3], 42, SPLIT_KEYS)
