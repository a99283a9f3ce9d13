"""Model properties: seeds fixed, importances sum to 1, KMeans nearest centre,
best of grid = max metric, save -> load gives equal scores."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tarmac.plans import features as FE
from tarmac.plans import jobs as J
from tarmac.plans import models as MO
from tarmac.session import shared_path
from tarmac.sources.fixtures import flights_clean


@pytest.fixture(scope="module")
def clean(spark, sf):
    return flights_clean(spark, sf).persist()


def test_kmeans_rows_are_nearest_their_centre(clean):
    res = J.cluster_job(clean, k=3)
    km = res.model.stages[-1]
    centres = np.array([c for c in km.clusterCenters()])
    rows = res.predictions.select(vector_to_array("features").alias("f"), "cluster").limit(300).collect()
    for r in rows:
        d = ((centres - np.array(r["f"])) ** 2).sum(axis=1)
        assert int(np.argmin(d)) == r["cluster"]
    assert res.report.count() == 3


def test_relevance_importances_sum_to_one(clean):
    imp = J.relevance_job(clean, "DepDelay", num_trees=5)
    vals = [r["importance"] for r in imp.collect()]
    assert sum(vals) == pytest.approx(1.0)
    assert [r["rank"] for r in imp.orderBy("rank").collect()] == list(range(1, len(vals) + 1))


def test_grid_best_is_max_and_report_metrics(clean):
    res = J.train_delay_classifier(clean, kind="lr", grid={"regParam": [0.01, 0.1]})
    g = res.grid.collect()
    best = [r for r in g if r["best"]]
    assert len(best) == 1 and best[0]["metric"] == max(r["metric"] for r in g)
    rep = {r["metric"]: r["value"] for r in res.report.collect()}
    assert 0.0 <= rep["accuracy"] <= 1.0 and 0.0 <= rep["auc"] <= 1.0
    assert rep["weighted_recall"] == pytest.approx(rep["accuracy"])


def test_save_load_gives_equal_scores(spark, clean):
    data = clean.withColumn(J.LABEL, F.when(F.col("ArrDelay") > 5, 1).otherwise(0))
    model = J.classifier_pipeline(MO.logistic_regression(J.LABEL, maxIter=5)).fit(data)
    path = MO.save(model, shared_path(spark, "model-test"))
    again = PipelineModel.load(path)
    a = model.transform(data).select("prediction").collect()
    b = again.transform(data).select("prediction").collect()
    assert a == b


def test_max_bins_check_fails_early(clean):
    with pytest.raises(ValueError):
        FE.fitted_index(clean, ["Origin"], 10)


def test_svm_job_runs_and_splits(spark, sf):
    from tarmac.operators.clean import derive_times, drop_columns
    from tarmac.sources.fixtures import flights_raw
    out = shared_path(spark, "svm-test")
    res = J.svm_delay_job(derive_times(drop_columns(flights_raw(spark, sf))), output=out)
    n_train = spark.read.parquet(f"{out}/train").count()
    n_val = spark.read.parquet(f"{out}/validation").count()
    skipped = res.extra["rows_with_null"]
    assert skipped > 0 and n_train + n_val + skipped == flights_raw(spark, sf).count()
    report = {r["metric"]: r["value"] for r in res.report.collect()}
    assert set(report) >= {"accuracy", "auc"} and report["rows_with_null"] == skipped
    again = MO.load_pipeline_model(f"{out}/model").transform(spark.read.parquet(f"{out}/validation"))
    assert again.select("prediction").collect() == res.predictions.select("prediction").collect()


def test_svm_keeps_strings_of_many_values(spark):
    df = spark.range(9000).selectExpr("cast(id % 5000 as string) AS name", "cast(id % 3 as string) AS kind", "id % 7 AS x", "id AS row",
                                      "CASE WHEN id % 9 > 0 THEN cast(id % 31 AS int) END AS ArrDelay")
    res = J.svm_delay_job(df)
    assert res.extra["rows_with_null"] == 1000
    sizes = dict(zip(("name", "kind"), res.model.stages[0].categorySizes))
    assert 3500 < sizes["name"] <= 5000 and sizes["kind"] == 3
    assert res.model.stages[-1].numFeatures == sizes["name"] + 3 + 2
    unseen = res.predictions.where(F.col("name Index") == sizes["name"])
    assert 0 < unseen.count() < res.predictions.count()


def test_dictionary_equals_string_indexer(spark, clean):
    from tarmac.plans import encode as EN
    cols = ["Origin", "OriginCityNameState"]
    rows = clean.select("flight_id", *cols).unionByName(spark.createDataFrame([(-1, None, "nowhere")], "flight_id bigint, Origin string, OriginCityNameState string"))
    old = FE.index_stage(cols, "keep", " want").fit(clean)
    got = EN.indexed(old.transform(rows), EN.value_index(clean, cols), cols)
    assert got.count() == rows.count()
    assert got.where(" OR ".join(f"NOT `{c} want` <=> `{c} Index`" for c in cols)).isEmpty()
    assert EN.indexed(rows, EN.value_index(clean.limit(0), cols), cols).where("`Origin Index` <> 0").isEmpty()


def test_reports_on_one_class(spark):
    data = spark.createDataFrame([(1.0, 1.0, 0.3), (1.0, 0.0, 0.2), (1.0, 1.0, None)], "label double, prediction double, score double")
    report = {r["metric"]: r["value"] for r in J.report_table(data, label="label").collect()}
    assert report["auc"] is None and report["accuracy"] == pytest.approx(2 / 3)


def test_label_thresholds(spark, sf):
    clean = flights_clean(spark, sf)
    from tarmac.functions.labels import threshold_label
    five, fifteen = (clean.where(threshold_label("ArrDelay", t) == 1).count() for t in (5, 15))
    assert five == clean.where("ArrDelay > 5").count() > fifteen == clean.where("ArrDelay > 15").count()


def test_forest_search_grid_and_loaded_search_model(spark, clean):
    assert len(MO.param_grid(MO.rf_classifier("y"), MO.RF_GRID)) == 4
    small = clean.where("flight_id % 19 = 0")
    assert small.where("ArrDelay > 5").count() > 20 < small.where("ArrDelay <= 5").count()
    res = J.train_delay_classifier(small, kind="rf", grid={"numTrees": [2, 3], "maxDepth": [2, 3]})
    assert res.grid.count() == 4 and MO.top_importances(res.importances).count() == 10
    path = MO.save(res.model, shared_path(spark, "search-test"))
    data = small.withColumn(J.LABEL, F.when(F.col("ArrDelay") > 5, 1).otherwise(0))
    a = res.model.transform(data).select("prediction").collect()
    assert a == MO.load_tvs_model(path).transform(data).select("prediction").collect()


def test_one_hot_query_equals_vector(spark, sf):
    from pyspark.ml import Pipeline
    from tarmac.registry.ml import CATS, q_one_hot
    data = flights_clean(spark, sf)
    model = Pipeline(stages=[FE.index_stage(CATS, "skip", " Index"), FE.one_hot_stage([c + " Index" for c in CATS])]).fit(data)
    c = CATS[-1]
    arr = vector_to_array(F.col(f"{c} OHE"))
    want = model.transform(data).select("flight_id", F.size(arr).alias("n"), (F.array_position(arr, 1.0) - 1).alias("i"))
    want = {(r.flight_id, r.n, r.i if r.i is not None and r.i >= 0 else None) for r in want.limit(400).collect()}
    got = {(r[0], r[1], r[2]) for r in q_one_hot(spark, sf).select("flight_id", f"{c} OHE_size", f"{c} OHE_index").collect()}
    assert want <= got


def test_fits_read_a_bounded_stored_file_as_a_task(spark, sf, monkeypatch):
    from tarmac.session import file_a_task, stored
    rows = stored(flights_clean(spark, sf), "bounded", 500)
    parts = lambda: [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    keys = ["spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"]
    before, packed = [spark.conf.get(k) for k in keys], len(parts())
    with file_a_task(spark):
        found = parts()
    assert max(found) <= 500 and sum(found) == rows.count() and len(found) > packed
    assert [spark.conf.get(k) for k in keys] == before and len(parts()) == packed
    seen = []
    monkeypatch.setattr(J, "FIT_ROWS", 1000)
    monkeypatch.setattr(J, "stored", lambda df, name, n=0: seen.append(n) or stored(df, name, n))
    assert J.cluster_job(flights_clean(spark, sf)).predictions.count() == rows.count() and seen == [1000]


def test_search_fits_untouched_stages_once(spark, clean, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression
    from tarmac.plans.search import untouched
    fits, fit = [], LinearRegression._fit
    monkeypatch.setattr(LinearRegression, "_fit", lambda self, rows: fits.append(1) or fit(self, rows))
    grid = J.train_delay_classifier(clean, kind="line", grid={"threshold": [0.3, 5.2, 1000.0]}).grid.collect()
    assert len(fits) == 2  # on the training side and, for the best, on all rows
    metrics = {r["params"]: r["metric"] for r in grid}
    assert len(metrics) == 3 and metrics["threshold=1000.0"] == min(metrics.values()) < max(metrics.values())
    line, cut = MO.delay_line_stages()[1]
    assert untouched([line, cut], MO.param_grid(cut, {"threshold": [1.0]})) == 1
    assert untouched([line, cut], [*MO.param_grid(cut, {"threshold": [1.0]}), *MO.param_grid(line, {"regParam": [0.1]})]) == 0
    assert untouched([line, cut], [{}]) == 2 and Pipeline(stages=[]).fit(clean).transform(clean).columns == clean.columns


def test_search_fits_many_rows_one_at_a_time(clean, monkeypatch):
    import threading
    import time
    from pyspark.ml.classification import LogisticRegression
    from tarmac.plans import search
    lock, running, most, fit = threading.Lock(), [0], [0], LogisticRegression._fit

    def counted(self, rows):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.5)
        try:
            return fit(self, rows)
        finally:
            with lock:
                running[0] -= 1
    monkeypatch.setattr(LogisticRegression, "_fit", counted)
    small = clean.where("flight_id % 7 = 0")
    grids = []
    for limit, at_once in ((search.ROWS_SIDE_BY_SIDE, 2), (10, 1)):
        monkeypatch.setattr(search, "ROWS_SIDE_BY_SIDE", limit)
        most[0] = 0
        res = J.train_delay_classifier(small, kind="lr", grid={"regParam": [0.01, 0.1]})
        assert most[0] == at_once
        grids.append(res.grid.orderBy("params").collect())
    assert grids[0] == grids[1] and sum((grids[0][0]["train_rows"], grids[0][0]["validation_rows"])) == small.count()
