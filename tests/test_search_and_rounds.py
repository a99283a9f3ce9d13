"""Row caps beyond a top-k, two-tier draws, the stored-vector search, the delay line and round tables."""

import glob
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac.operators import sampling as SA
from tarmac.operators.profile import total_order
from tarmac.plans import jobs as J
from tarmac.plans import models as MO
from tarmac.registry.ml import SPLIT_KEYS
from tarmac.session import shared_path
from tarmac.sources.fixtures import flights_clean
from tarmac.streaming import queries as SQ
from tarmac.streaming import rounds as RO
from tarmac.streaming.decode import decode_flights
from tarmac.streaming.publish import write_message_files


@pytest.fixture()
def rows(spark):
    return spark.range(500).selectExpr("id % 90 AS a", "CASE WHEN id % 7 > 0 THEN id % 11 END AS b", "'x' AS c").repartition(6)


@pytest.mark.parametrize("n", [0, 1, 7, 250, 499, 500, 501])
def test_row_cap_by_ranges_equals_a_sort(spark, rows, monkeypatch, n):
    monkeypatch.setattr(SA, "TOP_ROWS", -1)
    got = SA.limit_rows(rows, n, ["b"]).collect()
    want = rows.orderBy(*total_order(rows, ["b"])).limit(n).collect()
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == min(n, 500)


def test_row_cap_of_nothing_and_of_equal_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(SA, "TOP_ROWS", -1)
    assert SA.limit_rows(rows.where("a < 0"), 5).count() == 0
    same = spark.range(300).select(F.lit(1).alias("x"))
    assert SA.limit_rows(same, 120).count() == 120


def test_row_cap_has_no_task_with_all_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(SA, "TOP_ROWS", 100)
    clean = flights_clean(spark, sf)
    n = clean.count()
    cut = SA.limit_rows(clean, n // 2)
    assert cut.count() == n // 2 and "TakeOrderedAndProject" not in cut._jdf.queryExecution().executedPlan().toString()
    assert max(r["count"] for r in cut.groupBy(F.spark_partition_id()).count().collect()) < n // 2


@pytest.mark.parametrize("side", [SA.BROADCAST_KEYS, 3])
def test_draws_equal_those_of_one_numbered_table(spark, rows, monkeypatch, side):
    monkeypatch.setattr(SA, "BROADCAST_KEYS", side)
    keys = ["a", "b"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*total_order(rows, keys)))
    want = rows.select("*", nth.alias("nth")).select("a", "b", "c", SA._draw(keys, F.col("nth"), 9).alias("_draw"))
    got = SA.with_draw(rows, 9, keys)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_rows_with_keys_of_their_own_are_drawn_without_a_sort(spark, sf):
    plan = SA.sample_rows(flights_clean(spark, sf), 0.05, 42, SPLIT_KEYS)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
    parts = SA.with_split(flights_clean(spark, sf), [0.5, 0.3, 0.2], 42, SPLIT_KEYS).groupBy("split").count().collect()
    assert {r["split"] for r in parts} == {0, 1, 2}


def test_split_and_grid_are_equal_for_two_file_layouts(spark, sf):
    clean = flights_clean(spark, sf)
    results = [J.train_delay_classifier(c, kind="line", keys=SPLIT_KEYS) for c in (clean, clean.repartition(5).sort("ArrDelay"))]
    a, b = [sorted((r["params"], round(r["metric"], 9), r["best"], r["train_rows"], r["validation_rows"])
                   for r in x.grid.collect()) for x in results]
    assert a == b and sum(r[2] for r in a) == 1 and a[0][3] + a[0][4] == clean.count()
    line = results[0].model.bestModel.stages[-2]
    fit = clean.selectExpr("regr_slope(ArrDelay, DepTime - CRSDepTime) AS b", "regr_intercept(ArrDelay, DepTime - CRSDepTime) AS a").first()
    assert line.coefficients[0] == pytest.approx(fit.b) and line.intercept == pytest.approx(fit.a) and fit.b != 0


def test_search_prepares_once_and_equals_a_plain_fit(spark, sf):
    clean = flights_clean(spark, sf)
    res = J.train_delay_classifier(clean, kind="lr", grid={"regParam": [0.01, 5.0]}, keys=SPLIT_KEYS, parallelism=2)
    best = res.model.bestModel
    data = clean.withColumn(J.LABEL, F.when(F.col("ArrDelay") > 5, 1).otherwise(0))
    reg = 0.01 if [r["best"] for r in res.grid.orderBy("params").collect()][0] else 5.0
    plain = J.classifier_pipeline(MO.logistic_regression(J.LABEL, regParam=reg)).fit(data)
    assert best.stages[-1].coefficients.toArray() == pytest.approx(plain.stages[-1].coefficients.toArray(), abs=1e-6)
    assert list(res.model.validationMetrics) == pytest.approx([r["metric"] for r in res.grid.collect()])


def _line(clean):
    return J.train_delay_classifier(clean, kind="line", keys=SPLIT_KEYS, grid={"threshold": [5.2]}).model


def _uncommit(checkpoint, batch):
    for f in glob.glob(f"{checkpoint.removeprefix('file:')}/commits/{batch}*") + glob.glob(f"{checkpoint.removeprefix('file:')}/commits/.{batch}*"):
        os.remove(f)


def test_round_totals_go_on_after_restarts_and_a_retried_round(spark, sf):
    clean = flights_clean(spark, sf)
    model = _line(clean)
    feed, out, checkpoint = (shared_path(spark, x) for x in ("rf", "ro", "rc"))

    def run():
        scored = SQ.score_stream(decode_flights(SQ.message_file_stream(spark, f"{feed}/*/*")), model)
        RO.start_rounds(scored, out, checkpoint).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    for i in range(3):
        write_message_files(clean.where(F.col("flight_id") % 3 == i), f"{feed}/{i}")
        table = run()
        assert len(table) == (i + 1) * len(RO.KEYS)
    so_far = {(r[-1], r[0], r[1]): r[2:6] for r in table}
    assert so_far[2, "count", "all"][0] == clean.count()
    for i in range(3):
        part = clean.where(F.col("flight_id") % 3 <= i)
        assert so_far[i, "label", "1"][0] == part.where("ArrDelay > 5").count() == so_far[i, "count", "all"][1]
        assert sum(so_far[i, "weekday", str(d)][0] for d in range(1, 8)) == part.count()
        scored = model.transform(part.withColumn(J.LABEL, F.when(F.col("ArrDelay") > 5, 1).otherwise(0)))
        assert so_far[i, "count", "all"][3] == scored.where(F.col("prediction") == F.col(J.LABEL)).count()
    _uncommit(checkpoint, 2)
    assert run() == table


def test_live_job_keeps_five_tables_through_a_retried_batch(spark, sf):
    clean = flights_clean(spark, sf)
    model = _line(clean)
    feed, out, checkpoint = (shared_path(spark, x) for x in ("jf", "jo", "jc"))
    write_message_files(clean.repartition(1), feed, 3, order="flight_id")
    from pyspark.sql import types as T

    from tarmac.schema import CLEAN_SCHEMA
    schema = T.StructType([T.StructField("flight_id", T.LongType()), *CLEAN_SCHEMA.fields])

    def run():
        scored = SQ.score_stream(decode_flights(SQ.message_file_stream(spark, feed, 1), schema=schema), model)
        q = RO.start_delay_job(scored.select("flight_id", "DayOfWeek", "ArrDelay", J.LABEL, "prediction"), out, checkpoint)
        q.awaitTermination()
        return {t: sorted(map(tuple, RO.job_table(spark, out, t).collect())) for t in ("rows", *RO.TABLES)}

    first = run()
    assert first["count"] == [(clean.count(),)] and len(first["rows"]) == len(first["scores"]) == clean.count()
    delayed = {r["DayOfWeek"]: r["count"] for r in clean.where("ArrDelay > 5").groupBy("DayOfWeek").count().collect()}
    assert dict(first["weekdays"]) == delayed and dict(first["distribution"])[1] == sum(delayed.values())
    _uncommit(checkpoint, 2)
    assert run() == first
