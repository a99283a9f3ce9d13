"""Operators against brute-force answers on small frames."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarmac.operators import clean as C
from tarmac.operators import metrics as M
from tarmac.operators import profile as P
from tarmac.operators.sampling import limit_rows, random_split, sample_rows
from tarmac.sources.fixtures import flights_clean, flights_raw


def test_clean_null_test_before_derivations_matches_after(spark, sf):
    raw = flights_raw(spark, sf)
    early = C.clean_flights(raw)
    late = C.dropna_any(C.trim_headers(C.merge_city_state(C.derive_times(C.drop_columns(raw)))))
    assert sorted(early.columns) == sorted(late.columns)
    cols = sorted(early.columns)
    a = sorted(map(tuple, early.select(cols).collect()), key=repr)
    b = sorted(map(tuple, late.select(cols).collect()), key=repr)
    assert a == b


def test_clean_keeps_row_with_null_city_part(spark):
    row = dict(flight_id=1, Year=2020, Quarter=1, Month=1, DayOfWeek=1, Operating_Airline="A",
               OriginCityName=None, OriginStateName="S", DestCityName="D, X", DestStateName=None,
               CRSDepTime=905, DepTime=910.0, CRSArrTime=1100, ArrTime=1105.0, FlightDate=None)
    df = spark.createDataFrame([row], "flight_id long, Year int, Quarter int, Month int, DayOfWeek int, "
                               "Operating_Airline string, OriginCityName string, OriginStateName string, "
                               "DestCityName string, DestStateName string, CRSDepTime int, DepTime double, "
                               "CRSArrTime int, ArrTime double, FlightDate date")
    out = C.clean_flights(df).first()
    assert out["OriginCityNameState"] == "S" and out["DestCityNameState"] == "D"
    assert out["DepTime"] == 550 and out["DepDelay"] == 5 and out["ArrDelay"] == 5
    assert "FlightDate" not in C.clean_flights(df).columns


def test_trim_headers(spark):
    df = spark.createDataFrame([(1, 2)], "`Operating_Airline ` int, b int")
    assert C.trim_headers(df).columns == ["Operating_Airline", "b"]


def test_null_counts_one_pass(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    got = {r["column"]: r["nulls"] for r in P.null_counts(df).collect()}
    assert got == {"a": 1, "b": 2}


def test_duplicate_count(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (1, "a")], "x int, y string")
    r = P.duplicate_count(df).first()
    assert (r["rows"], r["distinct_rows"], r["duplicates"]) == (4, 2, 2)


def test_box_summary_matches_pandas(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.integers(1, 4, 500), "v": rng.integers(-50, 200, 500)})
    pdf.loc[0:5, "v"] = 1500  # outliers
    df = spark.createDataFrame(pdf)
    got = {r["g"]: r for r in P.box_summary(df, "g", "v").collect()}
    for g, part in pdf.groupby("g"):
        v = part["v"].to_numpy()
        q1, med, q3 = np.percentile(v, [25, 50, 75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = v[(v >= lo) & (v <= hi)]
        r = got[g]
        assert r["q1"] == pytest.approx(q1) and r["median"] == pytest.approx(med) and r["q3"] == pytest.approx(q3)
        assert r["whisker_low"] == inside.min() and r["whisker_high"] == inside.max()
        assert r["outliers"] == len(v) - len(inside) and r["n"] == len(v)


def test_box_quartiles_by_rank_selection(spark):
    # more distinct values than one task may sort, one value with a fifth of the rows, ties and a group of one row
    v = F.when(F.col("id") % 5 == 0, F.lit(0.5)).otherwise(F.pmod(F.xxhash64("id"), F.lit(100003)) / 7)
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), v.alias("v")).unionByName(
        spark.createDataFrame([(9, 4.0), (9, None), (None, 1.0)], "g bigint, v double"))
    got = {r["g"]: r for r in P.box_summary(df, "g", "v", most=50).collect()}
    pdf = df.dropna().toPandas()
    assert set(got) == {0, 1, 2, 9}
    for g, part in pdf.groupby("g"):
        want = np.percentile(part["v"], [25, 50, 75])
        assert [got[g][q] for q in ("q1", "median", "q3")] == pytest.approx(list(want), abs=1e-5)
        assert got[g]["n"] == len(part)
    assert P.box_summary(df.limit(0), "g", "v").count() == 0


def test_corr_matrix_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    for rows in (df, df.limit(0)):
        assert [r["r"] for r in P.corr_matrix(rows, ["a", "b"]).collect()] == [None] * 4
    large = spark.range(50).selectExpr("1e9 + id AS a", "1e9 - id * 3 AS b", "0.1D AS c", "CASE WHEN id % 2 = 0 THEN id * id END AS d")
    got = {(r["row"], r["col"]): r["r"] for r in P.corr_matrix(large, ["a", "b", "c", "d"]).collect()}
    want = large.select("a", "d").dropna().toPandas().astype(float).corr().iloc[0, 1]
    assert got["a", "b"] == -1.0 and got["a", "c"] is None and got["a", "d"] == pytest.approx(want, abs=1e-6)


def test_corr_matrix_matches_numpy(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=200)
    pdf = pd.DataFrame({"a": a, "b": 2 * a + rng.normal(size=200), "c": rng.normal(size=200)})
    got = {(r["row"], r["col"]): r["r"] for r in P.corr_matrix(spark.createDataFrame(pdf), ["a", "b", "c", "zz"]).collect()}
    ref = np.corrcoef(pdf.to_numpy().T)
    names = ["a", "b", "c"]
    assert len(got) == 9
    for i, x in enumerate(names):
        for j, y in enumerate(names):
            assert got[(x, y)] == pytest.approx(ref[i, j], abs=1e-6)


def test_group_profile_matches_pandas(spark):
    pdf = pd.DataFrame({"k": [0, 0, 1, 1, 1, 2], "x": [1.0, 3.0, 5.0, 7.0, 9.0, 11.0], "y": [1, 1, 1, 2, 2, 4]})
    got = {(r["k"], r["feature"]): r["diff"] for r in P.group_profile(spark.createDataFrame(pdf), "k", ["x", "y"]).collect()}
    ref = pdf.groupby("k").mean() - pdf.drop(columns="k").mean()
    for k in ref.index:
        for f in ["x", "y"]:
            assert got[(k, f)] == pytest.approx(ref.loc[k, f], abs=1e-6)


def test_last_rows_and_preview_total_order(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(20)], "a int, b int")
    assert [tuple(r) for r in P.last_rows(df, 3, ["b"]).collect()] == [(1, 19), (0, 18), (2, 17)]
    assert [tuple(r) for r in P.preview(df, 2).collect()] == [(0, 0), (0, 3)]
    assert limit_rows(df, 100).count() == 20


def test_split_is_disjoint_complete_and_repeatable(spark, sf):
    clean = flights_clean(spark, sf)
    a, b = random_split(clean, [0.7, 0.3], 42)
    n, na, nb = clean.count(), a.count(), b.count()
    assert na + nb == n and a.intersect(b).count() == 0
    assert abs(na / n - 0.7) < 0.05
    # independent of partitioning
    a2, _ = random_split(clean.repartition(5), [0.7, 0.3], 42)
    assert a2.exceptAll(a).count() == 0 and a.exceptAll(a2).count() == 0
    s = sample_rows(clean, 0.05, 42).count()
    sigma = math.sqrt(n * 0.05 * 0.95)
    assert abs(s - 0.05 * n) < 4 * sigma


@pytest.mark.parametrize("case", ["normal", "one_class", "no_positive_prediction", "empty"])
def test_binary_metrics_edge_frames(spark, case):
    rows = {"normal": [(1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (0.0, 1.0), (0.0, 0.0)],
            "one_class": [(1.0, 1.0), (1.0, 0.0)],
            "no_positive_prediction": [(1.0, 0.0), (0.0, 0.0)],
            "empty": []}[case]
    df = spark.createDataFrame(rows, "label double, prediction double")
    r = M.binary_metrics(df).first()
    tp = sum(1 for y, p in rows if y == 1 and p == 1)
    fp = sum(1 for y, p in rows if y == 0 and p == 1)
    assert r["tp"] == tp and r["fp"] == fp
    if case == "no_positive_prediction":
        assert r["precision"] is None and r["f1"] is None
    if case == "empty":
        assert r["accuracy"] is None


def test_per_class_and_weighted_agree_with_evaluator(spark):
    rows = [(0.0, 0.0)] * 5 + [(0.0, 1.0)] * 2 + [(1.0, 1.0)] * 3 + [(1.0, 0.0)] * 4 + [(2.0, 1.0)] * 2
    df = spark.createDataFrame(rows, "label double, prediction double")
    w = M.weighted_metrics(df).first()
    ev = {r["metric"]: r["value"] for r in M.evaluator_metrics(df).collect()}
    assert w["accuracy"] == pytest.approx(ev["accuracy"])
    assert w["weighted_precision"] == pytest.approx(ev["weightedPrecision"])
    assert w["weighted_recall"] == pytest.approx(ev["weightedRecall"])
    assert w["weighted_f1"] == pytest.approx(ev["f1"])
    pc = {r["label"]: r for r in M.per_class_metrics(df).collect()}
    assert pc[2.0]["precision"] == 0.0 and pc[2.0]["recall"] == 0.0


def _auc_brute(rows):
    pos = [s for y, s in rows if y == 1.0]
    neg = [s for y, s in rows if y == 0.0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_forms_agree_with_brute_force_including_ties(spark):
    rng = np.random.default_rng(11)
    rows = [(float(y), float(s)) for y, s in zip(rng.integers(0, 2, 400), rng.integers(0, 30, 400))]
    df = spark.createDataFrame(rows, "label double, score double")
    ref = _auc_brute(rows)
    assert M.auc(df).first()["auc"] == pytest.approx(ref, abs=1e-6)
    assert M.auc_rank(df).first()["auc"] == pytest.approx(ref, abs=1e-6)
    # many small score ranges: the prefix sums across ranges must give the same value


def test_confusion_matrix_fills_missing_cells(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (0.0, 1.0)], "label double, prediction double")
    got = {r["label"]: (r["pred_0"], r["pred_1"]) for r in M.confusion_matrix(df).collect()}
    assert got == {0.0: (0, 1), 1.0: (0, 2)}


# ---------------------------------------------------------------- rows that must not go missing
def test_clean_keeps_rows_whose_recorded_delay_is_missing(spark, sf):
    raw = flights_raw(spark, sf)
    assert raw.where("ArrDelay IS NULL").count() > 0
    kept = C.clean_flights(raw)
    late = C.trim_headers(C.merge_city_state(C.derive_times(C.drop_columns(raw)))).dropna()
    assert kept.count() == late.count() > 0
    assert kept.where("ArrDelay IS NULL").count() == 0


def test_null_tests_reach_the_scan(spark, sf, tmp_path):
    flights_raw(spark, sf).write.parquet(f"{tmp_path}/raw")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = C.clean_flights(spark.read.parquet(f"{tmp_path}/raw"))._jdf.queryExecution().toString()
    pushed = [x for x in plan.split("\n") if "PushedFilters" in x][-1]
    assert "IsNotNull(DepTime)" in pushed and "IsNotNull(ArrTime)" in pushed


def test_corr_matrix_uses_every_pair(spark):
    rows = [(1.0, 2.0, None), (2.0, 1.0, 5.0), (3.0, 5.0, None), (4.0, None, 1.0), (None, 9.0, 2.0), (5.0, 6.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double").withColumn("d", F.lit(1))
    pdf = pd.DataFrame(rows, columns=list("abc"))
    got = {(r["row"], r["col"]): r["r"] for r in P.corr_matrix(df, ["a", "b", "c", "d"]).collect()}
    for x in "abc":
        for y in "abc":
            assert got[x, y] == pytest.approx(pdf[x].corr(pdf[y]), abs=1e-6)
        assert got[x, "d"] is None


def test_confusion_matrix_is_whole(spark):
    one = spark.createDataFrame([(1.0, 0.0), (1.0, 7.0), (1.0, None)], "label double, prediction double")
    assert [tuple(r) for r in M.confusion_matrix(one).collect()] == [(0.0, 0, 0, 0), (1.0, 1, 0, 2)]


def test_binary_metrics_count_unjudged_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (0.0, None)], "label double, prediction double")
    r = M.binary_metrics(df).first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"], r["unjudged"]) == (1, 0, 0, 0, 2)


@pytest.mark.parametrize("rows,want", [
    ([], None), ([(1.0, 0.5), (1.0, 0.7)], None), ([(1.0, 0.5), (0.0, 0.5)], 0.5),
    ([(float(i % 2), float(i)) for i in range(300)], None), ([(1.0, None), (1.0, 2.0), (0.0, 1.0)], 1.0)])
def test_auc_rank_edges(spark, rows, want):
    df = spark.createDataFrame(rows, "label double, score double")
    got = M.auc_rank(df).first()["auc"]
    if len(rows) == 300:  # several ranges: as many as shuffle partitions
        pos, neg = ([s for y, s in rows if y == k] for k in (1.0, 0.0))
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert got == (pytest.approx(want, abs=1e-6) if want is not None else None)


def test_equal_rows_draw_apart(spark):
    df = spark.range(4_000).select(F.lit(1).alias("x"))
    n = sample_rows(df, 0.25).count()
    assert 800 < n < 1_200 and n == sample_rows(df.repartition(7), 0.25).count()
    parts = [p.count() for p in random_split(df, [0.7, 0.3])]
    assert sum(parts) == 4_000 and 2_600 < parts[0] < 3_000


def test_limit_rows_cuts(spark):
    df = spark.range(50).selectExpr("49 - id AS x")
    assert [r.x for r in limit_rows(df, 3).orderBy("x").collect()] == [0, 1, 2]


def test_kinds_by_type_family(spark):
    df = spark.sql("SELECT 1 AS i, 1.5D AS d, 2.5 AS dec, 's' AS s, date'2020-01-01' AS dt, timestamp'2020-01-01' AS ts, true AS b")
    assert {r["name"]: r["kind"] for r in P.column_kinds(df).collect()} == {
        "i": "numeric", "d": "numeric", "dec": "numeric", "s": "categorical", "dt": "temporal", "ts": "temporal", "b": "boolean"}


def test_csv_folder_of_drifting_headers(spark, tmp_path):
    from pyspark.sql import types as T

    from tarmac.sources.files import csv_headers, scan_csv_folder
    files = {"a.csv": "id, name ,x,\n1,\"p, q\",1.5,\n2,,,\n3,r\n", "b.csv": "\ufeffx,id,extra\n2.5,4,e\nbad,5,f\n1,6,g,h\n",
             "c.csv": "id,id,name\n7,8,s\n", "d.csv": "", "e.csv": "id,name\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("x", T.DoubleType())])
    assert len(csv_headers(spark, str(tmp_path))) == 4
    got = scan_csv_folder(spark, str(tmp_path), schema)
    assert got.columns == ["id", "name", "x", "extra", "id_2", "broken_row"]
    rows = {tuple(r) for r in got.collect()}
    assert rows == {(1, "p, q", 1.5, None, None, None), (2, None, None, None, None, None), (4, None, 2.5, "e", None, None),
                    (7, "s", None, None, "8", None), *[(None,) * 5 + (t,) for t in ("3,r", "bad,5,f", "1,6,g,h")]}
    assert got.where("broken_row IS NOT NULL").count() == 3 and got.count() == 7
    (tmp_path / "none").mkdir()
    assert scan_csv_folder(spark, str(tmp_path / "none"), schema).count() == 0


def test_flight_plans_keep_methods_small_enough_to_be_compiled(spark, sf):
    from tarmac.session import JIT_LIMIT, METHOD_LIMIT
    before = spark.conf.get(METHOD_LIMIT)
    try:
        for limit, kept in (("65535", JIT_LIMIT), ("4000", 4000)):
            spark.conf.set(METHOD_LIMIT, limit)
            rows = flights_clean(spark, sf)
            assert int(spark.conf.get(METHOD_LIMIT)) == kept
            assert rows.count() > 0
    finally:
        spark.conf.set(METHOD_LIMIT, before)
