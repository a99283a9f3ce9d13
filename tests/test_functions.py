"""Unit tests of the column functions on tiny literal frames."""

from pyspark.sql import functions as F

from tarmac.functions import (city_name, city_state, delay_label_name, delay_minutes, hhmm_to_minutes,
                              json_literal, json_unescape, threshold_label, weekday_name)


def test_hhmm_to_minutes_edges(spark):
    df = spark.createDataFrame([(0,), (5,), (905,), (1435,), (2400,), (None,)], "t int")
    got = [r[0] for r in df.select(hhmm_to_minutes("t").alias("m")).collect()]
    assert got == [0, 5, 545, 875, 1440, None]


def test_hhmm_to_minutes_double_keeps_fraction_type(spark):
    df = spark.createDataFrame([(905.0,)], "t double")
    assert df.select(hhmm_to_minutes("t")).first()[0] == 545.0


def test_delay_no_midnight_wrap(spark):
    df = spark.createDataFrame([(hhmm, sched) for hhmm, sched in [(5, 2355), (1000, 945)]], "a int, s int")
    got = [r[0] for r in df.select(delay_minutes(hhmm_to_minutes("a"), hhmm_to_minutes("s"))).collect()]
    assert got == [-1430, 15]


def test_city_name_and_state(spark):
    df = spark.createDataFrame([("Boston, MA", "Massachusetts"), ("Nowhere", "X"), (None, "Y"), ("A, B", None)],
                               "c string, s string")
    got = df.select(city_name("c").alias("n"), city_state("c", "s").alias("cs")).collect()
    assert [tuple(r) for r in got] == [("Boston", "Boston,Massachusetts"), ("Nowhere", "Nowhere,X"),
                                      (None, "Y"), ("A", "A")]


def test_threshold_label_null_is_zero(spark):
    df = spark.createDataFrame([(16,), (15,), (None,), (-3,)], "d int")
    assert [r[0] for r in df.select(threshold_label("d", 15)).collect()] == [1, 0, 0, 0]


def test_label_and_weekday_names(spark):
    df = spark.createDataFrame([(0, 1), (1, 7), (2, 8)], "l int, d int")
    got = [tuple(r) for r in df.select(delay_label_name("l"), weekday_name("d")).collect()]
    assert got == [("Não", "Segunda"), ("Sim", "Domingo"), (None, None)]


def test_json_literal_roundtrip_and_unescape_cases(spark):
    import json
    texts = ['{"Year": "2018", "DepTime": "905.0"}', 'quote " and backslash \\ and é']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    lit = [r[0] for r in df.select(json_literal("t")).collect()]
    assert [json.loads(x) for x in lit] == texts
    cases = spark.createDataFrame([(json.dumps(texts[0]),), (texts[0],), ("not json",), (None,)], "v string")
    got = [r[0] for r in cases.select(json_unescape("v")).collect()]
    assert json.loads(got[0]) == json.loads(texts[0])
    assert json.loads(got[1]) == json.loads(texts[0])
    assert got[2] is None and got[3] is None


def test_json_unescape_wants_exactly_one_value(spark):
    from tarmac.functions.json import json_unescape
    cases = {'1, "x"': None, '{"a":1} {"b":2}': None, '"x"': "x", '{"a":1}': '{"a":1}', "": None, "nope": None}
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    assert {r.v: r.j for r in df.select("v", json_unescape("v").alias("j")).collect()} == cases


def test_long_ids_keep_every_digit(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    from tarmac.functions.json import typed_from_string
    df = spark.createDataFrame([("9007199254740993",), ("905.0",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(typed_from_string(F.col("v"), T.LongType())).collect()] == [9007199254740993, 905, None, None]
