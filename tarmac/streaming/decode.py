"""Decode flight messages into the typed clean-flight table.

Works unchanged on a batch DataFrame and on a streaming one: a single
projection of native expressions (unescape, ``from_json``, casts), so a stream
decodes each micro-batch once instead of re-decoding its whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions.json import json_unescape, string_fields_schema, typed_from_string
from tarmac.functions.labels import threshold_label
from tarmac.schema import CLEAN_SCHEMA, DELAY_THRESHOLD_STREAM


def payload_struct(value: Column, schema: T.StructType = CLEAN_SCHEMA) -> Column:
    """Message text (JSON string literal of an object of strings) -> struct of strings."""
    names = [f.name for f in schema.fields]
    return F.from_json(json_unescape(value.cast("string")), string_fields_schema(names))


def decode_flights(df: DataFrame, value: str = "value", schema: T.StructType = CLEAN_SCHEMA,
                   threshold: float | None = DELAY_THRESHOLD_STREAM, keep: list[str] = ()) -> DataFrame:
    """Messages -> typed columns of ``schema`` (+ ``Tem_ArrDelay`` label unless ``threshold`` is None).

    Missing members, JSON nulls, empty strings and text that is not a number all
    give NULL; integers accept ``"905.0"``. Text that is not JSON gives a row of NULLs.
    ``keep`` lists input columns carried through (e.g. Kafka ``partition``/``offset``).
    """
    p = payload_struct(F.col(value), schema).alias("_p")
    out = df.select(*[F.col(k) for k in keep], p)
    cols = [typed_from_string(F.col(f"_p.{f.name}"), f.dataType).alias(f.name) for f in schema.fields]
    out = out.select(*[F.col(k) for k in keep], *cols)
    if threshold is not None:
        out = out.withColumn("Tem_ArrDelay", threshold_label("ArrDelay", threshold))
    return out


def decode_paths(df: DataFrame, value: str = "value", schema: T.StructType = CLEAN_SCHEMA) -> DataFrame:
    """The same fields extracted one by one (as ``get_json_object`` does with a path per field),
    all as strings -- the per-field form of :func:`payload_struct`.

    ``json_tuple`` takes all members out of one reading of the text. It differs from a path in one case only, a
    member that comes twice: the path gives the first one that is not null, the tuple the last; such texts, told
    by their member names, are read path by path.
    """
    names = [f.name for f in schema.fields]
    text = df.select(json_unescape(F.col(value).cast("string")).alias("_j"))
    keys = F.json_object_keys("_j")
    rows = text.select("_j", F.json_tuple("_j", *names).alias(*names)).withColumn("_twice", F.size(keys) > F.size(F.array_distinct(keys)))
    return rows.select(*[F.when(F.col("_twice"), F.get_json_object("_j", f"$.{c}")).otherwise(F.col(c)).alias(c) for c in names])
