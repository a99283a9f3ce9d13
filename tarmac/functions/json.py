"""JSON payload helpers: encode rows as JSON string literals and decode them back.

The flight publisher encodes every row twice -- an object of strings, then that
text again as a JSON string literal. Both directions are native expressions, so
they stay inside whole-stage codegen (no Python UDF hop per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_object_of_strings(cols: list[str]) -> Column:
    """Row -> JSON object text whose members are the columns cast to string (NULL members omitted)."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in cols]))


def json_literal(c: Column | str) -> Column:
    """Text -> the same text as one JSON string literal (quotes and escapes added)."""
    arr = F.to_json(F.array(_c(c)))          # '["..."]'
    return arr.substr(F.lit(2), F.length(arr) - 2)


def json_unescape(c: Column | str) -> Column:
    """Undo one level of JSON encoding.

    A JSON string literal yields its content; any other JSON value (e.g. an object
    that was encoded only once) yields its own text; text that is not exactly one JSON
    value yields NULL.
    """
    wrapped = F.concat(F.lit("["), _c(c), F.lit("]"))
    return F.when(F.json_array_length(wrapped) == 1, F.get_json_object(wrapped, "$[0]"))


def string_fields_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def typed_from_string(c: Column, dtype: T.DataType) -> Column:
    """Lenient cast of payload text: integers accept '905.0', whole ones keep every digit; bad text gives NULL.

    Integers are read as decimals, which hold both forms: a direct cast of '905.0' would throw and
    catch an exception for each value.
    """
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return c.try_cast("decimal(38,18)").try_cast(dtype)
    if isinstance(dtype, T.StringType):
        return c
    return c.try_cast(dtype)
