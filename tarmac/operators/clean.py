"""Cleaning operators: drop, rename, derive, null handling.

All are narrow (per-row) transformations that Catalyst collapses into one
projection + filter over the scan, so the whole clean job is a single
map-only stage with column pruning and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions.text import city_state
from tarmac.functions.times import delay_minutes, hhmm_to_minutes
from tarmac.schema import (CITY_STATE_PARTS, DELAY_COLUMNS, DISMISSED_RAW_COLUMNS,
                           HHMM_COLUMNS)


def drop_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Drop the listed columns; names that are not present are ignored."""
    return df.drop(*(DISMISSED_RAW_COLUMNS if names is None else names))


def trim_headers(df: DataFrame) -> DataFrame:
    """Strip blanks around column names (raw CSV headers may end in a blank)."""
    renames = {c: c.strip() for c in df.columns if c != c.strip()}
    return df.withColumnsRenamed(renames) if renames else df


def derive_times(df: DataFrame, as_int: bool = True) -> DataFrame:
    """hhmm clocks -> minutes after midnight, and delays recomputed from them.

    One projection (``withColumns``) instead of a chain of ``withColumn`` calls.
    The delays use the converted clocks, exactly like recomputing them after the
    conversion; there is no wrap at midnight.
    """
    present = [c for c in HHMM_COLUMNS if c in df.columns]
    minutes = {c: hhmm_to_minutes(F.col(c)) for c in present}
    new = {}
    for c, e in minutes.items():
        new[c] = e.cast("int") if as_int else e
    for d, (act, sch) in DELAY_COLUMNS.items():
        if act in minutes and sch in minutes:
            new[d] = delay_minutes(new[act], new[sch])
    return df.withColumns(new)


def merge_city_state(df: DataFrame, drop_parts: bool = True) -> DataFrame:
    """Add 'City,State' columns from the city and state name columns."""
    new = {out: city_state(F.col(city), F.col(state))
           for out, (city, state) in CITY_STATE_PARTS.items()
           if city in df.columns and state in df.columns}
    out = df.withColumns(new)
    if drop_parts:
        out = out.drop(*[p for parts in CITY_STATE_PARTS.values() for p in parts])
    return out


def null_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is NULL."""
    return df.filter(F.col(column).isNull())


def dropna_any(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without any NULL in ``columns`` (default: all).

    One ``IsNotNull`` condition for each column: unlike ``dropna``, these reach the parquet scan.
    """
    for c in df.columns if columns is None else columns:
        df = df.filter(F.col(f"`{c}`").isNotNull())
    return df


def clean_flights(raw: DataFrame, dismissed: list[str] | None = None) -> DataFrame:
    """Raw flights -> clean flights.

    Drop dismissed columns, convert the four hhmm clocks to minutes and
    recompute both delays, merge city and state, trim header blanks, and remove
    every row holding a NULL. Duplicates are counted elsewhere, never removed here.

    The NULL test runs on the raw columns, before the derivations, and leaves out
    those that are overwritten (recorded delays, which may be NULL) or merged (city
    and state; ``concat_ws`` is never NULL). Each derived column is NULL exactly when
    one of its inputs is, so the rows are the same as testing afterwards -- but these
    ``IsNotNull`` predicates reach the parquet scan, and the derivations are computed
    for kept rows only.
    """
    df = trim_headers(drop_columns(raw, dismissed))
    replaced = {p for pair in CITY_STATE_PARTS.values() for p in pair}
    replaced |= {d for d, clocks in DELAY_COLUMNS.items() if set(clocks) <= set(df.columns)}
    df = dropna_any(df, [c for c in df.columns if c not in replaced])
    df = merge_city_state(derive_times(df))
    # canonical layout: carried columns (e.g. a row id) first, then the clean record
    from tarmac.schema import CLEAN_COLUMNS
    clean_cols = [c for c in CLEAN_COLUMNS if c in df.columns]
    return df.select(*[c for c in df.columns if c not in clean_cols], *clean_cols)


def typed_select(df: DataFrame, schema: T.StructType, lenient: bool = True) -> DataFrame:
    """One projection casting each listed column to its type (others are kept as they are).

    With ``lenient`` the cast follows the payload rules of
    :func:`tarmac.functions.json.typed_from_string`: '905.0' is a valid integer, bad text is NULL.
    """
    from tarmac.functions.json import typed_from_string

    wanted = {f.name: f.dataType for f in schema.fields}
    cols = []
    for c in df.columns:
        if c in wanted:
            e = typed_from_string(F.col(c).cast("string"), wanted[c]) if lenient else F.col(c).cast(wanted[c])
            cols.append(e.alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)
