"""Binary labels and code -> display-name lookups."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac.schema import DELAY_LABEL_NAMES, WEEKDAY_NAMES


def threshold_label(c: Column | str, threshold: float) -> Column:
    """1 when ``c > threshold``, else 0 -- a NULL delay also gives 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > threshold, 1).otherwise(0)


def _lookup(mapping: dict, c: Column | str) -> Column:
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(sorted(mapping.items()))])
    return m[F.col(c) if isinstance(c, str) else c]


def delay_label_name(c: Column | str) -> Column:
    """0/1 -> 'Não'/'Sim'."""
    return _lookup(DELAY_LABEL_NAMES, c)


def weekday_name(c: Column | str) -> Column:
    """1..7 (1 = Monday) -> Portuguese weekday name."""
    return _lookup(WEEKDAY_NAMES, c)
