"""Clock arithmetic on hhmm integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hhmm_to_minutes(c: Column | str) -> Column:
    """hhmm clock (e.g. 1435) -> minutes after midnight (875). NULL stays NULL.

    Whole-day values pass through arithmetically: 2400 -> 1440.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / 100) * 60 + c % 100


def delay_minutes(actual: Column | str, scheduled: Column | str) -> Column:
    """Actual minus scheduled minutes, without wrapping at midnight (23:55 -> 00:05 is -1430)."""
    actual = F.col(actual) if isinstance(actual, str) else actual
    scheduled = F.col(scheduled) if isinstance(scheduled, str) else scheduled
    return actual - scheduled
