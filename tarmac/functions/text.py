"""String helpers for place names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def city_name(c: Column | str) -> Column:
    """'Boston, MA' -> 'Boston' (text before the first comma; whole text if none)."""
    return F.split(c, ",", 2)[0]


def city_state(city: Column | str, state: Column | str) -> Column:
    """'City,StateName'; a NULL part is skipped, as concat_ws does."""
    return F.concat_ws(",", city_name(city), state)
