"""Column-level functions (pure expressions, JVM-side, codegen friendly)."""

from tarmac.functions.json import json_literal, json_unescape
from tarmac.functions.labels import delay_label_name, threshold_label, weekday_name
from tarmac.functions.text import city_name, city_state
from tarmac.functions.times import delay_minutes, hhmm_to_minutes

__all__ = [
    "city_name", "city_state", "delay_label_name", "delay_minutes", "hhmm_to_minutes",
    "json_literal", "json_unescape", "threshold_label", "weekday_name",
]
