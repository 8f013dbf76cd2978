"""Numbers in text, read strictly."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
INFINITE = r"^[+-]?(?i:inf|infinity)\z"
_NUMBER, _INFINITE = re.compile(NUMBER.replace(r"\z", r"\Z")), re.compile(INFINITE.replace(r"\z", r"\Z"))


def strict_double(text: Column) -> Column:
    """A double where all of the text is a number: no spaces, no type letters; null beyond a double's range and for NaN."""
    value = text.try_cast("double")
    finite = F.when(F.abs(value) < float("inf"), value)
    return F.when(text.rlike(NUMBER), finite).when(text.rlike(INFINITE), F.when(text.startswith("-"), float("-inf")).otherwise(float("inf")))


def parse_double(text: str) -> float | None:
    """The same for a Python value."""
    if _NUMBER.match(text):
        value = float(text)
        return value if math.isfinite(value) else None
    if _INFINITE.match(text):
        return float("-inf") if text[0] == "-" else float("inf")
    return None
