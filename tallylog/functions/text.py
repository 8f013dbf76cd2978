"""Text, byte by byte where that matters."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(text: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def contains_ci(text: Column, part: str) -> Column:
    """Whether ``part`` is in the text, ASCII letters alike in either case."""
    return F.contains(ascii_lower(text), F.lit(part.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))))
