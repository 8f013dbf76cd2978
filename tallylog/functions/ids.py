"""Names and values of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX = "[0-9a-fA-F]"
UUID = f"^{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}\\z"


def normalize_name(name: Column) -> Column:
    """Snake case: an underscore where an upper-case letter follows a lower-case one, and for dashes and dots."""
    return F.translate(F.lower(F.regexp_replace(name, r"(?<=\p{Ll})(?=\p{Lu})", "_")), "-.", "__")


def name_of(name: str) -> str:
    """The same for a Python value."""
    out = "".join("_" + c if i and c.isupper() and name[i - 1].islower() else c for i, c in enumerate(name))
    return out.lower().replace("-", "_").replace(".", "_")


def is_uuid(value: Column) -> Column:
    return value.rlike(UUID)


def is_hex_id(value: Column) -> Column:
    """Sixteen hex digits and more, nothing else."""
    return value.rlike(f"^{_HEX}{{16,}}\\z")
