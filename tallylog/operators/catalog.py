"""What fields and values there are, and completions from them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.aliases import Aliases
from ..plans.compiler import field_of

#: A field with more different values than this has none to offer.
MOST_VALUES = 50
# Words of the language that complete like field names.
KEYWORDS = ("AND", "NOT", "OR", "last")


def field_names(records: DataFrame) -> DataFrame:
    """(name) of all fields, and ``level`` if any record has one."""
    keys = records.select(F.explode(F.array_union(F.map_keys("fields"), F.when(F.col("level") != "", F.array(F.lit("level"))).otherwise(F.array().cast("array<string>")))).alias("name"))
    return keys.distinct().orderBy("name")


def field_values(records: DataFrame, field: str) -> DataFrame:
    """(value) of a field, none if there are more than ``MOST_VALUES``. Levels are offered as written and by their normal names."""
    value = field_of(records, field)
    if field == "level":
        rows = records.select(F.explode(F.array(value, F.nullif(F.col("level"), F.lit("")))).alias("value"))
    else:
        rows = records.select(value.alias("value"))
    few = rows.where("value is not null").distinct().limit(MOST_VALUES + 1)
    n = few.agg(F.count(F.lit(1)).alias("n"))
    return few.join(F.broadcast(n), F.lit(True)).where(F.col("n") <= MOST_VALUES).select("value").orderBy("value")


def values_of_all_fields(records: DataFrame, most: int = MOST_VALUES) -> DataFrame:
    """(name, value) of all fields that have ``most`` different values at most, in one pass; ``level`` as in ``field_values``.

    A task keeps up to ``most`` + 1 values a field, so that identifiers, with a value a record, don't leave it: what is exchanged is that much a task and field, each pair once.
    """

    def few(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: dict[str, set[str]] = {}
        for batch in batches:
            fields, level = batch.column(0), batch.column(1)
            pairs = pa.table({"name": fields.keys, "value": fields.items}) if len(fields.keys) else pa.table({"name": pa.array([], pa.string()), "value": pa.array([], pa.string())})
            levels = level.unique().to_pylist()
            for name, value in zip(*[c.to_pylist() for c in pairs.group_by(["name", "value"]).aggregate([]).columns], strict=True):
                held = seen.setdefault(name, set())
                if value is not None and len(held) <= most:
                    held.add(value)
            seen.setdefault("level", set()).update(v for v in levels if v)
        rows = [(name, value) for name, held in seen.items() for value in sorted(held)[: most + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["name", "value"])

    pairs = records.select("fields", "level").mapInArrow(few, "name string, value string").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("name"))
    return pairs.withColumn("n", n).where(F.col("n") <= most).drop("n")


@dataclass(frozen=True)
class Context:
    """What is to be completed at a place: kind none, name, value or alias; the part there is; the field; where the part begins."""

    kind: str
    prefix: str = ""
    field: str = ""
    start: int = 0


def context_at(text: str, cursor: int) -> Context:
    left = text[:cursor]
    if not left or (cursor < len(text) and text[cursor] not in " \t):><~"):
        return Context("none")
    start = max(left.rfind(c) for c in " \t()") + 1
    token = left[start:]
    if not token or left.count('"') % 2:
        return Context("none")
    if token[0] == "@":
        return Context("alias", token, start=start)
    if any(c in token for c in "><=~"):
        return Context("none")
    field, colon, value = token.partition(":")
    if colon:
        return Context("value", value.removeprefix('"'), field, start + len(field) + 1)
    return Context("name", token, start=start)


def candidates(records: DataFrame, context: Context, aliases: Aliases | None = None) -> list[str]:
    """Completions, sorted; case doesn't matter. Names of fields are few, and values at most ``MOST_VALUES``: both are aggregated before they are fetched."""
    if context.kind == "name":
        found = [r["name"] for r in field_names(records).collect()] + list(KEYWORDS)
    elif context.kind == "value":
        found = [r["value"] for r in field_values(records, context.field).collect()]
    elif context.kind == "alias":
        found = [f"@{n}" for n in (aliases or Aliases()).names()]
    else:
        found = []
    return sorted(x for x in found if x.lower().startswith(context.prefix.lower()))
