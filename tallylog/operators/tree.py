"""JSON records as trees."""

from __future__ import annotations

from collections.abc import Collection, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources.jsontext import number_text, strict_loads


def value_text(value: object) -> str:
    """A leaf as it is shown."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    return number_text(value) if isinstance(value, float) else str(value)


def tree_lines(raw: str | None, collapsed: Collection[str] = ()) -> list[tuple[str, str, str, int, bool, int]]:
    """(path, key, value, depth, is_node, child_count) of each line: objects by key, arrays in order; nothing below collapsed paths.

    Only for an object that has an object or array in it; nothing otherwise.
    """
    text = (raw or "").strip()
    if not text.startswith("{"):
        return []
    try:
        top = strict_loads(text)
    except ValueError:
        return []
    if not any(isinstance(v, (dict, list)) for v in top.values()):
        return []
    out = []

    def walk(path: str, box: dict | list, depth: int) -> None:
        items = [(k, f"{path}.{k}" if path else k, box[k]) for k in sorted(box)] if isinstance(box, dict) else [(f"[{i}]", f"{path}[{i}]", v) for i, v in enumerate(box)]
        for key, where, v in items:
            if isinstance(v, (dict, list)):
                out.append((where, key, "", depth, True, len(v)))
                # Arrays in arrays stay closed.
                if where not in collapsed and not (isinstance(v, list) and isinstance(box, list)):
                    walk(where, v, depth + 1)
            else:
                out.append((where, key, value_text(v), depth, False, 0))

    walk("", top, 0)
    return out


@udtf(returnType="line int, path string, key string, value string, depth int, is_node boolean, child_count int")
class JsonTree:
    def eval(self, raw: str) -> Iterator[tuple]:
        for i, row in enumerate(tree_lines(raw)):
            yield (i, *row)


def register(spark: SparkSession) -> None:
    """``json_tree(raw)`` for SQL: ``SELECT t.* FROM records, LATERAL json_tree(raw) t``."""
    spark.udtf.register("json_tree", JsonTree)


