"""Questions to semi-structured logs, answered by Spark.

>>> logs = read_logs(spark, ["app.jsonl"])
>>> matching(logs, "level:error AND latency>500")
"""

from .operators.catalog import field_names, field_values
from .operators.diff import compare
from .operators.groups import group_counts
from .operators.histogram import histogram
from .operators.patterns import pattern_counts
from .operators.rows import matching
from .plans.aliases import Aliases
from .plans.compiler import compile_query
from .plans.language import QueryError, parse
from .sources.columns import records_from_columns
from .sources.files import read_logs

__all__ = ["Aliases", "QueryError", "compare", "compile_query", "field_names", "field_values", "group_counts", "histogram", "matching", "parse", "pattern_counts", "read_logs", "records_from_columns"]
