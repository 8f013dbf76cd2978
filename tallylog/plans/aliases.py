"""Names for queries: ``@name`` stands for the query in parentheses, outside quotes."""

from __future__ import annotations

import re
from collections.abc import Mapping

from .language import QueryError

# The names there always are.
BUILTIN = {
    "err": "level:error OR level:fatal",
    "warn": "level:warn OR level:warning",
    "slow": "latency>1000",
}
DEEPEST = 10

_NAME = re.compile(r"@([A-Za-z_]\w*)", re.ASCII)
_SEGMENT = re.compile(r'"[^"]*(?:"|\Z)|[^"]+')


class Aliases:
    """The builtin names and one's own, which go first. ``time_fields`` lets ``@timestamp`` be a field name where no alias has that name."""

    def __init__(self, own: Mapping[str, str] | None = None, time_fields: bool = False) -> None:
        self.queries = BUILTIN | dict(own or {})
        self.time_fields = time_fields

    def names(self) -> list[str]:
        return sorted(self.queries)

    def _once(self, text: str) -> str:
        def put(m: re.Match) -> str:
            if m[1] in self.queries:
                return f"({self.queries[m[1]]})"
            if self.time_fields and m[1] == "timestamp":
                return m[0]
            raise QueryError(f"unknown alias: {m[0]}")

        return "".join(s if s[0] == '"' else _NAME.sub(put, s) for s in _SEGMENT.findall(text))

    def expand(self, text: str) -> str:
        """The query without aliases; QueryError for an unknown one, and for one that contains itself."""
        for _ in range(DEEPEST):
            new = self._once(text)
            if new == text:
                return text
            text = new
        if _NAME.search(text):
            raise QueryError(f"circular alias detected (expansion exceeded {DEEPEST} levels)")
        return text
