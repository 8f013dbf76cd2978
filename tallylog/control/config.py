"""Configuration: a TOML file found from a folder upwards; aliases, views, columns and names of identifiers."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ..operators.trace import ID_NAMES
from ..plans.aliases import Aliases

FILE_NAME = ".tallylog.toml"


class ConfigError(ValueError):
    """A configuration that can't be read."""


@dataclass(frozen=True)
class Named:
    """A query with a name, and the columns to show with it."""

    query: str = ""
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    theme: str = ""
    columns: tuple[str, ...] = ()
    aliases: dict[str, Named] = field(default_factory=dict)
    views: dict[str, Named] = field(default_factory=dict)
    id_fields: tuple[str, ...] = ()

    def registry(self) -> Aliases:
        return Aliases({k: v.query for k, v in self.aliases.items()})

    def id_names(self) -> tuple[str, ...]:
        return self.id_fields or ID_NAMES

    def view_keys(self) -> dict[str, str]:
        """Views by key: 1 to 9 in alphabetical order."""
        return {str(i): name for i, name in enumerate(sorted(self.views)[:9], 1)}


def find_config(start: str | Path = ".") -> Path | None:
    here = Path(start).resolve()
    return next((p / FILE_NAME for p in (here, *here.parents) if (p / FILE_NAME).is_file()), None)


def _named(kind: str, table: object) -> dict[str, Named]:
    out = {}
    for name, value in (table or {}).items():
        if isinstance(value, str):
            out[name] = Named(value)
        elif isinstance(value, dict):
            query, columns = value.get("query"), value.get("columns")
            out[name] = Named(query if isinstance(query, str) else "", tuple(c for c in columns if isinstance(c, str)) if isinstance(columns, list) else ())
        else:
            raise ConfigError(f"invalid {kind} {name!r}: expected string or table")
    return out


def parse_config(text: str) -> Config:
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"parsing config: {e}") from None
    columns, ids = raw.get("columns", []), raw.get("trace", {}).get("id_fields", [])
    return Config(raw.get("theme", ""), tuple(columns), _named("alias", raw.get("aliases")), _named("view", raw.get("views")), tuple(ids))


def load_config(path: str | Path | None) -> Config:
    """The file's configuration; the default one for no file."""
    return parse_config(Path(path).read_text(encoding="utf-8")) if path else Config()
