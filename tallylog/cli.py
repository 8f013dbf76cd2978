"""Command line: ``python -m tallylog.cli [files] -q QUERY`` or ``python -m tallylog.cli diff BEFORE AFTER``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from typing import TextIO

from .control.config import Config, ConfigError, find_config, load_config
from .operators.diff import THRESHOLD, compare
from .operators.groups import group_counts
from .operators.patterns import pattern_counts
from .operators.rows import matching
from .plans.language import QueryError
from .session import get_session
from .sinks.writers import parse_format, write_diff, write_groups, write_patterns, write_rows
from .sources.files import from_lines, read_logs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallylog", description="Questions to log files.")
    p.add_argument("files", nargs="*")
    p.add_argument("-q", dest="query", default="", help="a filter")
    p.add_argument("-o", dest="output", help="a file for the rows")
    p.add_argument("--format", default="", help="raw, json or csv")
    p.add_argument("--count", action="store_true", help="only how many match")
    p.add_argument("--patterns", action="store_true", help="templates of messages")
    p.add_argument("--group-by", default="", help="counts by a field")
    p.add_argument("--top", type=int, default=0, help="only so many")
    p.add_argument("--columns", default="", help="fields for CSV, with commas between")
    p.add_argument("--view", default="", help="a view's name or key")
    return p


def diff_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallylog diff")
    p.add_argument("before")
    p.add_argument("after")
    p.add_argument("-q", dest="query", default="")
    p.add_argument("--format", default="table")
    p.add_argument("--top", type=int, default=0)
    p.add_argument("--threshold", type=float, default=THRESHOLD)
    return p


def _config(err: TextIO) -> Config:
    try:
        return load_config(find_config())
    except (ConfigError, OSError) as e:
        err.write(f"Warning: {e}\n")
        return Config()


def run(args: Sequence[str], spark=None, stdin: TextIO = sys.stdin, out: TextIO = sys.stdout, err: TextIO = sys.stderr, config: Config | None = None) -> int:
    """The exit code. Counts go before patterns, patterns before groups, groups before rows."""
    config = config or _config(err)
    aliases = config.registry()
    try:
        if args[:1] == ["diff"]:
            a = diff_parser().parse_args(args[1:])
            spark = spark or get_session()
            left, right = (matching(read_logs(spark, [f]), a.query, aliases) for f in (a.before, a.after))
            base = lambda p: p.rstrip("/").rsplit("/", 1)[-1]
            write_diff(compare(left, right), out, base(a.before), base(a.after), a.format, a.top, a.threshold)
            return 0
        a = parser().parse_args(args)
        kind, query, columns = parse_format(a.format), a.query, [c for c in a.columns.split(",") if c] or list(config.columns)
        if a.view:
            view = config.views[config.view_keys().get(a.view, a.view)]
            query, columns = query or view.query, columns or list(view.columns)
        spark = spark or get_session()
        records = read_logs(spark, a.files) if a.files else from_lines(spark, stdin.readlines())
        if records.isEmpty():
            err.write("No records found.\n")
            return 1
        found = matching(records, query, aliases)
        if a.count:
            out.write(f"{found.count()}\n")
            return 0
        with open(a.output, "w", encoding="utf-8", newline="") if a.output else _same(out) as to:
            if a.patterns:
                write_patterns(pattern_counts(found, a.top), to, kind)
            elif a.group_by:
                write_groups(group_counts(found, a.group_by, a.top), to, kind)
            else:
                n = write_rows(found, to, kind, columns)
                if a.output:
                    err.write(f"{n} records written to {a.output}\n")
        return 0
    except (QueryError, ValueError, KeyError, OSError) as e:
        err.write(f"{e}\n")
        return 1


class _same:
    """A stream that isn't to be closed."""

    def __init__(self, stream: TextIO) -> None:
        self.stream = stream

    def __enter__(self) -> TextIO:
        return self.stream

    def __exit__(self, *_) -> None:
        pass


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
