"""Conditions against a plain evaluator of the language, over records with missing fields and odd values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallylog.functions.numbers import parse_double
from tallylog.functions.timestamps import parse_timestamp
from tallylog.operators.rows import matching
from tallylog.plans import language as q
from tallylog.plans.compiler import compile_node, compile_query, promote
from tallylog.schema import RECORD
from tallylog.sources.entries import parse_entry

NOW = 1_772_964_600_000_000


def records():
    lines = [
        '{"timestamp":"2026-03-08T10:00:01Z","level":"WARNING","service":"api","latency":1200,"message":"Timeout after 3s"}',
        '{"timestamp":"2026-03-08T10:00:05.5Z","level":"error","service":"db","latency":"12f","message":"user 42 \\u212a"}',
        '{"ts":"2026-03-08 10:09:00","lvl":"E","latency":" 5 ","n":{"a":1.5}}', '{"level":"custom","latency":-1e3,"v":"inf"}',
        "ts=2026-03-08T10:05:00Z level=warn latency=0x10 msg=\"a \\\"b\\\" c\"", "2026-03-08 10:00:07 [ERROR] plain TIMEOUT text\n  at x.Y", "no time here", "{broken json", "", '{"a":""}', "Mar  8 10:00:09 host app: INFO: ok",
        '{"date":"2026-03-08T10:00:00Z","message":"line\\nbreak"}',
    ]
    return [parse_entry(x) for x in lines]


def holds(n, r):
    f = r.fields
    match n:
        case q.MatchAll():
            return True
        case q.FieldMatch(name, v):
            return f.get(name) == v or (name == "level" and r.level == v != "")
        case q.FieldCompare(name, op, v) | q.TimeCompare(name, op, v):
            timed = isinstance(n, q.TimeCompare)
            a = r.ts_us if timed else parse_double(f[name]) if name in f else None
            b = parse_timestamp(v) if timed else parse_double(v)
            return a is not None and b is not None and {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
        case q.RelativeTime(d):
            return r.ts_us is not None and r.ts_us >= NOW - q.duration_micros(d)
        case q.FieldRegex(name, p):
            try:
                return name in f and re.search(p, f[name], re.ASCII) is not None
            except re.error:
                return False
        case q.FullText(t):
            low = lambda s: "".join(c.lower() if c < "\x80" else c for c in s)
            return any(low(t) in low(v) for v in f.values())
        case q.And(a, b):
            return holds(a, r) and holds(b, r)
        case q.Or(a, b):
            return holds(a, r) or holds(b, r)
        case q.Not(a):
            return not holds(a, r)


LEAVES = [
    q.MatchAll(), q.FieldMatch("level", "warn"), q.FieldMatch("level", "WARNING"), q.FieldMatch("level", "error"), q.FieldMatch("service", "api"), q.FieldMatch("absent", "x"), q.FieldMatch("a", ""),
    q.FieldCompare("latency", ">", "0"), q.FieldCompare("latency", "<=", "-1000"), q.FieldCompare("latency", ">=", "1d"), q.FieldCompare("v", ">", "1e308"), q.FieldCompare("n.a", "<", "1.6"), q.FieldCompare("latency", "<", "nan"),
    q.TimeCompare("ts", ">=", "2026-03-08T10:00:05Z"), q.TimeCompare("time", "<", "2026/03/08 10:00:06"), q.TimeCompare("t", ">", "soon"), q.TimeCompare("t", "<", "1772964302"),
    q.RelativeTime("5m"), q.RelativeTime("1d"), q.FieldRegex("message", "^a"), q.FieldRegex("message", "(?i)timeout"), q.FieldRegex("message", "("), q.FieldRegex("service", "a|b"),
    q.FullText("TIMEOUT"), q.FullText("k"), q.FullText(""), q.FullText("break"), q.FullText("12f"),
]


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice(LEAVES)
    kind = rng.choice([q.And, q.Or, q.Not])
    return kind(tree(rng, depth - 1)) if kind is q.Not else kind(tree(rng, depth - 1), tree(rng, depth - 1))


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(None, i, *r) for i, r in enumerate(records())]
    return spark.createDataFrame(rows, RECORD).cache()


def test_leaves_and_random_trees(frame):
    rng = random.Random(4)
    nodes = [*LEAVES, *[q.Not(x) for x in LEAVES], *[tree(rng, 4) for _ in range(60)]]
    rows = records()
    for low in range(0, len(nodes), 40):
        part = nodes[low : low + 40]
        got = frame.orderBy("line_number").select(*[compile_node(n, now_us=NOW).alias(f"n{i}") for i, n in enumerate(part)]).collect()
        for i, n in enumerate(part):
            kept = {r["line_number"] for r in frame.where(compile_node(n, now_us=NOW, for_filter=True)).collect()} if i % 4 == 0 else None
            assert kept is None or kept == {k for k, r in enumerate(rows) if holds(n, r)}, n
            assert [r[i] for r in got] == [holds(n, r) for r in rows], n


def test_promoted_columns_agree(frame):
    text = "level:warn OR latency>0 AND NOT service~\"^d\""
    a = {r["line_number"] for r in frame.where(compile_query(text)).collect()}
    wide = promote(frame, ["level", "latency", "service"])
    assert {r["line_number"] for r in wide.where(compile_query(text, promoted=["level", "latency", "service"])).collect()} == a


def test_promoted_columns_are_pushed_down(frame, tmp_path):
    promote(frame, ["service"]).write.parquet(str(tmp_path / "r"))
    df = frame.sparkSession.read.parquet(str(tmp_path / "r"))
    df = matching(df, "service:api AND level:warn")
    assert "EqualTo(f_service,api)" in df._jdf.queryExecution().toString()


def test_raw_is_searched_on_request(frame):
    find = lambda **how: {r["line_number"] for r in frame.where(compile_query('"at x.y"', **how)).collect()}
    assert find() == {5}  # the message of an entry of several lines is its first line that says something
    find = lambda **how: {r["line_number"] for r in frame.where(compile_query('"10:00:07 [error]"', **how)).collect()}
    assert find() == set()
    assert 5 in find(search_raw=True)


def test_conditions_are_never_null(frame):
    nodes = [compile_node(n, now_us=NOW) for n in LEAVES]
    assert frame.select(*[F.count_if(n.isNull()).alias(f"c{i}") for i, n in enumerate(nodes)]).first() == tuple([0] * len(nodes))
