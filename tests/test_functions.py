import pytest
from pyspark.sql import functions as F

from tallylog.functions import changes, ids, levels, numbers, templates, text, timestamps


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


NUMBERS = ["1", "-2.5", "+3", ".5", "5.", "1e3", "1E-2", "1d", "12f", "1.5D", " 5 ", "", "inf", "-Infinity", "nan", "1e999", "0x10", "1_000", "٣", "1\n", "e5", ".", "--1"]
LEVELS = ["DEBUG", "dbg", "D", "trace", "trc", "Info", "inf", "i", "information", "WARN", "warning", "wrn", "w", "error", "ERR", "e", "fatal", "ftl", "F", "critical", "crit", "panic", "dpanic", " error ", "notice", " Odd ", ""]


def test_numbers(spark):
    got = column(spark, NUMBERS, numbers.strict_double)
    assert got == [numbers.parse_double(x) for x in NUMBERS]
    assert got[:7] == [1.0, -2.5, 3.0, 0.5, 5.0, 1000.0, 0.01] and got[7:12] == [None] * 5
    assert got[12:16] == [float("inf"), float("-inf"), None, None] and got[16:] == [None] * 7


def test_levels(spark):
    assert column(spark, LEVELS, levels.normalize_level) == [levels.level_of(x) for x in LEVELS]
    assert [levels.level_of(x) for x in ("WARNING", "E", " crit ", "Odd")] == ["warn", "error", "fatal", "odd"]


@pytest.mark.parametrize("value, want", [
    ("2026-03-08T10:00:01Z", 1772964001000000), ("2026-03-08T10:00:01.123456789Z", 1772964001123456), ("2026-03-08T12:00:01+02:00", 1772964001000000), ("2026-03-08T12:00:01+0200", None),
    ("2026-03-08 10:00:01", 1772964001000000), ("2026-03-08 10:00:01.5", 1772964001500000), ("2026-03-08T10:00:01", 1772964001000000), ("2026-03-08 10:00:01Z", None), ("08/Mar/2026:10:00:01 +0000", 1772964001000000),
    ("Sun Mar  8 10:00:01 UTC 2026", 1772964001000000), ("Sun Mar 08 10:00:01 +0000 2026", 1772964001000000), ("2026/03/08 10:00:01", 1772964001000000), ("1772964001", 1772964001000000), ("1772964001.5", 1772964001500000),
    ("1772964001000", 1772964001000000), ("999999999", None), ("2026-02-30 10:00:00", None), ("2026-03-08 24:00:00", None), ("2026", None), ("2026-03-08", None), ("T10:00", None), ("10:00:01", None), ("", None), (" 1772964001 ", 1772964001000000),
    ("Mar  8 12:43:10", -62161384610000000), ("Feb 29 00:00:00", -62162121600000000), ("nan", None),
])
def test_timestamps(value, want):
    assert timestamps.parse_timestamp(value) == want


TEMPLATES = {
    "Connection timeout to 10.0.1.5:5432 after 3000ms": "Connection timeout to <ip>:<num> after <duration>", "user 1234567890123456 x": "user <hex> x", "Disk full on /var/log/app": "Disk full on <path>",
    "GET /users 200": "GET /users <num>", "id 550e8400-e29b-41d4-a716-446655440000.": "id <uuid>.", "at 2026-03-08T10:00:01.5Z": "at <timestamp>", "é5 5é 5": "é<num> <num>é <num>", "took 4.5s and 2h": "took <duration> and <duration>",
    "v1.2.3": "v1.<num>", "abc": "abc", "": "", "999.1.1.1 1.2.3.4.5": "<ip> <ip>.<num>", "0x1f": "0x1f", "12µs": "<duration>",
}


def test_templates(spark):
    got = column(spark, list(TEMPLATES), templates.templatize)
    assert got[:11] == list(TEMPLATES.values())[:11] and got[11:] == list(TEMPLATES.values())[11:]


def test_names_and_ids(spark):
    names = ["traceId", "x-request-id", "trace.id", "TraceID", "a_b", "éÉ", "ID"]
    assert column(spark, names, ids.normalize_name) == [ids.name_of(n) for n in names] == ["trace_id", "x_request_id", "trace_id", "trace_id", "a_b", "é_é", "id"]
    values = ["550e8400-e29b-41d4-a716-446655440000", "a" * 16, "a" * 15, "g" * 16, "a" * 16 + "\n", ""]
    assert column(spark, values, ids.is_uuid) == [True] + [False] * 5
    assert column(spark, values, ids.is_hex_id) == [False, True] + [False] * 4


def test_text(spark):
    values = ["AbC", "É", "K", ""]
    assert column(spark, values, text.ascii_lower) == ["abc", "É", "K", ""]
    assert column(spark, values, lambda c: text.contains_ci(c, "B")) == [True, False, False, False]


def test_changes(spark):
    pairs = [(0, 0), (0, 5), (5, 0), (4, 4), (8, 9), (8, 7), (1000, 1001), (1000, 999), (2, 5)]
    assert [changes.format_change(a, b) for a, b in pairs] == ["-", "new", "-100%", "0%", "+12%", "-12%", "+0%", "-0%", "+150%"]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a long, b long").orderBy("i")
    assert [r[0] for r in df.select(changes.change_percent(F.col("a"), F.col("b"))).collect()] == pytest.approx([changes.percent_of(a, b) for a, b in pairs])
    assert [changes.format_size(n) for n in (5, 1536, 2 << 20, 3 << 30)] == ["5B", "1.5KB", "2.0MB", "3.0GB"]
