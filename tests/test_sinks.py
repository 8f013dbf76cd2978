import io
import json

import pytest

from tallylog.operators.diff import compare
from tallylog.operators.groups import group_counts
from tallylog.operators.patterns import pattern_counts
from tallylog.schema import RECORD
from tallylog.sinks.writers import diff_document, parse_format, save_rows, write_diff, write_groups, write_patterns, write_rows


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (None, 1, 10, "error", "bad 1", {"level": "error", "message": 'bad "1", <x>', "user": "é"}, "raw one"),
        (None, 2, 20, "info", "ok", {"service": "api", "level": "info", "note": "a\nb"}, "raw two"),
        (None, 3, 30, "warn", "bad 2", {"service": "db", "latency": "5"}, "raw three"),
    ]
    return spark.createDataFrame(rows, RECORD).repartition(3)


def text(f, *args, **how):
    out = io.StringIO()
    f(*args[:1], out, *args[1:], **how)
    return out.getvalue()


def test_formats():
    assert [parse_format(x) for x in ("", "raw", "json", "csv")] == ["raw", "raw", "json", "csv"]
    for bad in ("JSON", "xml"):
        with pytest.raises(ValueError):
            parse_format(bad)


def test_rows(records):
    assert text(write_rows, records) == "raw one\nraw two\nraw three\n"
    lines = text(write_rows, records, "json").splitlines()
    assert lines[0] == '{"level":"error","message":"bad \\"1\\", <x>","user":"é"}' and json.loads(lines[1])["note"] == "a\nb"
    assert text(write_rows, records, "csv") == 'latency,level,message,note,service,user\n,error,"bad ""1"", <x>",,,é\n,info,,"a\nb",api,\n5,,,,db,\n'
    assert text(write_rows, records, "csv", ["service", "none"]) == "service,none\n,\napi,\ndb,\n"
    assert text(write_rows, records, "raw", ["service"]) == "raw one\nraw two\nraw three\n"
    nothing = records.where("false")
    assert text(write_rows, nothing, "csv") == text(write_rows, nothing) == ""


def test_saved_by_executors(spark, records, tmp_path):
    for kind in ("raw", "json"):
        save_rows(records, str(tmp_path / kind), kind)
    assert [r[0] for r in spark.read.text(str(tmp_path / "raw")).collect()] and spark.read.text(str(tmp_path / "raw")).count() == 3
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    save_rows(records, str(tmp_path / "csv"), "csv", ["message", "service"])
    assert {r[0] for r in spark.read.text(str(tmp_path / "csv")).collect()} == {'"bad ""1"", <x>",', ",api", ",db"}


def test_groups(records):
    groups = group_counts(records, "service")
    assert text(write_groups, groups) == "VALUE    COUNT\n(empty)  1\napi      1\ndb       1\n"
    assert json.loads(text(write_groups, groups, "json"))[0] == {"value": "(empty)", "count": 1}
    assert text(write_groups, groups, "csv") == "value,count\n(empty),1\napi,1\ndb,1\n"
    assert text(write_groups, groups.where("false")) == "" and text(write_groups, groups.where("false"), "csv") == "value,count\n"


def test_patterns(records):
    found = pattern_counts(records)
    assert text(write_patterns, found) == " COUNT  TEMPLATE\n     2  bad <num>\n     1  ok\n"
    assert text(write_patterns, found, "csv") == "template,count\nbad <num>,2\nok,1\n"
    assert json.loads(text(write_patterns, found, "json")) == [{"template": "bad <num>", "count": 2}, {"template": "ok", "count": 1}]


def test_diff(records):
    c = compare(records, records.where("line_number > 1"))
    d = diff_document(c, "a", "b")
    assert d["left"] == {"name": "a", "records": 3, "patterns": 2} and d["changed_patterns"] == [{"template": "bad <num>", "left": 2, "right": 1, "change": "-50%"}] and d["new_patterns"] == d["gone_patterns"] == []
    assert d["levels"] == [{"level": "error", "left": 1, "right": 0, "change": "-100%"}, {"level": "warn", "left": 1, "right": 1, "change": "0%"}, {"level": "info", "left": 1, "right": 1, "change": "0%"}]
    table = text(write_diff, c, "a", "b")
    assert "  Records                     3        2     -33%\n" in table and "  New Patterns (0 only in b)\n    (none)\n" in table and "         2        1     -50%  bad <num>\n" in table
    assert json.loads(text(write_diff, c, "a", "b", "json")) == d
    assert "  Changed Patterns (>60% change)\n    (none)\n" in text(write_diff, c, "a", "b", threshold=60.0)
    gone = text(write_diff, compare(records, records.where("false")), "a", "b", top=1)
    assert "  Gone Patterns (2 only in a)\n       2  bad <num>\n\n" in gone
