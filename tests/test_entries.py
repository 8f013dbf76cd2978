import pytest

from tallylog.sources.entries import parse_entry, parse_pairs
from tallylog.sources.jsontext import compact, number_text, strict_loads

BACKSLASH = chr(92)


def test_json():
    r = parse_entry(' {"time":"2026-03-08T10:00:01Z","severity":"WARN","msg":"hi","n":{"key":"v","deep":{"x":1}},"tags":["a",{"b":2.5,"a":"<"}],"none":null,"ok":true,"n1":1.0,"n2":1e3,"n3":1234567.5,"n4":0.00001,"dup":1,"dup":2} ')
    assert (r.ts_us, r.level, r.message) == (1772964001000000, "warn", "hi")
    assert r.fields == {"time": "2026-03-08T10:00:01Z", "severity": "WARN", "msg": "hi", "n.key": "v", "n.deep.x": "1", "tags": '["a",{"a":"%su003c","b":2.5}]' % BACKSLASH, "ok": "true", "n1": "1", "n2": "1000", "n3": "1.2345675e+06", "n4": "1e-05", "dup": "2"}
    assert r.raw.startswith("{") and r.raw.endswith("}")


@pytest.mark.parametrize("text", ['{"a":1} x', "{'a':1}", '{"a":NaN}', '{"a":1e999}', '{"a":', "[1]", "{", '{"a":01}'])
def test_not_json_is_plain(text):
    r = parse_entry(text)
    assert r.fields == {"message": text} and r.message == text


def test_first_time_that_parses():
    assert parse_entry('{"timestamp":"soon","ts":"2026-03-08T10:00:01Z"}').ts_us == 1772964001000000
    assert parse_entry('{"timestamp":"","date":"1772964001"}').ts_us == 1772964001000000
    assert parse_entry('{"level":"","lvl":"E","message":"","text":"t"}')[1:3] == ("error", "t")


@pytest.mark.parametrize("text, want", [
    ('a=1 b=two c="x y"', {"a": "1", "b": "two", "c": "x y"}), ('a="x \\" y" b=', {"a": 'x \\" y', "b": ""}), ("a=1", None), ("word a=1 b=2", None), ("a=1 b=2 word c=3", {"a": "1", "b": "2"}), ("=x a=1 b=2", {"a": "1", "b": "2"}),
    ("a=1 a=2 b=3", {"a": "2", "b": "3"}), ("a=1 a=2", {"a": "2"}), ('a="never ends b=1 c', None), ('z=1 a="never ends b=1', {"z": "1", "a": "never ends b=1"}), ("a=b=c d=e=f", {"a": "b=c", "d": "e=f"}), ("msg=m ts=t lvl=l", {"msg": "m", "ts": "t", "lvl": "l", "message": "m", "timestamp": "t", "level": "l"}),
    ("a=1\nb=2 c=3", {"a": "1\nb=2", "c": "3"}), ("\ta=1\tb=2", {"a": "1", "b": "2"}),
])
def test_pairs(text, want):
    assert parse_pairs(text) == want


@pytest.mark.parametrize("text, ts, level, message, fields", [
    ("2026-03-08 10:00:01 [ERROR] bad", 1772964001000000, "error", "2026-03-08 10:00:01 [ERROR] bad", {"timestamp": "2026-03-08 10:00:01", "level": "error"}),
    ("2026-03-08T10:00:01+0200 INFO x", None, "info", None, {"level": "info"}), ("12:43:10.5 WARNING: x", -62167173409500000, "warn", None, {"timestamp": "12:43:10.5", "level": "warn"}),
    ("08/Mar/2026:10:00:01 +0000 x", 1772964001000000, "", None, {"timestamp": "08/Mar/2026:10:00:01 +0000"}), ("2026/03/08 10:00:01 x", None, "", None, {}), ("ERROR, no", None, "", None, {}), ("xERROR no", None, "", None, {}), ("trace TRACE crit", None, "", None, {}), ("(panic) now", None, "fatal", None, {"level": "fatal"}),
    ("x" * 195 + " ERROR tail", None, "", None, {}), ("x" * 190 + " ERROR tail", None, "error", None, {"level": "error"}),
    ("2026-03-08 10:00:01 ERROR NullPointer\n\n  at a.B\n  at c.D", 1772964001000000, "error", "at a.B", {"timestamp": "2026-03-08 10:00:01", "level": "error"}),
    ("2026-03-08 10:00:01\n---\n-----x\n real\n", 1772964001000000, "", "real", {"timestamp": "2026-03-08 10:00:01"}), ("no time\nsecond", None, "", "no time", {}),
])
def test_plain(text, ts, level, message, fields):
    r = parse_entry(text)
    message = text if message is None else message
    assert (r.ts_us, r.level, r.message, r.fields, r.raw) == (ts, level, message, fields | {"message": message}, text)


def test_blank():
    assert parse_entry("  \n") == (None, "", "", {}, "  \n")


def test_long_line():
    text = '{"m":"' + "x" * 1_000_000 + '"}'
    assert len(parse_entry(text).fields["m"]) == 1_000_000


@pytest.mark.parametrize("value, text, json_text", [
    (1.0, "1", "1"), (-0.5, "-0.5", "-0.5"), (123456.5, "123456.5", "123456.5"), (1234567.5, "1.2345675e+06", "1234567.5"), (0.0001, "0.0001", "0.0001"), (0.00001, "1e-05", "0.00001"), (1e-7, "1e-07", "1e-7"), (2.0**53 + 2, "9007199254740994", "9007199254740994"),
    (1e21, "1e+21", "1e+21"), (1e300, "1e+300", "1e+300"), (1.5e-300, "1.5e-300", "1.5e-300"), (0.1, "0.1", "0.1"), (0.0, "0", "0"),
])
def test_numbers(value, text, json_text):
    assert (number_text(value), compact(value)) == (text, json_text)


def test_compact():
    box = {"b": [True, None, "a&b" + chr(0x2028) + "\n>"], "a": {}}
    escaped = "a_u0026b_u2028_n_u003e".replace("_", BACKSLASH)
    assert compact(box) == '{"a":{},"b":[true,null,"%s"]}' % escaped
