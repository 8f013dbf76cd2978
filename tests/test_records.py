"""Records read inside the JVM are those of ``parse_entry``, entry by entry."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallylog.sources.entries import parse_entry
from tallylog.sources.files import read_logs
from tallylog.sources.records import sure_records, with_records

TIMES = ["2026-03-08T10:00:01Z", "2026-03-08T10:00:01.123456789+02:00", "2026-03-08 10:00:01.5", "2026-03-08T10:00:01", "1772964001", "1772964001123", "999999999", "2026-02-30T10:00:01Z", "2026-03-08T24:00:00Z", "2026-03-08T10:00:60Z",
         "0000-01-01T00:00:00Z", "0001-01-01 00:00:00", "9999-12-31T23:59:59.999999Z", "2026-03-08T10:00:01+19:00", "2026-03-08T10:00:01z", "2026-03-08 10:00:01Z", "2026-03-08T10:00:01,5", "2026-03-08T1:00:01Z", " 2026-03-08T10:00:01Z ", "soon", "", "  ",
         "08/Mar/2026:10:00:01 +0000", "Sun Mar  8 10:00:01 UTC 2026", "Mar  8 10:00:01", "2026/03/08 10:00:01", "1772964001.5", "-62135596800"]
JSON = ['{"a":1}', '{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1}],[{}', '{"a":1},7],{}', '{"a":1,"a":2}', '{"a":NaN}', '{"a":01}', "{'a':1}", '{"a":1e999}', '{"a":1e3}', '{"a":1.0,"b":-0,"c":-0.0,"d":-0.5}', '{"a":1.50}', '{"a":0.0001,"b":0.00001}', '{"a":999999.5,"b":1000000.5}',
        '{"a":123456789012345,"b":1}', '{"a":9007199254740993}', '{"a":12345678901234567890}', '{"a":0.1234567890123}', '{"":1}', '{"a":{"":1}}', '{}', '{"a":{}}', '{"a":[]}', '{"a":[-0]}', '{"a":[-0.5,1.5,1.0,0.25,100000.5,1e3]}', '{"a":[[1,[2,{"z":1,"y":[true,null]}]]]}', '{"a":["<"]}', '{"a":["é"]}', '{"a":["a\\"b"]}',
        '{"a.b":1,"a":{"b":2}}', '{"a":{"b":{"c":{"d":{"e":1}}}}}', '{"a":{"b":{"c":{"d":1}}},"x":"y"}', '{"a":"tab\there"}', '{"a":"\\u00e9\\n\\t\\\\"}', '{"a":"\\ud83d\\ude00"}', '{"a":null,"b":false,"c":true}', '{"msg":"","message":"x","text":"t"}', '{"level":"","lvl":" E "}', '{"level":"Odd Level"}', '{"a":1,}', '{"a"', '[1]', '{"a":"' + "x" * 5000 + '"}',
        '{"message":"a=1 b=2 {"}', ' {"a" : 1 }\n', '{"a":"2026-03-08","b":"1e5","c":"-0"}', '{"a":123456.5,"b":[1e5]}', '{"ts":"2026-03-08T10:00:01Z","n":{"key":"v","deep":{"x":1}},"tags":["a",{"b":2.5,"a":"x"}]}', '{"a":[9999999999]}', '{"a":[0.12345678]}', '{"a":[1.0e2]}', '{"k":"ı","level":"ınfo"}']
PAIRS = ['a=1 b=two c="x y"', 'a="x \\" y" b=', "a=1", "word a=1 b=2", "a=1 b=2 word c=3", "=x a=1 b=2", "a=1 a=2 b=3", "a=1 a=2", 'a="never ends b=1 c', 'z=1 a="never ends b=1', "a=b=c d=e=f", "msg=m ts=t lvl=l", "a=1\nb=2 c=3", "\ta=1\tb=2", 'a="x\\', 'a="x" b="y"c=2', 'a=""b=1', 'a="' + "\\\\" * 300 + '" b=1', "ts=2026-03-08T10:00:01Z level=error msg=a",
         "msg=m message=n x=y", 'x="é" y=ü', "a= b= c=", "==", "= =", "a==b c=d", 'k="multi\nline" l=2', "{a=1 b=2", "a=1 b=2 {", "x=1  y=2", "2026-03-08 10:00:01 ERROR a=1 b=2", "2026-03-08 10:00:01 ERROR took=5ms"]
PLAIN = ["", " \n", "hello", "2026-03-08 10:00:01 [ERROR] bad", "2026-03-08T10:00:01+0200 INFO x", "2026-03-08T10:00:01+02:00 INFO x", "2026-03-08T10:00:01.123Z warn", "12:43:10.5 WARNING: x", "08/Mar/2026:10:00:01 +0000 x", "Mar  8 10:00:01 host ERR x", "2026/03/08 10:00:01 x", "ERROR, no", "xERROR no", "trace TRACE crit", "(panic) now", "x" * 195 + " ERROR tail", "x" * 190 + " ERROR tail",
         "é" * 150 + " ERROR tail", "é" * 60 + " ERROR tail", "2026-03-08 10:00:01 ERROR NullPointer\n\n  at a.B\n  at c.D", "2026-03-08 10:00:01\n---\n-----x\n real\n", "no time\nsecond", "2026-02-30 10:00:01 x", "2026-03-08 10:00:01Z x", " 2026-03-08 10:00:01 x ", "2026-03-08 10:00:01\n\n\n\n\nlate\nlater", "2026-03-08 10:00:01\n", "warn", "[info]", "a\x1cb", "\x1c", "\u0085x\u0085", "  2026-03-08 10:00:01 x", "ınfo ERROR", "INFORMATIONAL INFO:", "2026-03-08 10:00:01 " + "y" * 70 + "\nnext"]


def made(seed, n=400):
    rng, out = random.Random(seed), []
    bits = list(' \t\n"\\={}[],:.-+eE019azé<&') + ["true", "null", '"a":', '"k":"v"', "a=b ", '="x"', "ERROR ", "2026-03-08", "T10:00:01", "Z", " 10:00:01", "\\u00e9"]
    for _ in range(n):
        out.append("".join(rng.choice(bits) for _ in range(rng.randint(1, 14))))
        inner = [rng.choice([1, -2, 0.5, 1e-5, 12.25, 1e16, True, None, "x", "é", "a<b", [], {}, [1, 2], {"p": 1}, {"p": {"q": [0.5, "s"]}}]) for _ in range(3)]
        out.append(json.dumps({rng.choice(["time", "level", "message", "a", "b"]): v for v in inner}, ensure_ascii=rng.random() < 0.5))
        out.append(" ".join(f"{rng.choice('abcmsg')}={rng.choice(['1', 'x', chr(34) + 'q w' + chr(34), '', 'y=z'])}" for _ in range(rng.randint(1, 4))))
    return out


def compare(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = {r["i"]: r["_record"] for r in with_records(df, F.col("text")).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r["ts_us"], r["level"], r["message"], r["fields"], r["raw"]) == tuple(parse_entry(text or "")), text


@pytest.mark.parametrize("texts", [JSON, PAIRS, PLAIN, [*[f'{{"time":{json.dumps(t)},"ts":"2026-03-08T11:00:00Z"}}' for t in TIMES], *[f'x="y" ts="{t}" a=b' for t in TIMES], *[f"{t} INFO x" for t in TIMES], None]], ids=["json", "pairs", "plain", "times"])
def test_as_in_python(spark, texts):
    compare(spark, texts)


@pytest.mark.parametrize("seed", range(3))
def test_as_in_python_on_anything(spark, seed):
    compare(spark, made(seed))


def test_common_entries_never_reach_python(spark):
    texts = ['{"time":"2026-03-08T10:00:01.123Z","severity":"WARN","user":7,"msg":"hi \\"you\\"","nested":{"v":12.5,"w":{"x":[1,"a"]}},"none":null}', 'ts=2026-03-08T10:00:01Z level=error msg="it is" took=5ms', "2026-03-08 10:00:01.123 [ERROR] it failed\n  at a.B\n  at c.D", "just words", "  "]
    df = sure_records(spark.createDataFrame([(t,) for t in texts], "text string"), F.col("text"))
    assert all(r["__sure"] for r in df.select("__sure").collect())


def test_only_refused_ones_are_handed_over(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a":1}\n{"a":1e3}\n')
    plan = read_logs(spark, [str(path)])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "CASE WHEN isnull(__sure" in plan.replace("#", " #").replace(" #", "#")


def test_flat_objects(spark):
    texts = ['{"a":"x","b":1,"c":-2.5,"d":true,"e":null}', '{ "a" : "x" ,\n"b":\t1 }', '{"a":"b:c,d}","k":"{"}', '{"a":""}', '{"a":"x",}', '{"a":"x" "b":1}', '{,"a":1}', '{"a":-0}', '{"a":1.10}', '{"a":0.00001}', '{"a":0.0001}', '{"a":-0.00005}', '{"a":1.}', '{"a":00}', '{"a":tru}', '{"a":truex}', '{"a":1}}', '{"a":1} ', '{"a":"x","a":null}', '{"a":null,"a":null}',
             '{"a":1,"a":1}', '{"a":"null","b":"true"}', '{"a":123456789012345}', '{"a":1234567890123456}', '{"a":1e5}', '{"a":1.5e5}', '{"a":"é","ü":"ß"}', '{"a":"x\ty"}', '{"a":"\x7f"}', '{"a":-}', '{"a":"1","level":"WARN","time":"1772964001"}', '{"a":999999.5}', '{"a":1999999.5}', '{"a":1 2}', '{"a":"b"c}', '{"":1}', '{"a":- 1}', '{"a":.5}', '{"a":-.5}', "{ }"]
    compare(spark, texts)
    compare(spark, ["{" + ",".join(f'"k{i}":"{"v" * 500}"' for i in range(300)) + "}"])


def test_nested_objects(spark):
    texts = ['{"a":{"x":1},"a":{"y":2}}', '{"a":{"x":1,"x":2}}', '{"a":null,"a":{"x":1}}', '{"n":{"v":235.0,"w":"235.0","x":1.50,"y":0.0,"z":0.0001}}', '{"n":{"v":1000000.0,"w":0.00001}}', '{"n":{"v":"1\\u002e0","w":"\\u007b","x":"{","y":"[1]"}}', '{"n":{"v":-0,"w":-0.0}}', '{"n":{"a":[1.0,2.50,0.0,-0.5]}}', '{"n":{"a":[ "x" , { "b" : 1 , "a" : null } ]}}', '{"n":{"a":[{"z":1,"z":2}]}}',
             '{"n":{"":1}}', '{"":{"a":1}}', "{'n':{'a':1}}", '{"n":{"a":NaN}}', '{"n":{"a":01}}', '{"n":{"a":1,}}', '{"n":{"a":1}} x', '{"n":{"a":1}}],[{}', '{"n":{"a":1}},{"b":2}', '{"n":{"a":1}', '{"n":{"a":tru}}', '{"n":{"a":{"b":{"c":{"d":1}}}}}', '{"n":{"a":{"b":{"c":{}}}}}', '{"n":{"v":"1.10","w":"-2.0","x":"10"}}', '{"n":{"v":10,"w":100,"x":-20.0}}', '{"n":{"a":"\\/\\"\\\\"}}', '{"n":{"a":"12\\n"}}', '{"n":{"v":1.0E3}}', '{"n" "a"}', '{"n":{"a" 1}}', '{"n":{"a":"x""b":1}}']
    compare(spark, texts)
    texts = ['{"n":{"range":"-0]","tags":["a"]},"id":"7e5"}', '{"n":{"v":235.0,"deep":{"tags":["x", {"n": [235, true], "a": null}], "none": null}}}']
    assert all(r["__sure"] for r in sure_records(spark.createDataFrame([(t,) for t in texts], "text string"), F.col("text")).select("__sure").collect())
