import pytest
from pyspark.sql import functions as F

from tallylog.operators import catalog, diff, groups, histogram, patterns, rows, trace
from tallylog.operators.highlight import Term, match_ranges, ranges_in, terms_of
from tallylog.operators.tree import register, tree_lines
from tallylog.plans.language import parse
from tallylog.schema import RECORD

START = 1_772_964_000_000_000
LEVELS, SERVICES = ("info", "error", "warn", "debug"), ("api", "auth", "db", "cache")


@pytest.fixture(scope="module")
def records(spark):
    made = []
    for i in range(20):
        fields = {"level": LEVELS[i % 4], "service": SERVICES[i % 4], "latency": str((i + 1) * 100), "message": f"message {i}"}
        made.append((None, i + 1, START + i * 1_000_000, LEVELS[i % 4], f"message {i}", fields, f"raw {i}"))
    return spark.createDataFrame(made, RECORD).cache()


def make(spark, items):
    return spark.createDataFrame([(None, i, it.get("ts"), it.get("level", ""), it.get("message", ""), it.get("fields", {}), it.get("raw", "")) for i, it in enumerate(items)], RECORD)


def found(df, query, **how):
    return [r["line_number"] for r in rows.matching(df, query, **how).orderBy("line_number").collect()]


def test_filters(records):
    assert len(found(records, "level:error")) == 5
    assert found(records, "latency>1800") == [19, 20] and found(records, "latency>=1800") == [18, 19, 20] and found(records, "latency<200") == [1] and found(records, "latency<=200") == [1, 2]
    assert found(records, "level:error AND latency>1000") == [14, 18] and found(records, "service:api OR service:db AND latency<400") == [1, 3, 5, 9, 13, 17]
    assert found(records, 'ts>"2026-03-08T10:00:17Z"') == [19, 20] and found(records, "last:5s", now_us=START + 20_000_000) == [16, 17, 18, 19, 20]
    assert found(records, '"message 1"') == [2, *range(11, 21)] and found(records, "raw") == [] and len(found(records, "raw", search_raw=True)) == 20
    assert len(found(records, "")) == 20 and len(found(records, "NOT nothing:x")) == 20


def test_groups(spark, records):
    assert [tuple(r) for r in groups.group_counts(records, "service").collect()] == [("api", 5), ("auth", 5), ("cache", 5), ("db", 5)]
    assert [tuple(r) for r in groups.group_counts(records, "service", 2).collect()] == [("api", 5), ("auth", 5)]
    odd = make(spark, [{"fields": {"s": "b"}}, {"fields": {"s": ""}}, {}, {"fields": {"s": "a"}}, {"fields": {"s": "b"}}])
    assert [tuple(r) for r in groups.group_counts(odd, "s").collect()] == [("(empty)", 2), ("b", 2), ("a", 1)]
    assert groups.group_counts(odd, "s", -1).count() == 3 and groups.group_counts(odd.where("false"), "s").collect() == []
    assert {tuple(r) for r in groups.level_counts(records).collect()} == {(x, 5) for x in LEVELS} and groups.level_counts(odd).collect() == []
    assert rows.count(odd).first()["count"] == 5


def buckets(df, n):
    return [tuple(r) for r in histogram.histogram(df, n).orderBy("bucket").collect()]


def test_histogram(spark, records):
    got = buckets(records, 4)
    assert [b[3:] for b in got] == [(5, 1), (5, 2), (5, 1), (5, 1)] and got[0][1:3] == (START, START + 4_750_000)
    same = make(spark, [{"ts": START, "level": "fatal"}] * 3)
    assert buckets(same, 2) == [(0, START, START + 500_000, 3, 3), (1, START + 500_000, START + 1_000_000, 0, 0)]
    thirds = make(spark, [{"ts": START + x} for x in (0, 1, 2, 9, 10)])
    assert [b[3] for b in buckets(thirds, 3)] == [3, 0, 2]
    assert buckets(records, 0) == [] and buckets(records.where("false"), 5) == [] and buckets(make(spark, [{}]), 5) == []
    assert sum(b[3] for b in buckets(make(spark, [{"ts": START}, {}, {"ts": START + 7}]), 7)) == 2


def test_patterns(spark, records):
    assert [tuple(r) for r in patterns.pattern_counts(records).collect()] == [("message <num>", 20)]
    odd = make(spark, [{"message": "b 1"}, {"message": "a"}, {"message": "b 2"}, {"raw": "raw 7"}])
    assert [tuple(r) for r in patterns.pattern_counts(odd).collect()] == [("b <num>", 2), ("a", 1), ("raw <num>", 1)]
    assert [tuple(r) for r in patterns.pattern_counts(odd, 1, share=True).collect()] == [("b <num>", 2, 50.0)]
    assert patterns.of_pattern(odd, "b <num>").count() == 2


def test_diff(spark):
    before = make(spark, [{"level": "error", "message": "timeout 1"}, {"level": "error", "message": "timeout 2"}, {"level": "info", "message": "start"}, {"level": "odd", "message": "gone"}])
    after = make(spark, [{"level": "error", "message": "timeout 9"}, {"level": "warn", "message": "new 1"}, {"level": "warn", "message": "new 2"}, {"level": "info", "message": "start"}, {"level": "info", "message": "fresh"}])
    c = diff.compare(before, after)
    got = {r["template"]: (r["kind"], r["left"], r["right"], r["percent"]) for r in c.patterns.collect()}
    assert got == {"timeout <num>": ("changed", 2, 1, -50.0), "start": ("changed", 1, 1, 0.0), "gone": ("gone", 1, 0, -100.0), "new <num>": ("new", 0, 2, 100.0), "fresh": ("new", 0, 1, 100.0)}
    assert [tuple(r) for r in c.levels.collect()] == [("error", 2, 1), ("warn", 0, 2), ("info", 1, 2)]
    assert tuple(c.summary.first()) == (4, 5, 3, 4)
    names = lambda kind, **how: [r["template"] for r in diff.section(c, kind, **how).collect()]
    assert names("new") == ["new <num>", "fresh"] and names("new", top=1) == ["new <num>"] and names("gone") == ["gone"]
    assert names("changed") == ["timeout <num>"] and names("changed", threshold=0.0) == ["timeout <num>", "start"] and names("changed", threshold=51.0) == []
    empty = diff.compare(before.where("false"), after.where("false"))
    assert empty.patterns.collect() == [] and tuple(empty.summary.first()) == (0, 0, 0, 0)


def test_trace(spark):
    uuid, hexid = "550e8400-e29b-41d4-a716-446655440000", "a" * 16
    df = make(spark, [{"fields": {"zid": uuid, "traceId": "t", "x-request-id": "r", "trace_id": "", "b": hexid, "c": "plain"}}, {}])
    got = trace.detect_ids(df).orderBy("line_number").collect()
    assert [tuple(x) for x in got[0]["ids"]] == [("traceId", "t", True), ("x-request-id", "r", True), ("b", hexid, False), ("zid", uuid, False)] and got[1]["ids"] == []
    assert [x["name"] for x in trace.detect_ids(df, ["c"]).orderBy("line_number").first()["ids"]] == ["c", "b", "zid"]
    assert trace.build_query("a", "x-1_2.é") == "a:x-1_2.é" and trace.build_query("a", "x y") == 'a:"x y"' and trace.build_query("a", "x:y") == 'a:"x:y"'
    assert trace.follow_traces(df, spark.createDataFrame([("t",), ("t",), ("u",)], "value string"), "traceId").count() == 1


def test_catalog(spark, records):
    names = lambda df: [r["name"] for r in catalog.field_names(df).collect()]
    values = lambda df, f: [r["value"] for r in catalog.field_values(df, f).collect()]
    assert names(records) == ["latency", "level", "message", "service"] and values(records, "service") == sorted(SERVICES)
    odd = make(spark, [{"level": "warn", "fields": {"level": "WARNING"}}, {"level": "info", "fields": {"sev": "i"}}])
    assert names(odd) == ["level", "sev"] and values(odd, "level") == ["WARNING", "info", "warn"] and values(odd, "none") == []
    many = make(spark, [{"fields": {"n": str(i)}} for i in range(51)])
    assert values(many, "n") == [] and len(values(many.limit(50), "n")) == 50


@pytest.mark.parametrize("text, cursor, want", [
    ("lev", 3, ("name", "lev", "", 0)), ("", 0, ("none", "", "", 0)), ("level:er", 8, ("value", "er", "level", 6)), ('level:"er', 9, ("none", "", "", 0)), ("@er", 3, ("alias", "@er", "", 0)), ("a AND @e", 8, ("alias", "@e", "", 6)),
    ("lat>5", 5, ("none", "", "", 0)), ("level:error AND ser", 19, ("name", "ser", "", 16)), ("(lev", 4, ("name", "lev", "", 1)), ("lev", 1, ("none", "", "", 0)), ("lev ", 3, ("name", "lev", "", 0)), ("lev ", 4, ("none", "", "", 0)), ("level:", 6, ("value", "", "level", 6)),
])
def test_completion_contexts(text, cursor, want):
    c = catalog.context_at(text, cursor)
    assert (c.kind, c.prefix, c.field, c.start) == want


def test_completions(records):
    offer = lambda text: catalog.candidates(records, catalog.context_at(text, len(text)))
    assert offer("L") == ["last", "latency", "level"] and offer("a") == ["AND"] and offer("service:A") == ["api", "auth"] and offer("@") == ["@err", "@slow", "@warn"] and offer("x>") == []


def test_highlight_terms():
    assert terms_of(parse('timeout AND NOT level:error OR path~"^/u" AND latency>5 OR svc:api')) == [Term("timeout"), Term(pattern="^/u", field="path"), Term("api", field="svc")]
    assert terms_of(parse('m~"("')) == []


@pytest.mark.parametrize("text, terms, field, want", [
    ("Error error", [Term("error")], "", [(0, 5), (6, 11)]), ("aaa", [Term("aa")], "", [(0, 2)]), ("abcd", [Term("ab"), Term("bc")], "", [(0, 3)]), ("abcd", [Term("ab"), Term("cd")], "", [(0, 4)]), ("x", [Term("y")], "", []), ("a b", [Term("a", field="f")], "g", []),
    ("hi", [Term("hi", field="msg")], "message", [(0, 2)]), ("a1b22", [Term(pattern=r"\d+", field="f")], "f", [(1, 2), (3, 5)]), ("", [Term("a")], "", []),
])
def test_ranges(text, terms, field, want):
    assert ranges_in(text, terms, field) == want


def test_ranges_of_a_column(records):
    got = records.select(match_ranges("MESSAGE", "message", F.col("message")).alias("r")).first()["r"]
    assert [tuple(x) for x in got] == [(0, 7)]


RAW = '{"b":{"y":[1,{"z":null}],"x":"s"},"a":1.5,"c":[[1],true],"d":{}}'


def test_tree():
    assert tree_lines(RAW) == [("a", "a", "1.5", 0, False, 0), ("b", "b", "", 0, True, 2), ("b.x", "x", "s", 1, False, 0), ("b.y", "y", "", 1, True, 2), ("b.y[0]", "[0]", "1", 2, False, 0), ("b.y[1]", "[1]", "", 2, True, 1), ("b.y[1].z", "z", "null", 3, False, 0),
                               ("c", "c", "", 0, True, 2), ("c[0]", "[0]", "", 1, True, 1), ("c[1]", "[1]", "true", 1, False, 0), ("d", "d", "", 0, True, 0)]
    assert [x[0] for x in tree_lines(RAW, {"b", "c"})] == ["a", "b", "c", "d"]
    assert tree_lines('{"a":1}') == tree_lines("[1]") == tree_lines("x") == tree_lines(None) == tree_lines("{") == []


def test_tree_in_sql(spark):
    register(spark)
    spark.createDataFrame([(RAW,), (None,)], "raw string").createOrReplaceTempView("tree_input")
    assert spark.sql("SELECT t.path FROM tree_input, LATERAL json_tree(raw) t").count() == 11


def test_rows(spark, records):
    assert [tuple(r) for r in rows.project(records.limit(1), ["service", "none"]).collect()] == [("api", "")]
    assert rows.between(records, START, START + 2_000_000).count() == 3
    assert rows.keep_ids(records, spark.createDataFrame([(3,), (3,), (99,)], "line_number long"), "line_number").count() == 1
    shown = rows.display_columns(make(spark, [{"ts": START, "level": "warn", "message": "a\nb", "fields": {"k": "v"}}, {"ts": -62167173410000000}]).orderBy("line_number"), ["timestamp", "level", "message", "k"])
    assert [tuple(r) for r in shown.collect()] == [("2026-03-08 10:00:00", "WARN", "a", "v"), ("0000-01-01 12:43:10", "", "", "")]


def test_values_of_all_fields_and_summary(spark):
    from tallylog.operators.catalog import field_values, values_of_all_fields
    from tallylog.operators.summary import summarised
    from tallylog.sources.files import from_lines

    lines = [f'{{"level":"{"ERROR" if i % 3 == 0 else "info"}","id":"{i}","k":{i % 50},"l":{i % 51},"e":"","n":{{"a":true}}}}' for i in range(200)] + ["plain text"] * 3
    logs = from_lines(spark, lines).repartition(5)
    got = {}
    for r in values_of_all_fields(logs).collect():
        got.setdefault(r["name"], set()).add(r["value"])
    assert got == {n: {r["value"] for r in field_values(logs, n).collect()} for n in ("level", "k", "e", "n.a", "message")}
    assert len(got["k"]) == 50 and "l" not in got and "id" not in got
    assert values_of_all_fields(logs.limit(0)).count() == 0
    found, summary = summarised(logs, "level:error")
    assert found.count() == 67
    assert {k: summary.get()[k] for k in ("total", "matches", "errors", "low")} == {"total": 203, "matches": 67, "errors": 67, "low": None}


def test_bookmarks_are_toggled_and_followed(spark):
    from tallylog.operators.rows import next_marked, toggled

    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "record_id long")
    marks = toggled(ids(1, 5, 5, 9), ids(5, 7, 7, 8))
    assert sorted(r[0] for r in marks.collect()) == [1, 8, 9]
    assert {r["record_id"]: r["next"] for r in next_marked(ids(0, 1, 7, 8, 9, 50), marks).collect()} == {0: 1, 1: 8, 7: 8, 8: 9, 9: 1, 50: 1}
    assert [r["next"] for r in next_marked(ids(3), marks.limit(0)).collect()] == [None]


def test_more_bookmarks_than_one_list_holds(spark, monkeypatch):
    from tallylog.operators import rows

    every = spark.range(250_000).withColumnRenamed("id", "record_id")
    got = rows.next_marked(every, every.where("record_id % 2 = 1")).where("next != if(record_id = 249999, 1, record_id + 1 + record_id % 2)")
    assert got.count() == 0
    monkeypatch.setattr(rows, "STRETCH", 3)
    some = [None, -(1 << 63), -40, -7, -1, 0, 5, 5, 900, (1 << 63) - 1]
    places = spark.createDataFrame([(x, str(x)) for x in some], "record_id long, name string")
    for marks in ([], [5], [-40, 900], [None, -(1 << 63), 0, (1 << 63) - 1], list(range(-9, 9))):
        marked = sorted({m for m in marks if m is not None})
        want = [(x, str(x), next((m for m in marked if x is not None and m > x), min(marked, default=None))) for x in some]
        frame = rows.next_marked(places, spark.createDataFrame([(m,) for m in marks], "record_id long"))
        assert frame.columns == ["record_id", "name", "next"] and sorted(map(str, map(tuple, frame.collect()))) == sorted(map(str, want))
