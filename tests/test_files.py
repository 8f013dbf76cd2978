import gzip

import pytest

from tallylog.operators.rows import in_order, matching
from tallylog.operators import rows as rows_module
from tallylog.sources import files
from tallylog.sources.files import from_lines, group_entries, mode_of, mode_of_file, number_lines, read_lines, read_logs

TRACE = ["2026-03-08 10:00:01 ERROR first", "java.lang.Exception: x", "  at a.B", "", "  at c.D", "2026-03-08 10:00:02 INFO second", "", "2026-03-08 10:00:03 INFO third", ""]


def entries(spark, lines, multiline=None):
    multiline = multiline or mode_of([x for x in map(str.strip, lines[:100]) if x])
    df = spark.createDataFrame([("f", 0, i, x) for i, x in enumerate(lines)], "path string, block long, at long, value string")
    return [(r["line_number"], r["text"]) for r in group_entries(number_lines(df), multiline).orderBy("line_number").collect()]


def test_stack_trace(spark):
    assert entries(spark, TRACE) == [(1, "\n".join(TRACE[:5])), (6, TRACE[5] + "\n"), (8, TRACE[7] + "\n")]


def test_single_lines(spark):
    lines = ["", '{"a":1}', "  ", '{"b":2}', "a=1 b=2", "tail"]
    assert entries(spark, lines[:5]) == [(2, '{"a":1}'), (4, '{"b":2}'), (5, "a=1 b=2")]
    assert entries(spark, ["just", "words"]) == [(1, "just"), (2, "words")]
    assert entries(spark, ["", " "]) == []


def test_structured(spark):
    lines = ["", "head", '{"a":1}', "  more", '  {"x":1}', "k=v l=w", "rest"]
    assert entries(spark, lines) == [(2, "head"), (3, '{"a":1}\n  more\n  {"x":1}'), (6, "k=v l=w\nrest")]


def test_only_the_first_lines_decide(spark):
    lines = ["plain"] * 100 + TRACE
    assert len(entries(spark, lines)) == 100 + 6


def test_mode_can_be_given(spark):
    assert entries(spark, ["x", "12:00:00 a", "b"], multiline="timed") == [(1, "x"), (2, "12:00:00 a\nb")]


def test_line_numbers_over_splits(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("".join(f"line {i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = read_lines(spark, [str(path)])
        assert lines.rdd.getNumPartitions() > 5
        rows = number_lines(lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["line_number"], r["value"]) for r in rows) == [(i + 1, f"line {i}") for i in range(20_000)]


def test_line_ends(spark, tmp_path):
    path = tmp_path / "x.log"
    path.write_bytes(b"a\r\nb\rc\r\r\nd")
    assert [r["value"] for r in read_lines(spark, [str(path)]).orderBy("at").collect()] == ["a", "b\rc\r", "d"]


@pytest.mark.parametrize("name", ["app.log.gz", "app.odd"])
def test_gzip_by_its_bytes(spark, tmp_path, name):
    path = tmp_path / name
    path.write_bytes(gzip.compress(b'{"level":"error"}\n{"level":"info"}\n'))
    assert [(r["line_number"], r["level"]) for r in read_logs(spark, [str(path)]).orderBy("line_number").collect()] == [(1, "error"), (2, "info")]


def test_sources_are_merged(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"ts":"2026-03-08T10:00:02Z","message":"two","source":"own"}\n{"message":"no time"}\n{"ts":"2026-03-08T10:00:05Z","message":"five"}\n')
    (tmp_path / "a.jsonl").write_text('{"ts":"2026-03-08T10:00:02Z","message":"TWO"}\n{"ts":"2026-03-08T10:00:01Z","message":"one"}\n')
    logs = read_logs(spark, [str(tmp_path / "b.jsonl"), str(tmp_path / "a.jsonl")])
    assert [r["message"] for r in in_order(logs).collect()] == ["one", "two", "no time", "TWO", "five"]
    assert {r["fields"]["source"] for r in logs.collect()} == {"a.jsonl", "b.jsonl"}
    assert matching(logs, "source:b.jsonl").count() == 3 and matching(logs, 'source~"^a"').count() == 2 and matching(logs, "a.jsonl").count() == 2
    one = read_logs(spark, [str(tmp_path / "b.jsonl")])
    assert {r["source"] for r in one.collect()} == {None} and one.where("fields['source'] = 'own'").count() == 1
    assert {r["source_index"] for r in one.collect()} == {0}


def test_standard_input(spark):
    records = from_lines(spark, ["ts=2026-03-08T10:00:01Z level=error msg=a\r\n", "\n", "ts=2026-03-08T10:00:02Z level=info msg=b\n"])
    assert [(r["line_number"], r["level"], r["message"]) for r in records.orderBy("line_number").collect()] == [(1, "error", "a"), (3, "info", "b")]


def test_modes_from_the_first_bytes(spark, tmp_path, monkeypatch):
    texts = {"trace": "\n".join(TRACE), "json": '{"a":1}\n' * 300, "mixed": '{"a":1}\n  more\n' * 60, "plain": "plain\n" * 100 + "\n".join(TRACE), "none": "", "blank": "\n" * 500, "wide": ("x" * 3000 + "\n") * 60 + "2026-03-08 10:00:01 a\n" * 40}
    want = {"trace": "timed", "json": "single", "mixed": "structured", "plain": "single", "none": "single", "blank": "single", "wide": "timed"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(text.encode()))
    assert {n: mode_of_file(spark, str(tmp_path / n)) for n in texts} == want
    assert {n: mode_of_file(spark, str(tmp_path / f"{n}.gz")) for n in texts} == want
    monkeypatch.setattr(files, "HEAD_BYTES", 1600)
    assert mode_of_file(spark, str(tmp_path / "trace")) == "timed" and mode_of_file(spark, str(tmp_path / "wide")) == "single"


def test_several_files_are_parsed_once(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text('{"ts":"2026-03-08T10:00:02Z"}\n' * 5)
    logs = read_logs(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert logs._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert logs.count() == 10


@pytest.mark.parametrize("tail", [2, 200])
def test_times_carry_over_stretches(spark, tmp_path, monkeypatch, tail):
    monkeypatch.setattr(rows_module, "STRETCH", 10)
    monkeypatch.setattr(files, "TAIL_LINES", tail)
    timed = {1, 3, 14, 15, 42, 47}
    (tmp_path / "a").write_text("".join(f'{{"ts":"2026-03-08T10:00:{i:02d}Z"}}\n' if i in timed else "x\n" for i in range(60)))
    (tmp_path / "b").write_text("y\n" * 25)
    logs = read_logs(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    got = {(r["source_index"], r["line_number"]): r["order_us"] for r in logs.collect()}
    start = 1772964000000000
    for i in range(60):
        past = [t for t in timed if t <= i]
        assert got[0, i + 1] == (start + max(past) * 1_000_000 if past else None)
    assert all(got[1, i + 1] is None for i in range(25))
    assert logs._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


@pytest.mark.parametrize("zipped", [False, True])
def test_a_folder_is_one_log_in_parts(spark, tmp_path, monkeypatch, zipped):
    monkeypatch.setattr(files, "WINDOW_LINES", 3)
    folder = tmp_path / "app"
    folder.mkdir()
    pieces = ["", "\n".join(TRACE[:3]) + "\n", "\n".join(TRACE[3:6]) + "\n", "\n".join(TRACE[6:])]
    for i, text in enumerate(pieces):
        (folder / f"part-{i}").write_bytes(gzip.compress(text.encode()) if zipped else text.encode())
    (folder / "_SUCCESS").write_text("2026-03-08 10:00:01 ERROR none\n")
    (tmp_path / "b.log").write_text("2026-03-08 10:00:09 INFO a\n2026-03-08 10:00:09 INFO b\n")
    logs = read_logs(spark, [str(tmp_path / "b.log"), str(folder)])
    got = sorted((r["source_index"], r["line_number"], r["raw"], r["source"]) for r in logs.collect())
    assert got[2:] == [(1, 1, "\n".join(TRACE[:5]), "app"), (1, 6, TRACE[5] + "\n", "app"), (1, 8, TRACE[7], "app")] and len(got) == 5


def test_windows_count_few_lines(spark, tmp_path):
    (tmp_path / "x").write_text("2026-03-08 10:00:01 ERROR first\n  at a.B\n" * 20)
    plan = read_logs(spark, [str(tmp_path / "x")])._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x and "_begin" in x]
    assert windows and all("_piece" in x for x in windows)
