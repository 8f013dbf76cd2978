import time

import pytest

from tallylog.streaming.follow import GrowingFileReader, counts_over_time, first_line_end, follow, follow_directory, follow_lines, last_line_end, lines_between


def test_line_ends(tmp_path):
    path = tmp_path / "x.log"
    path.write_bytes(b"a\r\r\nb\npart")
    p = str(path)
    assert (last_line_end(p, 0, 10), last_line_end(p, 6, 10), last_line_end(p, 0, 5)) == (6, 6, 4)
    assert (first_line_end(p, 0, 10), first_line_end(p, 4, 10), first_line_end(p, 6, 10)) == (4, 6, None)
    assert list(lines_between(p, 0, 6, 0)) == ["a", "b"] and list(lines_between(p, 2, 6, 0)) == ["b"] and list(lines_between(p, 0, 2, 0)) == ["a"] and list(lines_between(p, 4, 6, 4)) == ["b"]


@pytest.mark.parametrize("partition", [1, 3, 7, 1000])
def test_partitions_have_every_line_once(tmp_path, partition):
    path = tmp_path / "x.log"
    lines = ["", "a", "é" * 9, "", "x" * 40, "b c", ""]
    path.write_bytes(("\n".join(lines) + "\nopen").encode())
    reader = GrowingFileReader(str(path), 0, None, partition)
    start, end = reader.initialOffset(), reader.latestOffset()
    rows = [r for p in reader.partitions(start, end) for r in reader.read(p)]
    assert [r[2] for r in sorted(rows)] == lines and end["byte"] == len(path.read_bytes()) - 4


def test_batches_are_bounded(tmp_path):
    path = tmp_path / "x.log"
    path.write_bytes(b"0123456\n" * 10 + b"y" * 50 + b"\n" + b"z" * 30)
    reader = GrowingFileReader(str(path), 0, 20, 1000)
    at, ends = reader.initialOffset()["byte"], []
    for _ in range(9):
        ends.append(reader.latestOffset()["byte"])
    assert ends == [16, 32, 48, 64, 80, 131, 131, 131, 131] and at == 0
    with path.open("ab") as f:
        f.write(b"z\nw\n")
    assert [reader.latestOffset()["byte"] for _ in range(3)] == [163, 165, 165]
    assert GrowingFileReader(str(path), 0, 20, 1000).latestOffset()["byte"] == 165  # after a restart


def test_an_entry_over_two_batches_is_one(spark, tmp_path):
    path, seen = tmp_path / "app.log", []
    path.write_text("2026-03-08 10:00:01 ERROR first\n  at a.B\n")

    def collect(df, number):
        seen.extend((r["line_number"], r["raw"]) for r in df.collect())

    def until(query, met):
        end = time.time() + 90
        while not met() and time.time() < end and query.isActive:
            time.sleep(0.3)
        assert met(), query.exception()

    rows = lambda q: sum(p.numInputRows for p in q.recentProgress)
    query = follow(spark, str(path), "level:error", collect, str(tmp_path / "state"), across="timed", wait_ms=3_600_000, every="100 milliseconds")
    try:
        until(query, lambda: rows(query) >= 2)
        with path.open("a") as f:
            f.write("  at c.D\n\n2026-03-08 10:00:02 INFO second\n2026-03-08 10:00:03 ERROR third\n")
        until(query, lambda: rows(query) >= 6)
        assert seen == [(1, "2026-03-08 10:00:01 ERROR first\n  at a.B\n  at c.D\n")]
    finally:
        query.stop()
    query = follow(spark, str(path), "level:error", collect, str(tmp_path / "state"), across="timed", wait_ms=1, every="100 milliseconds")
    try:
        with path.open("a") as f:
            f.write("  at e.F\n")
        until(query, lambda: len(seen) == 2)
    finally:
        query.stop()
    assert seen[1:] == [(6, "2026-03-08 10:00:03 ERROR third\n  at e.F")]


def test_batches(spark, tmp_path):
    path, seen = tmp_path / "app.log", []
    path.write_text('{"level":"error","message":"one"}\n{"level":"info","message":"two"}\n{"level":"err')

    def collect(df, number):
        seen.append([(r["line_number"], r["message"]) for r in df.orderBy("line_number").collect()])

    run = lambda: follow(spark, str(path), "level:error", collect, str(tmp_path / "state"), once=True).awaitTermination(60)
    run()
    assert seen == [[(1, "one")]]
    with path.open("a") as f:
        f.write('or","message":"three"}\n{"level":"error","message":"four"}\n')
    run()
    assert seen[1:] == [[(1, "three"), (2, "four")]]


def test_lines(spark, tmp_path):
    path = tmp_path / "l.log"
    path.write_text("skip\na\nb\n")
    query = follow_lines(spark, str(path), 5).writeStream.format("memory").queryName("new_lines").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r["value"] for r in spark.table("new_lines").orderBy("block", "at").collect()] == ["a", "b"]


def test_directory_and_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("".join(f'{{"ts":"2026-03-08T10:0{m}:00Z","level":"{x}"}}\n' for m, x in ((0, "error"), (0, "info"), (1, "error"), (9, "error"))) + "\n")
    stream = follow_directory(spark, str(tmp_path / "in"))
    assert stream.isStreaming
    query = counts_over_time(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {(str(r["start"])[11:16], r["level"]): r["count"] for r in spark.table("windows").collect()}
    assert got == {("10:00", "error"): 1, ("10:00", "info"): 1, ("10:01", "error"): 1, ("10:09", "error"): 1}


def test_a_log_in_parts_is_followed(tmp_path):
    from tallylog.streaming.follow import log_size, open_log

    for name, data in (("a", b"one\ntwo\n"), ("b", b""), ("c", b"three\nfo"), ("_SUCCESS", b"no\n"), (".a.crc", b"no\n")):
        (tmp_path / name).write_bytes(data)
    p = str(tmp_path)
    assert (log_size(p), last_line_end(p, 0, 16), first_line_end(p, 5, 16)) == (16, 14, 8) and open_log(p).read() == b"one\ntwo\nthree\nfo"
    reader = GrowingFileReader(p, 0, None, 3)
    start, end = reader.initialOffset(), reader.latestOffset()
    assert [r[2] for part in reader.partitions(start, end) for r in reader.read(part)] == ["one", "two", "three"]
    (tmp_path / "d").write_bytes(b"ur\n")
    assert reader.latestOffset() == {"byte": 19}


def test_only_the_open_entry_reaches_the_driver(spark, tmp_path):
    from tallylog.streaming.follow import OpenEntry, entries_across

    def batch(*lines):
        return spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "block long, at long, value string")

    seen, count, held = [], 0, []
    for number, lines in enumerate((["", "  "], ["head", "12:00:01 a"], ["  x", ""], ["  y", "12:00:02 b", "12:00:03 c"], [], ["", "tail"], ["12:00:04 d"], [])):
        entries, count, held = entries_across(batch(*lines), "timed", count, held)
        OpenEntry(spark, str(tmp_path)).keep(number, count, held)
        assert OpenEntry(spark, str(tmp_path)).before(number + 1) == (count, held)
        seen += [sorted((r["line_number"], r["text"]) for r in entries.collect())]
    assert seen == [[], [(3, "head")], [], [(4, "12:00:01 a\n  x\n\n  y"), (8, "12:00:02 b")], [(9, "12:00:03 c")], [], [(11, "tail")], [(12, "12:00:04 d")]]
