import pytest
from pyspark.sql import functions as F

from tallylog.operators.rows import matching
from tallylog.sources.files import from_lines
from tallylog.sources.store import compact, files_for, look_up, save_records

DAY = 86_400_000_000


@pytest.fixture(scope="module")
def logs(spark):
    df = spark.range(5000).withColumn("ts", F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 172_800_000))
    line = F.concat(F.lit('{"ts":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","level":"'), F.when(F.col("id") % 7 == 0, "error").otherwise("info"), F.lit('","trace_id":"'), F.md5(F.floor(F.col("id") / 5).cast("string").cast("binary")), F.lit('","message":"request '), F.col("id").cast("string"), F.when(F.col("id") == 4321, " Zyxwvut").otherwise(""), F.lit('"}'))
    return from_lines(spark, [*[r[0] for r in df.select(line).collect()], "no time at all", "level=error without=time"]).persist()


@pytest.fixture(scope="module")
def store(spark, logs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    save_records(logs.where("line_number % 2 = 0"), path, ids=["trace_id"], file_rows=50)
    save_records(logs.where("line_number % 2 = 1"), path, ids=["trace_id"], file_rows=50)
    save_records(logs.limit(0), path)
    spark.conf.set("spark.sql.shuffle.partitions", old)
    return path


def ids(df):
    return sorted(r["line_number"] for r in df.select("line_number").collect())


NOW = 1_704_067_200_000_000 + 10 * DAY


@pytest.mark.parametrize("query", ["", "zyxwvut", '"request 4321"', "trace_id:cfcd208495d565ef66e7dff9f98764da", "level:error AND last:30h", "last:2h", 'timestamp<"2024-01-02T00:00:00Z"', 'NOT timestamp>"2024-01-02T00:00:00Z"', "zyxwvut OR last:1h", "NOT request", "without:time", "ab", 'message~"432[12]"', "last:1h AND NOT level:info", "nowhere:near", 'timestamp>soon'])
def test_as_without_a_store(spark, logs, store, query):
    assert ids(look_up(spark, store, query, now_us=NOW)) == ids(matching(logs, query, now_us=NOW))


def test_few_files_are_read(spark, store):
    everything = files_for(spark, store)
    assert len(everything) >= 100
    for query in ("zyxwvut", '"request 4321"', "trace_id:cfcd208495d565ef66e7dff9f98764da", "last:20h"):
        assert 0 < len(files_for(spark, store, query, now_us=NOW)) <= len(everything) / 10, query
    plan = look_up(spark, store, "last:20h", now_us=NOW)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan or "PartitionFilters: [cast(day" in plan or "day#" in plan.split("PartitionFilters")[1].split("]")[0]


def rows_scanned(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_bloom_filters_spare_row_groups(spark, store):
    found = look_up(spark, store, "trace_id:cfcd208495d565ef66e7dff9f98764da")
    assert 5 <= rows_scanned(found) <= 5002 / 10


def test_compaction_and_appends(spark, logs, tmp_path):
    path = str(tmp_path / "s")
    for k in range(3):
        save_records(logs.where(F.col("line_number") % 3 == k), path, file_rows=100)
    before = [f for f in files_for(spark, path) if f[1] == "2024-01-03"]
    compact(spark, path, "2024-01-03")
    after = [f for f in files_for(spark, path) if f[1] == "2024-01-03"]
    assert len(before) >= 3 and len(after) < len(before) and not set(after) & set(before)
    assert ids(look_up(spark, path)) == ids(logs)
    compact(spark, path, "none")
    compact(spark, path, "1999-01-01")
    save_records(logs.where("line_number = 1"), path)
    assert ids(look_up(spark, path)) == sorted([1, *ids(logs)])
    columns = look_up(spark, path).columns
    assert "day" not in columns and "batch" not in columns


def test_index_rows_are_made_by_many_tasks(spark, logs, tmp_path, monkeypatch):
    from tallylog.sources import store as module

    frame, made = type(logs), []
    coalesce = frame.coalesce
    monkeypatch.setattr(frame, "coalesce", lambda df, n: made.append(df._jdf.queryExecution().optimizedPlan().toString()) or coalesce(df, n))
    module.save_records(logs, str(tmp_path / "s"), file_rows=100)
    module.compact(spark, str(tmp_path / "s"), "2024-01-03")
    assert len(made) == 2 and not any("Aggregate" in plan or "Join" in plan for plan in made)
    assert ids(look_up(spark, str(tmp_path / "s"))) == ids(logs)
    assert {p.name for p in (tmp_path / "s").iterdir()} == {"records", "index"}


def test_values_are_folded_once(spark):
    from tallylog.sources import store as module

    df = spark.createDataFrame([({"a": "AbCd", "b": "xY", "c": None, "d": "ab\u00c4\u00e4"},)], "fields map<string,string>").withColumns({"ts_us": F.lit(1), "day": F.lit("d"), "_metadata": F.struct(F.lit("f").alias("file_path"))})
    described = module._described(df)
    plan = described._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(translate" not in plan.replace("lambda ", "")
    want = spark.createDataFrame([(x,) for x in ("abc", "bcd", "ab\u00c4", "b\u00c4\u00e4")], "t string").select(F.pmod(F.xxhash64("t"), F.lit(1 << 16)).cast("int")).collect()
    assert described.first()["trigrams"] == sorted(r[0] for r in want)
