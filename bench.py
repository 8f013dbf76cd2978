"""Headline queries, timed; prints one line of JSON.

``events`` are written as JSON lines once (not timed) and then parsed as any log. Kept apart, as in the published definitions: parsing; each query shape on
records that are parsed already; the first of these, cold. The operators of the ``llm`` subpackage run over whole tables, if it is there.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SHAPES = {
    "exact": "level:error", "numeric": "latency>2500", "compound": "level:error AND latency>1000", "complex": "level:error AND latency>1000 AND NOT service:view",
    "fulltext": "timeout", "regex": 'message~"timeout.*"',
}


def main() -> None:
    from pyspark.sql import functions as F

    from tallylog import histogram, matching, pattern_counts, read_logs
    from tallylog.catalogue import NOW_US, QUERIES, _level
    from tallylog.operators.groups import group_counts
    from tallylog.plans.compiler import promote
    from tallylog.session import get_session

    spark = get_session("bench", spark__master=f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="16g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    work, took = Path(tempfile.mkdtemp(prefix="bench-")), {}

    def timed(name: str, action, runs: int = 1):
        best, result = None, None
        for _ in range(runs):
            start = time.perf_counter()
            result = action()
            best = min(best or 1e9, time.perf_counter() - start)
        took[name] = round(best, 4)
        return result

    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), _level().alias("level"), F.col("event_type").alias("service"), F.floor(F.col("value") * 30).cast("long").alias("latency"),
        F.when(F.col("event_id") % 7 == 0, "connection timeout").otherwise(F.concat(F.lit("request "), F.col("event_id").cast("string"), F.lit(" done"))).alias("message"), F.col("user_id").cast("string").alias("request_id")))
    events.select(line).repartition(int(CPUS)).write.text(str(work / "log"))
    files = sorted(str(p) for p in (work / "log").glob("part-*.txt"))
    timed("parse", lambda: promote(read_logs(spark, files, multiline="single"), ["service", "latency"]).write.parquet(str(work / "records")))
    timed("parse_grouping", lambda: read_logs(spark, files).agg(F.max("ts_us"), F.count("level")).collect())
    records = spark.read.parquet(str(work / "records"))
    timed("cold", lambda: matching(records, SHAPES["compound"]).count())
    cached = records.cache()
    cached.count()
    for name, query in SHAPES.items():
        timed(name, lambda query=query: matching(cached, query, now_us=NOW_US).count(), 3)
    timed("histogram_50", lambda: histogram(cached, 50).collect(), 3)
    timed("group_by", lambda: group_counts(cached, "service", 10).collect(), 3)
    timed("patterns", lambda: pattern_counts(cached, 10).collect(), 3)
    for name in ("diff_patterns", "trace_follow_many", "detect_ids", "field_names", "roundtrip_json", "patterns_documents"):
        timed(f"q_{name}", lambda name=name: QUERIES[name](spark, SF_DIR).write.mode("overwrite").format("noop").save())
    try:
        from tallylog.llm.queries import QUERIES as llm
    except ImportError:
        llm = {}
    for name, query in llm.items():
        timed(name, lambda query=query: query(spark, SF_DIR).write.mode("overwrite").format("noop").save())
    shutil.rmtree(work, ignore_errors=True)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
