"""Registered queries over the driver's tables, and the same questions as SQL for another engine.

``events`` are records: event types become levels in various spellings, so that these are normalised; user, value and the property are fields.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog, diff, groups, patterns, rows, trace
from .operators.highlight import match_ranges
from .operators.histogram import histogram
from .operators.tree import tree_lines
from .plans.aliases import Aliases
from .plans.compiler import field_of
from .sources.columns import records_from_columns
from .sources.files import group_entries, number_lines, parse_entries, parts_of, read_logs
from .sources.records import with_records

#: What ``last:`` counts from: noon of 20 January 2024.
NOW_US = 1_705_752_000_000_000
LEVELS = {"error": "ERR", "purchase": "WARNING", "signup": "info", "click": "INFO", "view": "DBG"}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _level() -> Column:
    out = F.lit(None).cast("string")
    for kind, level in LEVELS.items():
        out = F.when(F.col("event_type") == kind, level).otherwise(out)
    return out


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as records; ``line_number`` is the event's id. One in three has no ``value``."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    fields = {
        "level": _level(), "service": F.col("event_type"), "user_id": F.col("user_id"), "value": F.when(F.col("event_id") % 3 != 0, F.format_string("%d", F.floor(F.col("value") * 100).cast("long"))),
        "k": F.get_json_object("props", "$.k"), "path": F.concat(F.lit("/api/"), F.col("event_type"), F.lit("/"), F.col("user_id").cast("string")),
        "trace_id": F.when(F.col("event_id") % 2 == 0, F.md5(F.col("user_id").cast("string").cast("binary"))),
        "message": _message(),
    }
    return records_from_columns(df, F.col("ts"), _level(), _message(), fields, line_number=F.col("event_id"))


def _message() -> Column:
    return F.concat(F.lit("User "), F.col("user_id").cast("string"), F.lit(" did "), F.col("event_type"), F.lit(" at 10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".7 in "), (F.col("event_id") % 900).cast("string"), F.lit("ms"))


_EVENTS = """
WITH e AS (
  SELECT event_id AS line_number, epoch_us(ts) AS ts_us, event_type AS service, user_id::VARCHAR AS user_id,
    CASE event_type WHEN 'error' THEN 'ERR' WHEN 'purchase' THEN 'WARNING' WHEN 'signup' THEN 'info' WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'DBG' END AS raw_level,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'info' WHEN 'click' THEN 'info' WHEN 'view' THEN 'debug' ELSE '' END AS level,
    CASE WHEN event_id % 3 <> 0 THEN floor(value * 100)::BIGINT END AS value, json_extract_string(props, '$.k') AS k,
    '/api/' || event_type || '/' || user_id AS path, CASE WHEN event_id % 2 = 0 THEN md5(user_id::VARCHAR) END AS trace_id,
    'User ' || user_id || ' did ' || event_type || ' at 10.0.' || (user_id % 256) || '.7 in ' || (event_id % 900) || 'ms' AS message
  FROM events)
"""


def _filter(name: str, query: str, where: str, **how) -> None:
    """A query that returns the ids that match, and the condition in SQL."""
    QUERIES[name] = lambda spark, d: rows.matching(events(spark, d), query, now_us=NOW_US, **how).select("line_number", "ts_us", "level")
    ORACLES[name] = f"{_EVENTS} SELECT line_number, ts_us, level FROM e WHERE {where}"


def _query(name: str, sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_ALL_TEXT = ["raw_level", "service", "user_id", "value::VARCHAR", "k", "path", "trace_id", "message"]


def _words(word: str) -> str:
    fold = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return "(" + " OR ".join(f"contains({fold.format(c)}, '{word}')" for c in _ALL_TEXT) + ")"


_filter("match_all", "", "true")
_filter("field_match", "service:error", "service = 'error'")
_filter("level_normalized", "level:warn", "raw_level = 'warn' OR level = 'warn'")
_filter("level_as_written", "level:WARNING", "raw_level = 'WARNING' OR level = 'WARNING'")
_filter("numeric_gt", "value>5000", "coalesce(value > 5000, false)")
_filter("numeric_ge", "value>=1234.5", "coalesce(value >= 1234.5, false)")
_filter("numeric_lt", "value<250", "coalesce(value < 250, false)")
_filter("numeric_le", "k<=1e1", "coalesce(k::DOUBLE <= 10, false)")
_filter("numeric_of_text", "service>1", "false")
_filter("ts_gt", 'timestamp>"2024-01-15T10:00:00Z"', "ts_us > epoch_us(TIMESTAMP '2024-01-15 10:00:00')")
_filter("ts_ge", 'ts>="2024-01-20 00:00:00"', "ts_us >= epoch_us(TIMESTAMP '2024-01-20 00:00:00')")
_filter("ts_lt", "time<1704672000", "ts_us < epoch_us(TIMESTAMP '2024-01-08 00:00:00')")
_filter("ts_le", 'datetime<="2024/01/03 12:00:00"', "ts_us <= epoch_us(TIMESTAMP '2024-01-03 12:00:00')")
_filter("ts_between", 'timestamp>="2024-01-10T00:00:00Z" AND timestamp<"2024-01-11T02:00:00+02:00"', "ts_us >= epoch_us(TIMESTAMP '2024-01-10') AND ts_us < epoch_us(TIMESTAMP '2024-01-11')")
_filter("last_window", "last:36h", f"ts_us >= {NOW_US} - 36 * 3600000000")
_filter("regex_match", 'path~"^/api/(error|view)/[0-9]*7$"', "regexp_matches(path, '^/api/(error|view)/[0-9]*7$')")
_filter("regex_boundary", r'message~"\b1\d ms|\bUser 1\d?\b"', r"regexp_matches(message, '\b1\d ms|\bUser 1\d?\b')")
_filter("fulltext", "PURCHASE", _words("purchase"))
_filter("fulltext_phrase", '"did click at"', _words("did click at"))
_filter("and_or_not", "(service:error OR service:view) AND NOT value>1000", "service IN ('error', 'view') AND NOT coalesce(value > 1000, false)")
_filter("precedence", "service:error OR service:view AND value>1000", "service = 'error' OR (service = 'view' AND coalesce(value > 1000, false))")
_filter("not_missing_field", "NOT value>0", "NOT coalesce(value > 0, false)")
_filter("not_invalid_regex", 'NOT message~"("', "true")
_filter("invalid_regex", 'message~"a(?=b)"', "false")
_filter("not_invalid_number", "NOT value>1d", "true")
_filter("alias_err", "@err", "raw_level IN ('error', 'fatal') OR level IN ('error', 'fatal')")
_filter("alias_nested", "@costly AND NOT @noise", "(level = 'error' OR level = 'fatal' OR service = 'purchase') AND coalesce(value > 2000, false) AND service <> 'click'", aliases=Aliases({"costly": "(@err OR service:purchase) AND value>2000", "noise": "service:click"}))


@_query("count", f"{_EVENTS} SELECT count(*) AS count FROM e WHERE level = 'error'")
def _(spark, d):
    return rows.count(rows.matching(events(spark, d), "level:error"))


@_query("group_by", f"{_EVENTS} SELECT service AS value, count(*) AS count FROM e GROUP BY 1")
def _(spark, d):
    return groups.group_counts(events(spark, d), "service")


@_query("group_by_empty", f"{_EVENTS} SELECT coalesce(value::VARCHAR, '(empty)') AS value, count(*) AS count FROM e GROUP BY 1")
def _(spark, d):
    return groups.group_counts(events(spark, d), "value")


@_query("top_n", f"{_EVENTS} SELECT user_id AS value, count(*) AS count FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, d):
    return groups.group_counts(events(spark, d), "user_id", 5)


@_query("level_counts", f"{_EVENTS} SELECT level, count(*) AS count FROM e WHERE level <> '' GROUP BY 1")
def _(spark, d):
    return groups.level_counts(events(spark, d))


def _histogram_sql(n: int, where: str = "true") -> str:
    return f"""{_EVENTS}, f AS (SELECT * FROM e WHERE {where}),
s AS (SELECT min(ts_us) AS low, greatest((CASE WHEN max(ts_us) = min(ts_us) THEN 1000000 ELSE max(ts_us) - min(ts_us) END * 1000)::BIGINT // {n}, 1) AS width FROM f HAVING count(*) > 0),
b AS (SELECT low, width, unnest(range({n})) AS bucket FROM s),
c AS (SELECT least(((ts_us - low) * 1000) // width, {n - 1}) AS bucket, count(*) AS n, count(*) FILTER (WHERE level IN ('error', 'fatal')) AS bad FROM f, s GROUP BY 1)
SELECT b.bucket::INT AS bucket, (low + (b.bucket * width) // 1000)::BIGINT AS start_us, (low + ((b.bucket + 1) * width) // 1000)::BIGINT AS end_us, coalesce(n, 0) AS count, coalesce(bad, 0) AS errors FROM b LEFT JOIN c USING (bucket)"""


@_query("histogram_10", _histogram_sql(10))
def _(spark, d):
    return histogram(events(spark, d), 10)


@_query("histogram_50", _histogram_sql(50))
def _(spark, d):
    return histogram(events(spark, d), 50)


@_query("histogram_filtered", _histogram_sql(20, "level = 'error' AND coalesce(value > 3000, false)"))
def _(spark, d):
    return histogram(rows.matching(events(spark, d), "level:error AND value>3000"), 20)


# The same patterns in the syntax of the other engine, whose \\b is of ASCII words as it is.
_TEMPLATES = (
    ("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
    (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "<ip>"),
    (r"\b[0-9a-fA-F]{16,}\b", "<hex>"),
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?", "<timestamp>"),
    ("(/[a-zA-Z0-9._-]+){2,}", "<path>"),
    (r"\b[0-9]+(\.[0-9]+)?(ms|ns|us|µs|s|m|h)\b", "<duration>"),
    (r"\b[0-9]+(\.[0-9]+)?\b", "<num>"),
)


def _template_sql(column: str) -> str:
    for pattern, placeholder in _TEMPLATES:
        column = f"regexp_replace({column}, '{pattern}', '{placeholder}', 'g')"
    return column


@_query("patterns", f"{_EVENTS} SELECT {_template_sql('message')} AS template, count(*) AS count FROM e GROUP BY 1")
def _(spark, d):
    return patterns.pattern_counts(events(spark, d))


@_query("patterns_top", f"SELECT {_template_sql('url')} AS template, count(*) AS count FROM pages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, d):
    return patterns.pattern_counts(_texts(spark, d, "pages", "url"), 20)


@_query("patterns_documents", f"SELECT {_template_sql('text')} AS template, count(*) AS count FROM documents WHERE text <> '' GROUP BY 1")
def _(spark, d):
    return patterns.pattern_counts(_texts(spark, d, "documents", "text").where("message != ''"))


@_query("patterns_share", f"{_EVENTS} SELECT {_template_sql('message')} AS template, count(*) AS count, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS share FROM e GROUP BY 1")
def _(spark, d):
    return patterns.pattern_counts(events(spark, d), share=True)


def _texts(spark: SparkSession, d: str, table: str, column: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet").select(F.col(column).alias("message"), F.col(column).alias("raw"))


_MIDDLE = 1_705_276_800_000_000  # 15 January 2024


def _halves(spark, d):
    e = events(spark, d)
    return e.where(F.col("ts_us") < _MIDDLE), e.where(F.col("ts_us") >= _MIDDLE)


_DIFF = f"""{_EVENTS}, s AS (SELECT {_template_sql('message')} AS template, level, (ts_us < {_MIDDLE})::INT AS l, (ts_us >= {_MIDDLE})::INT AS r FROM e)"""


@_query("diff_patterns", f"""{_DIFF}, c AS (SELECT template, sum(l)::BIGINT AS "left", sum(r)::BIGINT AS "right" FROM s GROUP BY 1)
SELECT CASE WHEN "left" = 0 THEN 'new' WHEN "right" = 0 THEN 'gone' ELSE 'changed' END AS kind, template, "left", "right",
  CASE WHEN "left" = 0 THEN 100.0::DOUBLE ELSE ("right" - "left")::DOUBLE / "left" * 100 END AS percent FROM c""")
def _(spark, d):
    return diff.compare(*_halves(spark, d)).patterns


@_query("diff_levels", f"""{_DIFF} SELECT level, sum(l)::BIGINT AS "left", sum(r)::BIGINT AS "right" FROM s WHERE level IN ('fatal', 'error', 'warn', 'info', 'debug') GROUP BY 1""")
def _(spark, d):
    return diff.compare(*_halves(spark, d)).levels


@_query("diff_summary", f"""{_DIFF}, c AS (SELECT template, sum(l) AS a, sum(r) AS b FROM s GROUP BY 1)
SELECT sum(a)::BIGINT AS left_count, sum(b)::BIGINT AS right_count, count(*) FILTER (WHERE a > 0) AS left_patterns, count(*) FILTER (WHERE b > 0) AS right_patterns FROM c""")
def _(spark, d):
    return diff.compare(*_halves(spark, d)).summary


@_query("diff_changed", f"""{_DIFF}, c AS (SELECT template, sum(l)::BIGINT AS "left", sum(r)::BIGINT AS "right" FROM s GROUP BY 1)
SELECT 'changed' AS kind, template, "left", "right", ("right" - "left")::DOUBLE / "left" * 100 AS percent FROM c WHERE "left" > 0 AND "right" > 0 AND abs(("right" - "left")::DOUBLE / "left" * 100) >= 5 ORDER BY abs(percent) DESC, template LIMIT 3""")
def _(spark, d):
    return diff.section(diff.compare(*_halves(spark, d)), "changed", 3, 5.0)


@_query("multi_source_merge", f"{_EVENTS} SELECT 'b' || (line_number % 2) AS source, ts_us AS order_us, line_number FROM e")
def _(spark, d):
    e = events(spark, d)
    both = [e.where(F.col("line_number") % 2 == i).withColumns({"source": F.lit(f"b{i}"), "source_index": F.lit(i)}) for i in (0, 1)]
    return rows.in_order(rows.merge_timeline(both[0].unionByName(both[1]))).select("source", "order_us", "line_number")


@_query("source_match", f"{_EVENTS} SELECT line_number FROM e WHERE line_number % 2 = 1")
def _(spark, d):
    e = events(spark, d).withColumn("fields", F.map_concat("fields", F.create_map(F.lit("source"), F.concat(F.lit("app"), (F.col("line_number") % 2).cast("string"), F.lit(".log")))))
    return rows.matching(e, "source:app1.log").select("line_number")


@_query("projection", f"{_EVENTS} SELECT service, user_id, coalesce(value::VARCHAR, '') AS value, '' AS absent FROM e")
def _(spark, d):
    return rows.project(events(spark, d), ["service", "user_id", "value", "absent"])


@_query("display_columns", f"{_EVENTS} SELECT strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S') AS timestamp, upper(level) AS level, message, k FROM e")
def _(spark, d):
    return rows.display_columns(events(spark, d), ["timestamp", "level", "message", "k"])


@_query("json_rows", f"""{_EVENTS} SELECT line_number, '{{"k":"' || k || '","level":"' || raw_level || '","message":"' || message || '","path":"' || path || '","service":"' || service || '"' || coalesce(',"trace_id":"' || trace_id || '"', '') ||
  ',"user_id":"' || user_id || '"' || coalesce(',"value":"' || value || '"', '') || '}}' AS line FROM e""")
def _(spark, d):
    from .sinks.writers import fields_json

    return events(spark, d).select("line_number", fields_json().alias("line"))


@_query("bookmarks", f"{_EVENTS} SELECT line_number FROM e WHERE line_number IN (3, 7, 77, 100000000)")
def _(spark, d):
    marks = spark.createDataFrame([(3,), (7,), (77,), (100_000_000,)], "line_number long")
    return rows.keep_ids(events(spark, d), marks, "line_number").select("line_number")


@_query("time_range", f"{_EVENTS} SELECT line_number FROM e WHERE ts_us BETWEEN {_MIDDLE} AND {_MIDDLE} + 86400000000")
def _(spark, d):
    return rows.between(events(spark, d), _MIDDLE, _MIDDLE + 86_400_000_000).select("line_number")


@_query("pattern_members", f"{_EVENTS} SELECT line_number FROM e WHERE {_template_sql('message')} = 'User <num> did view at <ip> in <duration>'")
def _(spark, d):
    return patterns.of_pattern(events(spark, d), "User <num> did view at <ip> in <duration>").select("line_number")


@_query("trace_follow", f"{_EVENTS} SELECT line_number FROM e WHERE trace_id = md5('7')")
def _(spark, d):
    return rows.matching(events(spark, d), trace.build_query("trace_id", "8f14e45fceea167a5a36dedd4bea2543")).select("line_number")


@_query("trace_follow_many", f"{_EVENTS} SELECT line_number FROM e WHERE trace_id IN (SELECT trace_id FROM e WHERE level = 'error')")
def _(spark, d):
    e = events(spark, d)
    wanted = rows.matching(e, "level:error").select(field_of(e, "trace_id").alias("value")).where("value is not null")
    return trace.follow_traces(e, wanted, "trace_id").select("line_number")


@_query("detect_ids", f"{_EVENTS} SELECT line_number, 'trace_id' AS name, trace_id AS value, true AS by_name FROM e WHERE trace_id IS NOT NULL")
def _(spark, d):
    return trace.detect_ids(events(spark, d)).select("line_number", F.explode("ids").alias("i")).select("line_number", "i.*")


@_query("field_names", "SELECT unnest(['k', 'level', 'message', 'path', 'service', 'trace_id', 'user_id', 'value']) AS name")
def _(spark, d):
    return catalog.field_names(events(spark, d))


@_query("field_values", f"{_EVENTS} SELECT DISTINCT service AS value FROM e")
def _(spark, d):
    return catalog.field_values(events(spark, d), "service")


@_query("field_values_level", f"{_EVENTS} SELECT raw_level AS value FROM e UNION SELECT level FROM e WHERE level <> ''")
def _(spark, d):
    return catalog.field_values(events(spark, d), "level")


@_query("field_values_many", f"{_EVENTS} SELECT path AS value FROM e WHERE false")
def _(spark, d):
    return catalog.field_values(events(spark, d).withColumn("fields", F.create_map(F.lit("n"), F.col("line_number").cast("string"))), "n")


def _rendered(spark: SparkSession, d: str, text: Column, *more: str) -> DataFrame:
    """Events written as text and read again, dealt by their ids, as a file has few row groups and each is one task."""
    df = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "user_id", "event_type").repartition("event_id").withColumn("lvl", _level())
    back = with_records(df.select("event_id", text.alias("text")), F.col("text")).select(F.col("event_id").alias("line_number"), "_record.*")
    return back.select("line_number", "ts_us", "level", F.col("fields")["user_id"].alias("user_id"), "message", *[F.col("fields")[x].alias(x.replace(".", "_")) for x in more])


_ISO = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
_BACK = f"{_EVENTS} SELECT line_number, ts_us, level, user_id, message FROM e"


_SHARE = "event_id % 4 / 4 + user_id"


@_query("roundtrip_json", f"""{_EVENTS} SELECT e.line_number, ts_us, level, e.user_id, message, CASE WHEN line_number % 4 = 0 THEN e.user_id ELSE ((line_number % 4) / 4 + e.user_id::DOUBLE)::VARCHAR END AS nested_v,
  '["' || service || '",{{"a":null,"n":[' || e.user_id || ',true]}}]' AS nested_deep_tags FROM e""")
def _(spark, d):
    """Objects in objects become fields with dotted names, a fraction prints in its shortest form, and an array is JSON text with its keys in order."""
    tags = F.concat(F.lit('["'), F.col("event_type"), F.lit('", {"n": ['), F.col("user_id").cast("string"), F.lit(', true], "a": null}]'))
    nested = F.concat(F.lit(', "nested": {"v": '), F.expr(f"cast({_SHARE} as string)"), F.lit(', "deep": {"tags": '), tags, F.lit(', "none": null}}}'))
    flat = F.to_json(F.struct(F.expr(_ISO).alias("time"), F.col("lvl").alias("severity"), "user_id", _message().alias("msg")))
    return _rendered(spark, d, F.concat(F.substring(flat, F.lit(1), F.length(flat) - 1), nested), "nested.v", "nested.deep.tags")


@_query("roundtrip_pairs", _BACK)
def _(spark, d):
    return _rendered(spark, d, _pairs_line())


@_query("roundtrip_plain", f"""{_EVENTS} SELECT line_number, (ts_us // 1000) * 1000 AS ts_us, CASE WHEN raw_level = 'DBG' THEN '' ELSE level END AS level, NULL::VARCHAR AS user_id,
  strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S.') || lpad(((ts_us // 1000) % 1000)::VARCHAR, 3, '0') || ' [' || raw_level || '] ' || message AS message FROM e""")
def _(spark, d):
    return _rendered(spark, d, _plain_line())


@_query("multiline_group", f"""{_EVENTS} SELECT 3 * row_number() OVER (ORDER BY line_number) - 2 AS line_number, (ts_us // 1000) * 1000 AS ts_us, 'at a.B.user' || user_id AS message, 3 AS lines FROM e""")
def _(spark, d):
    """Entries of three lines, of lines that are rows of a table: a time alone, which leaves the message to the line after it, and a line of dashes. A thousand events are a block."""
    df = spark.read.parquet(f"{d}/events.parquet")
    place = F.col("event_id") - F.lit(df.agg(F.min("event_id")).first()[0])  # ids have no gaps
    rows_ = df.select(F.lit("f").alias("path"), (F.floor(place / 1000)).alias("block"), F.posexplode(F.array(F.expr("date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS')"), F.lit("----"), F.concat(F.lit("  at a.B.user"), F.col("user_id").cast("string")))).alias("k", "value"), (3 * place).alias("at"))
    lines = number_lines(rows_.select("path", "block", (F.col("at") + F.col("k")).alias("at"), "value"))
    return parse_entries(group_entries(lines, "timed")).select("line_number", "ts_us", "message", F.size(F.split("raw", "\n")).alias("lines"))


def _folder(spark: SparkSession) -> str:
    """A new shared folder for files; a temporary one only where Spark runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tallylog-")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def _written(spark: SparkSession, d: str, line: Column, files: int = 1, zipped: bool = False) -> list[str]:
    """The events as logs of lines, each in the order of ids, one log for each remainder of the id; their paths. A log is a folder of parts, written by as many tasks. Of zipped ones every second has parts whose names don't tell."""
    df, base, paths = spark.read.parquet(f"{d}/events.parquet").withColumn("lvl", _level()), _folder(spark), []
    for i in range(files):
        path = f"{base}/{i}"
        lines = df.where(F.col("event_id") % files == i).repartitionByRange("event_id").sortWithinPartitions("event_id").select(line.alias("value"))
        lines.write.option("compression", "gzip" if zipped else "none").text(path)
        if zipped and i % 2:
            for part in parts_of(spark, path):
                old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (part, part.removesuffix(".txt.gz") + ".log"))
                old.getFileSystem(spark._jsc.hadoopConfiguration()).rename(old, new)
        paths.append(path)
    return paths


def _json_line() -> Column:
    return F.to_json(F.struct(F.expr(_ISO).alias("time"), F.col("lvl").alias("severity"), "user_id", _message().alias("msg")))


def _pairs_line() -> Column:
    return F.concat(F.lit("ts="), F.expr(_ISO), F.lit(" lvl="), F.col("lvl"), F.lit(" user_id="), F.col("user_id").cast("string"), F.lit(' msg="'), _message(), F.lit('"'))


def _plain_line() -> Column:
    return F.concat(F.expr("date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS')"), F.lit(" ["), F.col("lvl"), F.lit("] "), _message())


def _from_files(files: int) -> str:
    return f"""{_EVENTS} SELECT (line_number % {files})::INT AS source_index, row_number() OVER (PARTITION BY line_number % {files} ORDER BY line_number) AS line_number, ts_us, level, user_id, message FROM e"""


_READ = ("source_index", "line_number", "ts_us", "level", "fields['user_id'] AS user_id", "message")


@_query("read_json_files", _from_files(2))
def _(spark, d):
    return read_logs(spark, _written(spark, d, _json_line(), 2)).selectExpr(*_READ)


@_query("read_pairs_files", _from_files(3))
def _(spark, d):
    return read_logs(spark, _written(spark, d, _pairs_line(), 3)).selectExpr(*_READ)


@_query("read_gzip", _from_files(2))
def _(spark, d):
    return read_logs(spark, _written(spark, d, _json_line(), 2, zipped=True)).selectExpr(*_READ)


@_query("read_plain_traces", f"""{_EVENTS} SELECT 3 * row_number() OVER (ORDER BY line_number) - 2 AS line_number, (ts_us // 1000) * 1000 AS ts_us, CASE WHEN raw_level = 'DBG' THEN '' ELSE level END AS level,
  strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S.') || lpad(((ts_us // 1000) % 1000)::VARCHAR, 3, '0') || ' [' || raw_level || '] ' || message AS message, 3 AS lines FROM e""")
def _(spark, d):
    """Entries of three lines, found by the times at their beginnings."""
    trace_lines = F.concat(_plain_line(), F.lit("\njava.lang.IllegalStateException: no\n\tat a.B.c(D.java:1)"))
    return read_logs(spark, _written(spark, d, trace_lines)).select("line_number", "ts_us", "level", "message", F.size(F.split("raw", "\n")).alias("lines"))


@_query("read_structured", f"{_EVENTS} SELECT 2 * row_number() OVER (ORDER BY line_number) - 1 AS line_number, 2 AS lines FROM e")
def _(spark, d):
    """Entries that begin as JSON does, with a line of something else after each."""
    return read_logs(spark, _written(spark, d, F.concat(_json_line(), F.lit("\n  more of it")))).select("line_number", F.size(F.split("raw", "\n")).alias("lines"))


@_query("merged_files", f"""{_EVENTS}, l AS (SELECT (line_number % 2)::INT AS source_index, row_number() OVER (PARTITION BY line_number % 2 ORDER BY line_number) AS line_number, CASE WHEN line_number % 10 <> 3 THEN ts_us END AS ts_us FROM e)
SELECT source_index, line_number, ts_us, last_value(ts_us IGNORE NULLS) OVER (PARTITION BY source_index ORDER BY line_number) AS order_us FROM l""")
def _(spark, d):
    """Lines without a time stand after the last one of their file that has one."""
    line = F.when(F.col("event_id") % 10 == 3, F.lit("a note without a time")).otherwise(_json_line())
    return rows.in_order(read_logs(spark, _written(spark, d, line, 2))).select("source_index", "line_number", "ts_us", "order_us")


@_query("follow_growing", f"{_EVENTS} SELECT ts_us, user_id, message FROM e WHERE level = 'error'")
def _(spark, d):
    """A log followed from its first byte to its present end. It is read where the driver is, so its folder must be there, too."""
    from .streaming.follow import follow

    (path,) = _written(spark, d, _json_line())
    out = _folder(spark)
    schema = "ts_us long, user_id string, message string"
    spark.createDataFrame([], schema).write.parquet(out)

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("ts_us", F.col("fields")["user_id"].alias("user_id"), "message").write.mode("append").parquet(out)

    follow(spark, path.removeprefix("file://").replace("file:", ""), "level:error", keep, f"{out}-state", once=True).awaitTermination()
    return spark.read.schema(schema).parquet(out)


@_query("csv_rows", f"""{_EVENTS} SELECT 'k,message,value' AS line UNION ALL SELECT concat_ws(',', k, message, coalesce(value::VARCHAR, '')) FROM e""")
def _(spark, d):
    """Rows written as CSV by the executors and read back as lines, under a header of their own."""
    from .sinks.writers import save_rows

    out, names = _folder(spark), ["k", "message", "value"]
    save_rows(events(spark, d), out, "csv", names)
    return spark.createDataFrame([(",".join(names),)], "line string").unionByName(spark.read.text(out).select(F.col("value").alias("line")))


@_query("detect_ids_by_value", f"""{_EVENTS} SELECT line_number, 'ref' AS name, md5(user_id) AS value, false AS by_name FROM e UNION ALL
SELECT line_number, 'session', substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21), false FROM (SELECT line_number, md5(path) AS m FROM e)""")
def _(spark, d):
    e = events(spark, d)
    m = F.md5(e["f_path"].cast("binary"))
    session = F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    pairs = [F.lit("ref"), F.md5(e["f_user_id"].cast("binary")), F.lit("session"), session, F.lit("note"), F.lit("0123456789abcde"), F.lit("short"), F.substring(session, 1, 35)]
    named = e.select("line_number", F.create_map(*pairs).alias("fields"))
    return trace.detect_ids(named).select("line_number", F.explode("ids").alias("i")).select("line_number", "i.*")


def _leaf(path: str, value: str, depth: int, children: int = 0) -> str:
    key = path.rpartition(".")[2]
    key = key[key.index("[") :] if "[" in key else key
    return f"SELECT event_id, '{path}' AS path, '{key}' AS key, {value} AS value, {depth} AS depth, {'true' if children else 'false'} AS is_node, {children} AS child_count FROM events"


@_query("json_tree", " UNION ALL ".join([
    _leaf("event_id", "event_id::VARCHAR", 0), _leaf("event_type", "event_type", 0), _leaf("who", "''", 0, 2), _leaf("who.tags", "''", 1, 2),
    _leaf("who.tags[0]", "event_type", 2), _leaf("who.tags[1]", "'x'", 2), _leaf("who.user_id", "user_id::VARCHAR", 1)]))
def _(spark, d):
    df = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.to_json(F.struct("event_id", "event_type", F.struct("user_id", F.array("event_type", F.lit("x")).alias("tags")).alias("who"))).alias("raw"))

    @F.udf("array<struct<path:string,key:string,value:string,depth:int,is_node:boolean,child_count:int>>", useArrow=True)
    def lines(raw):
        return tree_lines(raw)

    return df.select("event_id", F.explode(lines("raw")).alias("line")).select("event_id", "line.*")


@_query("highlight_ranges", f"""{_EVENTS} SELECT line_number, (strpos(message, service) - 1)::INT AS "start", (strpos(message, service) - 1 + length(service))::INT AS "end" FROM e WHERE service = 'click'""")
def _(spark, d):
    e = rows.matching(events(spark, d), "service:click")
    return e.select("line_number", F.explode(match_ranges('CLICK AND NOT view', "message", F.col("message"))).alias("r")).select("line_number", "r.*")


@_query("promoted_columns", f"{_EVENTS} SELECT line_number FROM e WHERE service = 'error' AND coalesce(value > 1000, false)")
def _(spark, d):
    from .plans.compiler import promote

    return rows.matching(promote(events(spark, d), ["service", "value"]), "service:error AND value>1000").select("line_number")


@_query("follow_available_now", f"{_EVENTS} SELECT line_number, level, message FROM e WHERE level = 'error'")
def _(spark, d):
    """The events, written as a folder of lines, followed to their present end."""
    from .streaming.follow import follow_directory

    base = _folder(spark)
    df = spark.read.parquet(f"{d}/events.parquet")
    df.select(F.to_json(F.struct(F.col("event_id").alias("id"), _level().alias("level"), _message().alias("message")))).write.text(f"{base}/in")
    stream = rows.matching(follow_directory(spark, f"{base}/in"), "level:error").select(F.col("fields")["id"].cast("long").alias("line_number"), "level", "message")
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _stored(spark: SparkSession, d: str, file_rows: int = 2000) -> str:
    """The events in a store: two saves, one of which has every third event only."""
    from .sources.store import save_records

    path, e = _folder(spark), events(spark, d)
    for part in (e.where(F.col("line_number") % 3 != 0), e.where(F.col("line_number") % 3 == 0)):
        save_records(part, path, ["service", "value"], ["trace_id"], file_rows)
    return path


@_query("store_trace", f"{_EVENTS} SELECT line_number, ts_us FROM e WHERE trace_id = md5('7')")
def _(spark, d):
    from .sources.store import look_up

    return look_up(spark, _stored(spark, d), "trace_id:8f14e45fceea167a5a36dedd4bea2543").select("line_number", "ts_us")


@_query("store_word", f"{_EVENTS} SELECT line_number, message FROM e WHERE contains(lower(message), 'user 33 did purchase') OR (k = '7' AND coalesce(value > 4000, false))")
def _(spark, d):
    from .sources.store import look_up

    return look_up(spark, _stored(spark, d), '"USER 33 did purchase" OR (k:7 AND value>4000)').select("line_number", "message")


@_query("store_last", f"{_EVENTS} SELECT line_number, level FROM e WHERE ts_us >= {NOW_US} - 36 * 3600000000 AND level = 'error'")
def _(spark, d):
    """The last days of a store, one of which was written anew after the second save."""
    from .sources.store import compact, look_up

    path = _stored(spark, d)
    compact(spark, path, "2024-01-19", ["trace_id"])
    return look_up(spark, path, "last:36h AND level:error", now_us=NOW_US).select("line_number", "level")


#: Bytes of a followed batch at most, and seconds without a batch after which one is given up.
FOLLOWED_BYTES, STALLED_S = 256 << 20, 600


@_query("follow_traces", f"""{_EVENTS} SELECT * FROM (SELECT 3 * row_number() OVER (ORDER BY line_number) - 2 AS line_number, (ts_us // 1000) * 1000 AS ts_us, level, 3 AS lines FROM e) WHERE level <> 'debug'""")
def _(spark, d):
    """Entries of three lines in a log that is followed in bounded batches, which cut some entries in two; the last one comes when no line has come for a while."""
    import time

    from .streaming.follow import follow, log_size

    (path,) = _written(spark, d, F.concat(_plain_line(), F.lit("\njava.lang.IllegalStateException: no\n\tat a.B.c(D.java:1)")))
    out, schema, seen, last = _folder(spark), "line_number long, ts_us long, level string, lines int", [0], [time.time()]
    wanted = spark.read.parquet(f"{d}/events.parquet").count()
    local = path.removeprefix("file://").replace("file:", "")
    spark.createDataFrame([], schema).write.parquet(out)

    def keep(batch: DataFrame, number: int) -> None:
        batch = batch.select("line_number", "ts_us", "level", F.size(F.split("raw", "\n")).alias("lines")).persist()
        n = batch.count()
        batch.where("level != ''").write.mode("append").parquet(out)
        batch.unpersist()
        seen[0] += n
        last[0] = time.time()

    query = follow(spark, local, "", keep, f"{out}-state", across="timed", wait_ms=500, every="200 milliseconds", most=min(log_size(local) // 3 + 1, FOLLOWED_BYTES))
    try:
        while seen[0] < wanted and query.isActive and time.time() < last[0] + STALLED_S:
            time.sleep(0.2)
    finally:
        query.stop()
    if query.exception() or seen[0] != wanted:
        raise RuntimeError(f"{seen[0]} of {wanted} entries came: {query.exception()}")
    return spark.read.schema(schema).parquet(out)


_FIELDS = {"level": "raw_level", "service": "service", "user_id": "user_id", "value": "value::VARCHAR", "k": "k", "path": "path", "trace_id": "trace_id", "message": "message"}


@_query("values_of_all_fields", f"{_EVENTS}, v AS (" + " UNION ".join(f"SELECT '{name}' AS name, {sql} AS value FROM e" for name, sql in _FIELDS.items()) + " UNION SELECT 'level', level FROM e), n AS (SELECT name FROM v WHERE value <> '' GROUP BY name HAVING count(*) <= 50) SELECT name, value FROM v JOIN n USING (name) WHERE value <> ''")
def _(spark, d):
    return catalog.values_of_all_fields(events(spark, d))


@_query("summary", f"{_EVENTS} SELECT count(*) AS total, count(*) FILTER (value > 5000) AS matches, count(*) FILTER (value > 5000 AND level IN ('error', 'fatal')) AS errors, min(ts_us) FILTER (value > 5000) AS low, max(ts_us) FILTER (value > 5000) AS high FROM e")
def _(spark, d):
    """What was counted while the matches were written."""
    from .operators.summary import summarised

    found, summary = summarised(events(spark, d), "value>5000")
    found.select("line_number").write.parquet(_folder(spark))
    got = summary.get()
    names = ["total", "matches", "errors", "low", "high"]
    return spark.createDataFrame([tuple(got[n] for n in names)], ", ".join(f"{n} long" for n in names))


@_query("bookmark_next", f"{_EVENTS}, m AS (SELECT line_number FROM e WHERE (level = 'error' AND user_id::BIGINT % 7 = 0) <> (user_id::BIGINT % 11 = 0)) SELECT line_number, coalesce((SELECT min(m.line_number) FROM m WHERE m.line_number > e.line_number), (SELECT min(line_number) FROM m)) AS next FROM e")
def _(spark, d):
    """Errors of some users are marked, then every record of others is toggled; each record's next mark."""
    e = events(spark, d)
    user = F.col("fields")["user_id"].cast("long")
    marks = rows.toggled(e.where((F.col("level") == "error") & (user % 7 == 0)), e.where(user % 11 == 0), "line_number")
    return rows.next_marked(e.select("line_number"), marks, "line_number")
