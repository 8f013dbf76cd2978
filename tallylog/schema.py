"""The record: a fixed envelope and a map of text fields."""

from pyspark.sql import types as T

#: Microseconds since the epoch are the canonical time: years before 1 have no Python datetime. Null is "no time".
PARSED = T.StructType([
    T.StructField("ts_us", T.LongType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("raw", T.StringType()),
])
RECORD = T.StructType([T.StructField("source", T.StringType()), T.StructField("line_number", T.LongType()), *PARSED.fields])
