"""Records of entries' texts, as columns: JSON objects, key=value pairs and plain text are read inside the JVM.

Flat JSON objects without escapes are taken apart by patterns, others are read as maps of texts, level by level (arrays as variants); pairs and plain text are taken apart by patterns, too. Each step knows exactly what it can vouch for: an entry with anything else in it (a number
that may print differently, repeated keys, an unusual time, deep nesting, text behind the object) is refused, and refused entries alone are handed to ``parse_log``, whose argument is null for all others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import normalize_level
from ..schema import PARSED
from .entries import LEVEL_BYTES, LEVEL_KEYS, LOOK_AHEAD, MESSAGE_KEYS, SHORT_LINE, SHORT_NAMES, TIME_KEYS

#: Objects in objects that are flattened here.
NESTED = 3
#: Escapes in one entry up to which a pattern is let loose on it.
MOST_ESCAPES = 200

_TRIMMED, _VISIBLE_ENDS = r"(?U)^\s+|\s+$", r"^[!-~]{2}\z"
#: What counts as white space or as a letter in some engines only.
_ODD = r"[\x1c-\x1f\u0085İıſK]"
#: Arrays that print as they are: plain ASCII strings, short numbers.
_ARRAY = r"""^(?:[\[\]{}:,]|"[ !#-%'-;=?-\[\]-~]*+"|-?(?:0|[1-9][0-9]{0,8})(?:\.[0-9]{1,5})?(?![0-9.eE])|true|false|null)*+\z"""
#: A flat object of plain strings, short numbers, true, false and null; and one of its pairs.
_SCALAR = r'(?:"[^"\\\x00-\x1f]*+"|(?:0|-?[1-9][0-9]{0,14}+)(?![0-9.eE])|(?!-?0\.0000)-?(?:0|[1-9][0-9]{0,5}+)\.[0-9]{0,8}[1-9](?![0-9eE])|true|false|null)'
_FLAT = rf'^\{{[ \t\r\n]*+(?:"[^"\\\x00-\x1f]++"[ \t\r\n]*+:[ \t\r\n]*+{_SCALAR}[ \t\r\n]*+(?:,[ \t\r\n]*+(?=")|(?=\}}\z)))*+\}}\z'
_FLAT_PAIR = r'"([^"]++)"[ \t\r\n]*+:[ \t\r\n]*+(?:"([^"]*+)"|([^,} \t\r\n]++))'
#: Tokens of JSON, in any order, by which its values' texts tell what they are: no string begins with a bracket or prints as a number that ends in zeros, and none has halves of a pair; numbers are short.
_STRING = r'"(?:(?![\[{\-0-9]|\\u)[^"\\\x00-\x1f]*+(?:\\(?!u[dD][89a-fA-F]).[^"\\\x00-\x1f]*+)*+|(?!-?[0-9]++\.[0-9]*0")[-0-9][^"\\\x00-\x1f]*+)"'
_SHORT_NUMBER = r"(?!-0(?:\.0*+)?+(?![0-9.]))(?!-?0\.0000)-?(?:(?:0|[1-9][0-9]{0,5}+)\.[0-9]{1,9}+|(?:0|[1-9][0-9]{0,14}+))(?![0-9.eE])"
_TOKENS = rf"^(?:[{{}}\[\]:, \t\r\n]++|{_STRING}|{_SHORT_NUMBER}|true|false|null)*+\z"
_ENDS_IN_ZEROS = r"^-?[0-9]+\.[0-9]*0\z"
#: An object whose values stay texts.
_OBJECT = "map<string,string>"
_PAIR = r'\G[ \t]*+([^= \t]*+)=(?:"((?:[^"\\]++|\\[\s\S]|\\\z)*+)"?|([^ \t]*+))'

_DATE, _CLOCK = "[0-9]{4}-[0-9]{2}-[0-9]{2}", "[0-9]{2}:[0-9]{2}:[0-9]{2}"
_ZONED = rf"^{_DATE}T{_CLOCK}(?:\.[0-9]+)?(?:Z|[+-](?:0[0-9]|1[0-7]):[0-5][0-9])\z"
_NAIVE = rf"^{_DATE}[ T]{_CLOCK}(?:\.[0-9]+)?\z"
_EPOCH = r"^[0-9]{10,13}\z"
_LEADING_DATE = rf"^({_DATE}[T ]{_CLOCK}(?:\.[0-9]+)?(?:Z|[+-][0-9]{{2}}:?[0-9]{{2}})?)"
#: Other times that a plain line may begin with.
_OTHER_TIME = rf"^(?:[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}|[A-Z][a-z]{{2}}[\t\n\f\r ]+[0-9]{{1,2}}[\t\n\f\r ]+{_CLOCK}|[0-9]{{2}}/[A-Z][a-z]{{2}}/[0-9]{{4}}:{_CLOCK})"
_LEVEL_WORD = r"(?i)(?:\A|[\t\n\f\r \[(])(DEBUG|INFO|INFORMATION|WARN|WARNING|ERROR|ERR|FATAL|CRITICAL|PANIC)(?=[\t\n\f\r \]):]|\z)"


def plain_time(text: Column) -> Column:
    """Microseconds of the common layouts: a date and a clock with or without a zone, and whole seconds or milliseconds since the epoch; null for all others."""
    whole = text.try_cast("long")
    seconds = F.when(whole > 1_000_000_000_000, (whole / 1000).cast("long")).otherwise(whole)
    rest = F.when(whole > 1_000_000_000_000, (whole - seconds * 1000) / 1000).otherwise(F.lit(0.0))
    epoch = F.when(whole > 1_000_000_000, seconds * 1_000_000 + F.floor((rest * 1_000_000_000).cast("long") / 1000))
    year = ~text.startswith("0000")
    micros = lambda t: F.unix_micros(t.try_cast("timestamp"))
    return F.when(text.rlike(_ZONED) & year, micros(text)).when(text.rlike(_NAIVE) & year, micros(F.concat(text, F.lit("Z")))).when(text.rlike(_EPOCH), epoch)


def _first_of(fields: Column, keys) -> Column:
    """The first of the fields that isn't empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(fields, F.lit(k)), F.lit("")) for k in keys])


def _inner(objects: Column) -> Column:
    """Entries of each of the entries whose value is an object's text."""
    parsed = lambda e: F.map_entries(F.from_json(e["value"], _OBJECT))
    return F.flatten(F.transform(objects, lambda e: F.transform(parsed(e), lambda c: F.struct(F.concat(e["key"], F.lit("."), c["key"]).alias("key"), c["value"].alias("value")))))


def _leaf_text(e: Column) -> Column:
    """An entry with its value as it prints; null in its place where that isn't sure."""
    value = e["value"]
    array = F.try_parse_json(value).try_cast("string")
    text = F.when(value.startswith("["), F.when(array.rlike(_ARRAY), array)).when(value.endswith("0") & value.rlike(_ENDS_IN_ZEROS), F.regexp_replace(value, r"\.?0+\z", "")).otherwise(value)
    return F.struct(e["key"].alias("key"), text.alias("value"))


def _unique(keys: Column) -> Column:
    return F.size(F.array_distinct(keys)) == F.size(keys)


def _flat_columns(df: DataFrame) -> DataFrame:
    """Adds __flat: the fields of a flat JSON object whose strings have no escapes, as most logs' have; null for others."""
    bare = F.col("__bare")
    plain = F.when((F.col("__kind") == "json") & bare.rlike(_FLAT), bare)
    group = lambda i: F.regexp_extract_all(F.col("__even"), F.lit(_FLAT_PAIR), F.lit(i))
    df = df.withColumn("__even", plain)
    # A bare null is no value, and neither a string nor a number is empty in its own group.
    pairs = F.zip_with(F.arrays_zip(group(1).alias("k"), group(2).alias("q")), group(3), lambda p, u: F.struct(p["k"].alias("k"), F.when(u != "null", F.concat(p["q"], u)).alias("v")))
    df = df.withColumn("__fp", pairs)
    return df.withColumn("__flat", F.when(_unique(F.col("__fp.k")), F.map_from_entries(F.filter("__fp", lambda p: p["v"].isNotNull()))))


def _json_columns(df: DataFrame) -> DataFrame:
    """Adds __json: (k, v) of all leaves of an entry that is a JSON object; null for others and for refused ones."""
    bare, df = F.col("__bare"), _flat_columns(df)
    alike = (F.col("__kind") == "json") & F.col("__even").isNull() & bare.rlike(_TOKENS)
    # Jackson stops at the end of an array; the digest in its last object tells that this end is that of the text.
    mark = F.xxhash64(bare).cast("string")
    df = df.withColumn("__v", F.when(alike, F.from_json(F.concat(F.lit("["), bare, F.lit(',{"":"'), mark, F.lit('"}]')), f"array<{_OBJECT}>")))
    df = df.withColumn("__o", F.when((F.size("__v") == 2) & (F.try_element_at(F.get("__v", F.lit(1)), F.lit("")) == mark), F.get("__v", F.lit(0))))
    # By these tokens, a value that begins with a bracket is no string: objects and arrays are known by their first characters.
    levels, whole = [F.map_entries("__o")], ~F.map_contains_key("__o", "")
    for i in range(NESTED):
        df = df.withColumn(f"__l{i}", levels[i])
        df = df.withColumn(f"__b{i}", F.filter(f"__l{i}", lambda e: e["value"].startswith("{")))
        levels.append(F.when(F.size(f"__b{i}") > 0, _inner(F.col(f"__b{i}"))))
        whole = whole & ((F.coalesce(F.size(f"__b{i}"), F.lit(0)) == 0) | F.col(f"__l{i + 1}").isNotNull())
    df = df.withColumn(f"__l{NESTED}", levels[NESTED])
    none = F.array().cast("array<struct<key:string,value:string>>")
    df = df.withColumn("__all", F.when(F.col("__l0").isNotNull(), F.concat("__l0", *[F.coalesce(f"__l{i + 1}", none) for i in range(NESTED)])))
    df = df.withColumn("__pj", F.transform(F.filter("__all", lambda e: e["value"].isNotNull() & ~e["value"].startswith("{")), _leaf_text))
    deeper = F.exists(f"__l{NESTED}", lambda e: e["value"].startswith("{"))
    ok = whole & ~F.coalesce(deeper, F.lit(False)) & _unique(F.col("__all.key")) & ~F.exists("__pj", lambda e: e["value"].isNull())
    return df.withColumn("__json", F.coalesce("__flat", F.when(ok, F.map_from_entries("__pj"))))


def _pair_columns(df: DataFrame) -> DataFrame:
    """Adds __pairs (a map), and __loose: an entry with ``=`` that has fewer than two pairs, and so is plain text."""
    bare = F.col("__bare")
    asked = (F.col("__kind") == "pairs") & (F.length(bare) - F.length(F.replace(bare, F.lit("\\"), F.lit(""))) <= MOST_ESCAPES)
    group = lambda i: F.regexp_extract_all(bare, F.lit(_PAIR), F.lit(i))
    values = F.zip_with(group(2), group(3), lambda q, u: F.concat(q, u))
    found = F.filter(F.zip_with(group(1), values, lambda k, v: F.struct(k.alias("k"), v.alias("v"))), lambda p: p["k"] != "")
    df = df.withColumn("__pp", F.when(asked, found))
    df = df.withColumn("__pm", F.when((F.size("__pp") > 1) & _unique(F.col("__pp.k")), F.map_from_entries("__pp")))
    own = F.col("__pm")
    named = [F.struct(F.lit(name).alias("k"), F.try_element_at(own, F.lit(short)).alias("v")) for short, name in SHORT_NAMES.items()]
    more = F.filter(F.array(*named), lambda p: p["v"].isNotNull() & ~F.map_contains_key(own, p["k"]))
    return df.withColumns({"__pairs": F.when(own.isNotNull(), F.map_concat(own, F.map_from_entries(more))), "__loose": F.coalesce(F.size("__pp") < 2, F.lit(False)) & F.col("__pp").isNotNull()})


def _plain_columns(df: DataFrame) -> DataFrame:
    """Adds __plain: (ts_us, level, message, fields) of an entry of plain text; null for others and for refused ones."""
    text, bare = F.col("__text"), F.col("__bare")
    plain = (F.col("__kind") == "plain") | F.col("__loose")
    df = df.withColumns({"__first": F.when(plain, F.substring_index(text, "\n", 1)), "__rest": F.when(plain & text.contains("\n"), F.expr("substring(__text, locate('\n', __text) + 1)"))})
    first = F.regexp_replace("__first", _TRIMMED, "")
    df = df.withColumn("__short", first).withColumn("__stamp", F.regexp_extract("__short", _LEADING_DATE, 1))
    head = F.substring(bare, 1, LEVEL_BYTES)
    df = df.withColumns({"__ts": F.when(F.col("__stamp") != "", plain_time(F.col("__stamp"))), "__word": F.regexp_extract(head, _LEVEL_WORD, 1)})
    ascii_head = (F.octet_length(head) == F.length(head)) | (F.octet_length(bare) <= LEVEL_BYTES)
    sure = ((F.col("__stamp") == "") | F.col("__ts").isNotNull()) & ~F.col("__short").rlike(_OTHER_TIME) & ascii_head
    pieces = F.filter(F.transform(F.split("__rest", "\n", LOOK_AHEAD), lambda p: F.regexp_replace(p, _TRIMMED, "")), lambda p: (p != "") & (p != "---") & ~p.startswith("----"))
    ahead = (F.col("__rest") != "") & F.col("__ts").isNotNull() & (F.octet_length("__short") < SHORT_LINE)
    message = F.when(ahead, F.coalesce(F.try_element_at(pieces, F.lit(1)), F.col("__first"))).otherwise(F.col("__first"))
    level = normalize_level(F.col("__word"))
    df = df.withColumns({"__message": message, "__level": level})
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    fields = F.filter(F.array(entry("timestamp", F.when(F.col("__ts").isNotNull(), F.col("__stamp"))), entry("message", F.col("__message")), entry("level", F.when(F.col("__word") != "", F.col("__level")))), lambda p: p["v"].isNotNull())
    made = F.struct(F.col("__ts").alias("ts_us"), F.col("__level").alias("level"), F.col("__message").alias("message"), F.map_from_entries(fields).alias("fields"), text.alias("raw"))
    return df.withColumn("__plain", F.when(plain & sure, made))


def sure_records(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with __text, and with __sure: the record of each text that is read here; null where it is refused."""
    df = df.withColumn("__text", F.coalesce(text.cast("string"), F.lit("")))
    text = F.col("__text")
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    df = df.withColumn("__bare", F.when(ends.rlike(_VISIBLE_ENDS), text).otherwise(F.regexp_replace(text, _TRIMMED, "")))
    bare = F.col("__bare")
    odd = F.when(F.octet_length(text) > F.length(text), text.rlike(_ODD)).otherwise(reduce(Column.__or__, [text.contains(c) for c in "\x1c\x1d\x1e\x1f"]))
    df = df.withColumn("__kind", F.when(odd, "odd").when(bare == "", "blank").when(bare.startswith("{"), "json").when(bare.contains("="), "pairs").otherwise("plain"))
    df = _plain_columns(_pair_columns(_json_columns(df)))
    df = df.withColumn("__fields", F.coalesce("__json", "__pairs"))
    fields = F.col("__fields")
    df = df.withColumns({"__time": F.regexp_replace(_first_of(fields, TIME_KEYS), _TRIMMED, ""), "__said": _first_of(fields, LEVEL_KEYS), "__body": _first_of(fields, MESSAGE_KEYS)})
    df = df.withColumn("__at", plain_time(F.col("__time")))
    named = F.struct(F.col("__at").alias("ts_us"), F.coalesce(normalize_level(F.col("__said")), F.lit("")).alias("level"), F.coalesce("__body", F.lit("")).alias("message"), fields.alias("fields"), bare.alias("raw"))
    blank = F.struct(F.lit(None).cast("long").alias("ts_us"), F.lit("").alias("level"), F.lit("").alias("message"), F.create_map().cast("map<string,string>").alias("fields"), F.col("__text").alias("raw"))
    sure = F.when(F.col("__kind") == "blank", blank).when(fields.isNotNull() & (F.col("__time").isNull() | F.col("__at").isNotNull()), named).otherwise(F.col("__plain"))
    return df.withColumn("__sure", sure.cast(PARSED))


def with_records(df: DataFrame, text: Column, to: str = "_record") -> DataFrame:
    """``df`` with a column ``to``: the record (see ``schema.PARSED``) of each text. A null text is an empty one, and has an empty record."""
    from .files import parse_log

    own, df = df.columns, sure_records(df, text)
    df = df.withColumn("__slow", parse_log(F.when(F.col("__sure").isNull(), F.col("__text"))))
    return df.select(*[F.col(f"`{c}`") for c in own], F.coalesce("__sure", "__slow").alias(to))

