r"""Pseudonyms for personal data that keep their format, in SQL expressions alone.

Numbers and dates are validated first (check digits, calendar, octets), then permuted with a key within their own format by a Feistel network:
a card number stays a card number with a right check digit, a date a date, an address an address. The
map is one-to-one, so equal values stay equal across documents and different ones different. What has no such format (mail
addresses, passwords, access keys) becomes a keyed digest of its own, equal for equal values as well.

========== =====================================================  ==========================================
kind       found                                                  becomes
========== =====================================================  ==========================================
card       13 to 19 digits, blanks or dashes, or 4.4.4.4, Luhn    digits permuted, check digit made anew
iban       country, check (mod 97), account; blanks every 4       account's digits permuted, check made anew
phone      +country form of 8 to 15 digits, or North American     digits after the country code permuted
ssn        3-2-4 digits, assignable                               digits permuted among assignable ones
ip         four octets                                            32 bits permuted
date       y-m-d, d.m.y, d-m-y, d/m/y or m/d/y of 1900 to 2099    days of these years permuted
email      local@domain                                           digest@digest.example
secret     password=, token=, api_key= ... with a value; AKIA...  same length, from a digest
========== =====================================================  ==========================================

A secret's value ends at the next blank or quote (in quotes: at the closing one), less a comma or other mark of the sentence. After a bare colon, a word of
up to five letters ("token: hello") reads as prose, and so do words without digits on the next line. In longer runs of digits every part between separators
is tried as a card: 4-4-4-4 first, then the longest; parts that don't begin the run must begin as cards do (2 to 6), with four digits or more in all groups but the last.
Cards are looked for last, in what the other kinds leave.

Whatever doesn't validate stays as it is, as does all other text. The halves of a number are mixed by ``ROUNDS`` rounds of a keyed SHA-256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, positional

ROUNDS = 10
#: For tests and demonstrations. Give a secret of your own in production.
DEMO_KEY = "not-a-secret"

_EDGE, _REAR = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_KEY = r"(?:[Pp]assword|PASSWORD|[Pp]asswd|[Pp]wd|[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY)[\"']?+\s{0,3}+"
#: All before a secret's value.
_SECRET = _KEY + r"[=:]={0,2}+>?+\s{0,3}+[\"']?+"
_MARK = r",;.:)\]}>"
#: A value to the next blank or quote; a quote between letters or digits is part of it, marks at its end aren't. Loops are possessive, as others recurse in Java.
_VALUE = rf"(?:[^\s\"']++[\"'](?=[\p{{L}}\p{{N}}]))*+[^\s\"']*[^\s\"'{_MARK}]"
_QUOTED = "|".join(rf"(?<={q})(?=[^{q}\r\n])[^{q}\\\r\n]*+(?:\\[^\r\n][^{q}\\\r\n]*+)*+(?={q})" for q in "\"'")
_PROSE = rf"(?<=:[ \t]{{0,3}})(?:\p{{L}}{{1,5}}[{_MARK}!?]*+(?:\s|\z))|(?<=:\s{{1,3}})(?<=[\r\n]\s{{0,2}})(?![^\s0-9]*+[0-9])"
_BLANKED = r"[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?"
#: Marks in a text where a value of the first pass stood. One of the text's own is found as a value that stays.
_HOLE = "﷐"
#: Tried in this order at each place.
PATTERN = "|".join([
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    _EDGE + r"AKIA[A-Z0-9]{16}" + _REAR,
    _EDGE + _SECRET + rf"(?:{_QUOTED}|(?!{_PROSE}){_VALUE})",
    _EDGE + r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}" + _REAR,
    _EDGE + _BLANKED + _REAR,
    _EDGE + r"(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?:(?=T[0-9]{2}:)|" + _REAR + ")",
    _EDGE + r"(?<![0-9]-)[0-3]?[0-9]([./-])[0-3]?[0-9]\1(?:19|20)[0-9]{2}(?!-?[\p{L}\p{N}])",
    _EDGE + r"(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}" + _REAR,
    r"(?<![\p{L}\p{N}(])\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}" + _REAR,
    _EDGE + r"[0-9]{3}([-.])[0-9]{3}\2[0-9]{4}" + _REAR,
    r"(?<![\p{L}\p{N}.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![\p{L}\p{N}]|\.[0-9])",
    _HOLE,
])
#: Runs of groups of digits in which cards may be, of any length.
CARDS = _EDGE + r"[0-9]{4}(?:\.[0-9]{4}){3}(?![\p{L}\p{N}]|\.[0-9])|" + _EDGE + r"(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![\p{L}\p{N}])(?:[ -][0-9]++(?![\p{L}\p{N}]))*+"


def _q(text: str) -> str:
    """An SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hash(key: str, *parts: str) -> str:
    """Hex digits of the keyed hash of the parts (SQL)."""
    inner = f"sha2(concat_ws('|', {_q(key)}, {', '.join(parts)}), 256)"
    return f"sha2(concat({_q(key)}, {inner}), 256)"


def _number(key: str, *parts: str) -> str:
    """60 bits of it."""
    return f"cast(conv(substring({_hash(key, *parts)}, 1, 15), 16, 10) as bigint)"


def _p10(n: str) -> str:
    return f"cast(rpad('1', 1 + {n}, '0') as bigint)"


def _feistel(key: str, kind: str, digits: str) -> str:
    """Digits to as many digits, one-to-one (SQL). At most 36: a half fits a long."""
    n = f"length({digits})"
    u, v = f"({n} div 2)", f"({n} - {n} div 2)"
    half = lambda s: f"coalesce(try_cast({s} as bigint), 0L)"
    f = _number(key, f"'{kind}'", n, "i", "s.b")
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', {half(f'substring({digits}, 1, {u})')}, 'b', {half(f'substring({digits}, 1 + {u})')}), "
        f"(s, i) -> named_struct('a', s.b, 'b', (s.a + {f} % {_p10(f'if(i % 2 = 0, {u}, {v})')}) % {_p10(f'if(i % 2 = 0, {u}, {v})')}), "
        f"s -> concat(if({u} = 0, '', lpad(cast(s.a as string), {u}, '0')), lpad(cast(s.b as string), {v}, '0')))"
    )


def _mixed(key: str, kind: str, value: str, a: int, b: int) -> str:
    """A number below a * b to another, one-to-one (SQL)."""
    f = _number(key, f"'{kind}'", "i", "if(i % 2 = 0, s.b, s.a)")
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', ({value}) div {b}L, 'b', ({value}) % {b}L), "
        f"(s, i) -> named_struct('a', if(i % 2 = 0, (s.a + {f} % {a}L) % {a}L, s.a), 'b', if(i % 2 = 0, s.b, (s.b + {f} % {b}L) % {b}L)), s -> s.a * {b}L + s.b)"
    )


def _refill(mask: str, digits: str) -> str:
    """The digits of ``mask``, one after the other, become ``digits`` (SQL)."""
    return (
        f"aggregate(split({mask}, ''), named_struct('t', '', 'k', 1), (s, c) -> if(c rlike '[0-9]', "
        f"named_struct('t', concat(s.t, substring({digits}, s.k, 1)), 'k', s.k + 1), named_struct('t', concat(s.t, c), 'k', s.k)), s -> s.t)"
    )


def _luhn(digits: str, skip: int) -> str:
    """Luhn sum of digits; the last has weight 1 if skip is 0, 2 if it is 1 (SQL)."""
    d = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + if((i + {skip}) % 2 = 0, {d}, {d} * 2 - if({d} > 4, 9, 0)))"


def _mod97(text: str) -> str:
    """Remainder by 97 of a text with letters as 10 to 35 (SQL)."""
    return f"aggregate(split({text}, ''), 0, (s, c) -> case when c = '' then s when c rlike '[0-9]' then (s * 10 + cast(c as int)) % 97 else (s * 100 + ascii(c) - 55) % 97 end)"


def _digest(key: str, kind: str, value: str, length: str) -> str:
    long = f"concat({_hash(key, f"'{kind}'", value)}, {_hash(key, f"'{kind}2'", value)}, {_hash(key, f"'{kind}3'", value)}, {_hash(key, f"'{kind}4'", value)})"
    return f"substring(repeat({long}, cast(ceil({length} / 256) as int)), 1, {length})"


def _date(key: str, iso: str) -> str:
    """A valid ISO date text of 1900 to 2099 to another date (SQL): 73,049 days are 17 times 4,297."""
    return f"date_add(date'1900-01-01', cast({_mixed(key, 'date', f"cast(datediff(try_cast({iso} as date), date'1900-01-01') as bigint)", 17, 4297)} as int))"


def _with_digits(key: str, source: str, kind: str, mask: str) -> str:
    return f"element_at(transform(array(regexp_replace({source}, '[^0-9]', '')), d -> {_refill(mask, _feistel(key, kind, 'd'))}), 1)"


def _assignable(key: str, m: str) -> str:
    """An SSN to another that can be assigned: permuted again until it is one (SQL)."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    walk = f"aggregate(sequence(1, 64), {_feistel(key, 'ssn', digits)}, (w, z) -> if(w rlike '^(000|666|9..)|^...00|0000$', {_feistel(key, 'ssn', 'w')}, w))"
    return f"element_at(transform(array({walk}), x -> concat(substring(x, 1, 3), '-', substring(x, 4, 2), '-', substring(x, 6))), 1)"


def _account(m: str, key: str) -> str:
    """A valid IBAN without blanks to another (SQL)."""
    bban = f"substring({m}, 5)"
    return f"element_at(transform(array(if({bban} rlike '[0-9]', {_with_digits(key, bban, 'iban', bban)}, {bban})), b -> concat(substring({m}, 1, 2), lpad(cast(98 - {_mod97(f"concat(b, substring({m}, 1, 2), '00')")} as string), 2, '0'), b)), 1)"


def pseudonym(m: str, key: str) -> str:
    """SQL for the pseudonym of the match ``m`` (an SQL expression), or ``m`` itself where it doesn't validate."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    part = lambda k: f"split({m}, '[./-]')[{k}]"
    iso = lambda d, mo: f"concat({part(2)}, '-', lpad({part(mo)}, 2, '0'), '-', lpad({part(d)}, 2, '0'))"
    sep = f"case when {m} like '%/%' then '/' when {m} like '%-%' then '-' else '.' end"
    lay = lambda d, mo, new: f"date_format({new}, concat({'\'dd\'' if d == 0 else '\'MM\''}, {sep}, {'\'MM\'' if d == 0 else '\'dd\''}, {sep}, 'yyyy'))"
    code = f"regexp_extract({m}, '^[+][0-9]{{1,3}}(?=[ .(-])', 0)"
    rest = f"substring({m}, 1 + length({code}))"
    with_digits = lambda source, kind, mask: _with_digits(key, source, kind, mask)
    octets = f"transform(split({m}, '[.]'), o -> cast(o as bigint))"
    address = f"element_at(transform(array({octets}), o -> o[0] * 16777216L + o[1] * 65536L + o[2] * 256L + o[3]), 1)"
    new_ip = f"element_at(transform(array({_mixed(key, 'ip', 'w', 65536, 65536)}), w -> concat_ws('.', cast(w div 16777216 as string), cast(w div 65536 % 256 as string), cast(w div 256 % 256 as string), cast(w % 256 as string))), 1)"
    new_ip = f"element_at(transform(array({address}), w -> {new_ip}), 1)"
    solid = f"replace({m}, ' ', '')"
    ends = f"filter(transform(sequence(length({solid}), 15, -1), n -> substring({solid}, 1, n)), t -> {_mod97("concat(substring(t, 5), substring(t, 1, 4))")} = 1)"
    # Letters and digits of t back into the blanks of m; what follows t stays.
    spread = lambda t: f"concat(array_join(transform(sequence(1, length({t}), 4), i -> substring({t}, i, 4)), ' '), substring({m}, 1 + length({t}) + (length({t}) - 1) div 4))"
    blanked = f"coalesce(element_at(transform(slice({ends}, 1, 1), v -> element_at(transform(array({_account('v', key)}), t -> {spread('t')}), 1)), 1), {m})"
    blanked = f"if(size({ends}) = 0, {m}, {blanked})"
    prefix = f"regexp_extract({m}, {_q('^' + _SECRET)}, 0)"
    value = f"substring({m}, 1 + length({prefix}))"
    return f"""case
      when {m} rlike {_q('^' + _SECRET)} then concat({prefix}, {_digest(key, 'secret', value, f'length({value})')})
      when {m} like '%@%' then concat({_digest(key, 'mail', f"lower({m})", '12')}, '@', {_digest(key, 'host', f"lower(substring_index({m}, '@', -1))", '8')}, '.example')
      when {m} rlike '^AKIA[A-Z0-9]{{16}}$' then concat('AKIA', upper({_digest(key, 'akia', m, '16')}))
      when {m} rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+$' then if({_mod97(f"concat(substring({m}, 5), substring({m}, 1, 4))")} = 1, {_account(m, key)}, {m})
      when {m} rlike '^[A-Z]{{2}}[0-9]{{2}} ' then {blanked}
      when {m} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' then if(try_cast({m} as date) is null, {m}, cast({_date(key, m)} as string))
      when {m} rlike '^[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{4}}$' then case
        when try_cast({iso(0, 1)} as date) is not null then {lay(0, 1, _date(key, iso(0, 1)))}
        when {m} like '%/%' and try_cast({iso(1, 0)} as date) is not null then {lay(1, 0, _date(key, iso(1, 0)))}
        else {m} end
      when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then if({m} rlike '^(000|666|9..)-|-00-|-0000$', {m}, {_assignable(key, m)})
      when {m} rlike '^[0-9]+([.][0-9]+){{3}}$' then {new_ip}
      when {m} rlike '^([+(]|[0-9]{{3}}[-.][0-9]{{3}}[-.][0-9]{{4}}$)' then if(length({digits}) between 8 and 15, concat({code}, {with_digits(rest, 'phone', rest)}), {m})
      else {m} end"""


def cards(m: str, key: str) -> str:
    """SQL for a run of groups of digits with all cards in it under pseudonyms, from left to right."""
    joined = lambda i, j: f"array_join(slice(r.g, {i} + 1, {j} - {i} + 1), '')"
    shaped = "(i = 0 or (r.g[i] rlike '^([3-6]|2[2-7])' and forall(slice(r.g, i + 1, j - i), x -> length(x) >= 4)))"
    valid = f"(length({joined('i', 'j')}) between 13 and 19 and {shaped} and transform(array({joined('i', 'j')}), y -> {_luhn('y', 0)} % 10 = 0)[0])"
    ends = f"filter(sequence(least(i + 18, size(r.g) - 1), i, -1), j -> {valid})"
    four = "(size(r.g) > i + 3 and forall(slice(r.g, i + 1, 4), x -> length(x) = 4))"
    best = f"transform(array({ends}), e -> if({four} and array_contains(e, i + 3), i + 3, get(e, 0)))[0]"
    spans = f"filter(transform(sequence(0, size(r.g) - 1), i -> named_struct('i', i, 'j', {best})), s -> s.j is not null)"
    # No two that overlap.
    apart = f"aggregate({spans}, named_struct('n', 0, 'out', array_except(array(named_struct('i', 0, 'j', 0)), array(named_struct('i', 0, 'j', 0)))), (s, x) -> if(x.i < s.n, s, named_struct('n', x.j + 1, 'out', concat(s.out, array(named_struct('i', x.i, 'j', coalesce(x.j, 0)))))), s -> s.out)"
    new = f"element_at(transform(array({_feistel(key, 'card', 'p')}), x -> concat(x, cast((10 - {_luhn('x', 1)} % 10) % 10 as string))), 1)"
    start = lambda i: f"(1 + {i} + length(array_join(slice(r.g, 1, {i}), '')))"
    mask = f"substring({m}, {start('x.i')}, {start('(x.j + 1)')} - 1 - {start('x.i')})"
    card = f"element_at(transform(array(regexp_replace({mask}, '[^0-9]', '')), d -> element_at(transform(array(substring(d, 1, length(d) - 1)), p -> {_refill(mask, new)}), 1)), 1)"
    before = f"substring({m}, if(k = 0, 1, {start('(get(a, k - 1).j + 1)')} - 1), {start('x.i')} - if(k = 0, 1, {start('(get(a, k - 1).j + 1)')} - 1))"
    rest = f"substring({m}, {start('(get(a, size(a) - 1).j + 1)')} - 1)"
    text = f"if(size(a) = 0, {m}, concat(array_join(transform(a, (x, k) -> concat({before}, {card})), ''), {rest}))"
    return f"element_at(transform(array(named_struct('g', split({m}, '[ .-]'))), r -> element_at(transform(array({apart}), a -> named_struct('t', {text}, 'n', size(a))), 1)), 1)"


def pseudonymise(df: DataFrame, text_col: str = "text", key: str = DEMO_KEY, found: str | None = None) -> DataFrame:
    """``df`` with the personal data in ``text_col`` replaced; ``found`` names a column for the number of values replaced.

    Null texts stay null with 0 found, and empty ones empty. All columns and rows stay, repeated ones too, whatever their names.
    """
    own = df.columns
    (count_out,) = fresh(df, found or "found")
    df, text_col = positional(df, text_col)
    text = F.col(text_col)
    found_in = lambda t, pattern: F.when(t.rlike(pattern), F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("found"), F.split(t, pattern, -1).alias("between")))
    # First all kinds but cards. A value replaced, or a hole of the text's own, leaves a hole, so that cards are looked for around it.
    out = df.withColumn("_pii", found_in(text, PATTERN)).withColumn("_new", F.expr(f"transform(_pii.found, m -> {pseudonym('m', key)})"))
    hole = _q(_HOLE)
    out = out.withColumn("_kept", F.expr(f"filter(_new, (x, i) -> x != get(_pii.found, i) or x = {hole})"))
    holed = F.expr(f"array_join(transform(_pii.between, (x, i) -> concat(x, coalesce(if(get(_new, i) != get(_pii.found, i), {hole}, get(_pii.found, i)), ''))), '')")
    out = out.withColumn("_rest", F.when(F.col("_new").isNull(), text).otherwise(holed))
    out = out.withColumn("_runs", found_in(F.col("_rest"), CARDS)).withColumn("_cards", F.expr(f"transform(_runs.found, m -> {cards('m', key)})"))
    carded = F.expr("array_join(transform(_runs.between, (x, i) -> concat(x, coalesce(get(_cards, i).t, ''))), '')")
    out = out.withColumn("_rest", F.when(F.col("_cards").isNull(), F.col("_rest")).otherwise(carded))
    filled = F.expr(f"array_join(transform(split(_rest, {hole}, -1), (x, i) -> concat(x, coalesce(get(_kept, i), ''))), '')")
    out = out.withColumn("_text", F.when(F.coalesce(F.size("_kept"), F.lit(0)) > 0, filled).otherwise(F.col("_rest")))
    changed = F.expr(f"coalesce(size(filter(_kept, x -> x != {hole})), 0) + coalesce(aggregate(_cards, 0, (s, x) -> s + x.n), 0)")
    columns = [F.col("_text" if f"c{i}" == text_col else f"c{i}").alias(c) for i, c in enumerate(own)]
    return out.select(*columns, *([changed.alias(count_out)] if found else []))


def op9_feistel_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """Every document with its personal data under pseudonyms."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, found="n_replaced")
