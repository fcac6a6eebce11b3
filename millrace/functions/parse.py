"""Tolerant text parsing as Column expressions.

Unparsable input gives null, never an error. The accepted grammars are those of Python's ``float``
and ``datetime.fromisoformat`` (3.11), which differ from Spark's casts: ``1_000`` is a number,
``1d`` is not, a bare ``2024`` is not a date, ``20240115`` is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_DECIMAL = (
    rf"\A[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"
)
_INFINITE = r"(?i)\A[+-]?inf(?:inity)?\z"
_NAN = r"(?i)\A[+-]?nan\z"

_HOUR = r"(?:[01][0-9]|2[0-3])"
_SIXTY = r"[0-5][0-9]"
_LONG_DATE = r"(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}"
_LONG_TIME = rf"{_HOUR}(?::{_SIXTY}(?::{_SIXTY}(?:[.,][0-9]+)?)?)?"
# Full date and time with or without Z, which a cast reads as it is: nearly all real input.
_PLAIN = r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z?\z"
# Date with dashes and time with colons, in part and with any separator, no offset.
_COMMON = rf"(?s)\A{_LONG_DATE}(?:[^Z]{_LONG_TIME})?\z"
_DATE = rf"{_LONG_DATE}|(?!0000)[0-9]{{8}}"
_WEEK = r"(?!0000)[0-9]{4}-W[0-9]{2}(?:-[1-7])?|(?!0000)[0-9]{4}W[0-9]{2}[1-7]?"
_TIME = rf"{_LONG_TIME}|{_HOUR}{_SIXTY}(?:{_SIXTY}(?:[.,][0-9]+)?)?"
_OFFSET = rf"[+-]{_HOUR}(?::?{_SIXTY}(?::?{_SIXTY})?)?"
_ISO = rf"(?s)\A({_WEEK}|{_DATE})(?:.({_TIME})({_OFFSET})?)?\z"
_MARK = "\x1f"


def strip(c: Column) -> Column:
    """Text without leading and trailing Unicode whitespace."""
    return F.btrim(c, F.lit(WHITESPACE))


def parse_float(c: Column) -> Column:
    """Text to double; null, empty or unparsable text gives null."""
    s = strip(c)
    return (
        F.when(s.rlike(_DECIMAL), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
        .when(s.rlike(_INFINITE), F.when(s.startswith("-"), float("-inf")).otherwise(float("inf")))
        .when(s.rlike(_NAN), float("nan"))
    )


def truncate_to_long(x: Column) -> Column:
    """Double to bigint, truncating toward zero; NaN, infinite and too large values give null."""
    return F.when(~F.isnan(x), x.try_cast("bigint"))


def parse_int(c: Column) -> Column:
    """Text to bigint by way of double, so ``10.9`` gives 10."""
    return truncate_to_long(parse_float(c))


def _canonical_date(d: Column) -> Column:
    compact = F.concat_ws("-", d.substr(1, 4), d.substr(5, 2), d.substr(7, 2))
    week_text = F.replace(d, F.lit("-"), F.lit(""))
    year = week_text.substr(1, 4).try_cast("int")
    week = week_text.substr(6, 2).try_cast("int")
    day = F.coalesce(week_text.substr(8, 1).try_cast("int"), F.lit(1))
    first_monday = F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week")
    next_first_monday = F.trunc(F.make_date(year + 1, F.lit(1), F.lit(4)), "week")
    start = F.date_add(first_monday, (week - 1) * 7)
    from_week = F.when(
        (week >= 1) & (start < next_first_monday),
        F.date_add(start, day - 1).cast("string"),
    )
    return (
        F.when(d.contains("W"), from_week).when(F.length(d) == 8, compact).otherwise(d)
    )


def _canonical_time(t: Column) -> Column:
    colons = F.when(
        t.contains(":") | (F.length(t) <= 2), t
    ).otherwise(
        F.concat(
            t.substr(1, 2),
            F.lit(":"),
            t.substr(3, 2),
            F.when(F.length(t) > 4, F.concat(F.lit(":"), F.substring(t, 5, 64))).otherwise(""),
        )
    )
    padded = F.concat(colons, F.substr(F.lit("00:00:00"), F.length(colons) + 1))
    return F.translate(padded, ",", ".")


def _offset_seconds(o: Column) -> Column:
    digits = F.translate(o, "+-:", "")

    def part(at: int) -> Column:
        return F.coalesce(digits.substr(at, 2).try_cast("int"), F.lit(0))

    size = part(1) * 3600 + part(3) * 60 + part(5)
    return F.when(o.startswith("-"), -size).otherwise(size)


def bind(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with the value computed once, however often the result refers to it."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def _ts_of_fields(fields: Column) -> Column:
    date, time, offset = (F.get(fields, F.lit(i)) for i in range(3))
    utc = F.concat(_canonical_date(date), F.lit("T"), _canonical_time(time), F.lit("Z"))
    ts = utc.try_cast("timestamp")
    return (
        F.when(offset == "", ts)
        .when(offset.isNotNull(), F.timestamp_add("SECOND", -_offset_seconds(offset), ts))
    )


def _common_ts(c: Column) -> Column:
    time_chars = F.greatest(F.length(c) - 11, F.lit(0))
    padding = F.substr(F.lit("00:00:00"), time_chars + 1)
    text = F.concat(c.substr(1, 10), F.lit("T"), F.substring(c, 12, 1000), padding, F.lit("Z"))
    return F.translate(text, ",", ".").try_cast("timestamp")


def parse_ts(c: Column) -> Column:
    """ISO-8601 text to timestamp (an instant); text without an offset is taken as UTC."""
    ends_in_z = c.endswith("Z")
    bare = F.when(ends_in_z, F.substr(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    zoned = F.replace(c, F.lit("Z"), F.lit("+00:00"))
    marked = F.regexp_replace(zoned, _ISO, f"$1{_MARK}$2{_MARK}$3")
    plain = F.when(ends_in_z, c).otherwise(F.concat(c, F.lit("Z"))).try_cast("timestamp")
    return F.when(c.rlike(_PLAIN), plain).when(bare.rlike(_COMMON), _common_ts(bare)).when(
        c.rlike(r"\A[0-9]{4}") & ~c.contains(_MARK),
        bind(F.split(marked, _MARK, 3), _ts_of_fields),
    )


def parse_rss_date(c: Column) -> Column:
    """RFC 822 date (``Mon, 15 Jan 2024 10:00:00 +0000``) or ISO text to timestamp."""
    bare = F.regexp_replace(strip(c), r"\A[A-Za-z]{3,9},\s*", "")
    zoned = F.regexp_replace(bare, r"(?i)\s+(?:GMT|UTC?|Z)\z", " +0000")
    with_seconds = F.regexp_replace(
        zoned, r"\A(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}) ", "$1:00 "
    )
    # The North American zone names of RFC 822.
    for name, offset in (
        ("EST", "-0500"), ("EDT", "-0400"), ("CST", "-0600"), ("CDT", "-0500"),
        ("MST", "-0700"), ("MDT", "-0600"), ("PST", "-0800"), ("PDT", "-0700"),
    ):
        with_seconds = F.regexp_replace(with_seconds, rf"\s+{name}\z", f" {offset}")
    return F.coalesce(
        F.try_to_timestamp(with_seconds, F.lit("d MMM yyyy HH:mm:ss xx")), parse_ts(strip(c))
    )


def split_tags(c: Column) -> Column:
    """Comma separated text to a list of trimmed, non-empty tags; null gives an empty list."""
    parts = F.transform(F.split(c, ","), strip)
    return F.coalesce(F.filter(parts, lambda t: t != ""), F.array().cast("array<string>"))
