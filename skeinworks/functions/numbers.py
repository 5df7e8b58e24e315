"""Times, sizes and durations as column expressions; text that does not parse gives null.

Numbers in text are gated by anchored patterns: a cast alone accepts blanks and suffixes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = "\\A[+-]?[0-9]+\\z"
DECIMAL = "\\A[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\z"
EDGES = " \t\n\x0b\f\r\x85\xa0\u2028\u2029"

#: Texts that mean no limit, and units.
NO_SIZE = ("", "0", "off", "none", "unbounded", "unlimited")
NO_DURATION = ("", "0", "off", "none", "never")
SIZE_UNITS = {"": 0, "b": 0, "k": 10, "kb": 10, "kib": 10, "m": 20, "mb": 20, "mib": 20, "g": 30, "gb": 30, "gib": 30, "t": 40, "tb": 40, "tib": 40}
DURATION_UNITS = {
    **dict.fromkeys(("", "s", "sec", "secs"), 1),
    **dict.fromkeys(("m", "min", "mins"), 60),
    **dict.fromkeys(("h", "hr", "hrs"), 3600),
    **dict.fromkeys(("d", "day", "days"), 86_400),
    **dict.fromkeys(("w", "week", "weeks"), 604_800),
}


def trimmed(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(c, F.lit(EDGES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(c: Column) -> Column:
    return F.when(c.rlike(WHOLE), c.try_cast("long"))


def decimal(c: Column) -> Column:
    return F.when(c.rlike(DECIMAL), c.try_cast("double"))


def clock(seconds: Column) -> Column:
    """``HH:MM:SS``, hours as long as they are; 0 for what is not finite and positive."""
    good = (seconds > 0) & ~F.isnan(seconds) & (seconds < float("inf"))
    total = F.when(good, F.round(seconds)).otherwise(0.0).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60)


def rfc2822(epoch: Column) -> Column:
    """A date of whole seconds in UTC; the session's time zone must be UTC."""
    return F.coalesce(F.date_format(F.timestamp_seconds(epoch), "EEE, dd MMM yyyy HH:mm:ss Z"), F.lit(""))


def parse_rfc2822(c: Column) -> Column:
    """Epoch seconds, or null; the day's name is not looked at."""
    plain = F.regexp_replace(c, "\\A\\s*[A-Za-z]{3},\\s*", "")
    return F.unix_seconds(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")))


def chapter_seconds(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0.0))


def is_valid_cut(start: Column, end: Column) -> Column:
    return end - start > 0


def cue_seconds(index: Column) -> Column:
    """``mm:ss:ff`` with 75 frames a second; decimals count and what follows a third colon does not.

    Null unless the first three parts are numbers.
    """

    def of(parts: Column) -> Column:
        m, s, f = (decimal(F.get(parts, k)) for k in range(3))
        return m * 60 + s + f / 75

    return let(F.split(index, ":"), of)


def timebase_seconds(value: Column, numerator: Column, denominator: Column) -> Column:
    """``value`` in a time base, 1/1000 where that is missing or has a zero."""
    good = numerator.isNotNull() & (denominator != 0)
    return value * F.when(good, numerator).otherwise(1) / F.when(good, denominator).otherwise(1000)


def track_number(c: Column) -> Column:
    """The leading digits of a tag, if they fit 32 bits."""
    number = F.regexp_extract(trimmed(c), "\\A([0-9]+)", 1)
    value = F.nullif(number, F.lit("")).try_cast("decimal(38,0)")
    return F.when(value < (1 << 32), value.cast("long"))


def _number_and_unit(c: Column, number: str) -> Column:
    """A struct of the whole ``text`` in lower case, the ``number`` before its first letter, null if it is none, and the ``unit`` from there."""

    def cut(text: Column) -> Column:
        split = F.regexp_extract(text, "\\A([^a-z]*)", 1)
        return let(split, lambda s: F.struct(text.alias("text"), trimmed(s).alias("number"), trimmed(F.substring(text, F.length(s) + 1, F.lit(1 << 20))).alias("unit")))

    parts = let(F.lower(trimmed(c)), cut)
    return let(parts, lambda p: F.struct(p["text"].alias("text"), F.when(p["number"].rlike(number), p["number"]).alias("number"), p["unit"].alias("unit")))


def _unit(units: dict[str, int], name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in units.items() for x in pair]), name)


def parse_size(c: Column) -> Column:
    """A struct of ``bytes`` (null: no limit) and ``error`` (null: it parses)."""

    def parsed(p: Column) -> Column:
        return F.struct(p["text"].isin(*NO_SIZE).alias("none"), p["number"].try_cast("double").alias("value"), _unit(SIZE_UNITS, p["unit"]).alias("shift"))

    def made(p: Column) -> Column:
        none, value, shift = p["none"], p["value"], p["shift"]
        size = F.least(F.floor(value * F.pow(F.lit(2.0), shift)).cast("double"), F.lit(float((1 << 63) - 1024))).cast("long")
        error = F.when(none, None).when(value.isNull(), "number").when(value < 0, "negative").when(shift.isNull(), "unit")
        return F.struct(F.when(~none & error.isNull() & (size > 0), size).alias("bytes"), error.alias("error"))

    return let(let(_number_and_unit(c, DECIMAL), parsed), made)


def parse_duration(c: Column) -> Column:
    """A struct of ``seconds`` (null: no limit) and ``error``; seconds stop at the largest long."""
    most = F.lit((1 << 63) - 1)

    def parsed(p: Column) -> Column:
        return F.struct(p["text"].isin(*NO_DURATION).alias("none"), p["number"].try_cast("decimal(38,0)").alias("value"), _unit(DURATION_UNITS, p["unit"]).alias("factor"))

    def made(p: Column) -> Column:
        none, value, factor = p["none"], p["value"], p["factor"]
        total = F.when(value > most / factor, most).otherwise((value * factor).try_cast("long"))
        error = F.when(none, None).when(value.isNull(), "number").when(factor.isNull(), "unit")
        return F.struct(F.when(~none & error.isNull() & (total > 0), total).alias("seconds"), error.alias("error"))

    return let(let(_number_and_unit(c, "\\A[+]?[0-9]+\\z"), parsed), made)


def six_decimals(seconds: Column) -> Column:
    return F.format_string("%.6f", seconds)


def seconds(ts: Column) -> Column:
    """Whole seconds since the epoch of a timestamp of either kind, in the session's time zone."""
    return F.unix_seconds(ts.cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds; 0 before the epoch."""
    return F.greatest(seconds(ts), F.lit(0))


def epoch_millis(ts: Column) -> Column:
    return F.greatest(F.unix_millis(ts.cast("timestamp")), F.lit(0))
