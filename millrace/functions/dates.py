"""Date and time parsing by a fixed list of formats.

A shape test admits exactly the listed formats; the date part is then rewritten to
year-month-day and cast. Casting parses without a formatter and without an
exception per failure, and keeps the expression small enough to compile.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted layouts. Profiling reads day first where both readings are
# possible, rendering reads month first.
_CLOCK = r"[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"
PROFILE_SHAPE = (
    r"^(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[ T]" + _CLOCK + r")?"
    r"|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}"
    r"|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?: " + _CLOCK + r")?"
    r"|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})$"
)
LITERAL_SHAPE = (
    r"^(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[ T]" + _CLOCK + r")?"
    r"|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}(?: " + _CLOCK + r")?"
    r"|[0-9]{8}"
    r"|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?: " + _CLOCK + r")?"
    r"|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}(?: " + _CLOCK + r")?)$"
)
_YEAR_LAST = r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})"
_SLASHED = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"


def _without_fraction(c: Column) -> Column:
    bare = F.replace(F.regexp_replace(c, r"\.[0-9]+", ""), F.lit("Z"), F.lit(""))
    return F.regexp_replace(bare, r"\s+", " ")


def _cast(text: Column) -> Column:
    return text.try_cast("timestamp")


def profile_timestamp(c: Column) -> Column:
    """At least 6 characters, fraction and Z dropped, first format that fits.

    Only slashed dates may also read month first.
    """
    text = _without_fraction(c)
    dashed = F.replace(text, F.lit("/"), F.lit("-"))
    tries = F.coalesce(
        _cast(F.regexp_replace(dashed, _YEAR_LAST, "$3-$2-$1")),
        _cast(F.regexp_replace(text, _SLASHED, "$3-$1-$2")),
    )
    plausible = (F.length(c) >= 6) & c.rlike(r"^[0-9]{1,4}[-/][0-9]")
    return F.when(plausible, F.when(text.rlike(PROFILE_SHAPE), tries))


def aside(c: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule`` applied to ``c`` as a lambda: large rules for rare values stay out of the generated code."""
    return F.get(F.transform(F.array(c), rule), F.lit(0))


# Month names (English), halves of the day, and the clock as text layouts write it.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_TIME = r"(?:[ t]+([0-9]{1,2})(?::([0-9]{1,2})(?::([0-9]{1,2})(?:\.[0-9]+)?)?)? ?([ap]m)?)?"
_ZONE = r" ?(?:z|utc|gmt|[+-][0-9]{2}:?[0-9]{2})?"
_DAY_TEXTS = (
    # Layout of the day, then its groups in the order year, month, day.
    (r"([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", (1, 2, 3)),
    (r"([0-9]{1,2})[ -]" + _MONTH + r",?[ -]([0-9]{4})", (3, 2, 1)),
    (_MONTH + r" ([0-9]{1,2})(?:st|nd|rd|th)?,? ([0-9]{4})", (3, 1, 2)),
    (r"([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})", (3, 1, 2)),
    (r"([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})", (3, 2, 1)),
)


def _wordy_timestamp(c: Column) -> Column:
    """Layouts beyond the fixed list: minute precision, offsets, month names, halves of the day.

    The clock is the one that the text shows; an offset is read and left out.
    """
    text = F.regexp_replace(F.lower(c), r"\s+", " ")
    text = F.regexp_replace(text, r"^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,? ", "")
    tries = []
    for day, order in _DAY_TEXTS:
        shape = "^" + day + _TIME + _ZONE + "$"
        year, month, date = (F.regexp_extract(text, shape, g) for g in order)
        hour, minute, second, half = (F.regexp_extract(text, shape, g) for g in (4, 5, 6, 7))
        name = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(month, 1, 3)).cast("int")
        number = F.when(name > 0, name).otherwise(month.try_cast("int"))
        h = F.coalesce(hour.try_cast("int"), F.lit(0))
        bad_half = (half != "") & ((h < 1) | (h > 12))
        h = F.when(half == "pm", h % 12 + 12).when(half == "am", h % 12).otherwise(h)
        bare_hour = (hour != "") & (minute == "") & (half == "")
        stamp = F.concat_ws(" ", F.concat_ws("-", year, number.cast("string"), date),
                            F.concat_ws(":", h.cast("string"), F.when(minute != "", minute).otherwise(F.lit("0")), F.when(second != "", second).otherwise(F.lit("0"))))
        tries.append(F.when((year != "") & ~bad_half & ~bare_hour, _cast(stamp)))
    return F.coalesce(*tries)


def literal_timestamp(c: Column) -> Column:
    """A moment in any accepted layout, month first where both readings are possible."""
    text = _without_fraction(c)
    dashed = F.regexp_replace(F.replace(text, F.lit("/"), F.lit("-")), r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")
    tries = F.coalesce(
        _cast(F.regexp_replace(dashed, _YEAR_LAST, "$3-$1-$2")),
        _cast(F.regexp_replace(dashed, _YEAR_LAST, "$3-$2-$1")),
    )
    return F.when(text.rlike(LITERAL_SHAPE), tries).otherwise(aside(c, _wordy_timestamp))


def has_time_of_day(ts: Column) -> Column:
    return (F.hour(ts) + F.minute(ts) + F.second(ts)) > 0


def iso_text(ts: Column) -> Column:
    """Timestamps as ISO text without fraction."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
