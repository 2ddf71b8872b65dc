"""Text expressions: stripping, emptiness, names, tokens, exact rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a text strip removes (Unicode white space).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _printed(c: Column) -> Column:
    """Whether a text begins with a visible ASCII character; strings compare by bytes."""
    text = c.cast("string")
    return (text >= "!") & (text < "\x7f")


def strip(c: Column, plain: Column | None = None) -> Column:
    """Trimming compares a text's ends with each white space character, so text whose ends are visible ASCII without its spaces skips it.

    ``plain`` is the text without its spaces, where that is at hand.
    """
    plain = F.trim(c.cast("string")) if plain is None else plain
    return F.when(_printed(plain) & _printed(F.substring(plain, -1, 1)), plain).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def is_empty(c: Column) -> Column:
    """V1 for text: null or blank."""
    return c.isNull() | (~_printed(c) & ~_printed(F.substring(c, -1, 1)) & (F.btrim(c, F.lit(WHITESPACE)) == ""))


def is_empty_number(c: Column) -> Column:
    """V1 for doubles: null or NaN."""
    return c.isNull() | F.isnan(c)


def normalise_name(c: Column) -> Column:
    """M1: lower case without white space, underscores, hyphens, dots."""
    return F.regexp_replace(F.lower(c), r"[\s_\-.]+", "")


def name_tokens(c: Column) -> Column:
    """M2: lower-case words; camel case is split first. Duplicates are kept."""
    spaced = F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[\s_\-.]+"), lambda t: t != "")


def column_key(c: Column) -> Column:
    """Lower case, spaces to underscores."""
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def round2(x: Column) -> Column:
    """Round a non-negative double to 2 decimals, half to even on its *exact* binary value.

    ``bround`` rounds the shortest decimal text instead, which turns 0.045 (binary
    0.04499...) into a tie. Splitting the operand makes the product by 100 exact:
    ``hi`` is the rounded product and ``err`` what rounding dropped.
    """
    x = x.cast("double")
    split = x * F.lit(134217729.0)
    upper = split - (split - x)
    lower = x - upper
    hi = x * F.lit(100.0)
    err = (upper * F.lit(100.0) - hi) + lower * F.lit(100.0)
    whole = F.floor(hi)
    part = hi - whole
    up = (
        (part > 0.5)
        | ((part == 0.5) & (err > 0))
        | ((part == 0.5) & (err == 0) & (whole % 2 == 1))
    )
    return (whole + F.when(up, 1).otherwise(0)).cast("double") / F.lit(100.0)
