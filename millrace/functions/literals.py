"""SQL literals and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.dates import aside, literal_timestamp
from millrace.functions.kinds import TRUE_WORDS, is_number
from millrace.functions.text import is_empty, strip

# Identifier quotes per dialect (opening, closing).
QUOTES = {"tsql": ("[", "]"), "mysql": ("`", "`"), "postgres": ('"', '"')}


def quote_identifier(name: str, dialect: str = "tsql") -> str:
    """O9; a quote character inside the name is doubled."""
    left, right = QUOTES.get(dialect, QUOTES["tsql"])
    return left + name.strip("[]`\"' ").replace(right, right * 2) + right


def identifier(c: Column, dialect: str = "tsql") -> Column:
    """O9 for names held as data."""
    left, right = QUOTES.get(dialect, QUOTES["tsql"])
    bare = F.btrim(c, F.lit("[]`\"' "))
    return F.concat(F.lit(left), F.replace(bare, F.lit(right), F.lit(right * 2)), F.lit(right))


def text_literal(c: Column) -> Column:
    """Quoted, inner quotes doubled."""
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def _plain_number(c: Column) -> Column:
    return F.replace(strip(c), F.lit("_"), F.lit(""))


def _shifted(v: Column) -> Column:
    """Exponents, and fractions without a leading digit, shift the point within the digits.

    Beyond the range of a double there is no number.
    """
    parts = r"^[+-]?([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?$"
    front, back = F.regexp_extract(v, parts, 1), F.regexp_extract(v, parts, 2)
    shift = F.coalesce(F.regexp_extract(v, parts, 3).try_cast("int"), F.lit(0))
    right = F.concat(front, F.rpad(F.substring(back, F.lit(1), F.greatest(shift, F.lit(0))), F.greatest(shift, F.lit(0)), "0"))
    kept = F.greatest(F.length(front) + F.least(shift, F.lit(0)), F.lit(0))
    whole = F.ltrim(F.when(shift >= 0, right).otherwise(F.substring(front, F.lit(1), kept)), F.lit("0"))
    whole = F.when(whole == "", F.lit("0")).otherwise(whole)
    finite = is_number(v) & (F.abs(v.try_cast("double")) < float("inf")) & (F.abs(shift) < 400)
    minus = F.when(v.startswith("-") & (whole != "0"), F.lit("-")).otherwise(F.lit(""))
    return F.when(finite, F.concat(minus, whole))


def integer_literal(c: Column) -> Column:
    """Truncated toward zero; digits stay exact at any length, null when not a number."""
    v = _plain_number(c)
    digits = F.regexp_extract(v, r"^[+-]?0*([0-9]+)(\.[0-9]*)?$", 1)
    negative = v.startswith("-") & (digits != "0")
    by_text = F.when(digits != "", F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), digits))
    return F.coalesce(by_text, aside(v, _shifted))


def float_literal(c: Column) -> Column:
    """Kept as written when it parses."""
    return F.when(is_number(strip(c)), strip(c))


def boolean_literal(c: Column) -> Column:
    """O6."""
    return F.when(F.lower(strip(c)).isin(*TRUE_WORDS), F.lit("1")).otherwise(F.lit("0"))


def date_literal(c: Column) -> Column:
    """Date only at midnight, else to the second."""
    shown = F.date_format(literal_timestamp(strip(c)), "yyyy-MM-dd HH:mm:ss")
    return F.concat(F.lit("'"), F.replace(shown, F.lit(" 00:00:00"), F.lit("")), F.lit("'"))


def filled_literal(c: Column, category: str, bare_number: bool = False) -> Column:
    """O4-O8 of a value that is not empty, by declared category; unparsable falls back to text.

    ``bare_number`` marks values whose source column is numeric: those stay unquoted
    in text columns (Q20).
    """
    quoted = c if bare_number else text_literal(c)
    by_kind = {"integer": integer_literal, "float": float_literal, "date": date_literal}
    if category == "boolean":
        return boolean_literal(c)
    return F.coalesce(by_kind[category](c), quoted) if category in by_kind else quoted


def literal(c: Column, category: str, bare_number: bool = False) -> Column:
    """The same for any value; empty is NULL."""
    return F.when(is_empty(c), F.lit("NULL")).otherwise(filled_literal(c, category, bare_number))
