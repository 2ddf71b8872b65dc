"""Declared SQL type -> value category (C1), and value tests shared by P and O."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import strip

# Declared type names per category; any other name is text.
CATEGORY_NAMES = {
    "integer": ("int", "bigint", "smallint", "tinyint", "integer", "serial", "bigserial", "smallserial"),
    "float": ("decimal", "numeric", "float", "real", "money", "smallmoney", "double", "double precision"),
    "date": ("date", "datetime", "datetime2", "smalldatetime", "time", "datetimeoffset", "timestamp", "timestamptz"),
    "boolean": ("bit", "boolean", "bool"),
}

# Words and patterns the value tests accept.
BOOLEAN_WORDS = ("true", "false", "1", "0", "yes", "no", "t", "f", "y", "n")
TRUE_WORDS = ("1", "true", "yes", "y")
EMAIL_PATTERN = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
PHONE_PATTERN = r"^\+?[0-9\s\-()]{7,20}$"
INTEGER_PATTERN = r"^-?[0-9]+$"
DIGITS_PATTERN = r"^[0-9]+$"
NUMBER_PATTERN = (
    r"^[+-]?(([0-9](_?[0-9])*)(\.([0-9](_?[0-9])*)?)?|\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?$"
    r"|^[+-]?(?i:inf|infinity|nan)$"
)


def category_of(type_name: str) -> str:
    wanted = type_name.split("(")[0].strip().lower()
    for category, names in CATEGORY_NAMES.items():
        if wanted in names:
            return category
    return "string"


def category(c: Column) -> Column:
    """C1 as one ``when`` chain, so it stays inside the projection."""
    name = strip(F.lower(F.regexp_replace(c, r"\(.*$", "")))
    chain = F
    for label, names in CATEGORY_NAMES.items():
        chain = chain.when(name.isin(*names), F.lit(label))
    return chain.otherwise(F.lit("string"))


def is_number(c: Column) -> Column:
    """Text that parses as a float; stricter than a cast, which takes ``5d``."""
    return c.rlike(NUMBER_PATTERN)


def is_integer(c: Column) -> Column:
    return c.rlike(INTEGER_PATTERN)
