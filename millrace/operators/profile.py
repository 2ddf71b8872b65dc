"""Column profiles from values (P1-P13), for many columns and many sources at once.

Values are reduced to distinct values with weights first: that aggregate combines
map-side and spreads a hot column over its values, and every pattern test and
date parse then runs once per distinct value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.dates import has_time_of_day, profile_timestamp
from millrace.functions.kinds import BOOLEAN_WORDS, DIGITS_PATTERN, EMAIL_PATTERN, PHONE_PATTERN, is_integer, is_number
from millrace.functions.text import round2, strip
from millrace.operators.lookup import lookup
from millrace.session import stage, stage_facts

SAMPLES = 4
#: Longer values go through exchanges as digests.
SHORT_BYTES = 64
# Texts that count as no value; code lengths read as numeric text.
NO_VALUE_WORDS = ("null", "nan")
CODE_LENGTHS = (5, 6, 9)

FLAGS = (
    "is_numeric", "is_integer", "is_decimal", "is_date", "is_datetime",
    "is_boolean", "is_email_like", "is_phone_like", "is_numeric_string",
)


def unpivot(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), row: str = "row_idx") -> DataFrame:
    """Wide rows to ``by, row_idx, column, value`` (text)."""
    cast = df.select(*by, row, *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    return cast.unpivot([*by, row], list(columns), "column", "value").withColumnRenamed(row, "row_idx")


def clean_value(c: Column) -> Column:
    """Stripped text; null when blank or a no-value word."""
    v = strip(c)
    return F.when((v != "") & ~F.lower(v).isin(*NO_VALUE_WORDS), v)


def distinct_values(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, column, v, n, first_row``; a column's empty cells form its null group."""
    keyed = values.select(*by, "column", clean_value(F.col("value")).alias("v"), "row_idx")
    return keyed.groupBy(*by, "column", "v").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_row"))


def _tests(v: Column) -> dict[str, Column]:
    """What the flags ask of one value."""
    lower, ts = F.lower(v), profile_timestamp(v)
    return {
        "len": F.length(v), "bool_ok": lower.isin(*BOOLEAN_WORDS), "int_ok": is_integer(v), "num_ok": is_number(v), "dot": v.contains("."),
        "date_ok": F.when(v.isNotNull(), ts.isNotNull()), "timed": has_time_of_day(ts), "mail_ok": v.rlike(EMAIL_PATTERN),
        "phone_ok": v.rlike(PHONE_PATTERN) & (F.length(F.regexp_replace(v, "[^0-9]", "")) >= 7), "digits_ok": v.rlike(DIGITS_PATTERN),
        "zero_led": v.startswith("0") & (F.length(v) > 1),
    }


def tested_values(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, column, v, long, n, first_row`` and the tests of every distinct value; a column's empty cells form its null group.

    A value of more than ``SHORT_BYTES`` is tested where it stands and goes on as a 128-bit digest (``long``), so no long
    text is a grouping key or part of an exchange; short ones are tested once they are distinct.
    """
    v = F.col("v")
    rows = values.select(*by, "column", clean_value(F.col("value")).alias("v"), "row_idx")
    is_long = F.coalesce(F.octet_length(v) > SHORT_BYTES, F.lit(False))
    made = F.when(F.col("long"), F.struct(*[c.alias(n) for n, c in _tests(v).items()]))
    rows = rows.withColumn("long", is_long).withColumn("early", made).withColumn("v", F.when(F.col("long"), F.md5(v.cast("binary"))).otherwise(v))
    found = rows.groupBy(*by, "column", "long", "v").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_row"), F.first("early").alias("early"))
    # The parse is a column of its own, so that the tests share one evaluation.
    late = {n: F.when(F.col("long"), F.col(f"early.{n}")).otherwise(c) for n, c in _tests(v).items()}
    return found.select(*by, "column", "v", "long", "n", "first_row", *[c.alias(n) for n, c in late.items()])


def first_samples(distinct: DataFrame, by: Sequence[str] = (), limit: int = SAMPLES, values: DataFrame | None = None) -> DataFrame:
    """The first distinct values of each column in row order.

    The rank filter limits every map task to ``limit`` rows per column before the
    exchange, so no column's values meet in one task. Where ``distinct`` marks values as ``long``, their
    texts are looked up in ``values`` by the row they were first seen in: a few per column.
    """
    rank = F.row_number().over(W.partitionBy(*by, "column").orderBy("first_row", "v"))
    top = distinct.where(F.col("v").isNotNull()).withColumn("rk", rank).where(F.col("rk") <= limit)
    if values is not None:
        top = stage(top.select(*by, "column", "v", "long", "first_row", "rk", "n"), "top")
        wanted = stage_facts(top.where("long").select(*by, "column", "first_row", F.lit(True).alias("wanted")), "long-samples")
        if wanted.rows:
            cell = [*by, "column"]
            on = [*[(F.col(c), c) for c in cell], (F.col("row_idx"), "first_row")]
            texts = lookup(values.select(*cell, "row_idx", "value"), wanted, on, ["wanted"]).where("wanted")
            texts = texts.select(*[F.col(c).alias(f"__{c}") for c in cell], F.col("row_idx").alias("__row"), clean_value(F.col("value")).alias("__text"))
            same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cell]
            top = top.join(texts, [*same, F.col("first_row") == F.col("__row")], "left").withColumn("v", F.when(F.col("long"), F.col("__text")).otherwise(F.col("v")))
    found = F.array_sort(F.collect_list(F.struct("rk", "v", "n")))
    return top.groupBy(*by, "column").agg(F.transform(found, lambda s: s["v"]).alias("sample_values"))


def profile(values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per column: type label, flags, lengths, uniqueness, samples.

    The distinct values feed both the flags and the samples, so they are staged.
    """
    tested = stage(tested_values(values, by), "distinct")
    v = F.col("v")

    def every(c: str) -> Column:
        return F.coalesce(F.bool_and(c), F.lit(False)).alias(c)

    def some(c: str) -> Column:
        return F.coalesce(F.bool_or(c), F.lit(False)).alias(c)

    folded = tested.groupBy(*by, "column").agg(
        F.coalesce(F.sum(F.when(v.isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"),
        F.count("v").alias("n_distinct"),
        F.min("first_row").alias("first_row"),
        F.coalesce(F.min("len"), F.lit(0)).alias("min_length"),
        F.coalesce(F.max("len"), F.lit(0)).alias("max_length"),
        *[every(c) for c in ("bool_ok", "int_ok", "num_ok", "date_ok", "mail_ok", "phone_ok", "digits_ok")],
        *[some(c) for c in ("dot", "timed", "zero_led")],
    )
    numeric = F.col("int_ok") | F.col("num_ok")
    coded = (F.col("max_length") == F.col("min_length")) & F.col("max_length").isin(*CODE_LENGTHS)
    flagged = folded.select(
        *by, "column", "n_values", "n_distinct", "min_length", "max_length",
        numeric.alias("is_numeric"),
        F.col("int_ok").alias("is_integer"),
        (F.col("num_ok") & F.col("dot")).alias("is_decimal"),
        (F.col("date_ok") & ~F.col("timed")).alias("is_date"),
        (F.col("date_ok") & F.col("timed")).alias("is_datetime"),
        (F.col("bool_ok") & (F.col("n_distinct") <= 2)).alias("is_boolean"),
        F.col("mail_ok").alias("is_email_like"),
        (F.col("phone_ok") & ~numeric).alias("is_phone_like"),
        (F.col("digits_ok") & (F.col("zero_led") | coded)).alias("is_numeric_string"),
        F.when(F.col("n_values") > 0, round2(F.col("n_distinct") / F.col("n_values"))).otherwise(F.lit(0.0)).alias("uniqueness_ratio"),
    )
    typed = flagged.withColumn("inferred_type", inferred_type())
    samples = first_samples(tested, by, values=values)
    keys = [*by, "column"]
    right = samples.select(*[F.col(k).alias(f"__{k}") for k in keys], "sample_values")
    match = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = typed.join(right, match, "left").drop(*[f"__{k}" for k in keys])
    return joined.withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))


def inferred_type() -> Column:
    """The first label whose flag holds."""
    # Labels in order of priority.
    order = (
        ("is_boolean", "boolean"), ("is_datetime", "datetime"), ("is_date", "date"), ("is_email_like", "email-like"),
        ("is_phone_like", "phone-like"), ("is_numeric_string", "numeric-string"), ("is_integer", "integer"),
        ("is_decimal", "decimal"),
    )
    chain = F
    for flag, label in order:
        chain = chain.when(F.col(flag), F.lit(label))
    return chain.otherwise(F.lit("string"))
