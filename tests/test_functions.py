from __future__ import annotations

import random
from datetime import datetime

from pyspark.sql import functions as F

from millrace.functions import literals as X
from millrace.functions.dates import literal_timestamp, profile_timestamp
from millrace.functions.kinds import category, category_of, is_number
from millrace.functions.text import is_empty, name_tokens, normalise_name, round2, strip


def test_round2_is_exact_half_even(spark):
    rng = random.Random(5)
    values = [k / 200 for k in range(400)] + [k / 1000 for k in range(1000)] + [rng.random() for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    got = rows.select("x", round2(F.col("x")).alias("r")).collect()
    assert all(r["r"] == round(r["x"], 2) for r in got)


def test_strip_and_empty(one):
    assert one(strip, ["  a ", "\t\nb ", "　", None]) == ["a", "b", "", None]
    assert one(is_empty, [" ", None, "0", " "]) == [True, True, False, True]


def test_names(one):
    assert one(normalise_name, ["Customer_Name", "order-date.x y"]) == ["customername", "orderdatexy"]
    assert one(name_tokens, ["CustomerName", "order_Date-x", "__"]) == [["customer", "name"], ["order", "date", "x"], []]


def test_categories(one):
    names = ["INT", "Decimal(10,2)", "datetime2", "bit", "double precision", "nvarchar(5)", " serial "]
    want = ["integer", "float", "date", "boolean", "float", "string", "integer"]
    assert one(category, names) == want
    assert [category_of(n) for n in names] == want


def test_number_test_matches_float(one):
    values = ["1", "-1.5", "1e3", "1_000", "5d", ".5", "5.", "nan", "Infinity", "1__0", "_1", "+", "", "0x10", "1e", "--1"]

    def parses(v):
        try:
            float(v)
            return True
        except ValueError:
            return False

    assert one(is_number, values) == [parses(v) for v in values]


def test_profile_dates(one):
    want = {
        "2024-01-05": datetime(2024, 1, 5), "2024-1-5 3:4:5": datetime(2024, 1, 5, 3, 4, 5), "2024-01-05T10:00:00Z": datetime(2024, 1, 5, 10),
        "2024-01-05 10:00:00.123": datetime(2024, 1, 5, 10), "31/12/2024": datetime(2024, 12, 31), "12/31/2024": datetime(2024, 12, 31),
        "05/06/2024": datetime(2024, 6, 5), "31-12-2024": datetime(2024, 12, 31), "12-31-2024": None, "2024/02/30": None,
        "2024/02/28": datetime(2024, 2, 28), "31/12/2024 1:2:3": datetime(2024, 12, 31, 1, 2, 3), "2024-01-05 10:00": None,
        "20240105": None, "hello": None, "1-1-24": None,
    }
    assert dict(zip(want, one(profile_timestamp, list(want)), strict=True)) == want


def test_literal_dates_read_month_first(one):
    got = one(literal_timestamp, ["05/06/2024", "13/06/2024", "20260630", "2026-06-30 14:30:00", "x"])
    assert got == [datetime(2024, 5, 6), datetime(2024, 6, 13), datetime(2026, 6, 30), datetime(2026, 6, 30, 14, 30), None]


def test_literal_dates_in_other_layouts(one):
    want = {
        "2026-06-30 14:30": datetime(2026, 6, 30, 14, 30), "2026-06-30T14:30:00+02:00": datetime(2026, 6, 30, 14, 30), "2026-06-30T14:30Z": datetime(2026, 6, 30, 14, 30),
        "30 Jun 2026": datetime(2026, 6, 30), "30-June-2026": datetime(2026, 6, 30), "Jun 30, 2026 2:30 PM": datetime(2026, 6, 30, 14, 30),
        "Sept. 3rd, 2026": datetime(2026, 9, 3), "Tue, 30 Jun 2026 14:30:05": datetime(2026, 6, 30, 14, 30, 5), "06/30/2026 12:05 am": datetime(2026, 6, 30, 0, 5),
        "30/06/2026 12:05 pm": datetime(2026, 6, 30, 12, 5), "2026.06.30": datetime(2026, 6, 30), "June 2026": None, "2026-06-30 13:00 pm": None,
        "2026-06-30 25:00": None, "31 Jun 2026": None, "30 Foo 2026": None, "2026-06-30 14": None,
    }
    assert dict(zip(want, one(literal_timestamp, list(want)), strict=True)) == want


def test_wide_exponents(one):
    want = {"1e30": "1" + "0" * 30, "-1.25e1": "-12", "15e-1": "1", "1e-5": "0", ".5e1": "5", "-0.00e5": "0", "9" * 40: "9" * 40, "1e400": "'1e400'", "inf": "'inf'"}
    assert dict(zip(want, one(lambda c: X.literal(c, "integer"), list(want)), strict=True)) == want


# Worked literals that the output format prescribes.
def test_literals(one):
    assert one(lambda c: X.literal(c, "string"), ["John's Restaurant", None, "  "]) == ["'John''s Restaurant'", "NULL", "NULL"]
    assert one(lambda c: X.literal(c, "float"), ["100.5", " 250.75 ", "abc"]) == ["100.5", "250.75", "'abc'"]
    ints = ["42", "3.9", "-3.9", "1e3", "9007199254740993", "007", "-0.5", "-0", "1_000", "x1", ".5"]
    assert one(lambda c: X.literal(c, "integer"), ints) == [
        "42", "3", "-3", "1000", "9007199254740993", "7", "0", "0", "1000", "'x1'", "0",
    ]
    assert one(lambda c: X.literal(c, "boolean"), ["Yes", "t", "1", "False"]) == ["1", "0", "1", "0"]
    dates = ["2026-06-30 14:30:00", "2026-06-30 00:00:00", "soon"]
    assert one(lambda c: X.literal(c, "date"), dates) == ["'2026-06-30 14:30:00'", "'2026-06-30'", "'soon'"]
    assert one(lambda c: X.literal(c, "string", True), ["7.5"]) == ["7.5"]


def test_identifiers(one):
    assert X.quote_identifier("a]b") == "[a]]b]"
    assert X.quote_identifier("[Order]", "mysql") == "`Order`"
    assert one(lambda c: X.identifier(c, "postgres"), ["x", 'a"b']) == ['"x"', '"a""b"']


def test_strip_and_emptiness_at_both_ends(one):
    values = ["a", " a", "a ", " a ", "", " \t", "　", "a b", "!", "~", "\x7f", "é", "é ", " é", "a ", None]
    assert one(strip, values) == [None if v is None else v.strip() for v in values]
    assert one(is_empty, values) == [v is None or not v.strip() for v in values]


def test_strip_of_plain_text_skips_the_trim(spark):
    plan = spark.range(1).select(strip(F.lit("a").cast("string")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN" in plan
