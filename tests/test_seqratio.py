"""The sequence ratio of many pairs at once against written-out values and the plain measure."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from millrace.functions.seqratio import TOGETHER, ratios, sequence_ratio

# (first, second, matched letters): the order of the arguments decides which of several longest blocks counts.
WRITTEN = [("abcd", "bcde", 3), ("tide", "diet", 1), ("diet", "tide", 2), ("", "x", 0), ("ab", "ab", 2), ("orderdate", "dateorder", 5), ("xay", "yax", 1), ("aab", "ab", 2)]


def test_written_out_ratios():
    for first, second, n in WRITTEN:
        assert ratios([(first, second)])[0] == 2.0 * n / (len(first) + len(second)), (first, second)
    assert ratios([("", "")])[0] == 1.0


def test_against_the_plain_measure():
    rng = random.Random(6)
    made = lambda: "".join(rng.choices("abcé\U0001f600" if rng.random() < 0.5 else "abcdefghijkl", k=rng.randrange(0, 26)))
    pairs = [(made(), made()) for _ in range(2 * TOGETHER + 5)] + [("a" * 300, "ab" * 150), ("ab" * 99, "ba" * 99), ("x" * 400, "x"), ("q", "q" * 250)]
    assert ratios(pairs).tolist() == [SequenceMatcher(None, *p).ratio() for p in pairs]


def test_nulls_and_repeats(spark):
    rows = spark.createDataFrame([("ab", "abc"), (None, "a"), ("ab", "abc"), ("", None)], "x string, y string").coalesce(1)
    assert [r[0] for r in rows.select(sequence_ratio(F.col("x"), F.col("y"))).collect()] == [0.8, None, 0.8, None]
