from __future__ import annotations

import random

from millrace.operators.profile import profile, unpivot

SAMPLES = {
    "mail": (["a@b.com", "x.y@z.org", "q+1@mail.net"], "email-like"),
    "tel": (["(555) 123-4567", "+91 98765 43210", "555-0101"], "phone-like"),
    "whole": (["1", "-2", "300", "4"], "integer"),
    "money": (["1.5", "2.25", "-3.0", "4"], "decimal"),
    "day": (["2024-01-01", "31/12/2024", "2024/02/03"], "date"),
    "moment": (["2024-01-01 10:00:00", "2024-01-02T11:30:00Z"], "datetime"),
    "flag": (["yes", "no", "yes"], "boolean"),
    "zip": (["01234", "99999", "10001"], "numeric-string"),
    "mixed": (["1", "x", "2"], "string"),
    "none": ([None, " ", "null", "NaN"], "string"),
    "three": (["yes", "no", "YES"], "string"),
}


def test_type_labels(spark):
    rows = [(c, i, v) for c, (values, _) in SAMPLES.items() for i, v in enumerate(values)]
    got = {r["column"]: r for r in profile(spark.createDataFrame(rows, "column string, row_idx int, value string")).collect()}
    assert {c: got[c]["inferred_type"] for c in SAMPLES} == {c: label for c, (_, label) in SAMPLES.items()}
    empty = got["none"]
    assert (empty["max_length"], empty["min_length"], empty["uniqueness_ratio"], empty["sample_values"]) == (0, 0, 0.0, [])
    assert not any(empty[f] for f in ("is_integer", "is_numeric", "is_date", "is_boolean", "is_numeric_string"))


def test_samples_and_uniqueness(spark):
    rng = random.Random(2)
    values = [rng.choice(["a", " b", "c ", "d", "e", None]) for _ in range(200)]
    df = spark.createDataFrame([(i, v, "k") for i, v in enumerate(values)], "row_idx int, x string, y string")
    got = {r["column"]: r for r in profile(unpivot(df, ["x", "y"])).collect()}
    clean = [v.strip() for v in values if v]
    firsts = list(dict.fromkeys(clean))[:4]
    assert got["x"]["sample_values"] == firsts and got["x"]["n_values"] == len(clean)
    assert got["x"]["uniqueness_ratio"] == round(len(set(clean)) / len(clean), 2)
    assert got["y"]["sample_values"] == ["k"]
