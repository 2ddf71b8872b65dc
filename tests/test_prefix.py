from __future__ import annotations

import random

from pyspark.sql import functions as F

from millrace.operators.lookup import lookup
from millrace.operators.prefix import Running, number, number_by_order, running
from millrace.session import stage_facts


def test_running_across_buckets(spark):
    rng = random.Random(3)
    rows = []
    for g in ("a", "b"):
        for p in sorted(rng.sample(range(400_000), 300)):
            rows.append((g, p, rng.randint(-5, 5)))
    df = spark.createDataFrame(rows, "g string, p long, v long")
    specs = [
        Running("total", "sum", F.col("v")), Running("high", "max", F.col("v"), strict=True),
        Running("low", "min", F.col("v"), backward=True),
    ]
    got = {(r["g"], r["p"]): (r["total"], r["high"], r["low"]) for r in running(df, ["g"], "p", specs).collect()}
    for g in ("a", "b"):
        mine = [(p, v) for gg, p, v in rows if gg == g]
        for i, (p, _) in enumerate(mine):
            before = [v for _, v in mine[:i]]
            want = (sum(v for _, v in mine[: i + 1]), max(before) if before else None, min(v for _, v in mine[i:]))
            assert got[(g, p)] == want


def test_numbers_are_gap_free(spark):
    df = spark.range(2500).select((F.col("id") * 977).alias("p"))
    got = sorted((r["p"], r["n"]) for r in number(df, [], "p", "n").collect())
    assert [n for _, n in got] == list(range(1, 2501))
    by = number_by_order(df.withColumn("k", -F.col("p")), ["k"], "n").orderBy("n").collect()
    assert [r["n"] for r in by] == list(range(1, 2501)) and by[0]["p"] == 2499 * 977


def test_lookup_beyond_broadcast_and_under_hot_keys(spark):
    left = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"))
    left = left.withColumn("k", F.when(F.col("id") % 10 != 7, F.col("k")))
    right = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("f"), F.when(F.col("id") == 0, 2000).otherwise(1).alias("w"))
    want = sorted((r["id"], None if r["k"] is None or r["k"] >= 3000 else r["k"] * 2) for r in left.collect())
    for limit in (10_000, 0):
        got = lookup(left, right, [(F.col("k"), "k")], ["f"], "w", F.col("id"), broadcast_rows=limit)
        assert sorted((r["id"], r["f"]) for r in got.collect()) == want
    empty = lookup(left, right.limit(0), [(F.col("k"), "k")], ["f"], "w")
    assert empty.where("f is not null").isEmpty() and empty.count() == 6000


def test_facts_count_their_rows(spark):
    assert stage_facts(spark.range(37)).rows == 37


def test_staged_tables_go_with_their_block(spark, tmp_path):
    import os

    from millrace.session import stage, staging

    with staging(spark):
        path = stage(spark.range(3), "brief").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_lookup_beyond_broadcast_meets_in_a_shuffle(spark):
    """Small files say little about a side that has been found too wide: Spark must not broadcast it after all."""
    left = spark.range(100).withColumn("k", F.col("id") % 50)
    right = spark.range(50).select(F.col("id").alias("k"), F.lit("x").alias("f"), F.lit(0).alias("w"))  # no key is hot
    for weight in (None, "w"):
        got = lookup(left, right, [(F.col("k"), "k")], ["f"], weight, F.col("id"), broadcast_rows=0)
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString() and got.where("f = 'x'").count() == 100
