"""V9: a table that references itself, rows judged in row order.

A row passes a reference when it is empty, when no accepted row before it holds
any key yet, or when an accepted row before it holds the key. A row is accepted
when it passes all its references.

Where there is one reference and every key stands in one row, a row's verdict is
that of the end of its chain, and chains halve from round to round. Otherwise
acceptance spreads level by level: each round looks up the newly accepted keys
for the rows still waiting.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.lookup import lookup
from millrace.session import Facts, stage, stage_facts


def accept_in_order(links: DataFrame, refs: Sequence[int]) -> dict[int, tuple[Facts, int | None]]:
    """Fixpoint over ``row_idx, key<i>, ref<i>`` (trimmed text, null when empty).

    Returns per reference ``i`` the facts that decide any row: a staged table
    ``key, since, copies`` (earliest accepted row holding the key, and how many rows
    refer to it) and the first accepted key-bearing row, before which nothing is checked.
    """
    rows = stage(links, "selfref")
    firsts = rows.agg(*[F.min(F.when(F.col(f"key{i}").isNotNull(), F.col("row_idx"))).alias(f"f{i}") for i in refs]).first()
    first = {i: firsts[f"f{i}"] for i in refs}
    demand = {
        i: stage(
            rows.where(F.col(f"ref{i}").isNotNull()).groupBy(F.col(f"ref{i}").alias("key")).agg(
                F.count(F.lit(1)).alias("copies")
            ),
            "selfref-demand",
        )
        for i in refs
    }
    if len(refs) == 1 and not _held_twice(rows, refs[0]):
        total = _by_chains(rows, refs[0], first[refs[0]])
    else:
        total = _by_levels(rows, refs, first, demand)
        # With several references a first key can stand in a row that fails another one: the next row is then the first.
        while late := _rejected_firsts(total, refs, first):
            i = min(late, key=lambda k: first[k])
            first[i] = rows.where(F.col(f"key{i}").isNotNull() & (F.col("row_idx") > F.lit(first[i]))).agg(F.min("row_idx")).first()[0]
            total = _by_levels(rows, refs, first, demand)
    return {
        i: (stage_facts(_starts(total, i).join(demand[i], "key"), "selfref-starts"), first[i]) for i in refs
    }


def _held_twice(rows: DataFrame, i: int) -> bool:
    held = rows.where(F.col(f"key{i}").isNotNull()).groupBy(f"key{i}").agg(F.count(F.lit(1)).alias("n"))
    return not held.where("n > 1").isEmpty()


def _rejected_firsts(total: DataFrame, refs: Sequence[int], first: dict[int, int | None]) -> list[int]:
    """References whose supposed first row isn't among the accepted rows."""
    known = [f for f in first.values() if f is not None]
    seen = {r["row_idx"] for r in total.where(F.col("row_idx").isin(known)).select("row_idx").collect()} if known else set()
    return [i for i in refs if first[i] is not None and first[i] not in seen]


def _by_chains(rows: DataFrame, i: int, first: int | None) -> DataFrame:
    """Accepted rows where each key stands in one row: pointers double until they meet a settled row."""
    free = F.lit(True) if first is None else F.col(f"ref{i}").isNull() | (F.col("row_idx") <= F.lit(first))
    marked = rows.withColumn("free", free)
    holders = rows.where(F.col(f"key{i}").isNotNull()).select(F.col(f"key{i}").alias("key"), F.col("row_idx").alias("at"))
    bound = marked.where(~F.col("free")).select("row_idx", F.col(f"ref{i}").alias("key"))
    linked = bound.join(holders, "key", "left").select("row_idx", F.when(F.col("at") < F.col("row_idx"), F.col("at")).alias("at"))
    open_ = stage(linked, "selfref-open")
    settled = [marked.where("free").select("row_idx", F.lit(True).alias("ok")), open_.where("at IS NULL").select("row_idx", F.lit(False).alias("ok"))]
    settled = [stage(reduce(DataFrame.union, settled), "selfref-settled")]
    open_ = open_.where("at IS NOT NULL")
    while not open_.isEmpty():
        done = reduce(DataFrame.union, settled).select(F.col("row_idx").alias("at"), "ok", F.lit(None).cast("long").alias("further"))
        ahead = done.union(open_.select(F.col("row_idx").alias("at"), F.lit(None).cast("boolean"), F.col("at")))
        step = stage(open_.join(ahead, "at").select("row_idx", "ok", F.col("further").alias("at")), "selfref-step")
        settled.append(step.where("ok IS NOT NULL").select("row_idx", "ok"))
        open_ = step.where("ok IS NULL").select("row_idx", "at")
    accepted = reduce(DataFrame.union, settled).where("ok").select("row_idx")
    return stage(rows.join(accepted, "row_idx", "left_semi"), "selfref-accepted")


def _by_levels(rows: DataFrame, refs: Sequence[int], first: dict[int, int | None], demand: dict[int, DataFrame]) -> DataFrame:
    flags = [f"ok{i}" for i in refs]
    for i in refs:
        unchecked = F.col(f"ref{i}").isNull()
        unchecked = F.lit(True) if first[i] is None else unchecked | (F.col("row_idx") <= F.lit(first[i]))
        rows = rows.withColumn(f"ok{i}", unchecked)
    all_ok = reduce(lambda a, b: a & b, [F.col(f) for f in flags])
    fresh = stage(rows.where(all_ok).drop(*flags), "selfref-pass")
    waiting = stage(rows.where(~all_ok), "selfref-wait")
    accepted = [fresh]
    while not fresh.isEmpty() and not waiting.isEmpty():
        step = waiting
        for i in refs:
            facts = _starts(fresh, i).join(demand[i], "key")
            step = lookup(step, facts, [(F.col(f"ref{i}"), "key")], ["since"], "copies", F.col("row_idx"))
            step = step.withColumn(f"ok{i}", F.col(f"ok{i}") | F.coalesce(F.col("since") < F.col("row_idx"), F.lit(False)))
            step = step.drop("since")
        step = stage(step, "selfref-step")
        fresh = step.where(all_ok).drop(*flags)
        waiting = step.where(~all_ok)
        accepted.append(fresh)
    return reduce(DataFrame.unionByName, accepted)


def _starts(rows: DataFrame, i: int) -> DataFrame:
    held = rows.where(F.col(f"key{i}").isNotNull())
    return held.groupBy(F.col(f"key{i}").alias("key")).agg(F.min("row_idx").alias("since"))
