"""Running aggregates and gap-free numbering without a one-partition window.

Rows are grouped by the upper bits of their integer position. Every window then
sees at most 2**16 positions, whatever share of the data one source holds, and
the buckets' own running totals are found the same way one level up.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import stage

BITS = 16


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``kind`` is sum, max or min; ``backward`` runs from the end.

    The current row is included unless ``strict``.
    """

    out: str
    kind: str
    value: Column
    backward: bool = False
    strict: bool = False

    def fold(self, c: Column) -> Column:
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](c)

    def join(self, a: Column, b: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        return F.greatest(a, b) if self.kind == "max" else F.least(a, b)


def _window(key: str, order: str, backward: bool, strict: bool):
    spec = W.partitionBy(key).orderBy(F.col(order).desc() if backward else F.col(order).asc())
    return spec.rowsBetween(W.unboundedPreceding, -1 if strict else 0)


def running(df: DataFrame, by: Sequence[str], position: str, specs: Sequence[Running], depth: int = 2) -> DataFrame:
    """Add ``specs`` computed along ``position`` within ``by`` (nulls form a group).

    ``position`` must be a non-negative integer below 2**(16 * (depth + 1)).
    """
    by = list(by)
    key, bucket = f"__key{depth}", f"__bucket{depth}"
    group = [F.col(b) for b in by] or [F.lit(0).alias("all")]
    if depth == 0:
        df = df.withColumn(key, F.struct(*group))
        for s in specs:
            df = df.withColumn(s.out, s.fold(s.value).over(_window(key, position, s.backward, s.strict)))
        return df.drop(key)

    # Group and bucket form one struct key: null-safe, and the join below leaves the
    # rows partitioned just as the window needs them.
    rows = df.withColumn(bucket, F.shiftright(F.col(position), BITS))
    rows = rows.withColumn(key, F.struct(*group, F.col(bucket)))
    totals = rows.groupBy(key).agg(*[s.fold(s.value).alias(f"__t_{s.out}") for s in specs])
    totals = totals.select(key, F.col(key).dropFields(bucket).alias("__g") if by else F.lit(0).alias("__g"),
                           F.col(f"{key}.{bucket}").alias(bucket), *[f"__t_{s.out}" for s in specs])
    before = [Running(f"__b_{s.out}", s.kind, F.col(f"__t_{s.out}"), s.backward, True) for s in specs]
    totals = running(totals, ["__g"], bucket, before, depth - 1)
    right = totals.select(F.col(key).alias("__r"), *[b.out for b in before])
    joined = rows.join(right, F.col(key) == F.col("__r"), "left").drop("__r")
    for s in specs:
        local = s.fold(s.value).over(_window(key, position, s.backward, s.strict))
        joined = joined.withColumn(f"__l_{s.out}", local)
    for s in specs:
        joined = joined.withColumn(s.out, s.join(F.col(f"__b_{s.out}"), F.col(f"__l_{s.out}")))
    return joined.drop(key, bucket, *[f"__b_{s.out}" for s in specs], *[f"__l_{s.out}" for s in specs])


def number(df: DataFrame, by: Sequence[str], position: str, out: str, depth: int = 2) -> DataFrame:
    """Gap-free 1-based rank of ``position`` (unique within ``by``)."""
    return running(df, by, position, [Running(out, "sum", F.lit(1).cast("long"))], depth)


def batched(df: DataFrame, position: str, size: int) -> DataFrame:
    """Add the gap-free rank ``__rn`` of ``position`` (unique), its 0-based ``__batch`` of ``size`` ranks, the ``__bucket`` of its window, and ``__whole``.

    A ``__whole`` batch is full and has all its rows in one bucket, so grouping by ``__bucket`` and ``__batch`` gathers it where
    the window left it. The others hold at most two batches of any bucket.
    """
    rows = df.withColumn("__bucket", F.shiftright(F.col(position), BITS))
    totals = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    totals = running(totals, [], "__bucket", [Running("__before", "sum", F.col("__n"), strict=True)], depth=1)
    totals = totals.select(F.col("__bucket").alias("__r"), "__n", F.coalesce("__before", F.lit(0)).alias("__before"))
    placed = rows.join(totals, F.col("__bucket") == F.col("__r"), "left").drop("__r")
    local = F.count(F.lit(1)).over(_window("__bucket", position, False, False))
    placed = placed.withColumn("__rn", F.col("__before") + local)
    placed = placed.withColumn("__batch", F.floor((F.col("__rn") - 1) / F.lit(size)).cast("long"))
    first, last = F.col("__batch") * size + 1, (F.col("__batch") + 1) * size
    placed = placed.withColumn("__whole", (first > F.col("__before")) & (last <= F.col("__before") + F.col("__n")))
    return placed.drop("__n", "__before")


def number_by_order(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Gap-free 1-based numbering along any total order.

    One range-partitioned sort is written to the shared folder, so partition ids
    are fixed data; their row counts (one per partition) give the offsets.
    """
    local = "__local"
    sliced = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        local, F.monotonically_increasing_id()
    )
    fixed = stage(sliced, "numbered").withColumn("__part", F.shiftrightunsigned(F.col(local), 33))
    sizes = fixed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = running(sizes, [], "__part", [Running("__before", "sum", F.col("__n"), strict=True)], depth=1)
    # One row per shuffle partition: the bound is the partition count, not the data.
    offsets = F.broadcast(offsets.select(F.col("__part"), F.coalesce("__before", F.lit(0)).alias("__before")))
    numbered = fixed.join(offsets, "__part")
    inner = F.col(local).bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(out, F.col("__before") + inner + 1).drop("__part", "__before", local)
