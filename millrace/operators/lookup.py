"""Left lookup of per-key facts that holds up under hot keys.

The right side has one row per key. It is staged and measured: empty means no
join, small in rows and bytes means broadcast. Beyond that every key that holds more than a
fixed share of the left rows (by known row weight) is answered by a broadcast of just those
keys, whose number the share bounds and whose bytes are measured, while their rows are
spread over salts; all others meet in a shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import Facts, stage_facts

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
#: A key with more than one in so many left rows is hot; there are fewer such keys than this.
HOT_SHARE = 2_000
SALTS = 256
#: Where a lookup is written, left rows move in so many turns, each with its own keys.
SLICES = 2


def is_wide(right: Facts, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``lookup`` of these facts moves the left rows."""
    return right.rows > rows or right.bytes > BROADCAST_BYTES


def slices(left: DataFrame, right: Facts, on: Sequence[tuple[Column, str]]) -> list[tuple[DataFrame, Facts]]:
    """Both sides of a wide lookup by the hash of the key; what the right side is known to measure stays."""

    def turn(keys: Sequence[Column], i: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(SLICES)) == F.lit(i)

    exprs, names = [e for e, _ in on], [F.col(name) for _, name in on]
    return [(left.where(turn(exprs, i)), Facts(right.df.where(turn(names, i)), right.rows, right.bytes)) for i in range(SLICES)]


def lookup(
    left: DataFrame,
    right: DataFrame | Facts,
    on: Sequence[tuple[Column, str]],
    facts: Sequence[str],
    weight: str | None = None,
    spread: Column | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add ``facts`` of the matching right row to every left row (null where none).

    ``on`` pairs a left expression with a right key column; null left keys match
    nothing. ``weight`` names the right column holding the key's row count on the
    left. ``spread`` is a left expression that salts hot rows.
    """
    keys = [name for _, name in on]
    if not isinstance(right, Facts):
        wanted = dict.fromkeys([*keys, *facts, *([weight] if weight else [])])
        right = stage_facts(right.select(*wanted), "lookup")
    fixed, size = right.df, right.rows
    types = {f.name: f.dataType for f in fixed.schema.fields}
    if size == 0:
        return left.withColumns({f: F.lit(None).cast(types[f]) for f in facts})

    lk = {k: f"__k_{k}" for k in keys}
    rows = left.withColumns({lk[k]: expr for expr, k in on})
    side = fixed.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *facts)
    match = [F.col(lk[k]) == F.col(f"__r_{k}") for k in keys]
    spare = [*lk.values(), *[f"__r_{k}" for k in keys]]
    if not is_wide(right, broadcast_rows):
        return rows.join(F.broadcast(side), match, "left").drop(*spare)

    # Told to meet in a shuffle: by the size of its compressed files Spark would broadcast a side that has been found too wide.
    side = side.hint("merge")
    if weight is None:
        return rows.join(side, match, "left").drop(*spare)

    total = fixed.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = stage_facts(fixed.where(F.col(weight) * HOT_SHARE > F.lit(total)), "hot")
    if not hot.rows or hot.bytes > BROADCAST_BYTES:
        return rows.join(side, match, "left").drop(*spare)
    hot = hot.df.select(
        *[F.col(k).alias(f"__h_{k}") for k in keys],
        F.struct(*facts).alias("__hot"),
    )
    rows = rows.join(F.broadcast(hot), [F.col(lk[k]) == F.col(f"__h_{k}") for k in keys], "left")
    rows = rows.drop(*[f"__h_{k}" for k in keys])
    # A hash, not a random number: a recomputed task must salt its rows alike.
    basis = [spread] if spread is not None else [F.col(f"`{c}`") for c in left.columns]
    salt_of = F.pmod(F.xxhash64(*basis), F.lit(SALTS)).cast("int") + 1
    unkeyed = F.lit(False)
    for k in keys:
        unkeyed = unkeyed | F.col(lk[k]).isNull()
    rows = rows.withColumn("__salt", F.when(F.col("__hot").isNotNull() | unkeyed, salt_of).otherwise(F.lit(0)))
    cold = side.withColumn("__zero", F.lit(0))
    renamed = cold.select(
        *[f"__r_{k}" for k in keys], "__zero", *[F.col(f).alias(f"__c_{f}") for f in facts]
    ).hint("merge")
    joined = rows.join(renamed, [*match, F.col("__salt") == F.col("__zero")], "left")
    picked = {
        f: F.when(F.col("__hot").isNotNull(), F.col(f"__hot.{f}")).otherwise(F.col(f"__c_{f}")) for f in facts
    }
    joined = joined.withColumns(picked)
    return joined.drop("__hot", "__salt", "__zero", *spare, *[f"__c_{f}" for f in facts])
