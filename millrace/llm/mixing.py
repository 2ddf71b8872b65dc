"""Mixing sources to target weights: exact budgets over hash-random order, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm.text import WORD, fresh
from millrace.session import stage

#: Buckets of the random key a source is cut into; a window sees one bucket of one source, or one source's buckets.
BUCKETS = 1 << 12
#: Fixed value: the weights, repeated over the sources in code-point order.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Words of a whole text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column) -> Column:
    """60 bits of the identifier's MD5 digest: random order that reruns and other engines repeat."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def weigh(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add ``weight``: the weights repeat over the sources in code-point order, null last.

    Sources are ranked within buckets of a range partition, so no task holds them all.
    """
    null_last = F.col("source").isNull()
    ranged = sources.repartitionByRange(null_last, F.col("source")).sortWithinPartitions(null_last, F.col("source"))
    marked = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "sources")
    marked = marked.withColumn("_part", F.shiftrightunsigned("_at", 33))
    parts = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition, which bounds this window.
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    chosen = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int") + 1)
    return marked.join(parts, "_part").withColumn("weight", chosen).drop("_at", "_part", "_before")


def targets(sources: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """Add ``target`` to weighed sources (``source, source_size, weight``).

    The sources share ``share`` times all sizes by weight; a source stops at ``most``
    times its size, and what it leaves is shared by the others' weights until none is
    above. The water level rises from round to round; each round is one aggregate.
    """
    cap = F.col("source_size") * most
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        stopped = F.lit(level) * F.col("weight") >= cap
        seen = sources.agg(
            F.count_if(stopped).alias("n"),
            F.coalesce(F.sum(F.when(stopped, cap)), F.lit(0)).alias("cap"),
            F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if seen["n"] == full or not seen["weight"]:
            break
        full, level = seen["n"], (total - seen["cap"]) / seen["weight"]
    target = F.when(F.lit(level) * F.col("weight") >= cap, cap.cast("double")).otherwise(level * F.col("weight"))
    return sources.withColumn("target", target)


def mix_sources(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, before, text_digest`` for every row of ``docs``.

    Rows of a source stand in the order of a hash-random key (ties by identifier, size and
    text digest; rows equal in all are interchangeable). ``before`` is the number of words
    ahead of a row. The source's budget cuts that order at an exact word, after as many whole
    epochs as fit: ``taken`` counts a row's words in all epochs, at most ``most`` times ``size``.

    Null texts count 0 words, null sources form one source, null identifiers share one
    key. An empty table gives no rows. Only ``doc_id``, ``text`` and ``source`` are read, so
    other columns can't clash.
    """
    # Sources count bounded rows each only through (source, bucket) sums, so a hot source is spread over its buckets.
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id")).alias("_key"),
                        F.xxhash64("text").alias("_text"))
    sized = stage(sized.withColumn("_bucket", F.shiftright("_key", 60 - BUCKETS.bit_length() + 1).cast("int")), "sized")
    group = F.struct("source")
    cells = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_n"))
    cells = stage(cells, "cells")
    sources = weigh(cells.groupBy("source").agg(F.sum("_n").alias("source_size")), weights)
    aimed = targets(stage(sources, "weights"), share, most)
    ahead = F.sum("_n").over(W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.select(group.alias("_s"), "_bucket", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    aimed = aimed.select(group.alias("_s"), "source_size", "target")
    cells = cells.join(aimed, "_s").select(F.struct(F.col("_s.source").alias("source"), F.col("_bucket").alias("bucket")).alias("_cell"),
                                           "_ahead", "source_size", "target")
    rows = sized.withColumn("_cell", F.struct(F.col("source"), F.col("_bucket").alias("bucket")))
    inner = W.partitionBy("_cell").orderBy("_key", "doc_id", "size", "_text").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = rows.join(cells, "_cell").withColumn("before", F.col("_ahead") + F.col("_inner"))
    budget = F.floor("target")
    taken = F.lit(0).cast("long")
    for epoch in range(most):
        left = budget - F.col("source_size") * epoch - F.col("before")
        taken = taken + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "before", F.col("_text").alias("text_digest"))


def mixed(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: the rows of ``docs`` once per epoch that takes them, with ``epoch`` (from 1)
    and ``taken``, the words of the row's text that the epoch takes (all but at a source's cut).

    Rows that no epoch takes are left out. Equal rows are paired with equal decisions one to one.
    """
    epoch, taken, key, nth = (fresh(docs, c) for c in ("epoch", "taken", "key", "nth"))
    plan = mix_sources(docs, share, most, weights)
    pair = F.struct(F.col("doc_id"), F.col("source"), F.xxhash64("text").alias("text"))
    plan = plan.withColumn(key, F.struct("doc_id", "source", F.col("text_digest").alias("text")))
    by_key = W.partitionBy(key)
    plan = plan.withColumn(nth, F.row_number().over(by_key.orderBy("before"))).select(key, nth, F.col("taken").alias("_all"), F.col("size").alias("_size"))
    rows = docs.withColumn(key, pair).withColumn(nth, F.row_number().over(by_key.orderBy(F.lit(0))))
    met = rows.join(plan, [key, nth])
    parts = [F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), F.col("_all") - F.col("_size") * e)) for e in range(most)]
    met = met.select(*[F.col(f"`{c}`") for c in docs.columns], F.posexplode(F.array(*parts)).alias(epoch, taken))
    # A text without words gives the mix nothing.
    return met.where(F.col(taken) > 0).withColumn(epoch, F.col(epoch) + 1)
