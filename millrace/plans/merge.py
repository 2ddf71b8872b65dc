"""Merging automatic matches with user actions (A1-A6), for many imports at once.

``matched`` holds ``by, table, column, source, pos``; ``actions`` holds ``by, table,
column, action, source, custom_value, pos``. ``pos`` is the order of the list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"table_key": F.lower("table"), "column_key": F.lower("column")})


def duplicate_targets(matched: DataFrame, by: Sequence[str]) -> DataFrame:
    """A1: declared columns that several sources claim, with the error text."""
    claims = _keyed(matched).groupBy(*by, "table_key", "column_key").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("pos", "source"))).alias("claims")
    )
    listed = F.array_join(F.transform("claims", lambda c: c["source"]), ", ")
    text = F.concat(
        F.lit("Multiple Excel columns ("), listed, F.lit(") map to target ["), F.col("table_key"), F.lit("].["), F.col("column_key"), F.lit("]")
    )
    return claims.where(F.col("n") > 1).select(*by, "table_key", "column_key", "n", listed.alias("sources"), text.alias("message"))


def normalise_actions(actions: DataFrame, by: Sequence[str]) -> DataFrame:
    """One action per (table, column) in lower case, the last one given.

    Only the fields an action needs are kept.
    """
    given = _keyed(actions).where((F.col("table_key") != "") & (F.col("column_key") != ""))
    kind = F.upper(F.coalesce("action", F.lit("")))
    kind = F.when(kind == "DEFAULT", F.lit("DATABASE_DEFAULT")).when(kind == "IMPORT", F.lit("EXCEL")).otherwise(kind)
    last = given.withColumn("kind", kind).groupBy(*by, "table_key", "column_key").agg(
        F.max_by(F.struct("table", "column", "kind", "source", "custom_value"), "pos").alias("a"), F.max("pos").alias("pos")
    )
    return last.select(
        *by, "table_key", "column_key", "a.table", "a.column", F.col("a.kind").alias("action"),
        F.when(F.col("a.kind") == "EXCEL", F.col("a.source")).alias("source"),
        F.when(F.col("a.kind").isin("CUSTOM_VALUE", "CUSTOM"), F.col("a.custom_value")).alias("custom_value"), "pos",
    )


def merge(matched: DataFrame, actions: DataFrame, by: Sequence[str]) -> DataFrame:
    """A3: the source of every filled column; a user action beats a match.

    ``actions`` comes from ``normalise_actions``. Within one table a matched source fills one
    column and a column has one source; later entries win. A source that an action has
    placed in a table is no longer free to fill another column of it by a match; actions
    may place one source in several columns.
    """
    keys = [*by, "table_key", "column_key"]
    chosen = actions.where((F.col("action") == "EXCEL") & F.col("source").isNotNull()).select(*keys, "column", "source")
    free = _keyed(matched).join(actions.select(*keys), keys, "left_anti")
    free = free.join(chosen.select(*by, "table_key", "source"), [*by, "table_key", "source"], "left_anti")
    per_source = free.groupBy(*by, "table_key", "source").agg(
        F.max_by(F.struct("column_key", "column"), "pos").alias("t"), F.min("pos").alias("pos")
    )
    per_target = per_source.groupBy(*by, "table_key", F.col("t.column_key").alias("column_key")).agg(
        F.max_by(F.struct("source", F.col("t.column").alias("column")), "pos").alias("s")
    )
    rest = per_target.select(*keys, F.col("s.column").alias("column"), F.col("s.source").alias("source"))
    return chosen.unionByName(rest)


def unmapped_sources(headers: DataFrame, merged: DataFrame, by: Sequence[str]) -> DataFrame:
    """Headers (``by, source``) that fill nothing."""
    return headers.join(merged.select(*by, "source").distinct(), [*by, "source"], "left_anti")


def matches_of(plans: DataFrame, by: Sequence[str]) -> DataFrame:
    """A5: plans that import, as matches; the position follows the schema."""
    imports = plans.where(F.upper("action").isin("IMPORT", "EXCEL") & (F.coalesce("source", F.lit("")) != ""))
    return imports.select(*by, "table", "column", "source", F.col("target_pos").alias("pos"))
