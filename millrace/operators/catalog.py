"""Operators over target catalogs held as DataFrames.

``by`` names the columns that tell catalogs apart (an import id, a database).
Names compare in lower case throughout.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.kinds import category
from millrace.operators.lookup import lookup
from millrace.operators.prefix import number
from millrace.session import stage


def with_category(columns: DataFrame) -> DataFrame:
    """C1."""
    return columns.withColumn("data_type", category(F.col("sql_type")))


def _joined(left: DataFrame, right: DataFrame, by: Sequence[str], pairs: dict[str, str], how: str) -> DataFrame:
    """Join on ``by`` plus lower-case name pairs (left name -> right name)."""
    names = {c: f"__r_{c}" for c in [*by, *pairs.values()]}
    renamed = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    cond = [F.col(b) == F.col(names[b]) for b in by]
    cond += [F.lower(F.col(a)) == F.lower(F.col(names[b])) for a, b in pairs.items()]
    out = left.join(renamed, cond, how)
    return out.drop(*names.values()) if how == "left" else out


def mark_primary_keys(columns: DataFrame, keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """Flag each column that any key declaration names."""
    named = keys.select(*by, F.lower("table").alias("table"), F.lower("column").alias("column")).distinct()
    named = named.withColumn("is_pk", F.lit(True))
    out = _joined(columns.drop("is_pk"), named, by, {"table": "table", "name": "column"}, "left")
    return out.withColumn("is_pk", F.coalesce("is_pk", F.lit(False)))


def primary_key_lists(columns: DataFrame, keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ordered distinct key columns per table, in declared case, and their display text."""
    cased = columns.select(*by, "table", F.col("name").alias("cased"))
    first = keys.groupBy(*by, F.lower("table").alias("table_key"), F.lower("column").alias("column_key")).agg(
        F.min("pk_pos").alias("pk_pos"), F.min_by("column", "pk_pos").alias("raw"), F.min_by("table", "pk_pos").alias("table")
    )
    named = _with_case(first, cased, by)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pk_pos", "shown"))), lambda s: s["shown"])
    lists = named.groupBy(*by, "table_key").agg(F.first("table").alias("table"), ordered.alias("primary_keys"))
    return lists.select(*by, "table", "primary_keys", F.array_join("primary_keys", ", ").alias("primary_key"))


def _with_case(first: DataFrame, cased: DataFrame, by: Sequence[str]) -> DataFrame:
    right = cased.select(
        *[F.col(b).alias(f"__r_{b}") for b in by], F.lower("table").alias("__t"), F.lower("cased").alias("__c"), "cased"
    )
    cond = [F.col(b) == F.col(f"__r_{b}") for b in by]
    cond += [F.col("table_key") == F.col("__t"), F.col("column_key") == F.col("__c")]
    out = first.join(right, cond, "left")
    return out.withColumn("shown", F.coalesce("cased", "raw")).drop("__t", "__c", "cased", *[f"__r_{b}" for b in by])


def related_tables(tables: DataFrame, fks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Reference neighbours in both directions, distinct and sorted, per table of the catalog."""
    links = fks.select(*by, "child_table", "parent_table").distinct()
    forward = links.select(*by, F.lower("child_table").alias("k"), F.col("parent_table").alias("other"))
    back = links.select(*by, F.lower("parent_table").alias("k"), F.col("child_table").alias("other"))
    pairs = forward.unionByName(back).distinct()
    lists = pairs.groupBy(*by, "k").agg(F.array_sort(F.collect_set("other")).alias("related_tables"))
    out = _joined(tables, lists, by, {"table": "k"}, "left")
    return out.withColumn("related_tables", F.coalesce("related_tables", F.array().cast("array<string>")))


def table_summary(columns: DataFrame, fks: DataFrame, by: Sequence[str]) -> DataFrame:
    """C4: column count, identity columns, reference count per table."""
    named = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("is_identity"), F.struct("col_pos", "name")))), lambda s: s["name"]
    )
    base = columns.groupBy(*by, "table").agg(F.count(F.lit(1)).alias("column_count"), named.alias("identity_columns"))
    refs = fks.groupBy(*by, F.lower("child_table").alias("k")).agg(F.count(F.lit(1)).alias("fk_count"))
    out = _joined(base, refs, by, {"table": "k"}, "left")
    return out.select(
        *by, "table", "column_count", "identity_columns", (F.size("identity_columns") > 0).alias("has_identity"),
        F.coalesce("fk_count", F.lit(0)).alias("fk_count"),
    )


def column_roles(columns: DataFrame, fks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Key, reference (the last declared for a column counts) or normal."""
    last = fks.groupBy(*by, F.lower("child_table").alias("t"), F.lower("child_column").alias("c")).agg(
        F.max_by(F.concat_ws(".", "parent_table", "parent_column"), "fk_pos").alias("points_to")
    )
    out = _joined(columns, last, by, {"table": "t", "name": "c"}, "left")
    role = F.when(F.col("is_pk"), F.lit("PK")).when(
        F.col("points_to").isNotNull(), F.concat(F.lit("FK (References "), F.col("points_to"), F.lit(")"))
    )
    return out.withColumn("role", role.otherwise(F.lit("Normal"))).drop("points_to")


def select_tables(tables: DataFrame, selection: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Chosen tables, and selected names the catalog lacks.

    ``selection`` holds ``by`` and ``selected``; surrounding blanks do not count.
    """
    wanted = selection.withColumn("selected", F.trim("selected")).where(F.col("selected") != "")
    chosen = _joined(tables, wanted, by, {"table": "selected"}, "left_semi")
    unknown = _joined(wanted, tables, by, {"selected": "table"}, "left_anti")
    return chosen, unknown


def unmapped_action(prefix: str = "") -> Column:
    """What fills a column that has no source."""
    return (
        F.when(F.col(f"{prefix}is_identity"), F.lit("DATABASE_GENERATED"))
        .when(F.col(f"{prefix}has_default"), F.lit("DEFAULT"))
        .when(F.col(f"{prefix}nullable"), F.lit("NULL"))
        .otherwise(F.lit("VALIDATION_ERROR"))
    )


def plain_table(c: Column) -> Column:
    """A referenced table name without schema and quotes."""
    return F.lower(F.btrim(F.element_at(F.split(c, r"\."), -1), F.lit("[]`\"")))


#: Bits of a table's place in its schema inside the sort key of a level.
_PLACE_BITS = 24


def load_order(tables: DataFrame, fks: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, table, level, position``; parents first, cyclic remainder last.

    ``tables`` holds ``by, table, table_pos``. A table follows its last-placed
    parent, ties keep schema order. Round n places level n; each round touches only
    edges out of the tables just placed. A level is numbered by one long per table, its last parent's
    number in the level before and its own place in the schema, so nothing grows with the depth, and no
    window sees more than a bounded range of places.
    """
    by = list(by)
    nodes = tables.select(*by, F.lower("table").alias("k"), "table", F.col("table_pos").cast("long").alias("table_pos"))
    # Places without gaps: their bits are bounded by the number of tables, whatever positions are given.
    nodes = number(nodes.withColumn("table_pos", F.col("table_pos") - F.lit(nodes.agg(F.min("table_pos")).first()[0] or 0)), by, "table_pos", "place")
    edges = fks.select(*by, F.lower("child_table").alias("child"), plain_table(F.col("parent_table")).alias("parent"))
    known = nodes.select(*by, F.col("k").alias("parent"))
    edges = edges.where(F.col("child") != F.col("parent")).distinct().join(known, [*by, "parent"], "left_semi")
    edges = stage(edges, "fk-edges")
    needs = edges.groupBy(*by, F.col("child").alias("k")).agg(F.count(F.lit(1)).alias("open"))
    state = stage(nodes.join(needs, [*by, "k"], "left").fillna({"open": 0}), "order-state")

    def numbered(rows: DataFrame, level: int) -> DataFrame:
        key = F.shiftleft(F.col("last"), _PLACE_BITS) + F.col("place")
        found = number(rows.withColumn("key", key), by, "key", "rank")
        return stage(found.select(*by, "k", "table", F.lit(level).alias("level"), "rank"), "order-level")

    level, pending = 0, state.where(F.col("open") > 0).withColumn("last", F.lit(0).cast("long"))
    parts = [numbered(state.where(F.col("open") == 0).withColumn("last", F.lit(0).cast("long")), 0)]
    while not pending.isEmpty():
        hits = (
            edges.join(parts[-1].select(*by, F.col("k").alias("parent"), "rank"), [*by, "parent"])
            .groupBy(*by, F.col("child").alias("k"))
            .agg(F.count(F.lit(1)).alias("closed"), F.max("rank").alias("hit"))
        )
        step = pending.join(hits, [*by, "k"], "left").withColumns({"open": F.col("open") - F.coalesce("closed", F.lit(0)), "last": F.coalesce("hit", "last")})
        step = stage(step.drop("closed", "hit"), "order-step")
        ready = step.where(F.col("open") == 0)
        level += 1
        if ready.isEmpty():
            break
        parts.append(numbered(ready, level))
        pending = step.where(F.col("open") > 0)
    # What is left sits on or behind a cycle and keeps schema order.
    parts.append(numbered(pending.withColumn("last", F.lit(0).cast("long")), level))
    every = reduce(DataFrame.unionByName, parts)
    # A row per catalog and level: the window sees a catalog's depth.
    sizes = every.groupBy(*by, "level").agg(F.count(F.lit(1)).alias("n"))
    spec = W.partitionBy(*by).orderBy("level").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("start", F.coalesce(F.sum("n").over(spec), F.lit(0)))
    on = [*[(F.col(b), b) for b in by], (F.col("level"), "level")]
    placed = lookup(every, sizes, on, ["start"], "n", F.col("rank"))
    return placed.select(*by, "table", "level", (F.col("rank") + F.col("start")).alias("position"))
