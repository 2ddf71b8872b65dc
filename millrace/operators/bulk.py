"""Rules as rows: required columns, fill rules and row validation for all tables of many catalogs at once.

Nothing here is planned per table. A catalog (``by``, one sheet each) is DataFrames: declared columns, keys, references, the
source of each filled column (``plans.merge.merge``) and the user's actions (``plans.merge.normalise_actions``). Each table
becomes one row of positions into its own value array, and tables with the same positions share one shape. A tuple carries a
catalog number and a shape number only: names and reference texts meet rejected tuples alone. References and the values they
may refer to go on as narrow rows, each exchanged once by value, and the tables of one load-order level answer all references
to them together, so the jobs follow the depth of the references alone. Slices meet as one hash of their key first: one whose key is
met once is a distinct tuple as it stands, so only the others are compared by all their values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import is_empty, strip
from millrace.operators.catalog import load_order, plain_table
from millrace.operators.lookup import BROADCAST_BYTES, BROADCAST_ROWS, lookup
from millrace.session import Facts, stage, stage_facts

_DEFAULTS, _CUSTOM = ("DEFAULT", "DATABASE_DEFAULT"), ("CUSTOM_VALUE", "CUSTOM")


def declared(columns: DataFrame, sources: DataFrame, actions: DataFrame, by: Sequence[str]) -> DataFrame:
    """The columns of every covered table (V3: one that a source or an action fills) with ``source, action, custom_value``.

    ``columns`` holds ``by, table, col_pos, name, nullable, is_identity, has_default``.
    """
    keys = [*by, "table_key", "column_key"]
    said = actions.select(*keys, F.upper("action").alias("action"), "custom_value")
    covered = sources.select(*by, "table_key").union(actions.select(*by, "table_key")).distinct()
    own = columns.select(*by, "table", "col_pos", "name", "nullable", "is_identity", "has_default",
                         F.lower("table").alias("table_key"), F.lower("name").alias("column_key"))
    own = own.join(covered, [*by, "table_key"], "left_semi")
    return own.join(sources.select(*keys, "source"), keys, "left").join(said, keys, "left")


def missing_required(rules: DataFrame, by: Sequence[str]) -> DataFrame:
    """V2: ``by, table_key, table, missing, reason`` of tables with a required column that nothing fills."""
    action = F.coalesce("action", F.lit(""))
    excused = action.isin(*_DEFAULTS) | (action.isin(*_CUSTOM) & ~is_empty(F.col("custom_value")))
    open_ = rules.where(~F.col("nullable") & ~F.col("has_default") & ~F.col("is_identity") & F.col("source").isNull() & ~excused)
    named = open_.groupBy(*by, "table_key").agg(F.first("table").alias("table"), F.array_sort(F.collect_list(F.struct("col_pos", "name"))).alias("m"))
    named = named.withColumn("missing", F.col("m.name"))
    reason = F.concat(F.lit("Table ["), F.col("table"), F.lit("] cannot be generated: Missing required columns ("),
                      F.array_join("missing", ", "), F.lit(") with no default in Excel data."))
    return named.select(*by, "table_key", "table", "missing", reason.alias("reason"))


def fill_rules(rules: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, table, col_pos, column, rule, source, text``; identity columns are inserted where a source fills them."""
    action = F.coalesce("action", F.lit(""))
    steps = [
        (F.col("is_identity") & F.col("source").isNull(), "DATABASE_GENERATED", None, F.lit("DATABASE_GENERATED (Identity sequence; omitted from INSERT)")),
        (action.isin(*_CUSTOM) & F.col("custom_value").isNotNull(), "CUSTOM_VALUE", F.col("custom_value"),
         F.concat(F.lit("CUSTOM_VALUE ["), "custom_value", F.lit("] (Fixed value for all rows)"))),
        (action.isin(*_DEFAULTS), "DEFAULT", None, F.lit("DEFAULT (Database default)")),
        (action == "NULL", "NULL", None, F.lit("NULL (Explicit NULL)")),
        (F.col("source").isNotNull(), "EXCEL", F.col("source"), F.concat(F.lit("EXCEL ["), "source", F.lit("] (Mapped)"))),
        (F.col("has_default") & ~F.col("nullable"), "DEFAULT", None, F.lit("DEFAULT (Schema constraint)")),
        (F.col("nullable"), "NULL", None, F.lit("NULL (Unmapped nullable)")),
    ]
    made: Column = F.struct(F.lit("NULL").alias("rule"), F.lit(None).cast("string").alias("source"), F.lit("NULL").alias("text"))
    for test, rule, source, text in reversed(steps):
        held = F.lit(None).cast("string") if source is None else source
        made = F.when(test, F.struct(F.lit(rule).alias("rule"), held.alias("source"), text.alias("text"))).otherwise(made)
    return rules.withColumn("made", made).select(*by, "table", "col_pos", F.col("name").alias("column"), "made.*")


def _levels(tables: DataFrame, fks: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, table_key, level``: parents have lower levels; tables on or behind a cycle follow one by one in schema order."""
    order = load_order(tables, fks, by).select(*by, F.lower("table").alias("table_key"), "level", "position")
    order = stage(order, "levels")
    edge = fks.select(*by, F.lower("child_table").alias("table_key"), plain_table(F.col("parent_table")).alias("parent")).where("table_key <> parent")
    up = order.select(*by, F.col("table_key").alias("parent"), F.col("level").alias("above"))
    tied = edge.join(up, [*by, "parent"]).join(order, [*by, "table_key"]).where("above >= level").select(*by, "level").distinct()
    tied = tied.withColumn("tied", F.lit(True))
    # A window per catalog's cyclic rest, which a schema bounds.
    nth = F.col("position") - F.min("position").over(W.partitionBy(*by, "level"))
    placed = order.withColumn("nth", nth).join(tied, [*by, "level"], "left")
    return placed.select(*by, "table_key", (F.col("level") + F.when(F.col("tied"), F.col("nth")).otherwise(0)).cast("int").alias("level"))


def table_specs(rules: DataFrame, keys: DataFrame, fks: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per covered table without missing columns: ``by, table_key, table, level, names, sources`` of its filled columns
    and, as places in them, ``required``, ``pk`` (null unless all of it is filled), ``fks`` and ``refs`` (columns others refer to).

    ``keys`` holds ``by, table, pk_pos, column``; ``fks`` holds ``by, child_table, child_column, parent_table, parent_column, fk_pos``.
    References of a table to itself are left to ``selfref``.
    """
    own = [*by, "table_key"]
    good = rules.join(missing_required(rules, by).select(*own), own, "left_anti")
    filled = good.where("source IS NOT NULL")
    at = F.row_number().over(W.partitionBy(*own).orderBy("col_pos"))
    filled = stage(filled.withColumn("at", at), "filled")
    names = filled.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("at", "name", "source", "nullable", "has_default"))).alias("c"))
    pk = keys.select(*by, F.lower("table").alias("table_key"), F.lower("column").alias("column_key"), "pk_pos")
    pk = pk.groupBy(*own, "column_key").agg(F.min("pk_pos").alias("pk_pos")).join(filled.select(*own, "column_key", "at"), [*own, "column_key"], "left")
    pk = pk.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("pk_pos", "at"))).alias("p"), F.count_if(F.col("at").isNull()).alias("open"))
    link = fks.select(*by, F.lower("child_table").alias("table_key"), F.lower("child_column").alias("column_key"), F.col("child_column").alias("column"),
                      plain_table(F.col("parent_table")).alias("parent"), F.lower("parent_column").alias("parent_column"),
                      F.col("parent_table").alias("parent_shown"), F.col("parent_column").alias("parent_column_shown"), "fk_pos")
    link = link.where("table_key <> parent").join(filled.select(*own, "column_key", "at"), [*own, "column_key"])
    held = filled.select(*by, F.col("table_key").alias("parent"), F.col("column_key").alias("parent_column"), F.col("at").alias("parent_at"))
    # A reference counts where the parent's column is filled too.
    link = stage(link.join(held, [*by, "parent", "parent_column"]), "links")
    child = link.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("fk_pos", "at", "column", "parent", "parent_column", "parent_shown", "parent_column_shown"))).alias("fks"))
    refs = link.select(*by, F.col("parent").alias("table_key"), F.struct("parent_at", "parent_column").alias("r")).groupBy(*own).agg(F.collect_set("r").alias("refs"))
    tables = good.groupBy(*own).agg(F.first("table").alias("table"), F.min("col_pos").alias("_pos"))
    places = rules.groupBy(*by, "table").agg(F.min("col_pos").alias("table_pos")) if "table_pos" not in rules.columns else (
        rules.groupBy(*by, "table").agg(F.min("table_pos").alias("table_pos")))
    levels = _levels(places, fks, by)
    out = tables.join(names, own, "left").join(pk, own, "left").join(child, own, "left").join(refs, own, "left").join(levels, own)
    none = F.expr("array()")
    required = F.transform(F.filter("c", lambda x: ~x["nullable"] & ~x["has_default"]), lambda x: x["at"])
    return out.select(*own, "table", "level", F.coalesce("c.name", none.cast("array<string>")).alias("names"), F.coalesce("c.source", none.cast("array<string>")).alias("sources"),
                      F.coalesce(required, none.cast("array<int>")).alias("required"), F.when(F.col("open") == 0, F.col("p.at")).alias("pk"),
                      "fks", "refs")


@dataclass
class Bulk:
    """Verdicts over all tables, which ``cat`` (a catalog's number) and ``shape`` name.

    ``once`` has the slices that are tuples by themselves, as no other has their key's hash, and lack nothing; ``slices`` has all others,
    of which ``several`` are the distinct ones. A tuple has its first row, ``copies`` and ``n_empty`` (required columns without a value); ``clashing``
    has those of conflicting keys with ``key``; ``lost`` has ``n, value`` of each reference (place in ``specs.fks``) that no
    accepted parent holds, ``n_empty`` null where the tuple's key conflicts.
    """

    by: list[str]
    slices: DataFrame
    specs: DataFrame
    missing: DataFrame
    shapes: Facts
    once: DataFrame
    several: DataFrame
    clashing: Facts
    lost: DataFrame

    @property
    def tuples(self) -> DataFrame:
        return self.once.unionByName(self.several)

    @property
    def accepted(self) -> DataFrame:
        """Accepted distinct tuples with the row they were first seen in."""
        good = _keyed(self.once, self.several, self.clashing).where("n_empty = 0 AND key IS NULL")
        good = good.join(self.lost.select(*_TUPLE).hint("merge"), _TUPLE, "left_anti")
        return self._named(good, ["table", "names"]).select(*self.by, "table", "row_idx", "names", "values")

    def _named(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        known = stage_facts(self.specs.select("cat", "shape", *self.by, *columns), "named")
        return _met(rows, known, _TABLE, [*self.by, *columns])

    @property
    def counts(self) -> DataFrame:
        """V13 per table."""
        # Nothing joins all tuples: what conflicts and lost references change is added to the counts of all.
        names = ("source_rows", "valid_rows", "rejected_rows", "pk_conflict_keys", "fk_errors", "null_errors")
        n, whole = F.col("copies"), F.col("n_empty") == 0

        def part(rows: DataFrame, **values: Column) -> DataFrame:
            of = [F.sum(values[c].cast("long")).alias(c) if c in values else F.lit(0).cast("long").alias(c) for c in names]
            return rows.groupBy(*_TABLE).agg(*of)

        every = part(self.tuples, source_rows=n, valid_rows=whole, rejected_rows=F.when(whole, 0).otherwise(n), null_errors=n * F.col("n_empty"))
        parts = [every]
        if self.clashing.rows:
            clashing = self.clashing.df
            parts.append(part(clashing, valid_rows=-whole.cast("int"), rejected_rows=F.when(whole, n).otherwise(0), null_errors=-n * F.col("n_empty")))
            parts.append(part(clashing.select(*_TABLE, "key").distinct(), pk_conflict_keys=F.lit(1)))
        clean = self.lost.where("n_empty IS NOT NULL").groupBy(*_TUPLE).agg(F.first("copies").alias("copies"), F.first("n_empty").alias("n_empty"), F.count(F.lit(1)).alias("n"))
        parts.append(part(clean, valid_rows=-whole.cast("int"), rejected_rows=F.when(whole, n).otherwise(0), fk_errors=n * F.col("n")))
        seen = reduce(DataFrame.unionByName, parts).groupBy(*_TABLE).agg(*[F.sum(c).alias(c) for c in names])
        out = self.specs.select("cat", "shape", *self.by, "table").join(seen, _TABLE, "left").na.fill(0, list(names))
        return out.select(*self.by, "table", "source_rows", "valid_rows", "rejected_rows",
                          (F.col("source_rows") - F.col("valid_rows") - F.col("rejected_rows")).alias("duplicate_rows"), "pk_conflict_keys", "fk_errors", "null_errors")

    @property
    def invalid(self) -> DataFrame:
        """Tables that give no script, and why."""
        none = self.counts.where("valid_rows = 0").select(*self.by, "table", F.lit("No valid rows remaining after validation.").alias("reason"))
        return self.missing.select(*self.by, "table", "reason").unionByName(none)

    @property
    def rejected(self) -> DataFrame:
        """Each rejected row once per table, with its error type and joined reasons."""
        none = lambda kind: F.lit(None).cast(kind)
        places, lost = "array<int>", "struct<n:int,value:string>"
        conflict = self.clashing.df.select(*_TUPLE, "copies", "key", none(places).alias("places"), none(lost).alias("lost"))
        blank = lookup(self.several.where("n_empty > 0"), self.clashing, _on(_TUPLE), ["key"], "copies", F.col("row_idx")).where("key IS NULL")
        blank = _met(blank, self.shapes, ["shape"], ["required"])
        blank = blank.select(*_TUPLE, "copies", "key", F.filter("required", lambda i: is_empty(_value(i))).alias("places"), none(lost).alias("lost"))
        orphan = self.lost.where("n_empty IS NOT NULL").select(*_TUPLE, "copies", none("array<string>").alias("key"), none(places).alias("places"), F.struct("n", "value").alias("lost"))
        why = conflict.unionByName(blank).unionByName(orphan).groupBy(*_TUPLE).agg(
            F.max("copies").alias("copies"), F.first("key", True).alias("key"), F.first("places", True).alias("places"), F.collect_list("lost").alias("lost"))
        why = self._named(why, ["table", "names", "fks"])
        empty = F.transform("places", lambda i: F.concat(F.lit("Required column '"), F.get(F.col("names"), i - 1), F.lit("' is empty in row ")))
        fk = lambda o: F.get(F.col("fks"), o["n"] - 1)
        told = F.array_sort(F.transform("lost", lambda o: F.struct(
            fk(o)["fk_pos"].alias("fk_pos"), fk(o)["column"].alias("column"), o["value"].alias("value"),
            fk(o)["parent_shown"].alias("parent_shown"), fk(o)["parent_column_shown"].alias("parent_column_shown"))))
        told = F.transform(told, lambda o: F.concat(
            F.lit("Foreign key violation: Column '"), o["column"], F.lit("' value '"), o["value"], F.lit("' does not exist in parent table '"),
            o["parent_shown"], F.lit("."), o["parent_column_shown"], F.lit("'")))
        verdict = ["table", "key_text", "empty", "lost"]
        why = why.select(*_TUPLE, "copies", *self.by, "table", F.array_join("key", ", ").alias("key_text"),
                         F.coalesce(empty, F.expr("array()").cast("array<string>")).alias("empty"), told.alias("lost"))
        why = stage(why, "rejected")
        # A tuple seen once is its first row; only the rows of repeated ones are looked up.
        rows = why.where("copies = 1").select(*self.by, *verdict, "row_idx")
        again = why.where("copies > 1").join(self.several.where("copies > 1").select(*_TUPLE, "values"), _TUPLE)
        again = stage_facts(again.select("cat", "shape", "values", "copies", *self.by, *verdict), "repeated")
        if again.rows:
            found = lookup(self.slices, again, _on([*_TABLE, "values"]), [*self.by, *verdict], "copies", F.col("row_idx")).where("table IS NOT NULL")
            rows = rows.unionByName(found.select(*self.by, *verdict, "row_idx"))
        conflicts = F.col("key_text").isNotNull()
        reason = F.array_join(F.concat(F.transform("empty", lambda e: F.concat(e, F.col("row_idx").cast("string"))), "lost"), "; ")
        return rows.select(
            *self.by, "table", F.col("row_idx").alias("row_index"),
            F.when(conflicts, "PRIMARY_KEY_CONFLICT").otherwise("VALIDATION_ERROR").alias("error_type"),
            F.when(conflicts, F.concat(F.lit("Row rejected due to duplicate primary key conflict: '"), "key_text", F.lit("'"))).otherwise(reason).alias("reason"))


#: Up to so many places of the widest table are written out as plain expressions, which Spark compiles; array functions are interpreted.
UNROLLED = 16
#: Hashes are the narrowest rows, so more of them than of other facts are broadcast, within the same bytes.
BROADCAST_MARKS = 1_000_000
_TABLE = ["cat", "shape"]
_TUPLE = ["row_idx", "cat", "shape"]
_COLUMN = ["cat", "owner", "part"]


def _on(keys: Sequence[str]) -> list[tuple[Column, str]]:
    return [(F.col(k), k) for k in keys]


def _value(i: Column) -> Column:
    return F.get(F.col("values"), i - 1)


def _stripped(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``strip`` of columns, each trimmed once: Spark computes a column that is referred to, a repeated expression at each place."""
    trimmed = {c: f"_t_{c}" for c in columns}
    rows = rows.withColumns({t: F.trim(F.col(c)) for c, t in trimmed.items()})
    return rows.withColumns({c: strip(F.col(c), F.col(t)) for c, t in trimmed.items()}).drop(*trimmed.values())


def _mark(width: int, kept: Sequence[Column] | None = None) -> Column:
    """A hash of a tuple's whole key; null where the key has an empty part or the table no filled key. ``kept`` has its stripped parts."""
    if width > UNROLLED:
        blank = F.exists("pk", lambda i: is_empty(_value(i)))
        return F.when(~blank, F.xxhash64(*_TABLE, F.transform("pk", lambda i: strip(_value(i)))))
    places = [F.get("pk", F.lit(i)) for i in range(width)]
    texts = kept or [strip(_value(p)) for p in places]
    blank = reduce(lambda x, y: x | y, [p.isNotNull() & (t.isNull() | (t == "")) for p, t in zip(places, texts, strict=True)], F.lit(False))
    return F.when(F.col("pk").isNotNull() & ~blank, F.xxhash64(*_TABLE, *texts))


def _n_empty(width: int, kept: Sequence[Column] | None = None) -> Column:
    """Required columns without a value; ``kept`` has their values."""
    if width > UNROLLED:
        return F.size(F.filter("required", lambda i: is_empty(_value(i))))
    places = [F.get("required", F.lit(i)) for i in range(width)]
    texts = kept or [_value(p) for p in places]
    return reduce(lambda x, y: x + y, [F.when(p.isNotNull() & is_empty(t), 1).otherwise(0) for p, t in zip(places, texts, strict=True)], F.lit(0))


def _marked(slices: DataFrame, pk: int, required: int) -> DataFrame:
    """Slices with ``mark`` and ``n_empty``; ``pk`` and ``required`` are the longest lists of places."""
    parts = [f"_pk{i}" for i in range(pk)] if pk <= UNROLLED else []
    needs = [f"_required{i}" for i in range(required)] if required <= UNROLLED else []
    slices = slices.withColumns({c: _value(F.get(of, F.lit(i))) for of, cols in (("pk", parts), ("required", needs)) for i, c in enumerate(cols)})
    slices = _stripped(slices, parts)
    return slices.withColumns({"mark": _mark(pk, [F.col(c) for c in parts]), "n_empty": _n_empty(required, [F.col(c) for c in needs])}).drop(*parts, *needs)


def _keyed(once: DataFrame, several: DataFrame, clashing: Facts) -> DataFrame:
    """Tuples with the ``key`` of those whose keys conflict, which are none of ``once``."""
    told = lookup(several, clashing, _on(_TUPLE), ["key"], "copies", F.col("row_idx"))
    return once.withColumn("key", F.lit(None).cast("array<string>")).unionByName(told)


def _apart(slices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slices that are tuples by themselves, as their key's hash is met once, without empty required columns; and the others.

    Where too many hashes are met again to be broadcast, all slices are among the others.
    """
    again = slices.where("mark IS NOT NULL").groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = stage_facts(again, "again")
    if again.rows > BROADCAST_MARKS or again.bytes > BROADCAST_BYTES:
        return slices.where("false").withColumn("copies", F.lit(1).cast("long")), slices
    told = lookup(slices, again, _on(["mark"]), ["n"], broadcast_rows=BROADCAST_MARKS)
    alone = F.col("mark").isNotNull() & F.col("n").isNull() & (F.col("n_empty") == 0)
    return told.where(alone).drop("n").withColumn("copies", F.lit(1).cast("long")), stage(told.where(~alone).drop("n"), "others")


def _met(left: DataFrame, known: Facts, keys: list[str], facts: list[str]) -> DataFrame:
    """``facts`` of the known rows; those too wide to broadcast learn first how many left rows ask for each."""
    if known.rows > BROADCAST_ROWS or known.bytes > BROADCAST_BYTES:
        asked = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_asked"))
        known = stage_facts(known.df.select(*keys, *facts).join(asked, keys), "asked")
    return lookup(left, known, _on(keys), facts, "_asked", F.col("row_idx"))


def _shaped(specs: DataFrame, by: list[str]) -> tuple[DataFrame, Facts]:
    """Tables with their ``cat`` and ``shape``, and the shapes: all that judging a tuple needs, as numbers.

    ``links`` of a shape are the references to earlier levels: place ``n`` in the table's own list, ``at``, and the parent's place
    in its catalog (``owner``), column number (``part``) and level (``lv``); and, without ``n``, the columns others refer to.
    """
    own = [*by, "table_key"]
    nth = F.row_number().over(W.partitionBy(*by).orderBy("table_key"))  # a catalog's tables, which a schema bounds
    specs = specs.withColumns({"owner": nth, "parts": F.array_sort(F.array_distinct(F.transform("refs", lambda r: r["parent_column"])))})
    specs = stage(specs, "specs")
    to = specs.select(*by, F.col("table_key").alias("parent"), "owner", "parts", F.col("level").alias("lv"))
    links = specs.select(*own, "level", F.posexplode("fks").alias("n", "fk")).select(*own, "level", (F.col("n") + 1).alias("n"), "fk.at", "fk.parent", "fk.parent_column")
    links = links.join(to, [*by, "parent"]).where("lv < level").withColumn("part", F.array_position("parts", F.col("parent_column")).cast("int"))
    links = links.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("n", "at", "owner", "part", "lv"))).alias("links"))
    refs = F.array_sort(F.transform("refs", lambda r: F.struct(
        F.lit(None).cast("int").alias("n"), r["parent_at"].alias("at"), F.col("owner").alias("owner"),
        F.array_position("parts", r["parent_column"]).cast("int").alias("part"), F.col("level").alias("lv"))))
    every = F.concat(*[F.coalesce(x, F.array().cast("array<struct<n:int,at:int,owner:int,part:int,lv:int>>")) for x in (F.col("links"), refs)])
    form = F.struct("owner", "sources", "required", "pk", every.alias("links"))
    formed = stage(specs.join(links, own, "left").select(*own, "table", "names", "fks", form.alias("form"), F.to_json(form).alias("text")), "forms")
    shapes = formed.groupBy("text").agg(F.first("form").alias("form")).select("text", F.monotonically_increasing_id().alias("shape"), "form.*")
    shapes = stage_facts(shapes, "shapes")
    cats = stage(formed.select(*by).distinct().withColumn("cat", F.monotonically_increasing_id()), "catalogs")
    tables = lookup(formed, shapes, [(F.col("text"), "text")], ["shape"]).join(cats, by)
    return stage(tables.select("cat", "shape", *own, "table", "names", "fks"), "tables"), shapes


def validate_tables(rows: DataFrame, rules: DataFrame, keys: DataFrame, fks: DataFrame, by: Sequence[str]) -> Bulk:
    """Check ``rows`` (``by, row_idx, cells``: a map from header to text) against every table of their catalog.

    The rules are those of ``validate`` in an open world: a reference is unchecked while its parent has no accepted value.
    ``rules`` comes from ``declared`` (``table_pos``, if it has that, orders the tables of a schema).
    """
    by = list(by)
    specs, shapes = _shaped(table_specs(rules, keys, fks, by), by)
    per_sheet = stage_facts(specs.groupBy(*by, "cat").agg(F.collect_list("shape").alias("shapes")), "per-sheet")
    met = _met(rows, per_sheet, by, ["cat", "shapes"]).select("cat", "row_idx", "cells", F.explode("shapes").alias("shape"))
    widest = shapes.df.agg(*[F.coalesce(F.max(F.size(c)), F.lit(0)).alias(c) for c in ("sources", "required", "pk")]).first()
    values = F.transform("sources", lambda s: F.try_element_at("cells", s))
    if 0 < widest["sources"] <= UNROLLED:
        values = F.slice(F.array(*[F.try_element_at("cells", F.get("sources", F.lit(i))) for i in range(widest["sources"])]), F.lit(1), F.size("sources"))
    slices = _met(met, shapes, ["shape"], ["sources", "required", "pk"]).withColumn("values", values)
    slices = stage(_marked(slices, widest["pk"], widest["required"]).select(*_TABLE, "row_idx", "values", "mark", "n_empty"), "slices")
    once, slices = _apart(slices)
    several = slices.groupBy(*_TABLE, "values").agg(
        F.min("row_idx").alias("row_idx"), F.count(F.lit(1)).alias("copies"), F.first("mark").alias("mark"), F.first("n_empty").alias("n_empty"))
    several = stage(several, "several")
    told = lambda rows: rows.withColumn("key", F.transform("pk", lambda i: strip(_value(i))))

    # Keys meet as one hash; those met more than once are compared as they are.
    met = several.where("mark IS NOT NULL").groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    doubtful = lookup(several, met, _on(["mark"]), ["n"], "n", F.col("row_idx")).where("n IS NOT NULL")
    doubtful = stage(told(_met(doubtful, shapes, ["shape"], ["pk"])).select(*_TUPLE, "copies", "n_empty", "key"), "doubtful")
    keyed = doubtful.groupBy(*_TABLE, "key").agg(F.count(F.lit(1)).alias("variants"), F.sum("copies").alias("copies")).where("variants > 1")
    clashing = lookup(doubtful, keyed, _on([*_TABLE, "key"]), ["variants"], "copies", F.col("row_idx")).where("variants IS NOT NULL")
    clashing = stage_facts(clashing.drop("variants"), "clashing")

    # Each reference and each value that may be referred to: one narrow row, in a folder of the parent's level.
    flagged = _keyed(once, several, clashing)
    flagged = flagged.withColumn("n_empty", F.when(F.col("key").isNull(), F.col("n_empty")))
    links = _met(flagged, shapes, ["shape"], ["links"]).select(*_TUPLE, "copies", "n_empty", "values", F.explode("links").alias("to"))
    links = links.where("to.n IS NOT NULL OR n_empty = 0").select(*_TUPLE, "copies", "n_empty", "to.n", "to.owner", "to.part", "to.lv", _value(F.col("to.at")).alias("value"))
    links = _stripped(links.where(~is_empty(F.col("value"))), ["value"]).withColumn("asks", F.col("n").isNotNull())
    links = stage(links, "links", ["asks", "lv"])
    links = links.withColumn("meant", F.xxhash64(*_COLUMN, "value"))
    asking, offered = links.where("asks"), links.where("NOT asks")

    told = [*_TUPLE, "copies", "n_empty", "n", "value"]
    lost = asking.where("false").select(*told)
    # No more numbers than the references are deep.
    asked = sorted(r[0] for r in shapes.df.select(F.explode("links").alias("to")).where("to.n IS NOT NULL").select("to.lv").distinct().collect())
    for lv in asked:
        held = offered.where(F.col("lv") == lv)
        if lv != asked[0]:
            held = held.join(lost.select(*_TUPLE).hint("merge"), _TUPLE, "left_anti")
            held = stage(held.select("meant", *_COLUMN, "value"), "held")
        # The hash leads, so rows are sorted by one number; equal hashes are told apart by the columns themselves.
        one = ["meant", *_COLUMN, "value"]
        gone = asking.where(F.col("lv") == lv).join(held.select(*one).distinct().hint("merge"), one, "left_anti")
        # A reference is unchecked while its parent column holds nothing.
        known = held.groupBy(*_COLUMN).agg(F.lit(True).alias("known"))
        gone = lookup(gone, known, _on(_COLUMN), ["known"]).where("known")
        lost = lost.unionByName(stage(gone.select(*told), "lost"))
    return Bulk(by, slices, specs, missing_required(rules, by), shapes, once, several, clashing, lost)
