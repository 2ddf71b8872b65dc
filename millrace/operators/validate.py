"""Row validation against declared tables.

Everything a verdict depends on is a function of the mapped values, so one
partial-aggregated pass collapses the source to distinct value tuples per target
table (V10) and the rules run on those. Verdicts are held as per-key facts:
conflicting keys and orphan values, both staged, counted, and looked up with the
hot-key-safe join. Row reports apply the same facts to the source rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import is_empty, is_empty_number, strip
from millrace.operators.lookup import BROADCAST_BYTES, BROADCAST_ROWS, is_wide, lookup, slices
from millrace.operators.selfref import accept_in_order
from millrace.session import Facts, Steps, stage, stage_facts, stage_parts
from millrace.target import Fill, ForeignKey, Table, load_order

ROW = "row_idx"


def missing_required(table: Table, fill: Fill) -> list[str]:
    """V2: NOT NULL columns without default, identity, source, custom value or default action."""
    found = []
    for c in table.columns:
        if c.nullable or c.default or c.identity:
            continue
        act = fill.action(table.name, c.name)
        excused = act is not None and (act.is_default or (act.is_custom and act.has_value))
        if fill.source(table.name, c.name) is None and not excused:
            found.append(c.name)
    return found


def missing_required_message(table: str, columns: Sequence[str]) -> str:
    return (
        f"Table [{table}] cannot be generated: Missing required columns "
        f"({', '.join(columns)}) with no default in Excel data."
    )


@dataclass
class TableCheck:
    """The rules of one table bound to its source; every member is a lazy DataFrame."""

    table: Table
    source: DataFrame  # row_idx + mapped target columns as text
    tuples: DataFrame  # distinct tuples: columns, first row_idx, copies
    conflicts: Facts | None
    orphans: dict[int, Facts]
    self_facts: dict[int, tuple[Facts, int | None]] = field(default_factory=dict)
    judged: DataFrame | None = None  # the tuples with all facts, written once the rules are settled
    accepted: Facts | None = None  # the valid ones among them (self references are settled by row, so there they are written apart)
    repeats: Facts | None = None  # the failed tuples of several rows, where they are few enough for every task
    broken: DataFrame | None = None  # the failing rows, written once where several reports read them

    @property
    def mapped(self) -> list[str]:
        return [c for c in self.source.columns if c != ROW]

    # -- flags ---------------------------------------------------------------
    def _with_facts(self, df: DataFrame, step: Callable[[list[DataFrame]], DataFrame] | None = None) -> list[DataFrame]:
        """``df`` with all facts, in parts if ``step`` is given: lookups that move the rows then do it in slices of their
        keys, and ``step`` writes the parts of one before the next.
        """
        parts = [df]

        def meet(facts: Facts, on: list[tuple[Column, str]], wanted: list[str]) -> None:
            nonlocal parts
            if step is None or not is_wide(facts):
                parts = [lookup(part, facts, on, wanted, "copies", F.col(ROW)) for part in parts]
                return
            whole = parts[0] if len(parts) == 1 else step(parts)
            parts = [lookup(part, some, on, wanted, "copies", F.col(ROW)) for part, some in slices(whole, facts, on)]

        if self.conflicts is not None:
            meet(self.conflicts, [(e, f"pk{i}") for i, e in enumerate(self._key_parts())], ["variants", "first_row"])
        else:
            parts = [df.withColumns({"variants": F.lit(None).cast("long"), "first_row": F.lit(None).cast("long")})]
        for i, facts in self.orphans.items():
            value = strip(F.col(self._target(self.table.foreign_keys[i].column)))
            meet(facts.renamed("orphan", f"orphan{i}"), [(value, "fk_value")], [f"orphan{i}"])
        for i, (starts, first) in self.self_facts.items():
            ref = self._ref(i)
            meet(starts, [(ref, "key")], ["since"])
            late = F.lit(False) if first is None else F.col(ROW) > F.lit(first)
            missing = ref.isNotNull() & late & ~F.coalesce(F.col("since") < F.col(ROW), F.lit(False))
            parts = [part.withColumn(f"orphan{i}", F.when(missing, F.lit(True))).drop("since") for part in parts]
        return parts

    def _target(self, name: str) -> str:
        return next(c for c in self.mapped if c.lower() == name.lower())

    def _ref(self, i: int) -> Column:
        c = F.col(self._target(self.table.foreign_keys[i].column))
        return F.when(~is_empty(c), strip(c))

    def _key_parts(self) -> list[Column]:
        cols = [F.col(self._target(k)) for k in self.table.primary_key]
        any_empty = reduce(lambda a, b: a | b, [is_empty(c) for c in cols])
        return [F.when(~any_empty, strip(c)) for c in cols]

    def _null_failures(self) -> list[tuple[str, Column]]:
        out = []
        for c in self.table.columns:
            name = next((m for m in self.mapped if m.lower() == c.name.lower()), None)
            if name is not None and not c.nullable and not c.default:
                out.append((c.name, is_empty(F.col(name))))
        return out

    def required(self, column: str) -> bool:
        """A required column holds a value in every accepted row."""
        return column.lower() in {name.lower() for name, _ in self._null_failures()}

    def _fk_failures(self) -> list[tuple[int, ForeignKey, Column]]:
        known = sorted([*self.orphans, *self.self_facts])
        return [(i, self.table.foreign_keys[i], F.col(f"orphan{i}").isNotNull()) for i in known]

    def _failed(self) -> Column:
        tests = [F.col("variants").isNotNull()]
        tests += [t for _, t in self._null_failures()] + [t for *_, t in self._fk_failures()]
        return reduce(lambda a, b: a | b, tests)

    # -- outputs -------------------------------------------------------------
    @property
    def valid(self) -> DataFrame:
        """Accepted distinct tuples with the row they were first seen in."""
        return self._valid() if self.accepted is None else self.accepted.df

    def settle(self) -> None:
        """Write the verdicts: one table of tuples with their facts serves the valid ones, their number and the counters."""
        if self.self_facts:
            self.accepted = stage_facts(self._valid(), f"valid-{self.table.key}", compact=True)
            return
        steps = Steps(f"met-{self.table.key}", self.tuples)
        again = self._failed() & (F.col("copies") > 1)
        seen, parts = [], []
        for part in self._with_facts(self.tuples, steps):
            seen.append(Observation())
            parts.append(part.observe(seen[-1], F.count_if(~self._failed()).alias("n"), F.count_if(again).alias("again")))
        self.judged = stage_parts(parts, f"judged-{self.table.key}")
        self.tuples = self.judged.select(*self.tuples.columns)
        steps.done()
        valid = self.judged.where(~self._failed()).select(ROW, *self.mapped)
        self.accepted = Facts(valid, sum(o.get["n"] for o in seen), 1 << 62)  # of unknown width: never sent to every task
        if self.mapped and sum(o.get["again"] for o in seen) <= BROADCAST_ROWS:
            several = self.judged.where(again).select(F.struct(*self.mapped).alias("tuple"), F.col(ROW).alias("tuple_row"), *self._facts())
            repeats = stage_facts(several, f"repeats-{self.table.key}")
            self.repeats = repeats if repeats.bytes <= BROADCAST_BYTES else None

    def _facts(self) -> list[str]:
        return ["variants", "first_row", *[f"orphan{i}" for i in self.orphans]]

    def _valid(self) -> DataFrame:
        if self.self_facts:
            rows = self.flagged.where(~self._failed())
            return distinct_tuples(rows.select(ROW, *self.mapped)).select(ROW, *self.mapped)
        return self._with_facts(self.tuples)[0].where(~self._failed()).select(ROW, *self.mapped)

    @property
    def flagged(self) -> DataFrame:
        return self._with_facts(self.source)[0]

    @property
    def failing(self) -> DataFrame:
        """The rows that break a rule, with their facts and the first row of their tuple where ``repeats`` is known."""
        return reduce(DataFrame.unionByName, self._failing()) if self.broken is None else self.broken

    def _failing(self, step: Callable[[list[DataFrame]], DataFrame] | None = None) -> list[DataFrame]:
        """A tuple seen once is its own row, so its verdict needs no further join. Rows of the others are looked up in the
        source while their failed tuples are few, else all rows meet the facts.
        """
        if self.judged is None or self.repeats is None:
            return [part.where(self._failed()) for part in self._with_facts(self.source, step)]
        facts = self._facts()
        once = self.judged.where(self._failed() & (F.col("copies") == 1)).select(ROW, *self.mapped, F.col(ROW).alias("tuple_row"), *facts)
        if not self.repeats.rows:
            return [once]
        rows = lookup(self.source, self.repeats, [(F.struct(*self.mapped), "tuple")], ["tuple_row", *facts])
        return [once, rows.where(F.col("tuple_row").isNotNull())]

    def write_failing(self) -> None:
        """Write the failing rows, so that reports read them and no lookup runs, or is broadcast, once a report."""
        if self.broken is None:
            steps = Steps(f"met-{self.table.key}")
            self.broken = stage_parts(self._failing(steps), f"failing-{self.table.key}")
            steps.done()

    @property
    def null_errors(self) -> DataFrame:
        """V6: one line per empty required cell of a row that has no key conflict."""
        items = [
            F.when(test, F.struct(
                F.lit(name).alias("column"),
                F.concat(F.lit(f"Required column '{name}' is empty in row "), F.col(ROW).cast("string")).alias("reason"),
            ))
            for name, test in self._null_failures()
        ]
        rows = self.failing.where(F.col("variants").isNull())
        return self._exploded(rows, items, ["column", "reason"])

    @property
    def fk_errors(self) -> DataFrame:
        """V7: one line per reference to a value no accepted parent row holds."""
        items = []
        for _, fk, test in self._fk_failures():
            value = strip(F.col(self._target(fk.column)))
            items.append(F.when(test, F.struct(
                F.lit(fk.column).alias("column"),
                value.alias("value"),
                F.lit(fk.parent_table).alias("parent_table"),
                F.lit(fk.parent_column).alias("parent_column"),
                _fk_message(fk, value).alias("reason"),
            )))
        rows = self.failing.where(F.col("variants").isNull())
        return self._exploded(rows, items, ["column", "value", "parent_table", "parent_column", "reason"])

    def _exploded(self, rows: DataFrame, items: list[Column], fields: list[str]) -> DataFrame:
        head = [F.col(ROW).alias("row_index"), F.lit(self.table.name).alias("table")]
        if not items:
            schema = [F.lit(None).cast("string").alias(f) for f in fields]
            return rows.limit(0).select(*head, *schema)
        found = rows.select(*head, F.explode(F.array_compact(F.array(*items))).alias("e"))
        return found.select("row_index", "table", *[F.col(f"e.{f}").alias(f) for f in fields])

    @property
    def pk_errors(self) -> DataFrame:
        """Later rows that differ from the first row of their key."""
        head = [F.lit(self.table.name).alias("table")]
        if self.conflicts is None or not self.conflicts.rows:
            return self.source.limit(0).select(
                *head, *[F.lit(None).cast("string").alias(n) for n in ("pk_columns", "pk_value")],
                F.col(ROW).alias("row_index"), F.col(ROW).alias("conflicting_with_row"),
                F.lit(None).cast("string").alias("reason"),
            )
        parts = self._key_parts()
        on = [(e, f"pk{i}") for i, e in enumerate(parts)]
        if self.repeats is not None:
            rows = self.failing.where(F.col("variants").isNotNull() & (F.col("tuple_row") != F.col("first_row")))
        else:
            facts = stage_facts(first_tuples(self.conflicts.df, self.tuples, self.mapped), "first-tuples", compact=True)
            rows = lookup(self.source, facts, on, ["first_row", "first_tuple"], "copies", F.col(ROW))
            same = reduce(
                lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"first_tuple.c{i}")) for i, c in enumerate(self.mapped)]
            )
            rows = rows.where(F.col("first_row").isNotNull() & (F.col(ROW) > F.col("first_row")) & ~same)
        key_text = F.concat_ws(", ", *parts)
        return rows.select(
            *head,
            F.lit(", ".join(k.lower() for k in self.table.primary_key)).alias("pk_columns"),
            key_text.alias("pk_value"),
            F.col(ROW).alias("row_index"),
            F.col("first_row").alias("conflicting_with_row"),
            F.concat(
                F.lit("Duplicate primary-key value '"), key_text, F.lit("' with conflicting data (rows "),
                F.col("first_row").cast("string"), F.lit(" and "), F.col(ROW).cast("string"), F.lit(")"),
            ).alias("reason"),
        )

    @property
    def rejected(self) -> DataFrame:
        """Each rejected row once, with its error type and joined reasons."""
        conflict = F.col("variants").isNotNull()
        reasons = [
            F.when(test, F.concat(F.lit(f"Required column '{name}' is empty in row "), F.col(ROW).cast("string")))
            for name, test in self._null_failures()
        ] + [
            F.when(test, _fk_message(fk, strip(F.col(self._target(fk.column)))))
            for _, fk, test in self._fk_failures()
        ]
        joined = F.concat_ws("; ", *reasons) if reasons else F.lit("")
        if self.conflicts is not None:
            key_text = F.concat_ws(", ", *self._key_parts())
            joined = F.when(
                conflict, F.concat(F.lit("Row rejected due to duplicate primary key conflict: '"), key_text, F.lit("'"))
            ).otherwise(joined)
        return self.failing.select(
            F.col(ROW).alias("row_index"),
            F.lit(self.table.name).alias("table"),
            F.when(conflict, F.lit("PRIMARY_KEY_CONFLICT")).otherwise(F.lit("VALIDATION_ERROR")).alias("error_type"),
            joined.alias("reason"),
        )

    @property
    def counts(self) -> DataFrame:
        """One row of counters, from weighted distinct tuples: no row-level join."""
        conflict = F.col("variants").isNotNull()
        nulls = _count_true([t for _, t in self._null_failures()])
        fks = _count_true([t for *_, t in self._fk_failures()])
        if self.self_facts:
            base = self.flagged.withColumn("copies", F.lit(1).cast("long"))
        else:
            base = self._with_facts(self.tuples)[0] if self.judged is None else self.judged
        n_conflicts = 0 if self.conflicts is None else self.conflicts.rows
        aggs = [
            F.coalesce(F.sum("copies"), F.lit(0)).alias("source_rows"),
            F.lit(self.accepted.rows).cast("long").alias("valid_rows"),
            F.coalesce(F.sum(F.when(self._failed(), F.col("copies"))), F.lit(0)).alias("rejected_rows"),
            F.lit(n_conflicts).cast("long").alias("pk_conflict_keys"),
            F.coalesce(F.sum(F.when(~conflict, fks * F.col("copies"))), F.lit(0)).cast("long").alias("fk_errors"),
            F.coalesce(F.sum(F.when(~conflict, nulls * F.col("copies"))), F.lit(0)).cast("long").alias("null_errors"),
        ]
        return base.agg(*aggs).select(
            F.lit(self.table.name).alias("table"), "source_rows", "valid_rows", "rejected_rows",
            (F.col("source_rows") - F.col("valid_rows") - F.col("rejected_rows")).alias("duplicate_rows"),
            "pk_conflict_keys", "fk_errors", "null_errors",
        )


def _count_true(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [t.cast("long") for t in tests], F.lit(0).cast("long"))


def _fk_message(fk: ForeignKey, value: Column) -> Column:
    return F.concat(
        F.lit(f"Foreign key violation: Column '{fk.column}' value '"), value,
        F.lit(f"' does not exist in parent table '{fk.parent_table}.{fk.parent_column}'"),
    )


def distinct_tuples(rows: DataFrame) -> DataFrame:
    """V10 as a map-side combined aggregate; null-safe, first row kept.

    Without mapped columns every row is the same tuple, so one row remains.
    """
    cols = [c for c in rows.columns if c != ROW]
    out = rows.groupBy(*cols).agg(F.min(ROW).alias(ROW), F.count(F.lit(1)).alias("copies"))
    return out if cols else out.where(F.col("copies") > 0)


def project(staged: DataFrame, table: Table, fill: Fill) -> DataFrame:
    """This table's own slice of a source that may feed several tables; NaN is a missing value."""
    picked = []
    floating = {f.name.lower() for f in staged.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    for c in table.columns:
        src = fill.source(table.name, c.name)
        if src is not None:
            value = F.col(f"`{src}`")
            value = F.when(~is_empty_number(value), value) if src.lower() in floating else value
            picked.append(value.cast("string").alias(c.name))
    return staged.select(F.col(ROW), *picked)


def find_conflicts(tuples: DataFrame, key_parts: list[Column]) -> DataFrame:
    """V5: keys (trimmed) held by more than one distinct tuple (untrimmed)."""
    names = [f"pk{i}" for i in range(len(key_parts))]
    keyed = tuples.select(*[e.alias(n) for n, e in zip(names, key_parts)], ROW, "copies").where(F.col("pk0").isNotNull())
    found = keyed.groupBy(*names).agg(
        F.count(F.lit(1)).alias("variants"), F.sum("copies").alias("copies"), F.min(ROW).alias("first_row")
    )
    return found.where(F.col("variants") > 1)


def first_tuples(conflicts: DataFrame, tuples: DataFrame, mapped: list[str]) -> DataFrame:
    """The values of each conflicting key's first row; row_idx is unique, so this spreads evenly."""
    firsts = tuples.select(
        F.col(ROW).alias("__row"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(mapped)]).alias("first_tuple")
    )
    return conflicts.hint("merge").join(firsts, F.col("first_row") == F.col("__row")).drop("__row")


def parent_values(valid: DataFrame, column: str) -> DataFrame:
    """V8: distinct non-empty values of a referenced column among accepted rows."""
    value = F.col(column)
    return valid.where(~is_empty(value)).select(strip(value).alias("fk_value")).distinct()


def find_orphans(tuples: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """V7: referenced values that no parent holds; weighted distinct values meet, not rows."""
    value = F.col(column)
    wanted = tuples.where(~is_empty(value)).groupBy(strip(value).alias("fk_value")).agg(F.sum("copies").alias("copies"))
    return wanted.join(parents.hint("merge"), "fk_value", "left_anti").withColumn("orphan", F.lit(True))


# Report layouts for a run in which no table takes part.
EMPTY_REPORTS = {
    "rejected": "row_index long, table string, error_type string, reason string",
    "pk_errors": "table string, pk_columns string, pk_value string, row_index long, conflicting_with_row long, reason string",
    "fk_errors": "row_index long, table string, column string, value string, parent_table string, parent_column string, reason string",
    "null_errors": "row_index long, table string, column string, reason string",
    "counts": "table string, source_rows long, valid_rows long, rejected_rows long, duplicate_rows long, "
    "pk_conflict_keys long, fk_errors long, null_errors long",
}


@dataclass
class Validation:
    order: list[Table]
    checks: dict[str, TableCheck]
    invalid: dict[str, str]
    valid_tables: list[str]
    missing_required_count: int
    spark: SparkSession

    def _stack(self, member: str) -> DataFrame:
        parts = [getattr(c, member) for c in self.checks.values()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], EMPTY_REPORTS[member])

    @property
    def rejected(self) -> DataFrame:
        return self._stack("rejected")

    @property
    def pk_errors(self) -> DataFrame:
        return self._stack("pk_errors")

    @property
    def fk_errors(self) -> DataFrame:
        return self._stack("fk_errors")

    @property
    def null_errors(self) -> DataFrame:
        return self._stack("null_errors")

    @property
    def table_counts(self) -> DataFrame:
        return self._stack("counts")

    @property
    def invalid_tables(self) -> DataFrame:
        schema = T.StructType([T.StructField("table", T.StringType()), T.StructField("reason", T.StringType())])
        return self.spark.createDataFrame(list(self.invalid.items()), schema)

    @property
    def stats(self) -> DataFrame:
        """V13."""
        return self.table_counts.agg(
            F.coalesce(F.sum("valid_rows"), F.lit(0)).alias("total_valid_rows"),
            F.coalesce(F.sum("rejected_rows"), F.lit(0)).alias("total_rejected_rows"),
            F.coalesce(F.sum("pk_conflict_keys"), F.lit(0)).alias("pk_error_count"),
            F.coalesce(F.sum("fk_errors"), F.lit(0)).alias("fk_error_count"),
            F.lit(self.missing_required_count).cast("long").alias("missing_required_count"),
        )


def validate(
    staged: DataFrame,
    tables: Sequence[Table],
    fill: Fill,
    self_fk: str = "ordered",
    open_world: bool = True,
) -> Validation:
    """Check ``staged`` (``row_idx`` plus source columns) against ``tables``, parents first.

    ``open_world`` (Q10): a reference is unchecked while its parent has no accepted
    values; in a closed world nothing satisfies it then. ``self_fk`` is ``"ordered"`` (checked against earlier accepted rows) or
    ``"off"``.
    """
    order = load_order(tables)
    checks: dict[str, TableCheck] = {}
    invalid: dict[str, str] = {}
    valid_tables: list[str] = []
    missing_total = 0

    for table in order:
        if not fill.covers(table.name):  # V3
            continue
        missing = missing_required(table, fill)
        if missing:
            invalid[table.name] = missing_required_message(table.name, missing)
            missing_total += len(missing)
            continue

        source = project(staged, table, fill)
        tuples = stage(distinct_tuples(source), f"tuples-{table.key}", compact=True)
        check = TableCheck(table, source, tuples, None, {})
        mapped = {c.lower() for c in check.mapped}
        if table.primary_key and all(k.lower() in mapped for k in table.primary_key):
            check.conflicts = stage_facts(find_conflicts(tuples, check._key_parts()), f"conflicts-{table.key}", compact=True)

        for i, fk in enumerate(table.foreign_keys):
            parent = checks.get(fk.parent_key)
            if fk.column.lower() not in mapped or fk.parent_key == table.key:
                continue
            if parent is not None and fk.parent_column.lower() in {c.lower() for c in parent.mapped}:
                values = parent_values(parent.valid, parent._target(fk.parent_column))
                held = parent.required(fk.parent_column) and parent.accepted.rows > 0
                if open_world and not held and values.isEmpty():
                    continue
            elif open_world:
                continue
            else:
                values = staged.sparkSession.createDataFrame([], "fk_value string")
            orphans = find_orphans(tuples, check._target(fk.column), values)
            check.orphans[i] = stage_facts(orphans, f"orphans-{table.key}", compact=True)

        own = [
            i for i, fk in enumerate(table.foreign_keys)
            if fk.parent_key == table.key and {fk.column.lower(), fk.parent_column.lower()} <= mapped
        ]
        if own and self_fk == "ordered":
            links = [F.col(ROW)]
            for i in own:
                held = F.col(check._target(table.foreign_keys[i].parent_column))
                links += [F.when(~is_empty(held), strip(held)).alias(f"key{i}"), check._ref(i).alias(f"ref{i}")]
            clean = check.flagged.where(~check._failed())
            check.self_facts = accept_in_order(clean.select(*links), own)

        checks[table.key] = check
        check.settle()
        if not check.accepted.rows:  # V12
            invalid[table.name] = "No valid rows remaining after validation."
        else:
            valid_tables.append(table.name)

    return Validation(order, checks, invalid, valid_tables, missing_total, staged.sparkSession)
