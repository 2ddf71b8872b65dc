"""Load statements from accepted rows.

Value text is a projection; batch numbers come from gap-free numbering (T2), so
each statement is one group of at most ``batch_size`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.literals import filled_literal, literal, quote_identifier
from millrace.functions.text import is_empty
from millrace.operators.lookup import lookup
from millrace.operators.prefix import batched, number_by_order
from millrace.operators.validate import ROW, Validation
from millrace.session import stage, stage_facts, stage_parts
from millrace.target import Column, Fill, Table

BATCH_ROWS = 1000
RULE = "-- ==========================================="
THIN = "-- -------------------------------------------"

# Transaction words per dialect.
BEGIN = {"postgres": "BEGIN;", "mysql": "START TRANSACTION;", "tsql": "BEGIN TRANSACTION;"}
COMMIT = "COMMIT;"


@dataclass(frozen=True)
class Slot:
    """One inserted column and the expression that renders it."""

    column: Column
    expr: Expr


def _held(valid: DataFrame, name: str | None) -> str | None:
    return None if name is None else next((c for c in valid.columns if c.lower() == name.lower()), None)


def has_values(valid: DataFrame, column: str) -> bool:
    """O2: whether any accepted row fills the column; stops at the first hit."""
    return not valid.where(~is_empty(F.col(column))).select(F.lit(1)).limit(1).isEmpty()


def inserted_columns(valid: DataFrame, table: Table, fill: Fill) -> list[Column]:
    """O1: every column in schema order, identity only where rows fill it."""
    kept = []
    for c in table.columns:
        if c.identity:
            held = _held(valid, c.name)
            if held is None or not has_values(valid, held):
                continue
        kept.append(c)
    return kept


def value_expr(valid: DataFrame, table: Table, fill: Fill, c: Column, numeric: Sequence[str] = ()) -> Expr:
    """O3: custom value, default, null, source value, else what the schema says."""
    spare = F.lit("DEFAULT" if c.default and not c.nullable else "NULL")
    act = fill.action(table.name, c.name)
    if act is not None and act.is_custom:
        if not act.has_value:
            return spare
        bare = isinstance(act.value, (int, float)) and not isinstance(act.value, bool)
        return literal(F.lit(str(act.value)), c.category, bare)
    if act is not None and act.is_default:
        return F.lit("DEFAULT")
    if act is not None and act.is_null:
        return F.lit("NULL")
    held = _held(valid, c.name)
    if held is None:
        return spare
    source = fill.source(table.name, c.name)
    return F.when(is_empty(F.col(held)), spare).otherwise(filled_literal(F.col(held), c.category, source in numeric))


def table_name(table: Table, dialect: str) -> str:
    name = quote_identifier(table.name, dialect)
    return f"{quote_identifier(table.schema, dialect)}.{name}" if dialect == "tsql" else name


def statements(
    valid: DataFrame,
    table: Table,
    fill: Fill,
    dialect: str = "tsql",
    batch_size: int = BATCH_ROWS,
    columns: list[Column] | None = None,
    numeric: Sequence[str] = (),
) -> DataFrame:
    """``batch, n_rows, text``, one multi-row INSERT per batch."""
    columns = inserted_columns(valid, table, fill) if columns is None else columns
    cells = [F.concat(F.lit("    "), value_expr(valid, table, fill, c, numeric)) for c in columns]
    names = ",\n".join(f"    {quote_identifier(c.name, dialect)}" for c in columns)
    head = f"INSERT INTO {table_name(table, dialect)}\n(\n{names}\n)\nVALUES\n"
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__rn", "tuple"))), lambda s: s["tuple"])
    told = [F.count(F.lit(1)).alias("n_rows"), F.concat(F.lit(head), F.array_join(ordered, ",\n"), F.lit(";")).alias("text")]
    # Values are moved to their numbers once and become text there; only batches at the borders of buckets meet as text.
    rows = batched(valid, ROW, batch_size)
    rows = rows.select("__bucket", F.col("__batch").alias("batch"), "__whole", "__rn", F.concat(F.lit("(\n"), F.concat_ws(",\n", *cells), F.lit("\n)")).alias("tuple"))
    inside = rows.where("__whole").groupBy("__bucket", "batch").agg(*told).drop("__bucket")
    return inside.unionByName(rows.where("NOT __whole").groupBy("batch").agg(*told))


def fill_rule(table: Table, fill: Fill, c: Column, inserted: bool) -> tuple[str, str | None]:
    """The rule that fills one column, and its source or value."""
    act = fill.action(table.name, c.name)
    source = (act.source if act is not None else None) or fill.source(table.name, c.name)
    if c.identity and not inserted:
        return "DATABASE_GENERATED", None
    if act is not None and act.is_custom and act.value is not None:
        return "CUSTOM_VALUE", str(act.value)
    if act is not None and act.is_default:
        return "DEFAULT", None
    if act is not None and act.is_null:
        return "NULL", "explicit"
    if source:
        return "EXCEL", source
    if c.default and not c.nullable:
        return "DEFAULT", "schema"
    return "NULL", "unmapped" if c.nullable else None


_RULE_TEXT = {
    ("DATABASE_GENERATED", None): "DATABASE_GENERATED (Identity sequence; omitted from INSERT)",
    ("DEFAULT", None): "DEFAULT (Database default)",
    ("NULL", "explicit"): "NULL (Explicit NULL)",
    ("DEFAULT", "schema"): "DEFAULT (Schema constraint)",
    ("NULL", "unmapped"): "NULL (Unmapped nullable)",
    ("NULL", None): "NULL",
}


def _rule_text(rule: str, detail: str | None) -> str:
    if rule == "CUSTOM_VALUE":
        return f"CUSTOM_VALUE [{detail}] (Fixed value for all rows)"
    if rule == "EXCEL":
        return f"EXCEL [{detail}] (Mapped)"
    return _RULE_TEXT[(rule, detail)]


def manifest(spark: SparkSession, table: Table, fill: Fill, inserted: Sequence[Column]) -> DataFrame:
    """O13 as rows: table, position, column, rule, source."""
    schema = "table string, col_pos int, column string, rule string, source string"
    names = {c.name for c in inserted}
    rows = []
    for i, c in enumerate(table.columns, start=1):
        rule, detail = fill_rule(table, fill, c, c.name in names)
        rows.append((table.name, i, c.name, rule, detail if rule in ("EXCEL", "CUSTOM_VALUE") else None))
    return spark.createDataFrame(rows, schema)


Line = tuple[int, int, int, int, str]


def _lines(lines: Sequence[str], *place: int) -> list[Line]:
    """Frame lines at ``(section, table, part)``; their number is bounded by the schema."""
    return [(*place, i, line) for i, line in enumerate(lines)]


def _frame(spark: SparkSession, lines: Sequence[Line]) -> DataFrame:
    names = ("section", "table_pos", "part", "item")
    rows = [F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(names, r)], F.lit(r[4]).alias("text")) for r in lines]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def script(
    result: Validation,
    fill: Fill,
    dialect: str = "tsql",
    use_transaction: bool = True,
    batch_size: int = BATCH_ROWS,
    include_report: bool = False,
    unmapped: Sequence[str] = (),
    candidates: DataFrame | None = None,
    numeric: Sequence[str] = (),
) -> DataFrame:
    """The whole load script as rows ordered by section, table_pos, part, item.

    Tables come in load order; tables without accepted rows are skipped.
    """
    spark = result.spark
    head = [RULE, "-- VALID INSERTS", RULE, ""]
    if use_transaction:
        head += [BEGIN.get(dialect, BEGIN["tsql"]), ""]
    frame, parts = _lines(head, 0, 0, 0), []
    for pos, name in enumerate(result.valid_tables):
        check = result.checks[name.lower()]
        # Written once by the validation; read by the identity test, the count and the statements.
        valid, table = check.valid, check.table
        columns = inserted_columns(valid, table, fill)
        if not columns:
            continue
        inserted_names = [c.name for c in columns]
        identity = [c for c in table.columns if c.identity]
        filled = [c.name for c in identity if c.name in inserted_names]
        omitted = [c.name for c in identity if c.name not in inserted_names]
        target = table_name(table, dialect)
        header = [
            THIN,
            f"-- TARGET SQL TABLE: {target}",
            f"-- Complete Columns in Table Schema: {len(table.columns)}",
            f"-- Columns in INSERT Statement: {len(columns)}",
            "-- Column Sources & Filling Rules:",
        ]
        for c in table.columns:
            header.append(f"--   {c.name} -> {_rule_text(*fill_rule(table, fill, c, c.name in inserted_names))}")
        footer = []
        if filled:
            footer.append(f"-- Explicit Identity Values Inserted: {', '.join(filled)}")
        if omitted:
            footer.append(f"-- Identity Columns Omitted (DB Generated): {', '.join(omitted)}")
        footer.append(THIN)
        closing = [""]
        if filled and dialect == "tsql":
            footer.append(f"SET IDENTITY_INSERT {target} ON;")
            closing = [f"SET IDENTITY_INSERT {target} OFF;", ""]
        frame += _lines(header, 1, pos, 0) + _lines(footer, 1, pos, 2) + _lines(closing, 1, pos, 4)
        place = [F.lit(v).cast("long").alias(n) for v, n in ((1, "section"), (pos, "table_pos"))]
        total = valid.agg(F.concat(F.lit("-- Valid Rows to Insert: "), F.count(F.lit(1)).cast("string")).alias("text"))
        inserts = statements(valid, table, fill, dialect, batch_size, columns, numeric)
        spaced = F.concat(F.when(F.col("batch") > 0, F.lit("\n")).otherwise(F.lit("")), F.col("text"))
        total = total.select(*place, F.lit(1).cast("long").alias("part"), F.lit(0).cast("long").alias("item"), "text")
        inserts = inserts.select(*place, F.lit(3).cast("long").alias("part"), F.col("batch").alias("item"), spaced.alias("text"))
        parts.append(total.unionByName(inserts))
    if use_transaction:
        frame += _lines([COMMIT, ""], 2, 0, 0)
    if include_report:
        report_lines, report_parts = _report(result, fill, unmapped, candidates)
        frame += report_lines
        parts += report_parts
    parts.append(_frame(spark, frame))
    # Ordering samples its input first, so the lines are staged rather than made twice.
    return stage_parts(parts, "script")


def ordered(lines: DataFrame) -> DataFrame:
    """Lines in script order. The borders between tasks come from a sample of places alone: a sort by the text would
    send sampled statements to the driver. The lines of one place share a task, where the text orders several messages of a row.
    """
    place = ("section", "table_pos", "part", "item")
    return lines.repartitionByRange(*place).sortWithinPartitions(*place, "text")


def rejection_report(result: Validation) -> DataFrame:
    """Invalid tables, then key, reference and null failures, one line each."""
    for check in result.checks.values():
        check.write_failing()
    kinds = (
        ("INVALID TABLE", result.invalid_tables.select("table", F.lit(None).cast("long").alias("row_index"), "reason")),
        ("PRIMARY KEY CONFLICT", result.pk_errors.select("table", "row_index", "reason")),
        ("FOREIGN KEY ERROR", result.fk_errors.select("table", "row_index", "reason")),
        ("NOT NULL ERROR", result.null_errors.select("table", "row_index", "reason")),
    )
    return reduce(
        DataFrame.unionByName,
        [df.select("table", F.lit(k).alias("kind"), F.col("row_index").cast("long").alias("row_index"), "reason") for k, df in kinds],
    )


def ambiguous_lines(candidates: DataFrame) -> DataFrame:
    """``item, text``: the candidates by source column and falling score, a source's first line led by its name."""
    listed = candidates.select("source", "table", "column", "score", (-F.col("score")).alias("down"))
    listed = number_by_order(listed, ["source", "down", "table", "column"], "item")
    heads = stage_facts(listed.groupBy("source").agg(F.min("item").alias("first"), F.count(F.lit(1)).alias("n")), "heads")
    listed = lookup(listed, heads.renamed("source", "s"), [(F.col("source"), "s")], ["first"], "n", F.col("item"))
    title = F.when(F.col("item") == F.col("first"), F.concat(F.lit("--   Excel Column: "), F.col("source"), F.lit("\n"))).otherwise(F.lit(""))
    text = F.concat(title, F.lit("--     Candidate: "), F.col("table"), F.lit("."), F.col("column"), F.lit(" (Confidence: "), F.col("score").cast("string"), F.lit(")"))
    return listed.select(F.col("item").cast("long").alias("item"), text.alias("text"))


def _report(
    result: Validation, fill: Fill, unmapped: Sequence[str], candidates: DataFrame | None
) -> tuple[list[Line], list[DataFrame]]:
    """Frame lines, and the lines that come from data.

    Fixed values: the comment lines of the script's format.
    """
    lines = [RULE, "-- VALIDATION ERRORS", RULE, ""]
    if result.invalid:
        lines.append("-- [TABLES CANNOT BE GENERATED]")
        for name, reason in result.invalid.items():
            lines += [f"-- Table: {name}", f"--   Reason: {reason}", "--"]
        lines.append("")
    frame, parts = _lines(lines, 3, 0, 0), []
    for pos, check in enumerate(result.checks.values()):
        name = check.table.name
        place = [F.lit(v).cast("long").alias(n) for v, n in ((4, "section"), (pos, "table_pos"))]

        def lines_of(df: DataFrame, part: int, text: Expr, item: Expr, place=place) -> DataFrame:
            return df.select(*place, F.lit(part).cast("long").alias("part"), item.cast("long").alias("item"), text.alias("text"))

        check.write_failing()
        rejected = stage(check.counts.where(F.col("rejected_rows") > 0), "rejected")
        row = F.col("row_index")
        title = F.concat(F.lit(f"-- [Table: {name}] Rejected Rows: "), F.col("rejected_rows").cast("string"))
        told = (
            lines_of(rejected, 0, title, F.lit(0)),
            lines_of(check.pk_errors, 1, F.concat(F.lit("--   PRIMARY KEY CONFLICT: "), F.col("reason")), row),
            lines_of(check.fk_errors, 2, F.concat(F.lit("--   FOREIGN KEY ERROR: Row "), row.cast("string"), F.lit(" - "), F.col("reason")), row),
            lines_of(check.null_errors, 3, F.concat(F.lit("--   NOT NULL ERROR: "), F.col("reason")), row),
            lines_of(rejected, 4, F.lit("--"), F.lit(0)),
        )
        parts.append(reduce(DataFrame.unionByName, told))
    tail = ["", RULE, "-- UNMAPPED EXCEL COLUMNS", RULE]
    for header in unmapped:
        tail += [
            f"-- Excel Column: {header}",
            "--   Reason: No sufficiently confident database-column mapping was found.",
        ]
    if not unmapped:
        tail.append("-- None (All columns were mapped)")
    tail += ["", RULE, "-- COLUMN MAPPING SUMMARY", RULE]
    cased = {(t.key, c.name.lower()): c.name for t in result.order for c in t.columns}
    for name, pairs in fill.sources.items():
        tail.append(f"-- Target Table: [{name}]")
        tail += [f"--   {source} -> {cased.get((name, column), column)} [MATCHED]" for column, source in pairs.items()]
        tail.append("--")
    frame += _lines(tail, 5, 0, 0)
    if candidates is not None:
        frame += _lines(["-- AMBIGUOUS MAPPINGS REQUIRING CONFIRMATION:"], 6, 0, 0)
        place = [F.lit(v).cast("long").alias(n) for v, n in ((6, "section"), (0, "table_pos"), (1, "part"))]
        parts.append(ambiguous_lines(candidates).select(*place, "item", "text"))
    return frame, parts
