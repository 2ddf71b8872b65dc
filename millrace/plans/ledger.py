"""The import ledger (L1-L5), fed from validation results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import grid as G
from millrace.operators.validate import ROW, Validation
from millrace.sources.grids import inspect


def current(ledger: DataFrame) -> DataFrame:
    """One line per import: the ledger only grows, and an import's last line says how it stands.

    The last line is the one with the highest ``seq``; without that column, or between equals, one that
    closes the import. Lines meet in a map-side combined maximum.
    """
    closed = F.coalesce(F.col("status") != "PENDING", F.lit(False))
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(0).cast("long")) if "seq" in ledger.columns else F.lit(0).cast("long")
    line = F.struct(*[F.col(f"`{c}`") for c in ledger.columns if c != "import_id"])
    last = ledger.groupBy("import_id").agg(F.max_by(line, F.struct(seq, closed)).alias("line"))
    return last.select("import_id", "line.*").select(*[f"`{c}`" for c in ledger.columns])


def history(ledger: DataFrame) -> DataFrame:
    """L1: every import once, as it stands, newest first."""
    return current(ledger).orderBy(F.col("upload_date").desc())


def find_import(ledger: DataFrame, import_id: object) -> DataFrame:
    """L2: at most one row, the import as it stands; the predicate reaches the scan."""
    return current(ledger.where(F.col("import_id") == F.lit(import_id)))


def errors(records: DataFrame, import_id: object | None = None) -> DataFrame:
    """L3: error rows of one import, or of all."""
    found = records.where(F.col("status") == "ERROR")
    if import_id is not None:
        found = found.where(F.col("import_id") == F.lit(import_id))
    return found.select("import_id", "row_index", "sheet_name", "raw_data", "errors")


def staging_records(staged: DataFrame, result: Validation, import_id: str, sheet: str) -> DataFrame:
    """One record per source row and target table that accepted or rejected it.

    Rows dropped as duplicates leave no record. Both joins are on the unique row position.
    """
    raw = staged.select(F.col(ROW).alias("row_index"), F.to_json(F.struct(*[c for c in staged.columns if c != ROW])).alias("raw_data"))
    parts = []
    for check in result.checks.values():
        mapped = F.to_json(F.struct(*check.mapped)) if check.mapped else F.lit("{}")
        good = check.valid.select(F.col(ROW).alias("row_index"), mapped.alias("mapped_data"), F.lit(None).cast("string").alias("errors"), F.lit("VALID").alias("status"))
        bad = check.rejected.select("row_index", F.lit(None).cast("string").alias("mapped_data"), F.col("reason").alias("errors"), F.lit("ERROR").alias("status"))
        parts.append(good.unionByName(bad).withColumn("target_table", F.lit(check.table.name)))
    found = reduce(DataFrame.unionByName, parts).join(raw, "row_index")
    return found.select(
        F.lit(import_id).alias("import_id"), F.lit(sheet).alias("sheet_name"), "target_table", "row_index", "raw_data", "mapped_data",
        (F.col("status") == "VALID").alias("is_valid"), "errors", "status",
    )


def counters(result: Validation, import_id: str) -> DataFrame:
    """L4: totals over the target tables of one import, all in rows per table, so that they add up."""
    return result.table_counts.agg(
        F.sum("source_rows").alias("total_records"), F.sum("valid_rows").alias("successful_records"),
        F.sum("rejected_rows").alias("failed_records"), F.sum("duplicate_rows").alias("duplicate_records"),
    ).withColumn("import_id", F.lit(import_id))


def preview(grid: DataFrame, structured: G.Structured, limit: int = 20) -> DataFrame:
    """Per table its counts, columns and first rows, beside the sheet's inspection."""
    sample = G.samples(structured.rows, limit).groupBy(*G.SHEET, "block_start").agg(
        F.array_sort(F.collect_list(F.struct("sample_no", "values"))).alias("sample")
    )
    names = structured.columns.groupBy(*G.SHEET, "block_start").agg(F.array_sort(F.collect_list(F.struct("col_pos", "header", "name"))).alias("columns"))
    seen = inspect(grid).select(*G.SHEET, F.col("rows").alias("sheet_rows"), F.col("columns").alias("sheet_columns"))
    keys = [*G.SHEET, "block_start"]
    return structured.tables.join(names, keys).join(sample, keys).join(seen, list(G.SHEET)).select(
        *G.SHEET, "table_name", "row_count", "column_count", "sheet_rows", "sheet_columns", "columns", "sample"
    )
