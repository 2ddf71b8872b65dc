"""Tables inside raw grids.

A grid is rows of ``source, sheet, row_idx, cells`` with 0-based positions that
restart per sheet. Block borders come from running aggregates over bounded buckets
(``prefix.running``), so one sheet holding most of the data is no special case;
headers are read from the first 21 rows of a block only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.kinds import is_number
from millrace.functions.text import column_key, round2, strip
from millrace.operators.lookup import lookup
from millrace.operators.prefix import Running, number, running
from millrace.session import stage, stage_facts

SHEET = ("source", "sheet")
SEARCH_ROWS = 20
LONG_TEXT = 50
NEAR_COUNT = 2


def row_is_empty(cells: Column) -> Column:
    """G1: every cell null; blank text is not null here."""
    return F.forall(cells, lambda c: c.isNull())


def segment(grid: DataFrame) -> DataFrame:
    """Rows of kept blocks with ``block_start`` and ``row_in_block``.

    A block is a maximal run of non-empty rows of at least two rows. A sheet without
    any is one block, empty rows included.
    """
    at = F.col("row_idx")
    empty = row_is_empty(F.col("cells"))
    rows = grid.withColumn("is_empty", empty)
    rows = running(
        rows, SHEET, "row_idx",
        [
            Running("empty_before", "max", F.when(F.col("is_empty"), at)),
            Running("empty_after", "min", F.when(F.col("is_empty"), at), backward=True),
            Running("last_row", "max", at, backward=True),
        ],
    )
    start = F.coalesce(F.col("empty_before"), F.lit(-1)) + 1
    end = F.coalesce(F.col("empty_after"), F.col("last_row") + 1)
    rows = rows.withColumns({"run_start": start, "run_rows": end - start})
    rows = stage(rows.drop("empty_before", "empty_after", "last_row"), "segments")
    kept = ~F.col("is_empty") & (F.col("run_rows") >= 2)
    whole = rows.groupBy(*SHEET).agg(F.bool_or(kept).alias("has_block"), F.count(F.lit(1)).alias("n"))
    bare = whole.where(~F.col("has_block")).select(*SHEET, F.lit(True).alias("one_block"), "n")
    rows = lookup(rows, bare, [(F.col(c), c) for c in SHEET], ["one_block"], "n", at)
    found = rows.where(kept | F.col("one_block"))
    block_start = F.when(F.col("one_block"), F.lit(0)).otherwise(F.col("run_start"))
    return found.select(*SHEET, "row_idx", "cells", block_start.cast("long").alias("block_start"),
                        (at - block_start).cast("long").alias("row_in_block"))


def table_name(sheet: Column) -> Column:
    return F.replace(F.lower(sheet), F.lit(" "), F.lit("_"))


def blocks(segmented: DataFrame) -> DataFrame:
    """One row per block: rows (those that a gap implies included), order within its sheet, table name."""
    found = segmented.groupBy(*SHEET, "block_start").agg(
        (F.max("row_in_block") + 1).alias("n_rows"), F.max(F.size("cells")).alias("width")
    )
    numbered = stage(number(found, SHEET, "block_start", "block_no"), "blocks")
    per_sheet = numbered.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n_blocks"))
    out = lookup(numbered, per_sheet, [(F.col(c), c) for c in SHEET], ["n_blocks"], "n_blocks", F.col("block_start"))
    suffix = F.when(F.col("n_blocks") > 1, F.concat(F.lit("_"), F.col("block_no").cast("string"))).otherwise(F.lit(""))
    return out.select(*SHEET, "block_start", "n_rows", "width", "block_no", F.concat(table_name(F.col("sheet")), suffix).alias("table_name"))


def header_scores(segmented: DataFrame, numeric_cells: str = "parsed") -> DataFrame:
    """Header score of the first 20 rows of each block; empty rows have none.

    Staged cells are text: ``numeric_cells="parsed"`` counts number-like text as
    numbers (and not as strings), ``"typed"`` counts none, as for untyped columns.
    """
    head = segmented.where(F.col("row_in_block") <= SEARCH_ROWS)
    filled = F.filter("cells", lambda c: c.isNotNull())

    def numeric(c: Column) -> Column:
        return is_number(strip(c)) if numeric_cells == "parsed" else F.lit(False)

    counted = head.select(
        *SHEET, "block_start", "row_in_block", F.size("cells").alias("width"),
        F.size(filled).alias("filled"),
        F.size(F.filter(filled, lambda c: (strip(c) != "") & ~numeric(c))).alias("strings"),
        F.size(F.filter(filled, lambda c: (F.length(c) > LONG_TEXT) & ~numeric(c))).alias("longs"),
        F.size(F.filter(filled, numeric)).alias("numbers"),
    )
    # At most 21 rows per block meet here.
    following = F.lead("filled").over(W.partitionBy(*SHEET, "block_start").orderBy("row_in_block"))
    near = F.coalesce(F.abs(following - F.col("filled")) <= NEAR_COUNT, F.lit(False)).cast("int")
    value = F.col("strings") * 2 - F.col("longs") * 5 - F.col("numbers") * 10 + F.col("filled") + near * 5
    scored = counted.withColumn("score", value)
    return scored.where((F.col("row_in_block") < SEARCH_ROWS) & (F.col("filled") > 0))


def headers(segmented: DataFrame, block_list: DataFrame, numeric_cells: str = "parsed") -> DataFrame:
    """Header row (-1 for none), first data row and confidence per block."""
    best = header_scores(segmented, numeric_cells).groupBy(*SHEET, "block_start").agg(
        F.max_by("row_in_block", F.struct("score", -F.col("row_in_block"))).alias("best_row"), F.max("score").alias("best")
    )
    out = block_list.join(best, [*SHEET, "block_start"], "left")
    # A block of empty rows only has no scored row.
    score, width = F.coalesce(F.col("best"), F.lit(-1000)), F.col("width")
    ratio = F.least(F.greatest(score / (width * 3 + 5), F.lit(0.0)), F.lit(1.0))
    poor = score < width * 0.5
    return out.select(
        *block_list.columns,
        F.when(poor, F.lit(-1)).otherwise(F.col("best_row")).cast("long").alias("header_row"),
        F.when(poor, F.lit(0)).otherwise(F.col("best_row") + 1).cast("long").alias("data_start"),
        round2(ratio).alias("confidence"),
    )


@dataclass(frozen=True)
class Structured:
    """``columns``: one row per kept column; ``rows``: kept data rows as arrays; ``tables``: per table."""

    tables: DataFrame
    columns: DataFrame
    rows: DataFrame


def ignored_rows(tables: DataFrame) -> DataFrame:
    """Block rows before the data."""
    upto = F.when(F.col("data_start") > 0, F.sequence(F.lit(0).cast("long"), F.col("data_start") - 1))
    return tables.select(*SHEET, "table_name", F.explode(upto).alias("row_in_block"))


def structure(grid: DataFrame, numeric_cells: str = "parsed") -> Structured:
    """A grid to clean tables.

    ``rows`` holds ``source, sheet, table_name, row_idx, values`` with values in the
    order of the table's kept columns.
    """
    segmented = stage(segment(grid), "segmented")
    heads = stage_facts(headers(segmented, blocks(segmented), numeric_cells), "headers")
    keys = [*SHEET, "block_start"]
    facts = heads.narrowed(*keys, "table_name", "header_row", "data_start", "n_rows")
    placed = lookup(segmented, facts, [(F.col(k), k) for k in keys], ["table_name", "header_row", "data_start"], "n_rows", F.col("row_idx"))
    data = placed.where(F.col("row_in_block") >= F.col("data_start"))

    # Columns with any value in the data rows; counts combine map-side.
    used = data.select(*keys, F.posexplode("cells").alias("col_pos", "cell")).groupBy(*keys, "col_pos").agg(F.count("cell").alias("n"))
    kept = used.where(F.col("n") > 0).drop("n")
    # One header row per block.
    names = placed.where(F.col("row_in_block") == F.col("header_row")).select(
        *keys, F.posexplode("cells").alias("col_pos", "raw")
    )
    columns = kept.join(names, [*keys, "col_pos"], "left").join(heads.df.select(*keys, "table_name", "header_row"), keys)
    columns = stage(name_columns(columns, keys), "columns")

    order = columns.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.col("col_pos"))).alias("kept_pos")
    ).join(heads.df.select(*keys, "n_rows"), keys)
    rows = lookup(data, order, [(F.col(k), k) for k in keys], ["kept_pos"], "n_rows", F.col("row_idx"))
    values = F.transform("kept_pos", lambda p: F.get("cells", p))
    rows = rows.withColumn("values", values).where(F.exists("values", lambda v: v.isNotNull()))  # G13
    rows = stage(rows.select(*SHEET, "table_name", "block_start", "row_idx", "row_in_block", "values"), "clean-rows")

    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))  # G14
    widths = columns.groupBy(*keys).agg(F.count(F.lit(1)).alias("column_count"))
    tables = heads.df.join(counts, keys).join(widths, keys)
    return Structured(tables, columns, rows)


def name_columns(columns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shown and normalised names; repeated normalised names get _2, _3."""
    position = F.concat(F.lit("Column_"), (F.col("col_pos") + 1).cast("string"))
    # An absent header cell, like a header containing this word, is named by position.
    raw = F.when(F.col("header_row") >= 0, F.coalesce(F.col("raw"), F.lit("Unnamed")))
    shown = F.when(raw.isNull() | raw.contains("Unnamed"), position).otherwise(strip(raw))
    named = columns.withColumn("header", shown).withColumn("base", column_key(F.col("header")))
    # As long as one table's list of equal headers.
    again = F.row_number().over(W.partitionBy(*keys, "base").orderBy("col_pos"))
    suffix = F.when(again > 1, F.concat(F.lit("_"), again.cast("string"))).otherwise(F.lit(""))
    return named.select(*keys, "table_name", "col_pos", "header", F.concat("base", suffix).alias("name"))


def samples(rows: DataFrame, limit: int = 20) -> DataFrame:
    """First rows of each table; every task keeps only its own first rows."""
    at = F.row_number().over(W.partitionBy(*SHEET, "block_start").orderBy("row_idx"))
    return rows.withColumn("sample_no", at).where(F.col("sample_no") <= limit)


def wide(rows: DataFrame, columns: DataFrame, sheet: tuple[str, str], name: str) -> DataFrame:
    """One table as named text columns; its column list is as small as a schema."""
    one = (F.col("source") == sheet[0]) & (F.col("sheet") == sheet[1]) & (F.col("table_name") == name)
    found = columns.where(one).orderBy("col_pos").select("name").toLocalIterator()
    picked = [F.get("values", F.lit(i)).alias(r["name"]) for i, r in enumerate(found)]
    return rows.where(one).select("row_idx", *picked)


def physical_types(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """Narrowest of five types that every value of a column has; text values."""
    text = F.lower(strip(F.col("value")))
    filled, whole = F.col("filled"), r"^[+-]?[0-9]+$"
    tested = values.select(*by, F.when(text != "", text).alias("filled")).select(
        *by,
        (filled.rlike(whole) & filled.try_cast("long").isNotNull()).alias("int_ok"),
        filled.rlike(whole).alias("whole_ok"),
        is_number(filled).alias("num_ok"),
        filled.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([t ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?)?$").alias("date_ok"),
        filled.rlike("^(true|false)$").alias("bool_ok"),
        filled.isNull().alias("no_value"),
    )
    folded = tested.groupBy(*by).agg(
        *[F.bool_and(c).alias(c) for c in ("int_ok", "whole_ok", "num_ok", "date_ok", "bool_ok")], F.bool_or("no_value").alias("gaps")
    )
    # A column of whole numbers with gaps is held as floats; booleans with gaps as text, and so are
    # whole numbers that no integer type holds, whose digits a float would lose.
    kind = (
        F.when(F.col("bool_ok") & ~F.col("gaps"), F.lit("boolean"))
        .when(F.col("int_ok") & ~F.col("gaps"), F.lit("integer"))
        .when(F.col("num_ok") & (F.col("int_ok") | ~F.col("whole_ok")), F.lit("float"))
        .when(F.col("date_ok"), F.lit("date"))
    )
    return folded.select(*by, kind.otherwise(F.lit("string")).alias("physical_type"))


# Spark type name -> physical category.
SPARK_CATEGORIES = {
    "byte": "integer", "short": "integer", "integer": "integer", "long": "integer", "float": "float", "double": "float",
    "decimal": "float", "date": "date", "timestamp": "date", "timestamp_ntz": "date", "boolean": "boolean",
}


def schema_types(df: DataFrame) -> dict[str, str]:
    """G15 for typed data: read from the schema."""
    return {f.name: SPARK_CATEGORIES.get(f.dataType.typeName(), "string") for f in df.schema.fields}


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text, nulls kept."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
