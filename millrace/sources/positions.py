"""Stable 1-based row positions at read time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.lookup import lookup
from millrace.session import stage, stage_facts


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet rows with ``row_idx``: position in the file, files in path order."""
    raw = spark.read.parquet(path)
    cols = columns or raw.columns
    at = F.col("_metadata.row_index")
    files = raw.inputFiles()
    if len(files) == 1:
        return raw.select((at + 1).alias("row_idx"), *cols)
    rows = raw.select(F.col("_metadata.file_path").alias("__file"), at.alias("__at"), *cols)
    sizes = raw.select(F.col("_metadata.file_path").alias("file"), at.alias("at")).groupBy("file").agg(
        (F.max("at") + 1).alias("n")
    )
    # One row per file: the window is as long as the directory listing.
    before = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("file").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("file", "n", F.coalesce(before, F.lit(0)).alias("skip"))
    placed = lookup(rows, offsets, [(F.col("__file"), "file")], ["skip"], "n", F.col("__at"))
    return placed.select((F.col("skip") + F.col("__at") + 1).alias("row_idx"), *cols)


def with_positions(raw: DataFrame, **columns: Column) -> DataFrame:
    """``source`` (file path), 0-based ``row_no`` in that file, and ``columns`` of a file read.

    Spark reads a file in blocks and numbers rows per task; the first number and the
    row count of each block turn those into file positions. One fact per block.
    """
    rows = raw.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
        *[expr.alias(name) for name, expr in columns.items()],
    )
    # Written once, so that ids and block facts come from the same scan.
    rows = stage(rows, "positioned")
    blocks = rows.groupBy("source", "__block").agg(F.min("__id").alias("first"), F.count(F.lit(1)).alias("n"))
    # A file's blocks are its size over the split size, far below one window's reach.
    before = F.sum("n").over(W.partitionBy("source").orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    facts = stage_facts(
        blocks.select(
            F.col("source").alias("file"), F.col("__block").alias("block"), "n",
            (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
        ),
        "blocks",
    )
    on = [(F.col("source"), "file"), (F.col("__block"), "block")]
    placed = lookup(rows, facts, on, ["shift"], "n", F.col("__id"))
    return placed.select("source", (F.col("__id") + F.col("shift")).alias("row_no"), *columns)


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8", glob: str = "*") -> DataFrame:
    """Text lines with ``source``, 0-based ``row_no`` in the file, and ``line``."""
    reader = spark.read.option("pathGlobFilter", glob)
    if encoding != "UTF-8":
        reader = reader.option("encoding", encoding).option("lineSep", "\n")
    return with_positions(reader.text(path), line=F.col("value"))
