"""Caches and sinks."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.dates import iso_text
from millrace.operators.prefix import number
from millrace.operators.render import ordered


def write_cache(rows: DataFrame, path: str) -> None:
    """One partition per ``import_id`` and ``table_name``; a re-run replaces only its own partitions.

    Rows are cut by table before writing, and a large table still spreads over as
    many files as its share of the data asks for.
    """
    cut = rows.hint("rebalance", "import_id", "table_name")
    cut.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("import_id", "table_name").parquet(path)


def read_cache(spark: SparkSession, path: str, import_id: str, table_name: str) -> DataFrame:
    """The two predicates prune to one partition; a missing table is empty.

    Ids are text whatever they look like: '007' and '7' are two imports.
    """
    keys = ("import_id", "table_name")
    fields = [T.StructField(f.name, T.StringType()) if f.name in keys else f for f in spark.read.parquet(path).schema.fields]
    found = spark.read.schema(T.StructType(fields)).parquet(path)
    return found.where((F.col("import_id") == import_id) & (F.col("table_name") == table_name))


def iso_timestamps(df: DataFrame) -> DataFrame:
    """Every timestamp column as ISO text."""
    kinds = (T.TimestampType, T.TimestampNTZType)
    return df.select(*[
        iso_text(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f"`{f.name}`") for f in df.schema.fields
    ])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of any float column as null."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*[
        F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def write_script(lines: DataFrame, path: str) -> None:
    """Statement text in order; range-partitioned, so part files follow each other."""
    ordered(lines).select("text").write.mode("overwrite").text(path)


# Physical category -> column type of a created table.
SINK_TYPES = {"integer": T.LongType(), "float": T.DoubleType(), "date": T.TimestampType(), "boolean": T.BooleanType()}


def typed(df: DataFrame, categories: Mapping[str, str]) -> DataFrame:
    """Columns cast by category; text that does not fit becomes null."""
    return df.select(*[
        F.col(f"`{c}`").try_cast(SINK_TYPES[k]).alias(c) if (k := categories.get(c, "string")) in SINK_TYPES
        else F.col(f"`{c}`").cast("string").alias(c)
        for c in df.columns if c != "row_idx"
    ] + (["row_idx"] if "row_idx" in df.columns else []))


def add_to_table(
    existing: DataFrame | None, rows: DataFrame, categories: Mapping[str, str], primary_key: tuple[str, ...] = ()
) -> DataFrame:
    """Rows added to a table that grows by the columns it lacks.

    Without a primary key a new table gets a gap-free ``id`` in row order, which
    continues after the highest one when the table already has it. ``rows`` carries
    ``row_idx``.
    """
    fresh = typed(rows, categories)
    surrogate = not primary_key and (existing is None or "id" in existing.columns)
    if surrogate:
        base = F.lit(0) if existing is None else F.coalesce(existing.agg(F.max("id").alias("m")).scalar(), F.lit(0))
        fresh = number(fresh, [], "row_idx", "__rn").withColumn("id", (base + F.col("__rn")).cast("long")).drop("__rn")
    fresh = fresh.drop("row_idx")
    if existing is None:
        return fresh.select("id", *[c for c in fresh.columns if c != "id"]) if surrogate else fresh
    aligned = [
        F.col(f"`{c}`").cast(existing.schema[c].dataType).alias(c) if c in existing.columns else F.col(f"`{c}`") for c in fresh.columns
    ]
    return existing.unionByName(fresh.select(*aligned), allowMissingColumns=True)


#: One line per load of a stored table: its number, the last id, the rows added, and the table's columns after it.
_LOAD = "__load"
LOADS = "load int, last_id long, added long, columns string, surrogate boolean"


def _loads(spark: SparkSession, path: str):
    """The last committed load of a stored table, or None."""
    log = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/loads")
    if not log.getFileSystem(spark._jsc.hadoopConfiguration()).exists(log):
        return None
    line = F.struct("load", "last_id", "columns", "surrogate")
    return spark.read.schema(LOADS).parquet(f"{path}/loads").agg(F.max_by(line, "load").alias("line")).first()["line"]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table as of its last committed load; columns that came later are null in earlier rows."""
    last = _loads(spark, path)
    if last is None:
        raise ValueError(f"no table at {path}")
    columns = T.StructType.fromJson(json.loads(last["columns"]))
    rows = spark.read.schema(T.StructType([*columns, T.StructField(_LOAD, T.IntegerType())])).parquet(f"{path}/rows")
    return rows.where(F.col(_LOAD) <= last["load"]).drop(_LOAD)


def grow_table(spark: SparkSession, path: str, rows: DataFrame, categories: Mapping[str, str], primary_key: tuple[str, ...] = ()) -> DataFrame:
    """S12 as a stored table: ``rows`` (with ``row_idx``) are appended, and the table grows by the columns it lacks.

    Known columns keep their types. Without a primary key a new table has a gap-free ``id`` in row order. The last
    id and the columns stand in a log beside the rows, so a further load reads no stored row. A load is
    written to a folder of its own and counts once its line is in the log; one that broke off is written anew.
    """
    last = _loads(spark, path)
    known = T.StructType([]) if last is None else T.StructType.fromJson(json.loads(last["columns"]))
    surrogate = not primary_key if last is None else last["surrogate"]
    types = {f.name.lower(): f.dataType for f in known}
    fresh = typed(rows, categories)
    # A column is the same one whatever the case of its letters, and keeps its first spelling.
    spelled = {f.name.lower(): f.name for f in known}
    fresh = fresh.select(*[F.col(f"`{c}`").try_cast(types.get(c.lower(), fresh.schema[c].dataType)).alias(spelled.get(c.lower(), c)) for c in fresh.columns])
    base, load = (0, 1) if last is None else (last["last_id"], last["load"] + 1)
    if surrogate:
        if "id" in {c.lower() for c in rows.columns}:
            raise ValueError("rows bring an id of their own: name it as the primary key")
        fresh = number(fresh, [], "row_idx", "__rn").select((F.lit(base) + F.col("__rn")).cast("long").alias("id"), "*").drop("__rn")
    fresh = fresh.drop("row_idx")
    seen = Observation()
    fresh.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/rows/{_LOAD}={load}")
    columns = T.StructType([*known, *[T.StructField(f.name, f.dataType) for f in fresh.schema if f.name.lower() not in types]])
    line = [(load, base + seen.get["n"], seen.get["n"], json.dumps(columns.jsonValue()), surrogate)]
    spark.createDataFrame(line, LOADS).coalesce(1).write.mode("append").parquet(f"{path}/loads")
    return read_table(spark, path)


HISTORY = (
    "import_id string, file_name string, upload_date timestamp, total_records long, successful_records long, "
    "failed_records long, duplicate_records long, status string, error_message string, seq long"
)


def append_import(spark: SparkSession, path: str, import_id: str, file_name: str) -> None:
    """One PENDING line in the ledger."""
    row = spark.createDataFrame([(import_id, file_name)], "import_id string, file_name string")
    zero = F.lit(0).cast("long")
    row.select(
        "import_id", "file_name", F.current_timestamp().alias("upload_date"), zero.alias("total_records"), zero.alias("successful_records"),
        zero.alias("failed_records"), zero.alias("duplicate_records"), F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("error_message"), zero.alias("seq"),
    ).write.mode("append").parquet(path)


def close_import(spark: SparkSession, path: str, import_id: str, counters: DataFrame | None, error: str | None = None) -> None:
    """The import's last line in the ledger, with its counters, or FAILED with the reason."""
    lines = spark.read.schema(HISTORY).parquet(path).where(F.col("import_id") == F.lit(import_id))
    # One import's lines: the opening one gives name and date, the number of the next line follows the last.
    opened = lines.agg(F.min_by(F.struct("file_name", "upload_date"), F.coalesce("seq", F.lit(0))).alias("first"), F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    opened = opened.where("first IS NOT NULL").select(F.lit(import_id).alias("import_id"), "first.*", "last")
    names = ("total_records", "successful_records", "failed_records", "duplicate_records")
    if counters is None:
        counts = [F.lit(0).cast("long").alias(n) for n in names]
    else:
        seen = counters.select(*names).first()
        counts = [F.lit(seen[n] or 0).cast("long").alias(n) for n in names]
    opened.select(
        "import_id", "file_name", "upload_date", *counts, F.lit("COMPLETED" if error is None else "FAILED").alias("status"),
        F.lit(error).cast("string").alias("error_message"), (F.col("last") + 1).cast("long").alias("seq"),
    ).write.mode("append").parquet(path)
