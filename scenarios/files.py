"""S: files written from the tables, then read as messy grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import grid as G
from millrace.operators import render as R
from millrace.operators.validate import validate
from millrace.session import scratch_path, stage
from millrace.sources import grids as S
from millrace.sources import store
from scenarios.base import positioned, query, table
from scenarios.grids import GRID_SQL, event_sheets
from scenarios.rendering import ORDER_FILL, ORDER_LOAD, order_sheet


def messy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines per customer: a regular one, so that any file starts with five fields, and a messy one."""
    k = F.col("c_custkey")
    key, name, seg = k.cast("string"), F.col("c_name"), F.col("c_mktsegment")
    regular = F.concat_ws(",", key, name, F.col("c_nationkey").cast("string"), F.col("c_acctbal").cast("string"), seg)
    messy = (
        F.when(k % 10 == 0, F.concat(regular, F.lit(",extra")))
        .when(k % 10 == 1, F.concat_ws(",", key, name))
        .when(k % 10 == 2, F.lit(""))
        .when(k % 10 == 3, F.concat(F.lit('"'), seg, F.lit(', ""quoted"""'), F.lit(","), key))
        .when(k % 10 == 4, F.lit(",,,,"))
        .when(k % 10 == 5, F.concat(F.lit("NA,"), name, F.lit(",null,,")))
        .when(k % 10 == 6, F.concat(key, F.lit(',size 5",wide 6",'), seg))
        .when(k % 10 == 7, F.concat(F.lit('"'), seg, F.lit('\n\n""two"", lines",'), key))
        .otherwise(F.concat(regular, F.lit(",")))
    )
    return table(spark, sf_dir, "customer").select(F.concat(regular, F.lit("\n"), messy).alias("value"))


@query(
    "s01_csv_grid",
    """SELECT 'Data' AS sheet, concat_ws('|', c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) AS text FROM customer
UNION ALL SELECT 'Data', CASE c_custkey % 10 WHEN 1 THEN c_custkey || '|' || c_name || '|~|~|~' WHEN 3 THEN c_mktsegment || ', "quoted"|' || c_custkey || '|~|~|~'
  WHEN 4 THEN '~|~|~|~|~' WHEN 5 THEN '~|' || c_name || '|~|~|~' WHEN 6 THEN c_custkey || '|size 5"|wide 6"|' || c_mktsegment || '|~'
  WHEN 7 THEN c_mktsegment || chr(10) || chr(10) || '"two", lines|' || c_custkey || '|~|~|~' END FROM customer WHERE c_custkey % 10 IN (1, 3, 4, 5, 6, 7)""",
)
def csv_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over-wide records dropped, short ones padded, blank ones gone; inch marks and quoted line breaks kept."""
    path = scratch_path(spark, "csv")
    messy_lines(spark, sf_dir).write.text(path)
    return S.csv_grid(spark, path).select("sheet", F.array_join("cells", "|", "~").alias("text"))


@query(
    "s02_json_records",
    """SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id, event_type, props, ((event_id + 1) * 1000003)::VARCHAR || '12345678.5' AS long_number FROM events""",
)
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as the file spells them; a number of many digits stays as it is."""
    path = scratch_path(spark, "json")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    number = F.concat(((F.col("event_id") + 1) * 1000003).cast("string"), F.lit("12345678.5"))
    body = F.regexp_replace(F.to_json(F.struct("*")), r"\}$", "")
    events.select(F.concat(body, F.lit(',"long_number":'), number, F.lit("}")).alias("value")).write.text(path)
    return S.json_records(spark, path, lines=True).select("event_id", "user_id", "event_type", "props", "long_number")


def spell(spark: SparkSession, lines: DataFrame, folder: str, name: str) -> None:
    """Write a few lines as one file of the given name, through Spark's own file system."""
    made = scratch_path(spark, "one")
    lines.coalesce(1).write.text(made)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(made)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))
    fs.rename(part, hadoop.Path(f"{folder}/{name}"))


@query(
    "s04_mixed_folder",
    """SELECT sheet, count(*) AS n FROM (SELECT 'Data' AS sheet FROM customer UNION ALL SELECT 'Data' FROM customer WHERE c_custkey % 10 IN (1, 3, 4, 5, 6, 7)
 UNION ALL SELECT 'JSON Data' FROM supplier UNION ALL SELECT 'JSON Data' FROM nation UNION ALL SELECT 'CSV Data' FROM region) GROUP BY 1""",
)
def mixed_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and JSON files of one folder, each by its extension in any case; header rows of JSON grids aside."""
    path = scratch_path(spark, "mixed")
    messy_lines(spark, sf_dir).write.text(path)
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").write.mode("append").json(path)
    spell(spark, table(spark, sf_dir, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value")), path, "NATION.Json")
    spell(spark, table(spark, sf_dir, "region").select(F.concat_ws(",", "r_regionkey", "r_name").alias("value")), path, "REGION.CSV")
    grid = S.read_grids(spark, path, json_lines=True)
    is_head = (F.col("sheet") == "JSON Data") & (F.col("row_idx") == 0)
    return grid.where(~is_head).groupBy("sheet").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s03_cell_grid",
    f"""WITH {GRID_SQL}, last AS (SELECT sheet, max(row_idx) AS r, max(CASE WHEN c3 IS NOT NULL THEN 4 ELSE 3 END) AS w FROM grid WHERE NOT e GROUP BY 1)
SELECT sheet, row_idx, coalesce(c0, '~') || '|' || coalesce(c1, '~') || '|' || coalesce(c2, '~') || CASE WHEN w = 4 THEN '|' || coalesce(c3, '~') ELSE '' END AS text
FROM grid JOIN last USING (sheet) WHERE row_idx <= r""",
)
def cell_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the sheets as a cell table and back; blank rows between cells reappear."""
    sheets = event_sheets(spark, sf_dir)
    cells = sheets.select("source", "sheet", "row_idx", F.posexplode("cells").alias("col_pos", "value")).where(F.col("value").isNotNull())
    return S.with_blank_rows(S.cell_grid(cells)).select("sheet", "row_idx", F.array_join("cells", "|", "~").alias("text"))


@query(
    "s03_sparse_cells",
    f"""WITH {GRID_SQL}, far AS (SELECT sheet, row_idx + row_idx // 5 * 100000000 AS r FROM grid WHERE NOT e),
far_runs AS (SELECT *, r - row_number() OVER (PARTITION BY sheet ORDER BY r) AS g FROM far),
found AS (SELECT sheet, min(r) AS block_start, count(*) AS n_rows FROM far_runs GROUP BY sheet, g HAVING count(*) >= 2
  UNION ALL SELECT sheet, 0, max(r) + 1 FROM far_runs GROUP BY sheet HAVING sheet NOT IN (SELECT sheet FROM far_runs GROUP BY sheet, g HAVING count(*) >= 2))
SELECT sheet, block_start, n_rows, replace(lower(sheet), ' ', '_') || CASE WHEN count(*) OVER (PARTITION BY sheet) > 1
  THEN '_' || row_number() OVER (PARTITION BY sheet ORDER BY block_start) ELSE '' END AS table_name FROM found""",
)
def sparse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of rows a hundred million positions apart; the gaps between them stay implied."""
    row = F.col("row_idx") + F.floor(F.col("row_idx") / 5) * 100_000_000
    sheets = event_sheets(spark, sf_dir).select("source", "sheet", row.alias("row_idx"), F.posexplode("cells").alias("col_pos", "value"))
    found = G.blocks(G.segment(S.cell_grid(sheets.where(F.col("value").isNotNull()))))
    return found.select("sheet", "block_start", "n_rows", "table_name")


@query("s05_inspection", f"""WITH {GRID_SQL} SELECT sheet, count(*) - 1 AS "rows", 4 AS "columns", count(*) = 1 AS is_empty FROM grid GROUP BY 1""")
def inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.inspect(event_sheets(spark, sf_dir)).drop("source")


@query("s05_file_inspection")
def file_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 with file names and sizes of the files just written."""
    path = scratch_path(spark, "csv")
    messy_lines(spark, sf_dir).write.text(path)
    return S.inspect_files(spark, path, S.inspect(S.csv_grid(spark, path)))


@query("s07_cached_table", """SELECT o_orderkey, o_totalprice, o_orderpriority AS import_id, o_orderstatus AS table_name FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'""")
def cached_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached by import and table; one partition read back."""
    path = scratch_path(spark, "cache")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("import_id"), F.col("o_orderstatus").alias("table_name"))
    store.write_cache(rows, path)
    return store.read_cache(spark, path, "1-URGENT", "F")


@query(
    "s08_iso_text",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events""",
)
def iso_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps as ISO text, NaN as null."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return store.nan_to_null(store.iso_timestamps(ev))


@query(
    "s11_script_lines",
    """SELECT count(*) * 10 + 13 * ceil(count(*) / 1000.0)::BIGINT + 25 AS n_lines, count(*) FILTER (o_orderkey % 4 = 0) AS n_null FROM orders""",
)
def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script of all orders, written and counted back."""
    result = validate(stage(order_sheet(spark, sf_dir), "orders"), [ORDER_LOAD], ORDER_FILL)
    path = scratch_path(spark, "script")
    store.write_script(R.script(result, ORDER_FILL), path)
    back = spark.read.text(path)
    return back.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.trim("value").isin("NULL", "NULL,")).alias("n_null"))


@query(
    "s12_growing_table",
    """WITH li AS (SELECT row_number() OVER () AS row_idx, * FROM customer)
SELECT row_idx AS id, c_custkey::BIGINT AS key, c_acctbal AS bal, CAST(NULL AS VARCHAR) AS seg FROM li
UNION ALL SELECT row_idx + (SELECT count(*) FROM customer), c_custkey, NULL, c_mktsegment FROM li""",
)
def growing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table created with a surrogate id, then grown by rows with one more column."""
    cust = positioned(spark, sf_dir, "customer").select(
        "row_idx", F.col("c_custkey").cast("string").alias("key"), F.col("c_acctbal").cast("string").alias("bal"), F.col("c_mktsegment").alias("seg")
    )
    first = stage(store.add_to_table(None, cust.drop("seg"), {"key": "integer", "bal": "float"}), "table")
    return store.add_to_table(first, cust.drop("bal"), {"key": "integer"})


@query(
    "s12_stored_table",
    """WITH c AS (SELECT row_number() OVER () AS i, count(*) OVER () AS n, * FROM customer)
SELECT i AS id, c_custkey::BIGINT AS key, c_acctbal AS bal, CAST(NULL AS VARCHAR) AS seg, CAST(NULL AS BOOLEAN) AS good FROM c
UNION ALL SELECT i + n, c_custkey, NULL, c_mktsegment, NULL FROM c UNION ALL SELECT i + 2 * n, NULL, NULL, NULL, c_acctbal > 0 FROM c""",
)
def stored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three loads of a stored table, each with another column; ids go on, and a known column keeps its type."""
    cust = positioned(spark, sf_dir, "customer")
    text = {"key": F.col("c_custkey").cast("string"), "bal": F.col("c_acctbal").cast("string"), "seg": F.col("c_mktsegment"),
            "KEY": F.concat(F.lit("no "), F.col("c_name")), "good": F.when(F.col("c_acctbal") > 0, "true").otherwise("false")}
    pick = lambda *names: cust.select("row_idx", *[text[n].alias(n) for n in names])
    path = scratch_path(spark, "grown")
    store.grow_table(spark, path, pick("key", "bal"), {"key": "integer", "bal": "float"})
    store.grow_table(spark, path, pick("key", "seg"), {"key": "integer"})
    return store.grow_table(spark, path, pick("KEY", "good"), {"KEY": "string", "good": "boolean"})


@query(
    "g15_physical_types",
    """SELECT * FROM (VALUES ('o_orderkey', 'integer'), ('o_custkey', 'integer'), ('o_orderstatus', 'string'), ('o_totalprice', 'float'), ('o_orderdate', 'date'), ('o_orderpriority', 'string'))
 v("column", physical_type), (SELECT count(*) AS n_rows FROM orders)""",
)
def physical_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types read back from all-text columns."""
    from millrace.operators.profile import unpivot

    orders = positioned(spark, sf_dir, "orders")
    cols = [c for c in orders.columns if c != "row_idx"]
    kinds = G.physical_types(unpivot(orders, cols), ["column"])
    return kinds.withColumn("n_rows", orders.agg(F.count(F.lit(1))).scalar())
