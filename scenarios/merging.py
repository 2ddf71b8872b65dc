"""A and L: merged plans, and ledger queries, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import grid as G
from millrace.plans import ledger as L
from millrace.plans import merge as A
from millrace.plans.intake import auto_match, load, source_profiles, targets_of, upload
from millrace.session import scratch_path, stage
from millrace.target import Column, Table
from scenarios.base import positioned, query, table
from scenarios.catalogs import BY
from scenarios.grids import GRID_SQL
from scenarios.matching import ANSWERS_SQL, SCORED_SQL, final_plans, line_sources
from scenarios.validation import SHEET_SQL, sales, sales_sheet

MERGE_SQL = """
li AS (SELECT row_number() OVER () AS row_idx, * FROM lineitem),
matched AS (SELECT l_orderkey AS import_id, 'T' || (l_linenumber % 2) AS "table", 'Col_' || (l_partkey % 5) AS "column", 's' || (l_suppkey % 4) AS source, row_idx AS pos FROM li),
acts AS (SELECT o_orderkey AS import_id, 't' || (o_custkey % 2) AS "table", 'COL_' || (o_custkey % 5) AS "column",
  CASE o_orderstatus WHEN 'F' THEN 'Default' WHEN 'O' THEN 'import' ELSE 'custom_value' END AS action, 's' || (o_custkey % 3) AS source, o_orderpriority AS custom_value, o_orderkey AS pos FROM orders
  UNION ALL SELECT o_orderkey, 'T' || (o_custkey % 2), 'col_' || (o_custkey % 5), 'NULL', 's9', 'x', -1 FROM orders),
norm AS (SELECT import_id, lower("table") AS tk, lower("column") AS ck, arg_max(upper(action), pos) AS a0, arg_max(source, pos) AS s0, arg_max(custom_value, pos) AS v0, arg_max("column", pos) AS c0 FROM acts GROUP BY 1, 2, 3),
na AS (SELECT import_id, tk, ck, c0, CASE a0 WHEN 'DEFAULT' THEN 'DATABASE_DEFAULT' WHEN 'IMPORT' THEN 'EXCEL' ELSE a0 END AS action,
  CASE WHEN a0 = 'IMPORT' THEN s0 END AS source, CASE WHEN a0 = 'CUSTOM_VALUE' THEN v0 END AS custom_value FROM norm)"""


def merge_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = positioned(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])

    def named(prefix, key, n):
        return F.concat(F.lit(prefix), (F.col(key) % n).cast("string"))

    matched = li.select(
        F.col("l_orderkey").alias("import_id"), named("T", "l_linenumber", 2).alias("table"), named("Col_", "l_partkey", 5).alias("column"),
        named("s", "l_suppkey", 4).alias("source"), F.col("row_idx").alias("pos"),
    )
    orders = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    last = orders.select(
        F.col("o_orderkey").alias("import_id"), named("t", "o_custkey", 2).alias("table"), named("COL_", "o_custkey", 5).alias("column"),
        F.when(status == "F", F.lit("Default")).when(status == "O", F.lit("import")).otherwise(F.lit("custom_value")).alias("action"),
        named("s", "o_custkey", 3).alias("source"), F.col("o_orderpriority").alias("custom_value"), F.col("o_orderkey").alias("pos"),
    )
    first = orders.select(
        F.col("o_orderkey").alias("import_id"), named("T", "o_custkey", 2).alias("table"), named("col_", "o_custkey", 5).alias("column"),
        F.lit("NULL").alias("action"), F.lit("s9").alias("source"), F.lit("x").alias("custom_value"), F.lit(-1).cast("long").alias("pos"),
    )
    return matched, last.unionByName(first)


@query(
    "a01_duplicate_targets",
    f"""WITH {MERGE_SQL}
SELECT import_id, lower("table") AS table_key, lower("column") AS column_key, count(*) AS n, string_agg(source, ', ' ORDER BY pos) AS sources,
  'Multiple Excel columns (' || string_agg(source, ', ' ORDER BY pos) || ') map to target [' || lower("table") || '].[' || lower("column") || ']' AS message
FROM matched GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.duplicate_targets(merge_inputs(spark, sf_dir)[0], BY)


@query("a02_actions", f"""WITH {MERGE_SQL} SELECT import_id, tk AS table_key, ck AS column_key, action, source, custom_value FROM na""")
def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A6."""
    found = A.normalise_actions(merge_inputs(spark, sf_dir)[1], BY)
    return found.select("import_id", "table_key", "column_key", "action", "source", "custom_value")


@query(
    "a03_merged_sources",
    f"""WITH {MERGE_SQL},
free AS (SELECT import_id, lower("table") AS tk, lower("column") AS ck, source, pos FROM matched m WHERE NOT EXISTS
  (SELECT 1 FROM na WHERE na.import_id = m.import_id AND tk = lower(m."table") AND (ck = lower(m."column") OR action = 'EXCEL' AND na.source = m.source))),
per_source AS (SELECT import_id, tk, source, arg_max(ck, pos) AS ck, min(pos) AS pos FROM free GROUP BY 1, 2, 3),
per_target AS (SELECT import_id, tk, ck, arg_max(source, pos) AS source FROM per_source GROUP BY 1, 2, 3)
SELECT import_id, tk AS table_key, ck AS column_key, source FROM na WHERE action = 'EXCEL' UNION ALL SELECT * FROM per_target""",
)
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched, acts = merge_inputs(spark, sf_dir)
    return A.merge(matched, A.normalise_actions(acts, BY), BY).select("import_id", "table_key", "column_key", "source")


@query(
    "a04_unmapped_sources",
    f"""WITH {SCORED_SQL}, {ANSWERS_SQL}
SELECT DISTINCT import_id, source FROM cand c WHERE NOT EXISTS (SELECT 1 FROM one WHERE action = 'IMPORT' AND one.import_id = c.import_id AND one.source = c.source)""",
)
def unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5."""
    matches = A.matches_of(final_plans(spark, sf_dir), BY)
    return A.unmapped_sources(line_sources(spark, sf_dir).select("import_id", "source"), matches, BY)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as uploads."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("import_id"), F.concat(F.lit("file_"), F.col("o_custkey").cast("string"), F.lit(".csv")).alias("file_name"),
        F.col("o_orderdate").alias("upload_date"), F.col("o_orderstatus").alias("status"),
    )


@query("l01_history", """SELECT o_orderkey AS import_id, 'file_' || o_custkey || '.csv' AS file_name, o_orderdate AS upload_date, o_orderstatus AS status FROM orders""")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.history(history(spark, sf_dir))


LOG_SQL = """
log AS (SELECT o_orderkey AS import_id, 'file_' || o_custkey || '.csv' AS file_name, o_orderdate AS upload_date, o_custkey AS n, CASE
  WHEN o_orderkey % 15 = 5 THEN 'COMPLETED' WHEN o_orderkey % 5 = 0 THEN 'FAILED' WHEN o_orderkey % 3 = 0 THEN 'PENDING' ELSE 'COMPLETED' END AS status FROM orders),
line AS (SELECT import_id, file_name, upload_date, status, CASE WHEN status = 'COMPLETED' THEN n ELSE 0 END AS total_records, CASE WHEN status = 'FAILED' THEN 'no rows' END AS error_message FROM log)"""


def ledger_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger as it is written: every import opened, some closed, some failed and closed again by a further attempt; the last lines first."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    failed, again = k % 5 == 0, k % 15 == 5

    def lines(rows: DataFrame, seq: int, status: str) -> DataFrame:
        total = F.col("o_custkey") if status == "COMPLETED" else F.lit(0)
        return rows.select(k.alias("import_id"), F.concat(F.lit("file_"), F.col("o_custkey").cast("string"), F.lit(".csv")).alias("file_name"),
                           F.col("o_orderdate").alias("upload_date"), F.lit(status).alias("status"), total.cast("long").alias("total_records"),
                           F.lit("no rows" if status == "FAILED" else None).cast("string").alias("error_message"), F.lit(seq).cast("long").alias("seq"))

    parts = lines(orders.where(again), 2, "COMPLETED").unionByName(lines(orders.where(failed), 1, "FAILED"))
    return parts.unionByName(lines(orders.where(~failed & (k % 3 != 0)), 1, "COMPLETED")).unionByName(lines(orders, 0, "PENDING"))


@query("l01_current_lines", f"""WITH {LOG_SQL} SELECT * FROM line""")
def current_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: opened, closed and failed imports, one row each."""
    return L.history(ledger_log(spark, sf_dir)).drop("seq")


@query("l02_find_closed", f"""WITH {LOG_SQL} SELECT * FROM line WHERE import_id = (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 15 = 5)""")
def find_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: an import that failed first and was closed by a further attempt."""
    newest = table(spark, sf_dir, "orders").where("o_orderkey % 15 = 5").agg(F.max("o_orderkey")).first()[0]
    return L.find_import(ledger_log(spark, sf_dir), newest).drop("seq")


@query("l02_find_import", """SELECT o_orderkey AS import_id, 'file_' || o_custkey || '.csv' AS file_name, o_orderdate AS upload_date, o_orderstatus AS status
FROM orders WHERE o_orderkey = (SELECT max(l_orderkey) FROM lineitem)""")
def find(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0]
    return L.find_import(history(spark, sf_dir), newest)


@query(
    "l03_errors",
    f"""WITH {SHEET_SQL}
SELECT 'sales' AS import_id, row_idx AS row_index, 'Sheet 1' AS sheet_name, l_orderkey AS raw_order,
 CASE WHEN conflict THEN 'Row rejected due to duplicate primary key conflict: ''' || k1 || ', ' || k2 || ''''
  ELSE concat_ws('; ', CASE WHEN no_flag THEN 'Required column ''Return_Flag'' is empty in row ' || row_idx END,
    CASE WHEN orphan THEN 'Foreign key violation: Column ''Order_Key'' value ''' || k1 || ''' does not exist in parent table ''Orders.Order_Key''' END) END AS errors
FROM li_flag WHERE conflict OR no_flag OR orphan
UNION ALL SELECT 'sales', row_idx, 'Sheet 1', l_orderkey, 'Foreign key violation: Column ''Cust_Key'' value ''' || o_custkey || ''' does not exist in parent table ''Customer.Cust_Key''' FROM sheet WHERE c_name IS NULL
UNION ALL SELECT 'sales', row_idx, 'Sheet 1', l_orderkey, 'Required column ''Cust_Name'' is empty in row ' || row_idx FROM sheet WHERE c_name IS NULL""",
)
def ledger_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = stage(sales_sheet(spark, sf_dir), "sheet")  # the validation and the records read the one sheet
    result = sales(spark, sf_dir, sheet)
    found = L.errors(L.staging_records(sheet, result, "sales", "Sheet 1"), "sales")
    return found.select("import_id", "row_index", "sheet_name", F.get_json_object("raw_data", "$.l_orderkey").alias("raw_order"), "errors")


@query(
    "l04_counters",
    f"""WITH {SHEET_SQL}, ok AS (SELECT count(DISTINCT sig) AS n, count(*) AS m FROM li_flag WHERE NOT (conflict OR no_flag OR orphan))
SELECT 'sales' AS import_id, 3 * (SELECT count(*) FROM sheet) AS total_records,
 (SELECT count(*) FROM cust_ok) + (SELECT count(*) FROM ord_ok) + n AS successful_records,
 2 * (SELECT count(*) FROM sheet WHERE c_name IS NULL) + (SELECT count(*) FROM sheet) - m AS failed_records,
 2 * (SELECT count(*) FROM sheet WHERE c_name IS NOT NULL) - (SELECT count(*) FROM cust_ok) - (SELECT count(*) FROM ord_ok) + m - n AS duplicate_records FROM ok""",
)
def ledger_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.counters(sales(spark, sf_dir), "sales")


@query(
    "l05_preview",
    f"""WITH {GRID_SQL}, r AS (SELECT sheet, table_name, row_idx, count(v) AS f FROM cells GROUP BY 1, 2, 3),
seen AS (SELECT sheet, count(*) - 1 AS sheet_rows, 4 AS sheet_columns FROM grid GROUP BY 1)
SELECT r.sheet, table_name, count(*) AS row_count, (SELECT count(*) FROM cols c WHERE c.sheet = r.sheet AND c.table_name = r.table_name) AS column_count,
  any_value(sheet_rows) AS sheet_rows, any_value(sheet_columns) AS sheet_columns, least(count(*), 20) AS samples
FROM r JOIN seen USING (sheet) WHERE f > 0 GROUP BY 1, 2""",
)
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.operators import grid as G
    from scenarios.grids import event_sheets

    grid = stage(event_sheets(spark, sf_dir), "grid")
    found = L.preview(grid, G.structure(grid))
    return found.select("sheet", "table_name", "row_count", "column_count", "sheet_rows", "sheet_columns", F.size("sample").alias("samples"))


FLOW = Table("Customer", (
    Column("Cust_Key", "int", False), Column("Cust_Name", "varchar(40)", False), Column("Acct_Bal", "decimal(12,2)"), Column("Mkt_Segment", "varchar(20)"),
    Column("Branch", "int", False), Column("Remark", "varchar(80)")), ("Cust_Key",))


@query(
    "s13_import_flow",
    """SELECT 'i1' AS import_id, 'customers.csv' AS file_name, 'COMPLETED' AS status, count(*) AS total_records, count(*) FILTER (c_custkey % 13 <> 0) AS successful_records,
  count(*) FILTER (c_custkey % 13 = 0) AS failed_records, 0::BIGINT AS duplicate_records, count(*) FILTER (c_custkey % 13 <> 0) AS script_rows, 'nation' AS unused FROM customer""",
)
def import_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer sheet from grid to script: upload, match, actions, load, and the ledger's last line."""
    cust = positioned(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey"])
    name = F.when(F.col("c_custkey") % 13 != 0, F.col("c_name"))
    body = cust.select(F.col("row_idx"), F.array(F.col("c_custkey").cast("string"), name, F.col("c_acctbal").cast("string"), "c_mktsegment", F.col("c_nationkey").cast("string")).alias("cells"))
    head = spark.range(1).select(F.lit(0).cast("long").alias("row_idx"), F.array(*map(F.lit, ("Cust Key", "Cust Name", "Acct Bal", "Mkt Segment", "Nation"))).alias("cells"))
    sheet = head.unionByName(body).select(F.lit("customers.csv").alias("source"), F.lit("Customers").alias("sheet"), "row_idx", "cells")
    cache, book = scratch_path(spark, "cache"), scratch_path(spark, "ledger")
    found = upload(spark, stage(sheet, "sheet"), "i1", "customers.csv", cache, book)
    staged = stage(G.wide(found.rows, found.columns, ("customers.csv", "Customers"), "customers"), "staged")

    heads = source_profiles(found).drop(*G.SHEET, "table_name", "header").withColumnRenamed("source_key", "source").withColumn("import_id", F.lit("i1"))
    declared = spark.createDataFrame(
        [("i1", FLOW.name, i, c.name, c.sql_type, c.nullable, c.identity, c.default, 40 if "varchar" in c.sql_type else None) for i, c in enumerate(FLOW.columns)],
        "import_id string, table string, target_pos int, name string, sql_type string, nullable boolean, is_identity boolean, has_default boolean, length int")
    keys = spark.createDataFrame([("i1", FLOW.name, 1, "Cust_Key")], "import_id string, table string, pk_pos int, column string")
    none = spark.createDataFrame([], "import_id string, child_table string, child_column string, parent_table string, parent_column string, fk_pos int")
    matching = auto_match(targets_of(declared, keys, none, ["import_id"]), heads, ["import_id"])
    given = spark.createDataFrame([(FLOW.name, "branch", "CUSTOM_VALUE", None, "-3", 0)], "table string, column string, action string, source string, custom_value string, pos long")
    done = load(staged, [FLOW], matching.plans, heads.select("source"), book, "i1", given, candidates=matching.candidates)
    shown = done.script.agg(F.sum(F.size(F.split("text", r"\n    -3,\n")) - 1).alias("script_rows"),
                            F.max(F.regexp_extract("text", r"^-- Excel Column: (.*)$", 1)).alias("unused"))
    line = L.find_import(spark.read.parquet(book), "i1")
    return line.join(shown).select("import_id", "file_name", "status", "total_records", "successful_records", "failed_records", "duplicate_records", F.col("script_rows").cast("long").alias("script_rows"), "unused")
