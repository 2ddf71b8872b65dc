"""O and T: literals, batches and scripts over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.literals import boolean_literal, date_literal, float_literal, identifier, integer_literal, literal, text_literal
from millrace.operators import render as R
from millrace.operators.prefix import number, number_by_order
from millrace.operators.validate import validate
from millrace.session import stage, staging
from millrace.target import Action, Column, Table, fill
from scenarios.base import positioned, query, table
from scenarios.validation import SHEET_SQL, sales, sales_fill

ORDER_LOAD = Table(
    "Order_Load",
    (
        Column("Load_Id", "int", False, True), Column("Order_Key", "bigint", False), Column("Customer", "varchar(40)", False),
        Column("Placed", "datetime"), Column("Total", "decimal(12,2)"), Column("Urgent", "bit"),
        Column("Loaded_At", "datetime", False, False, True), Column("Note", "varchar(20)"), Column("Batch", "varchar(10)"),
    ),
    ("Order_Key",),
)
ORDER_FILL = fill(
    {"Order_Load": {"o_orderkey": "Order_Key", "label": "Customer", "placed": "Placed", "o_totalprice": "Total", "urgent": "Urgent", "note": "Note"}},
    {("Order_Load", "Batch"): Action("CUSTOM_VALUE", value="B'1")},
)


def order_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = positioned(spark, sf_dir, "orders")
    return o.select(
        "row_idx", F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.concat(F.lit("O'Brien "), F.col("o_custkey").cast("string")).alias("label"),
        F.date_format(F.expr("o_orderdate + make_interval(0, 0, 0, 0, o_orderkey % 3)"), "yyyy-MM-dd HH:mm:ss").alias("placed"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Yes")).otherwise(F.lit("no")).alias("urgent"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(" ")).otherwise(F.col("o_orderstatus")).alias("note"),
    )


TUPLE_SQL = """
o AS (SELECT row_number() OVER () AS rn, * FROM orders),
t AS (SELECT rn, (rn - 1) // 1000 AS batch, '(' || chr(10) || concat_ws(',' || chr(10), '    ' || o_orderkey, '    ''O''''Brien ' || o_custkey || '''',
  '    ''' || CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate + to_hours(CAST(o_orderkey % 3 AS INT)), '%Y-%m-%d %H:%M:%S') END || '''',
  '    ' || o_totalprice, '    ' || CASE WHEN o_orderpriority = '1-URGENT' THEN '1' ELSE '0' END, '    DEFAULT',
  '    ' || CASE WHEN o_orderkey % 4 = 0 THEN 'NULL' ELSE '''' || o_orderstatus || '''' END, '    ''B''''1''') || chr(10) || ')' AS tuple FROM o)"""


@query("o10_batches", f"""WITH {TUPLE_SQL} SELECT batch, count(*) AS n_rows, min(rn) AS first_row FROM t GROUP BY 1""")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O10 on T2 numbering: gap-free chunks of 1000."""
    o = number(positioned(spark, sf_dir, "orders", ["o_orderkey"]), [], "row_idx", "rn")
    return o.groupBy(F.floor((F.col("rn") - 1) / 1000).alias("batch")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("rn").alias("first_row"))


@query(
    "o11_insert_text",
    f"""WITH {TUPLE_SQL}
SELECT batch, count(*) AS n_rows, 'INSERT INTO [dbo].[Order_Load]' || chr(10) || '(' || chr(10) ||
 '    [Order_Key],' || chr(10) || '    [Customer],' || chr(10) || '    [Placed],' || chr(10) || '    [Total],' || chr(10) || '    [Urgent],' || chr(10) ||
 '    [Loaded_At],' || chr(10) || '    [Note],' || chr(10) || '    [Batch]' || chr(10) || ')' || chr(10) || 'VALUES' || chr(10) ||
 string_agg(tuple, ',' || chr(10) ORDER BY rn) || ';' AS text FROM t GROUP BY 1""",
)
def insert_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted orders as multi-row statements."""
    result = validate(stage(order_sheet(spark, sf_dir), "orders"), [ORDER_LOAD], ORDER_FILL)
    return R.statements(result.checks["order_load"].valid, ORDER_LOAD, ORDER_FILL)


@query("o12_script")
def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole sales script with its report. What the steps staged goes when its lines are written."""
    with staging(spark) as kept:
        lines = kept(R.script(sales(spark, sf_dir), sales_fill(), include_report=True, unmapped=["l_tax"]))
    return R.ordered(lines)


@query(
    "o13_fill_rules",
    """SELECT * FROM (VALUES ('Order_Load', 1, 'Load_Id', 'DATABASE_GENERATED', NULL), ('Order_Load', 2, 'Order_Key', 'EXCEL', 'o_orderkey'),
 ('Order_Load', 3, 'Customer', 'EXCEL', 'label'), ('Order_Load', 4, 'Placed', 'EXCEL', 'placed'), ('Order_Load', 5, 'Total', 'EXCEL', 'o_totalprice'),
 ('Order_Load', 6, 'Urgent', 'EXCEL', 'urgent'), ('Order_Load', 7, 'Loaded_At', 'DEFAULT', NULL), ('Order_Load', 8, 'Note', 'EXCEL', 'note'),
 ('Order_Load', 9, 'Batch', 'CUSTOM_VALUE', 'B''1')) v("table", col_pos, "column", rule, source), (SELECT count(*) AS valid_rows FROM orders)""",
)
def fill_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = validate(stage(order_sheet(spark, sf_dir), "orders"), [ORDER_LOAD], ORDER_FILL).checks["order_load"].valid
    rules = R.manifest(spark, ORDER_LOAD, ORDER_FILL, R.inserted_columns(valid, ORDER_LOAD, ORDER_FILL))
    return rules.withColumn("valid_rows", valid.agg(F.count(F.lit(1))).scalar())


@query(
    "o14_rejection_report",
    f"""WITH {SHEET_SQL}
SELECT 'Shipment' AS "table", 'INVALID TABLE' AS kind, CAST(NULL AS BIGINT) AS row_index, 'Table [Shipment] cannot be generated: Missing required columns (Carrier) with no default in Excel data.' AS reason
UNION ALL SELECT 'Lineitem', 'PRIMARY KEY CONFLICT', row_idx, 'Duplicate primary-key value ''' || k1 || ', ' || k2 || ''' with conflicting data (rows ' || first_row || ' and ' || row_idx || ')'
  FROM li_flag WHERE conflict AND row_idx > first_row AND sig IS DISTINCT FROM first_sig
UNION ALL SELECT 'Lineitem', 'FOREIGN KEY ERROR', row_idx, 'Foreign key violation: Column ''Order_Key'' value ''' || k1 || ''' does not exist in parent table ''Orders.Order_Key''' FROM li_flag WHERE orphan AND NOT conflict
UNION ALL SELECT 'Orders', 'FOREIGN KEY ERROR', row_idx, 'Foreign key violation: Column ''Cust_Key'' value ''' || o_custkey || ''' does not exist in parent table ''Customer.Cust_Key''' FROM sheet WHERE c_name IS NULL
UNION ALL SELECT 'Lineitem', 'NOT NULL ERROR', row_idx, 'Required column ''Return_Flag'' is empty in row ' || row_idx FROM li_flag WHERE no_flag AND NOT conflict
UNION ALL SELECT 'Customer', 'NOT NULL ERROR', row_idx, 'Required column ''Cust_Name'' is empty in row ' || row_idx FROM sheet WHERE c_name IS NULL""",
)
def rejection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rejection_report(sales(spark, sf_dir))


@query(
    "o04_number_literals",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 6
  WHEN 0 THEN CAST(l_quantity AS BIGINT)::VARCHAR WHEN 1 THEN '-' || trunc(l_extendedprice)::BIGINT WHEN 2 THEN '9007199254740993' WHEN 3 THEN (l_linenumber * 1000)::VARCHAR
  WHEN 4 THEN 'null' ELSE NULL END AS int_text,
  CASE l_partkey % 6 WHEN 0 THEN l_quantity::VARCHAR WHEN 1 THEN '-' || l_extendedprice WHEN 2 THEN '9007199254740993' WHEN 3 THEN l_linenumber || 'e3' ELSE NULL END AS float_text
FROM lineitem""",
)
def number_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O4, O5; text that is no number has no number literal."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit(" "), F.col("l_quantity").cast("string")))
        .when(k == 1, F.concat(F.lit("-"), F.col("l_extendedprice").cast("string")))
        .when(k == 2, F.lit("9007199254740993"))
        .when(k == 3, F.concat(F.col("l_linenumber").cast("string"), F.lit("e3")))
        .when(k == 4, F.lit("12d"))
        .otherwise(F.col("l_returnflag"))
    )
    shown = F.when(k == 4, F.lit("null")).otherwise(integer_literal(F.col("raw")))
    return li.withColumn("raw", raw).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(k == 4, F.coalesce(integer_literal(F.col("raw")), shown)).otherwise(shown).alias("int_text"),
        float_literal(F.col("raw")).alias("float_text"),
    )


@query(
    "o08_text_literals",
    """SELECT doc_id, '''' || replace(text, '''', '''''') || '''' AS text_literal, '[' || replace(source, ']', ']]') || ']' AS tsql, '`' || source || '`' AS mysql, '"' || source || '"' AS postgres,
  CASE WHEN doc_id % 5 = 0 THEN 'NULL' ELSE '''' || lang || '''' END AS lang FROM documents""",
)
def text_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O8, O9 over whole document texts."""
    docs = table(spark, sf_dir, "documents")
    src = F.col("source")
    return docs.select(
        "doc_id", text_literal(F.col("text")).alias("text_literal"), identifier(src).alias("tsql"), identifier(src, "mysql").alias("mysql"),
        identifier(src, "postgres").alias("postgres"), literal(F.when(F.col("doc_id") % 5 != 0, F.col("lang")), "string").alias("lang"),
    )


@query(
    "o07_date_literals",
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN strftime(ts, '''%Y-%m-%d''') WHEN 2 THEN strftime(ts, '''%Y-%m-%d''') ELSE strftime(ts, '''%Y-%m-%d %H:%M:%S''') END AS date_text,
  CASE WHEN event_type IN ('click', 'view') THEN '1' ELSE '0' END AS flag_text FROM events""",
)
def date_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O6, O7."""
    ev = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    raw = (
        F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 2, F.date_format("ts", "yyyyMMdd")).otherwise(F.date_format("ts", "M/d/yyyy"))
    )
    flag = F.when(F.col("event_type") == "click", F.lit(" YES ")).when(F.col("event_type") == "view", F.lit("1")).otherwise(F.col("event_type"))
    return ev.select("event_id", date_literal(raw).alias("date_text"), boolean_literal(flag).alias("flag_text"))


@query(
    "o07_date_layouts",
    """WITH m AS (SELECT event_id, event_id % 8 AS k, ts, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS s, strftime(ts, '%H:%M') || ':00' AS m FROM events),
c AS (SELECT event_id, CASE WHEN k = 5 AND day(ts) <= 12 THEN strftime(ts, '%Y-%d-%m') ELSE d END AS d, CASE WHEN k IN (0, 3) THEN m WHEN k IN (1, 4, 7) THEN s ELSE '00:00:00' END AS clock FROM m)
SELECT event_id, '''' || d || CASE WHEN clock = '00:00:00' THEN '' ELSE ' ' || clock END || '''' AS date_text FROM c""",
)
def date_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes alone, an offset, month and day names, halves of the day, day or month first, dots."""
    layouts = ("yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "d MMMM yyyy", "MMM d, yyyy h:mm a", "EEEE, d MMM yyyy HH:mm:ss", "dd-MM-yyyy", "yyyy.MM.dd", "MM/dd/yyyy hh:mm:ss a")
    raw = F
    for k, layout in enumerate(layouts):
        raw = raw.when(F.col("event_id") % 8 == k, F.date_format("ts", layout))
    return table(spark, sf_dir, "events").select("event_id", date_literal(raw).alias("date_text"))


@query("t01_positions", """SELECT row_number() OVER () AS row_idx, l_orderkey, l_linenumber, l_partkey FROM lineitem""")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioned(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "t02_gap_free_numbers",
    """WITH li AS (SELECT row_number() OVER () AS row_idx, * FROM lineitem)
SELECT row_idx, row_number() OVER (PARTITION BY l_returnflag ORDER BY row_idx) AS rn, sum(l_linenumber) OVER (PARTITION BY l_returnflag ORDER BY row_idx)::BIGINT AS running FROM li""",
)
def gap_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 by bucketed prefix sums: three groups hold all rows, none meets in one task."""
    from millrace.operators.prefix import Running, running

    li = positioned(spark, sf_dir, "lineitem", ["l_returnflag", "l_linenumber"])
    specs = [Running("rn", "sum", F.lit(1).cast("long")), Running("running", "sum", F.col("l_linenumber").cast("long"))]
    return running(li, ["l_returnflag"], "row_idx", specs).select("row_idx", "rn", "running")


@query("t02_numbers_by_order", """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders""")
def by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 by one range-partitioned sort, for any order."""
    return number_by_order(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], "rn").select("o_orderkey", "rn")
