"""V: a denormalised sales sheet validated into customer, orders and lineitem.

Dirt is injected by expression: blank names, blank flags, padded keys. Nothing is
filtered, so every query covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.validate import Validation, validate
from millrace.session import stage
from millrace.target import Column, Fill, ForeignKey, Table, fill
from scenarios.base import positioned, query, table

CUSTOMER = Table(
    "Customer",
    (Column("Cust_Key", "bigint", False), Column("Cust_Name", "varchar(50)", False), Column("Segment", "varchar(20)")),
    ("Cust_Key",),
)
ORDERS = Table(
    "Orders",
    (
        Column("Order_Key", "bigint", False), Column("Cust_Key", "bigint", False), Column("Status", "char(1)"),
        Column("Order_Date", "datetime", False), Column("Total", "decimal(12,2)"),
    ),
    ("Order_Key",),
    (ForeignKey("Cust_Key", "Customer", "Cust_Key"),),
)
LINEITEM = Table(
    "Lineitem",
    (
        Column("Order_Key", "bigint", False), Column("Line_No", "int", False), Column("Part_Key", "bigint", False),
        Column("Quantity", "float"), Column("Return_Flag", "char(1)", False),
    ),
    ("Order_Key", "Line_No"),
    (ForeignKey("Order_Key", "Orders", "Order_Key"),),
)
SHIPMENT = Table(
    "Shipment",
    (Column("Shipment_Id", "bigint", False, True), Column("Carrier", "varchar(30)", False), Column("Order_Key", "bigint")),
    ("Shipment_Id",),
    (ForeignKey("Order_Key", "Orders", "Order_Key"),),
)

MAPPINGS = {
    "Customer": {"c_custkey": "Cust_Key", "c_name": "Cust_Name", "c_mktsegment": "Segment"},
    "Orders": {
        "o_orderkey": "Order_Key", "o_custkey": "Cust_Key", "o_orderstatus": "Status",
        "o_orderdate": "Order_Date", "o_totalprice": "Total",
    },
    "Lineitem": {
        "l_orderkey": "Order_Key", "l_linenumber": "Line_No", "l_partkey": "Part_Key",
        "l_quantity": "Quantity", "l_returnflag": "Return_Flag",
    },
    "Shipment": {"l_orderkey": "Order_Key"},
}


def sales_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per line item, as a spreadsheet export would have it."""
    li = positioned(
        spark, sf_dir, "lineitem",
        ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"],
    )
    orders = table(spark, sf_dir, "orders").drop("o_orderpriority")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    # Orders meet their customers first: they are fewer than the line items, which then move once. Their text is made there too.
    placed = orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        F.col("o_orderkey").alias("placed_key"),
        *[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")],
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
        F.col("c_custkey").cast("string").alias("c_custkey"),
        F.when(F.col("c_custkey") % 13 == 0, F.lit(None)).otherwise(F.col("c_name")).alias("c_name"),
        "c_mktsegment",
    )
    wide = li.join(placed, li.l_orderkey == placed.placed_key)
    return wide.select(
        "row_idx",
        *[F.col(c).cast("string").alias(c) for c in ("l_orderkey", "l_partkey", "l_quantity")],
        # A padded line number is the same key but different data.
        F.when(F.col("row_idx") % 1009 == 0, F.concat(F.col("l_linenumber").cast("string"), F.lit(" ")))
        .otherwise(F.col("l_linenumber").cast("string")).alias("l_linenumber"),
        F.when(F.col("row_idx") % 11 == 0, F.lit(" ")).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        *placed.columns[1:],
    )


SHEET_SQL = """
li AS (SELECT row_number() OVER () AS row_idx, * FROM lineitem),
sheet AS (
  SELECT row_idx, CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey,
    CAST(l_quantity AS VARCHAR) AS l_quantity,
    CASE WHEN row_idx % 1009 = 0 THEN CAST(l_linenumber AS VARCHAR) || ' ' ELSE CAST(l_linenumber AS VARCHAR) END AS l_linenumber,
    CASE WHEN row_idx % 11 = 0 THEN ' ' ELSE l_returnflag END AS l_returnflag,
    CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
    CAST(o_totalprice AS VARCHAR) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
    CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_name END AS c_name, c_mktsegment
  FROM li JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
cust_ok AS (
  SELECT c_custkey, c_name, c_mktsegment, min(row_idx) AS row_idx FROM sheet
  WHERE trim(coalesce(c_name, '')) <> '' GROUP BY ALL),
ord_ok AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_totalprice, min(row_idx) AS row_idx FROM sheet
  WHERE o_custkey IN (SELECT c_custkey FROM cust_ok) GROUP BY ALL),
li_key AS (
  SELECT *, trim(l_orderkey) AS k1, trim(l_linenumber) AS k2,
    (l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag) AS sig FROM sheet),
li_bad AS (
  SELECT k1, k2, count(DISTINCT sig) AS variants, min(row_idx) AS first_row, arg_min(sig, row_idx) AS first_sig
  FROM li_key GROUP BY 1, 2 HAVING count(DISTINCT sig) > 1),
li_flag AS (
  SELECT li_key.*, li_bad.k1 IS NOT NULL AS conflict, first_row, first_sig, trim(l_returnflag) = '' AS no_flag,
    k1 NOT IN (SELECT o_orderkey FROM ord_ok) AS orphan
  FROM li_key LEFT JOIN li_bad USING (k1, k2))"""


def sales(spark: SparkSession, sf_dir: str, sheet: DataFrame | None = None) -> Validation:
    sheet = stage(sales_sheet(spark, sf_dir), "sheet", compact=True) if sheet is None else sheet
    return validate(sheet, [LINEITEM, ORDERS, CUSTOMER, SHIPMENT], fill(MAPPINGS))


def sales_fill() -> Fill:
    return fill(MAPPINGS)


@query(
    "v13_table_counts",
    f"""WITH {SHEET_SQL}
SELECT 'Customer' AS "table", (SELECT count(*) FROM sheet) AS source_rows, (SELECT count(*) FROM cust_ok) AS valid_rows,
  (SELECT count(*) FROM sheet WHERE c_name IS NULL) AS rejected_rows,
  (SELECT count(*) FROM sheet WHERE c_name IS NOT NULL) - (SELECT count(*) FROM cust_ok) AS duplicate_rows,
  CAST(0 AS BIGINT) AS pk_conflict_keys, CAST(0 AS BIGINT) AS fk_errors, (SELECT count(*) FROM sheet WHERE c_name IS NULL) AS null_errors
UNION ALL
SELECT 'Orders', (SELECT count(*) FROM sheet), (SELECT count(*) FROM ord_ok), (SELECT count(*) FROM sheet WHERE c_name IS NULL),
  (SELECT count(*) FROM sheet WHERE c_name IS NOT NULL) - (SELECT count(*) FROM ord_ok), 0,
  (SELECT count(*) FROM sheet WHERE c_name IS NULL), 0
UNION ALL
SELECT 'Lineitem', count(*), count(DISTINCT CASE WHEN NOT (conflict OR no_flag OR orphan) THEN sig END),
  count(*) FILTER (conflict OR no_flag OR orphan),
  count(*) FILTER (NOT (conflict OR no_flag OR orphan)) - count(DISTINCT CASE WHEN NOT (conflict OR no_flag OR orphan) THEN sig END),
  (SELECT count(*) FROM li_bad), count(*) FILTER (orphan AND NOT conflict), count(*) FILTER (no_flag AND NOT conflict)
FROM li_flag""",
)
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).table_counts


@query(
    "v13_overall_stats",
    f"""WITH {SHEET_SQL}
SELECT (SELECT count(*) FROM cust_ok) + (SELECT count(*) FROM ord_ok)
    + count(DISTINCT CASE WHEN NOT (conflict OR no_flag OR orphan) THEN sig END) AS total_valid_rows,
  CAST(2 * (SELECT count(*) FROM sheet WHERE c_name IS NULL) + count(*) FILTER (conflict OR no_flag OR orphan) AS BIGINT) AS total_rejected_rows,
  (SELECT count(*) FROM li_bad) AS pk_error_count,
  CAST((SELECT count(*) FROM sheet WHERE c_name IS NULL) + count(*) FILTER (orphan AND NOT conflict) AS BIGINT) AS fk_error_count,
  CAST(1 AS BIGINT) AS missing_required_count
FROM li_flag""",
)
def overall_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).stats


@query(
    "v02_table_required",
    """SELECT 'Shipment' AS "table",
 'Table [Shipment] cannot be generated: Missing required columns (Carrier) with no default in Excel data.' AS reason,
 (SELECT count(*) FROM lineitem) AS source_rows""",
)
def table_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = stage(sales_sheet(spark, sf_dir), "sheet")
    result = validate(sheet, [SHIPMENT], fill(MAPPINGS))
    return result.invalid_tables.withColumn("source_rows", sheet.agg(F.count(F.lit(1))).scalar())


@query(
    "v05_conflict_pairs",
    f"""WITH {SHEET_SQL}
SELECT 'Lineitem' AS "table", 'order_key, line_no' AS pk_columns, k1 || ', ' || k2 AS pk_value, row_idx AS row_index,
  first_row AS conflicting_with_row,
  'Duplicate primary-key value ''' || k1 || ', ' || k2 || ''' with conflicting data (rows ' || first_row || ' and ' || row_idx || ')' AS reason
FROM li_flag WHERE conflict AND row_idx > first_row AND sig IS DISTINCT FROM first_sig""",
)
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).checks["lineitem"].pk_errors


@query(
    "v05_conflict_keys",
    f"""WITH {SHEET_SQL}
SELECT k1 AS order_key, k2 AS line_no, variants, first_row FROM li_bad""",
)
def conflict_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sales(spark, sf_dir).checks["lineitem"].conflicts.df
    return found.select(F.col("pk0").alias("order_key"), F.col("pk1").alias("line_no"), "variants", "first_row")


@query(
    "v06_null_errors",
    f"""WITH {SHEET_SQL}
SELECT row_idx AS row_index, 'Lineitem' AS "table", 'Return_Flag' AS "column",
  'Required column ''Return_Flag'' is empty in row ' || row_idx AS reason FROM li_flag WHERE no_flag AND NOT conflict
UNION ALL
SELECT row_idx, 'Customer', 'Cust_Name', 'Required column ''Cust_Name'' is empty in row ' || row_idx FROM sheet WHERE c_name IS NULL""",
)
def null_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).null_errors


@query(
    "v07_fk_errors",
    f"""WITH {SHEET_SQL}
SELECT row_idx AS row_index, 'Lineitem' AS "table", 'Order_Key' AS "column", k1 AS "value", 'Orders' AS parent_table,
  'Order_Key' AS parent_column,
  'Foreign key violation: Column ''Order_Key'' value ''' || k1 || ''' does not exist in parent table ''Orders.Order_Key''' AS reason
FROM li_flag WHERE orphan AND NOT conflict
UNION ALL
SELECT row_idx, 'Orders', 'Cust_Key', o_custkey, 'Customer', 'Cust_Key',
  'Foreign key violation: Column ''Cust_Key'' value ''' || o_custkey || ''' does not exist in parent table ''Customer.Cust_Key'''
FROM sheet WHERE c_name IS NULL""",
)
def fk_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).fk_errors


@query(
    "v10_valid_lineitem",
    f"""WITH {SHEET_SQL}
SELECT min(row_idx) AS row_idx, l_orderkey AS "Order_Key", l_linenumber AS "Line_No", l_partkey AS "Part_Key",
  l_quantity AS "Quantity", l_returnflag AS "Return_Flag"
FROM li_flag WHERE NOT (conflict OR no_flag OR orphan) GROUP BY ALL""",
)
def valid_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).checks["lineitem"].valid


@query(
    "v14_split_customer_orders",
    f"""WITH {SHEET_SQL}
SELECT 'Customer' AS "table", row_idx, c_custkey AS key, c_name AS label FROM cust_ok
UNION ALL SELECT 'Orders', row_idx, o_orderkey, o_custkey || '/' || o_totalprice FROM ord_ok""",
)
def split_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = validate(stage(sales_sheet(spark, sf_dir), "sheet"), [ORDERS, CUSTOMER], sales_fill())
    cust, orders = result.checks["customer"].valid, result.checks["orders"].valid
    return cust.select(F.lit("Customer").alias("table"), "row_idx", F.col("Cust_Key").alias("key"), F.col("Cust_Name").alias("label")).unionByName(
        orders.select(F.lit("Orders").alias("table"), "row_idx", F.col("Order_Key").alias("key"), F.concat_ws("/", "Cust_Key", "Total").alias("label"))
    )


@query(
    "v11_rejected_rows",
    f"""WITH {SHEET_SQL}
SELECT row_idx AS row_index, 'Lineitem' AS "table", CASE WHEN conflict THEN 'PRIMARY_KEY_CONFLICT' ELSE 'VALIDATION_ERROR' END AS error_type,
  CASE WHEN conflict THEN 'Row rejected due to duplicate primary key conflict: ''' || k1 || ', ' || k2 || ''''
  ELSE concat_ws('; ', CASE WHEN no_flag THEN 'Required column ''Return_Flag'' is empty in row ' || row_idx END,
    CASE WHEN orphan THEN 'Foreign key violation: Column ''Order_Key'' value ''' || k1 || ''' does not exist in parent table ''Orders.Order_Key''' END) END AS reason
FROM li_flag WHERE conflict OR no_flag OR orphan
UNION ALL
SELECT row_idx, 'Orders', 'VALIDATION_ERROR', 'Foreign key violation: Column ''Cust_Key'' value ''' || o_custkey || ''' does not exist in parent table ''Customer.Cust_Key'''
FROM sheet WHERE c_name IS NULL
UNION ALL
SELECT row_idx, 'Customer', 'VALIDATION_ERROR', 'Required column ''Cust_Name'' is empty in row ' || row_idx FROM sheet WHERE c_name IS NULL""",
)
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).rejected


PARENT = Table("Part", (Column("Part_Key", "bigint", False), Column("Part_Of", "bigint")), ("Part_Key",), (ForeignKey("Part_Of", "Part", "Part_Key"),))

TREE_SQL = """
p AS (SELECT row_number() OVER () AS row_idx, CAST(p_partkey AS VARCHAR) AS k, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN CAST(p_partkey + 3 AS VARCHAR)
  WHEN p_partkey % 11 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE CAST(p_partkey // 2 AS VARCHAR) END AS r FROM part),
ok AS (SELECT row_idx, k FROM p WHERE r IS NULL OR row_idx <= 1 UNION ALL SELECT p.row_idx, p.k FROM p JOIN ok ON p.r = ok.k AND ok.row_idx < p.row_idx WHERE p.row_idx > 1)"""


@query(
    "v09_self_reference",
    f"""WITH RECURSIVE {TREE_SQL}
SELECT row_idx, k, r, 'accepted' AS verdict FROM p WHERE row_idx IN (SELECT row_idx FROM ok)
UNION ALL SELECT row_idx, k, r, 'Foreign key violation: Column ''Part_Of'' value ''' || r || ''' does not exist in parent table ''Part.Part_Key''' FROM p WHERE row_idx NOT IN (SELECT row_idx FROM ok)""",
)
def self_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: every part may belong to an earlier one."""
    key = F.col("p_partkey")
    up = F.when(key % 7 == 0, F.lit(None)).when(key % 5 == 0, key + 3).when(key % 11 == 0, key).otherwise(F.floor(key / 2))
    rows = positioned(spark, sf_dir, "part", ["p_partkey"]).select("row_idx", key.cast("string").alias("k"), up.cast("string").alias("r"))
    check = validate(rows, [PARENT], fill({"Part": {"k": "Part_Key", "r": "Part_Of"}})).checks["part"]
    good = check.valid.select("row_idx", F.col("Part_Key").alias("k"), F.col("Part_Of").alias("r"), F.lit("accepted").alias("verdict"))
    bad = check.rejected.join(rows, F.col("row_index") == F.col("row_idx")).select("row_idx", "k", "r", F.col("reason").alias("verdict"))
    return good.unionByName(bad)


@query(
    "v07_open_world",
    """SELECT 'Customer' AS "table", (SELECT count(*) FROM orders) AS source_rows, CAST(0 AS BIGINT) AS valid_rows, CAST(0 AS BIGINT) AS fk_errors
UNION ALL SELECT 'Orders', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders), 0""",
)
def open_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No customer survives, so the references of the orders go unchecked."""
    o = positioned(spark, sf_dir, "orders").select(
        "row_idx", *[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")],
        F.lit(" ").alias("c_name"),
    )
    mappings = {"Customer": {"o_custkey": "Cust_Key", "c_name": "Cust_Name"}, "Orders": MAPPINGS["Orders"]}
    result = validate(o, [ORDERS, CUSTOMER], fill(mappings))
    return result.table_counts.select("table", "source_rows", "valid_rows", "fk_errors")
