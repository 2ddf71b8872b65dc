"""V2, V11, V13, O13 over catalogs held as rows: four tables of ten columns for every forty parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import bulk
from scenarios.base import positioned, query, table

BY = ["import_id"]

#: k counts parts from 0; a table's column 1 is its key, column 2 refers to the table before, column 3 to the catalog's first.
CATALOG_SQL = """
p AS (SELECT p_partkey AS k, p_name FROM part),
cols AS (SELECT k, k // 40 AS import_id, k // 10 % 4 AS j, 'Tab_' || (k // 10 % 4) AS "table", CAST(k % 10 + 1 AS INTEGER) AS col_pos,
  'C' || (k % 10 + 1) || '_' || split_part(p_name, ' ', 1) AS name, k % 10 NOT IN (0, 1, 4) AS nullable, k % 10 = 3 AS is_identity, k % 10 = 4 AND k % 20 = 4 AS has_default FROM p),
srcs AS (SELECT import_id, j, col_pos, CASE col_pos WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' WHEN 6 THEN 'd' END AS source FROM cols
  WHERE col_pos IN (1, 3, 6) OR (col_pos = 2 AND k // 10 % 11 <> 3)),
acts AS (SELECT import_id, j, col_pos, CASE WHEN k % 3 = 0 THEN 'CUSTOM_VALUE' ELSE 'DATABASE_DEFAULT' END AS action,
  CASE WHEN k % 9 = 0 THEN ' ' WHEN k % 3 = 0 THEN 'v' || k END AS custom_value FROM cols WHERE (col_pos = 5 AND k % 3 < 2)
  UNION ALL SELECT import_id, j, col_pos, 'NULL', NULL FROM cols WHERE col_pos = 9 AND k % 7 = 0),
ruled AS (SELECT * FROM cols LEFT JOIN srcs USING (import_id, j, col_pos) LEFT JOIN acts USING (import_id, j, col_pos)),
lacks AS (SELECT import_id, j, "table", string_agg(name, ', ' ORDER BY col_pos) AS missing FROM ruled
  WHERE NOT nullable AND NOT has_default AND NOT is_identity AND source IS NULL
    AND NOT coalesce(action = 'DATABASE_DEFAULT' OR (action = 'CUSTOM_VALUE' AND trim(custom_value) <> ''), false) GROUP BY ALL)"""

ROWS_SQL = f"""{CATALOG_SQL},
tabs AS (SELECT DISTINCT import_id, j, "table" FROM cols WHERE (import_id, j) NOT IN (SELECT import_id, j FROM lacks)),
has AS (SELECT import_id, j, max(col_pos) FILTER (col_pos = 2) IS NOT NULL AS b, arg_max(name, col_pos = 1) AS key_name FROM srcs JOIN cols USING (import_id, j, col_pos) GROUP BY ALL),
names AS (SELECT import_id, j, max(name) FILTER (col_pos = 1) AS n1, max(name) FILTER (col_pos = 2) AS n2, max(name) FILTER (col_pos = 3) AS n3 FROM cols GROUP BY ALL),
li AS (SELECT row_number() OVER () AS row_idx, * FROM lineitem),
sheet AS (SELECT row_idx, l_partkey // 40 AS import_id, ' ' || (l_orderkey * 10 + least(l_linenumber, 5)) AS a,
  CASE WHEN l_quantity = 7 THEN ' ' WHEN l_discount = 0.05 THEN 'x' || l_linenumber ELSE CAST(l_orderkey * 10 + least(l_linenumber, 5) AS VARCHAR) END AS b,
  CASE WHEN l_tax > 0.02 THEN CAST(l_orderkey * 10 + least(l_linenumber, 5) AS VARCHAR) END AS c, l_linestatus AS d FROM li),
tup AS (SELECT import_id, j, "table", n1, n2, n3, a, CASE WHEN has.b THEN s.b END AS b, c, d, has.b AS has_b, min(row_idx) AS row_idx, count(*) AS copies
  FROM sheet s JOIN tabs USING (import_id) JOIN has USING (import_id, j) JOIN names USING (import_id, j) GROUP BY ALL),
flag AS (SELECT *, count(*) OVER (PARTITION BY import_id, j, trim(a)) > 1 AS conflict, has_b AND trim(b) = '' AS empty_b FROM tup),
"""


def _level_sql(j: int) -> str:
    """Table j against the accepted rows of the table before it and of the first one."""
    def lost(column: str, parent: int) -> str:
        return (f"coalesce(trim({column}) <> '', false) AND EXISTS (SELECT 1 FROM ok{parent} o WHERE o.import_id = f.import_id)"
                f" AND NOT EXISTS (SELECT 1 FROM ok{parent} o WHERE o.import_id = f.import_id AND o.v = trim(f.{column}))")

    b, c = (lost("b", j - 1), lost("c", 0)) if j else ("false", "false")
    return (f"t{j} AS (SELECT *, {b} AS lost_b, {c} AS lost_c FROM flag f WHERE j = {j}),\n"
            f"ok{j} AS (SELECT import_id, trim(a) AS v FROM t{j} WHERE NOT conflict AND NOT empty_b AND NOT lost_b AND NOT lost_c)")


JUDGED_SQL = ROWS_SQL + ",\n".join(_level_sql(j) for j in range(4)) + """,
every AS (SELECT *, NOT conflict AND NOT empty_b AND NOT lost_b AND NOT lost_c AS accepted FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3))"""


def catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules (``bulk.declared``), keys and references."""
    k = F.col("k")
    cols = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name")
    pos = (k % 10 + 1).cast("int")
    name = lambda at: F.concat(F.lit("C"), at.cast("string"), F.lit("_"), F.substring_index("p_name", " ", 1))
    cols = cols.select(k, F.floor(k / 40).alias("import_id"), F.concat(F.lit("Tab_"), (F.floor(k / 10) % 4).cast("string")).alias("table"), pos.alias("col_pos"), name(pos).alias("name"),
                       (~(k % 10).isin(0, 1, 4)).alias("nullable"), (k % 10 == 3).alias("is_identity"), ((k % 10 == 4) & (k % 20 == 4)).alias("has_default"),
                       (F.floor(k / 10) % 4).alias("table_pos"))
    at = F.struct("import_id", F.lower("table").alias("table_key"), F.lower("name").alias("column_key"))
    p = F.col("col_pos")
    source = F.when(p == 1, "a").when((p == 2) & (F.floor(k / 10) % 11 != 3), "b").when(p == 3, "c").when(p == 6, "d")
    sources = cols.select(at.alias("at"), source.alias("source")).where("source IS NOT NULL").select("at.*", "source")
    fifth, ninth = (p == 5) & (k % 3 < 2), (p == 9) & (k % 7 == 0)
    kind = F.when(ninth, "NULL").when(k % 3 == 0, "CUSTOM_VALUE").otherwise("DATABASE_DEFAULT")
    value = F.when(~ninth & (k % 9 == 0), " ").when(~ninth & (k % 3 == 0), F.concat(F.lit("v"), k.cast("string")))
    actions = cols.where(fifth | ninth).select(at.alias("at"), kind.alias("action"), value.alias("custom_value")).select("at.*", "action", "custom_value")
    rules = bulk.declared(cols, sources, actions, BY).join(cols.select("import_id", F.lower("table").alias("table_key"), "table_pos").distinct(), ["import_id", "table_key"])
    first = cols.where(p == 1).select("import_id", "table_pos", F.col("table").alias("parent_table"), F.col("name").alias("parent_column"))
    keys = cols.where(p == 1).select("import_id", F.upper("table").alias("table"), F.lit(1).alias("pk_pos"), F.upper("name").alias("column"))
    child = cols.where(p.isin(2, 3) & (F.col("table_pos") > 0)).select(
        "import_id", F.col("table").alias("child_table"), F.col("name").alias("child_column"), p.alias("fk_pos"),
        F.when(p == 2, F.col("table_pos") - 1).otherwise(0).alias("table_pos"))
    return rules, keys, child.join(first, ["import_id", "table_pos"]).drop("table_pos")


def judged(spark: SparkSession, sf_dir: str) -> bulk.Bulk:
    li = positioned(spark, sf_dir, "lineitem", ["l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus"])
    key = (F.col("l_orderkey") * 10 + F.least("l_linenumber", F.lit(5))).cast("string")
    b = F.when(F.col("l_quantity") == 7, " ").when(F.col("l_discount") == 0.05, F.concat(F.lit("x"), F.col("l_linenumber").cast("string"))).otherwise(key)
    cells = F.create_map(F.lit("a"), F.concat(F.lit(" "), key), F.lit("b"), b, F.lit("c"), F.when(F.col("l_tax") > 0.02, key), F.lit("d"), "l_linestatus", F.lit("spare"), F.lit("-"))
    rows = li.select(F.floor(F.col("l_partkey") / 40).alias("import_id"), "row_idx", cells.alias("cells"))
    rules, keys, fks = catalog(spark, sf_dir)
    return bulk.validate_tables(rows, rules, keys, fks, BY)


@query(
    "v02_catalog_required",
    f"""WITH {CATALOG_SQL}
SELECT import_id, "table", missing, 'Table [' || "table" || '] cannot be generated: Missing required columns (' || missing || ') with no default in Excel data.' AS reason FROM lacks""",
)
def catalog_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bulk.missing_required(catalog(spark, sf_dir)[0], BY)
    return found.select("import_id", "table", F.array_join("missing", ", ").alias("missing"), "reason")


@query(
    "o13_catalog_rules",
    f"""WITH {CATALOG_SQL}
SELECT import_id, "table", col_pos, name AS "column",
  CASE WHEN is_identity AND source IS NULL THEN 'DATABASE_GENERATED' WHEN action = 'CUSTOM_VALUE' AND custom_value IS NOT NULL THEN 'CUSTOM_VALUE'
    WHEN action = 'DATABASE_DEFAULT' THEN 'DEFAULT' WHEN action = 'NULL' THEN 'NULL' WHEN source IS NOT NULL THEN 'EXCEL' WHEN has_default AND NOT nullable THEN 'DEFAULT' ELSE 'NULL' END AS rule,
  CASE WHEN action = 'CUSTOM_VALUE' THEN custom_value WHEN action IS NULL THEN source END AS source,
  CASE WHEN is_identity AND source IS NULL THEN 'DATABASE_GENERATED (Identity sequence; omitted from INSERT)'
    WHEN action = 'CUSTOM_VALUE' AND custom_value IS NOT NULL THEN 'CUSTOM_VALUE [' || custom_value || '] (Fixed value for all rows)'
    WHEN action = 'DATABASE_DEFAULT' THEN 'DEFAULT (Database default)' WHEN action = 'NULL' THEN 'NULL (Explicit NULL)' WHEN source IS NOT NULL THEN 'EXCEL [' || source || '] (Mapped)'
    WHEN has_default AND NOT nullable THEN 'DEFAULT (Schema constraint)' WHEN nullable THEN 'NULL (Unmapped nullable)' ELSE 'NULL' END AS text
FROM ruled""",
)
def catalog_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bulk.fill_rules(catalog(spark, sf_dir)[0], BY)


@query(
    "v13_catalog_counts",
    f"""WITH {JUDGED_SQL}
SELECT import_id, t."table", coalesce(source_rows, 0) AS source_rows, coalesce(valid_rows, 0) AS valid_rows, coalesce(rejected_rows, 0) AS rejected_rows,
  coalesce(source_rows - valid_rows - rejected_rows, 0) AS duplicate_rows, coalesce(pk_conflict_keys, 0) AS pk_conflict_keys, coalesce(fk_errors, 0) AS fk_errors, coalesce(null_errors, 0) AS null_errors
FROM tabs t LEFT JOIN (
  SELECT import_id, j, sum(copies)::BIGINT AS source_rows, count(*) FILTER (accepted) AS valid_rows, coalesce(sum(copies) FILTER (NOT accepted), 0)::BIGINT AS rejected_rows,
    count(DISTINCT trim(a)) FILTER (conflict) AS pk_conflict_keys, coalesce(sum(copies * (lost_b::INT + lost_c::INT)) FILTER (NOT conflict), 0)::BIGINT AS fk_errors,
    coalesce(sum(copies) FILTER (empty_b AND NOT conflict), 0)::BIGINT AS null_errors FROM every GROUP BY ALL) USING (import_id, j)""",
)
def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).counts


@query(
    "v11_catalog_rejected",
    f"""WITH {JUDGED_SQL}
SELECT import_id, e."table", s.row_idx AS row_index, CASE WHEN conflict THEN 'PRIMARY_KEY_CONFLICT' ELSE 'VALIDATION_ERROR' END AS error_type,
  CASE WHEN conflict THEN 'Row rejected due to duplicate primary key conflict: ''' || trim(e.a) || '''' ELSE concat_ws('; ',
    CASE WHEN empty_b THEN 'Required column ''' || n2 || ''' is empty in row ' || s.row_idx END,
    CASE WHEN lost_b THEN 'Foreign key violation: Column ''' || n2 || ''' value ''' || trim(e.b) || ''' does not exist in parent table ''Tab_' || (j - 1) || '.' || p.key_name || '''' END,
    CASE WHEN lost_c THEN 'Foreign key violation: Column ''' || n3 || ''' value ''' || trim(e.c) || ''' does not exist in parent table ''Tab_0.' || q.key_name || '''' END) END AS reason
FROM every e JOIN sheet s ON s.import_id = e.import_id AND s.a = e.a AND (NOT has_b OR s.b IS NOT DISTINCT FROM e.b) AND s.c IS NOT DISTINCT FROM e.c AND s.d IS NOT DISTINCT FROM e.d
  LEFT JOIN has p ON p.import_id = e.import_id AND p.j = e.j - 1 LEFT JOIN has q ON q.import_id = e.import_id AND q.j = 0
WHERE NOT accepted""".replace("SELECT import_id, e.", "SELECT e.import_id, e.").replace("|| (j - 1)", "|| (e.j - 1)"),
)
def catalog_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).rejected
