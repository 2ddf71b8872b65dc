"""C: a catalog of many small schemas, one declared column per row of ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import catalog as C
from scenarios.base import query, table

# Fixed values of the scenario: what each tenth column is called and typed.
NAMES = {0: "Record_ID", 1: "Column1", 2: "Email_Address", 3: "Created_At", 4: "Is_Active"}
TYPES = {
    0: "INT", 1: "varchar(50)", 2: "VARCHAR(100)", 3: "datetime", 4: "bit", 5: "int", 6: "DECIMAL(10,2)",
    7: "nvarchar(20)", 8: "timestamptz", 9: "bigint",
}
WORDS = ("Anvil", "Bolt", "Gear", "Gizmo", "Plate", "Ring", "Spring", "Widget")
BY = ["import_id"]


def _case(key: str, values: dict[int, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items())


PARTS_SQL = f"""
cols AS (
  SELECT p_partkey, p_partkey // 40 AS import_id, {_case('(p_partkey // 10) % 8', dict(enumerate(WORDS)))} END AS "table",
    p_partkey % 10 + 1 AS col_pos,
    {_case('p_partkey % 10', NAMES)} ELSE upper(p_name[1]) || lower(split_part(p_name, ' ', 1)[2:]) || '_'
      || upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2:]) || '_' || (p_partkey % 10) END AS name,
    {_case('p_partkey % 10', TYPES)} END AS sql_type,
    p_partkey % 10 NOT IN (0, 5) AS nullable, p_partkey % 10 = 0 AS is_identity, p_partkey % 10 = 3 AS has_default
  FROM part),
pks AS (
  SELECT import_id, lower("table") AS "table", CASE WHEN col_pos = 1 THEN 2 ELSE 1 END AS pk_pos, upper(name) AS "column" FROM cols
  WHERE col_pos = 1 OR (col_pos = 6 AND p_partkey % 3 = 0)
  UNION ALL SELECT import_id, "table", 9, name FROM cols WHERE col_pos = 1 AND p_partkey % 7 = 0),
fks AS (
  SELECT child.import_id, child."table" AS child_table, child.name AS child_column, parent."table" AS parent_table,
    parent.name AS parent_column, child.p_partkey AS fk_pos
  FROM cols child JOIN cols parent ON parent.p_partkey = (CASE WHEN child.col_pos = 10 THEN (child.p_partkey // 40) * 40
      ELSE ((child.p_partkey * 7) % 40 // 10) * 10 + (child.p_partkey // 40) * 40 END)
  WHERE child.col_pos IN (6, 10))"""


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    word, name, kind = F, F, F
    for k, v in enumerate(WORDS):
        word = word.when(F.floor(key / 10) % 8 == k, F.lit(v))
    for k, v in NAMES.items():
        name = name.when(key % 10 == k, F.lit(v))
    for k, v in TYPES.items():
        kind = kind.when(key % 10 == k, F.lit(v))
    made = F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), (key % 10).cast("string"))
    return part.select(
        "p_partkey", "p_name", F.floor(key / 40).alias("import_id"), word.alias("table"), (key % 10 + 1).alias("col_pos"),
        name.otherwise(made).alias("name"), kind.alias("sql_type"),
        (~(key % 10).isin(0, 5)).alias("nullable"), (key % 10 == 0).alias("is_identity"), (key % 10 == 3).alias("has_default"),
    )


def keys(cols: DataFrame) -> DataFrame:
    pos = F.col("col_pos")
    main = cols.where((pos == 1) | ((pos == 6) & (F.col("p_partkey") % 3 == 0))).select(
        "import_id", F.lower("table").alias("table"), F.when(pos == 1, 2).otherwise(1).alias("pk_pos"), F.upper("name").alias("column")
    )
    again = cols.where((pos == 1) & (F.col("p_partkey") % 7 == 0)).select("import_id", "table", F.lit(9).alias("pk_pos"), F.col("name").alias("column"))
    return main.unionByName(again)


def references(cols: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    start = F.floor(key / 40) * 40
    to = F.when(F.col("col_pos") == 10, start).otherwise(F.floor((key * 7) % 40 / 10) * 10 + start)
    child = cols.where(F.col("col_pos").isin(6, 10)).select(
        "import_id", F.col("table").alias("child_table"), F.col("name").alias("child_column"), to.alias("parent_key"), key.alias("fk_pos")
    )
    parent = cols.select(key.alias("parent_key"), F.col("table").alias("parent_table"), F.col("name").alias("parent_column"))
    return child.join(parent, "parent_key").drop("parent_key")


def tables(cols: DataFrame) -> DataFrame:
    return cols.groupBy("import_id", "table").agg(F.min("p_partkey").alias("table_pos"))


@query(
    "c01_type_category",
    f"""WITH {PARTS_SQL}
SELECT p_partkey, sql_type, CASE p_partkey % 10 WHEN 0 THEN 'integer' WHEN 3 THEN 'date' WHEN 4 THEN 'boolean' WHEN 5 THEN 'integer'
  WHEN 6 THEN 'float' WHEN 8 THEN 'date' WHEN 9 THEN 'integer' ELSE 'string' END AS data_type FROM cols""",
)
def type_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_category(columns(spark, sf_dir)).select("p_partkey", "sql_type", "data_type")


@query(
    "c02_primary_keys",
    f"""WITH {PARTS_SQL},
f AS (SELECT import_id, lower("table") AS k, lower("column") AS c, min(pk_pos) AS pos, arg_min("table", pk_pos) AS t FROM pks GROUP BY 1, 2, 3)
SELECT f.import_id, min(t) AS "table", string_agg(cols.name, ', ' ORDER BY pos) AS primary_key
FROM f JOIN cols ON cols.import_id = f.import_id AND lower(cols."table") = k AND lower(cols.name) = c GROUP BY f.import_id, k""",
)
def primary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = columns(spark, sf_dir)
    return C.primary_key_lists(cols, keys(cols), BY).select("import_id", F.lower("table").alias("table"), "primary_key")


@query(
    "c02_key_columns",
    f"""WITH {PARTS_SQL}
SELECT p_partkey, EXISTS (SELECT 1 FROM pks WHERE pks.import_id = cols.import_id AND lower(pks."table") = lower(cols."table")
  AND lower(pks."column") = lower(cols.name)) AS is_pk FROM cols""",
)
def key_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = columns(spark, sf_dir)
    return C.mark_primary_keys(cols, keys(cols), BY).select("p_partkey", "is_pk")


@query(
    "c03_related_tables",
    f"""WITH {PARTS_SQL},
pairs AS (SELECT import_id, child_table AS t, parent_table AS o FROM fks UNION SELECT import_id, parent_table, child_table FROM fks)
SELECT import_id, "table", coalesce(string_agg(o, ',' ORDER BY o), '') AS related
FROM (SELECT DISTINCT import_id, "table" FROM cols) c LEFT JOIN pairs p USING (import_id) WHERE p.t IS NULL OR p.t = c."table" GROUP BY 1, 2
UNION ALL SELECT import_id, "table", '' FROM (SELECT DISTINCT import_id, "table" FROM cols) c
WHERE EXISTS (SELECT 1 FROM pairs p WHERE p.import_id = c.import_id) AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.import_id = c.import_id AND p.t = c."table")""",
)
def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = columns(spark, sf_dir)
    found = C.related_tables(tables(cols), references(cols), BY)
    return found.select("import_id", "table", F.array_join("related_tables", ",").alias("related"))


@query(
    "c04_table_summary",
    f"""WITH {PARTS_SQL}
SELECT import_id, "table", count(*) AS column_count, coalesce(string_agg(CASE WHEN is_identity THEN name END, ',' ORDER BY col_pos), '') AS identity_columns,
  bool_or(is_identity) AS has_identity, (SELECT count(*) FROM fks WHERE fks.import_id = cols.import_id AND fks.child_table = cols."table") AS fk_count
FROM cols GROUP BY 1, 2""",
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = columns(spark, sf_dir)
    found = C.table_summary(cols, references(cols), BY)
    return found.withColumn("identity_columns", F.array_join("identity_columns", ","))


@query(
    "c05_column_roles",
    f"""WITH {PARTS_SQL}, last AS (SELECT import_id, child_table, child_column, arg_max(parent_table || '.' || parent_column, fk_pos) AS p FROM fks GROUP BY 1, 2, 3)
SELECT cols.p_partkey, CASE WHEN EXISTS (SELECT 1 FROM pks WHERE pks.import_id = cols.import_id AND lower(pks."table") = lower(cols."table")
  AND lower(pks."column") = lower(cols.name)) THEN 'PK' WHEN p IS NOT NULL THEN 'FK (References ' || p || ')' ELSE 'Normal' END AS role
FROM cols LEFT JOIN last ON last.import_id = cols.import_id AND child_table = "table" AND child_column = name""",
)
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = columns(spark, sf_dir)
    marked = C.mark_primary_keys(cols, keys(cols), BY)
    return C.column_roles(marked, references(cols), BY).select("p_partkey", "role")


SELECTION_SQL = """sel AS (SELECT s_suppkey % 10 AS import_id, CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE ' ' ||
  (CASE (s_suppkey // 10) % 9 WHEN 0 THEN 'anvil' WHEN 1 THEN 'BOLT' WHEN 2 THEN 'gear' WHEN 3 THEN 'Gizmo' WHEN 4 THEN 'plate'
   WHEN 5 THEN 'ring' WHEN 6 THEN 'spring' WHEN 7 THEN 'widget' ELSE 'lathe' END) || ' ' END AS selected FROM supplier)"""


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    names = ("anvil", "BOLT", "gear", "Gizmo", "plate", "ring", "spring", "widget", "lathe")
    name = F
    for i, n in enumerate(names):
        name = name.when(F.floor(key / 10) % 9 == i, F.lit(f" {n} "))
    return sup.select((key % 10).alias("import_id"), F.when(key % 9 == 0, F.lit(" ")).otherwise(name).alias("selected"))


@query(
    "c06_select_tables",
    f"""WITH {PARTS_SQL}, {SELECTION_SQL}
SELECT DISTINCT import_id, "table", 'selected' AS state FROM cols WHERE EXISTS (SELECT 1 FROM sel WHERE sel.import_id = cols.import_id AND lower(trim(selected)) = lower("table"))
UNION ALL
SELECT import_id, trim(selected), 'unknown' FROM sel WHERE trim(selected) <> '' AND NOT EXISTS
  (SELECT 1 FROM cols WHERE sel.import_id = cols.import_id AND lower(trim(selected)) = lower("table"))""",
)
def select(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, unknown = C.select_tables(tables(columns(spark, sf_dir)), selection(spark, sf_dir), BY)
    return chosen.select("import_id", "table", F.lit("selected").alias("state")).unionByName(
        unknown.select("import_id", F.col("selected").alias("table"), F.lit("unknown").alias("state"))
    )


FOREST_SQL = """
nodes AS (SELECT p_partkey AS pos, p_partkey // 500 AS import_id, 'T' || p_partkey AS "table",
  CASE WHEN p_partkey % 500 = 0 THEN NULL WHEN p_partkey % 97 = 1 THEN p_partkey + 1 WHEN p_partkey % 97 = 2 THEN p_partkey - 1
    WHEN p_partkey % 11 = 0 THEN p_partkey ELSE (p_partkey // 500) * 500 + (p_partkey % 500) // 3 END AS up FROM part)"""


@query(
    "c07_load_order",
    f"""WITH RECURSIVE {FOREST_SQL},
walk AS (
  SELECT pos, import_id, "table", 0 AS level, lpad(CAST(pos AS VARCHAR), 10, '0') AS path FROM nodes
  WHERE up IS NULL OR up = pos OR up NOT IN (SELECT n2.pos FROM nodes n2 WHERE n2.import_id = nodes.import_id)
  UNION ALL
  SELECT n.pos, n.import_id, n."table", w.level + 1, w.path || lpad(CAST(n.pos AS VARCHAR), 10, '0')
  FROM nodes n JOIN walk w ON n.up = w.pos AND n.import_id = w.import_id WHERE n.up <> n.pos),
every AS (
  SELECT import_id, "table", level, path FROM walk
  UNION ALL SELECT import_id, "table", 1000000, lpad(CAST(pos AS VARCHAR), 10, '0') FROM nodes WHERE pos NOT IN (SELECT pos FROM walk))
SELECT import_id, "table", row_number() OVER (PARTITION BY import_id ORDER BY level, path) AS position FROM every""",
)
def load_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference forest over all parts, with self references and two-table cycles."""
    key = F.col("p_partkey")
    start = F.floor(key / 500) * 500
    up = (
        F.when(key % 500 == 0, F.lit(None)).when(key % 97 == 1, key + 1).when(key % 97 == 2, key - 1)
        .when(key % 11 == 0, key).otherwise(start + F.floor(key % 500 / 3))
    )
    nodes = table(spark, sf_dir, "part").select(
        F.floor(key / 500).alias("import_id"), F.concat(F.lit("T"), key.cast("string")).alias("table"), key.alias("table_pos"), up.alias("up")
    )
    fks = nodes.where(F.col("up").isNotNull()).select(
        "import_id", F.col("table").alias("child_table"), F.concat(F.lit("[dbo].[T"), F.col("up").cast("string"), F.lit("]")).alias("parent_table")
    )
    return C.load_order(nodes.drop("up"), fks, BY).select("import_id", "table", "position")


@query(
    "c08_unmapped_action",
    f"""WITH {PARTS_SQL}
SELECT p_partkey, CASE WHEN is_identity THEN 'DATABASE_GENERATED' WHEN has_default THEN 'DEFAULT' WHEN nullable THEN 'NULL' ELSE 'VALIDATION_ERROR' END AS action FROM cols""",
)
def unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns(spark, sf_dir).select("p_partkey", C.unmapped_action().alias("action"))
