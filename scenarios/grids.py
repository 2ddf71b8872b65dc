"""G: the event log of each user read as a messy sheet.

Errors are blank rows, sign-ups are header rows, every fifth event lacks its value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import grid as G
from millrace.operators.prefix import number
from scenarios.base import query, round2_sql, table

GRID_SQL = """
grid AS (
  SELECT 'User ' || user_id AS sheet, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS row_idx, event_type = 'error' AS e,
    CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN 'Event Type' ELSE event_type END AS c0,
    CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN 'Value' ELSE CASE WHEN event_id % 5 <> 0 THEN CAST(value AS VARCHAR) END END AS c1,
    CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'event type' END ELSE props END AS c2,
    CASE WHEN user_id % 3 = 0 AND event_type <> 'error' THEN repeat('long note ', 6) END AS c3
  FROM events),
runs AS (SELECT *, sum(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY sheet ORDER BY row_idx) AS g FROM grid),
sized AS (SELECT *, min(row_idx) FILTER (NOT e) OVER (PARTITION BY sheet, g) AS s, count(*) FILTER (NOT e) OVER (PARTITION BY sheet, g) AS n FROM runs),
whole AS (SELECT sheet, bool_or(NOT e AND n >= 2) AS has FROM sized GROUP BY 1),
seg AS (SELECT z.sheet, row_idx, c0, c1, c2, c3, CASE WHEN has THEN s ELSE 0 END AS block_start, row_idx - CASE WHEN has THEN s ELSE 0 END AS row_in_block
  FROM sized z JOIN whole USING (sheet) WHERE (NOT e AND n >= 2) OR NOT has),
blk AS (SELECT sheet, block_start, count(*) AS n_rows, row_number() OVER (PARTITION BY sheet ORDER BY block_start) AS block_no,
  count(*) OVER (PARTITION BY sheet) AS n_blocks FROM seg GROUP BY 1, 2),
named AS (SELECT sheet, block_start, n_rows, block_no, replace(lower(sheet), ' ', '_') || CASE WHEN n_blocks > 1 THEN '_' || block_no ELSE '' END AS table_name FROM blk),
feat AS (SELECT sheet, block_start, row_in_block,
    (c0 IS NOT NULL)::INT + (c1 IS NOT NULL)::INT + (c2 IS NOT NULL)::INT + (c3 IS NOT NULL)::INT AS filled,
    (coalesce(c1, '') SIMILAR TO '[0-9].*')::INT AS numbers, (c3 IS NOT NULL)::INT AS longs FROM seg WHERE row_in_block <= 20),
feat2 AS (SELECT *, lead(filled) OVER (PARTITION BY sheet, block_start ORDER BY row_in_block) AS nx FROM feat),
scored AS (SELECT sheet, block_start, row_in_block, (filled - numbers) * 2 - longs * 5 - numbers * 10 + filled
   + CASE WHEN abs(nx - filled) <= 2 THEN 5 ELSE 0 END AS score FROM feat2 WHERE row_in_block < 20 AND filled > 0),
pick AS (SELECT sheet, block_start, max(score) AS best, arg_max(row_in_block, score * 1000 - row_in_block) AS best_row FROM scored GROUP BY 1, 2),
head AS (SELECT named.*, CASE WHEN coalesce(best, -1000) < 2.0 THEN -1 ELSE best_row END AS header_row,
  CASE WHEN coalesce(best, -1000) < 2.0 THEN 0 ELSE best_row + 1 END AS data_start, least(greatest(coalesce(best, -1000) / 17.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS ratio
  FROM named LEFT JOIN pick USING (sheet, block_start)),
dat AS (SELECT seg.*, table_name, header_row FROM seg JOIN head USING (sheet, block_start) WHERE row_in_block >= data_start),
cells AS (SELECT sheet, block_start, table_name, header_row, row_idx, 0 AS p, c0 AS v FROM dat UNION ALL SELECT sheet, block_start, table_name, header_row, row_idx, 1, c1 FROM dat
  UNION ALL SELECT sheet, block_start, table_name, header_row, row_idx, 2, c2 FROM dat UNION ALL SELECT sheet, block_start, table_name, header_row, row_idx, 3, c3 FROM dat),
kept AS (SELECT sheet, block_start, table_name, header_row, p FROM cells GROUP BY ALL HAVING count(v) > 0),
hname AS (SELECT k.*, CASE WHEN header_row < 0 THEN NULL ELSE CASE p WHEN 0 THEN s.c0 WHEN 1 THEN s.c1 WHEN 2 THEN s.c2 ELSE s.c3 END END AS raw
  FROM kept k LEFT JOIN seg s ON s.sheet = k.sheet AND s.block_start = k.block_start AND s.row_in_block = k.header_row),
cols AS (SELECT sheet, table_name, block_start, p AS col_pos, CASE WHEN raw IS NULL THEN 'Column_' || (p + 1) ELSE trim(raw) END AS header FROM hname),
cols2 AS (SELECT *, row_number() OVER (PARTITION BY sheet, block_start, replace(lower(header), ' ', '_') ORDER BY col_pos) AS k FROM cols)"""


def event_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    kind, k = F.col("event_type"), F.col("event_id")

    def cell(signup, data):
        return F.when(kind == "error", F.lit(None)).when(kind == "signup", signup).otherwise(data)

    cells = F.array(
        cell(F.lit("Event Type"), kind),
        cell(F.lit("Value"), F.when(k % 5 != 0, F.col("value").cast("string"))),
        cell(F.when(k % 2 == 0, F.lit("event type")), F.col("props")),
        F.when((F.col("user_id") % 3 == 0) & (kind != "error"), F.repeat(F.lit("long note "), 6)),
    )
    rows = ev.select(F.lit("events").alias("source"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("sheet"), k, cells.alias("cells"))
    return number(rows, ["source", "sheet"], "event_id", "rn").select("source", "sheet", (F.col("rn") - 1).alias("row_idx"), "cells")


@query("g02_segments", f"""WITH {GRID_SQL} SELECT sheet, row_idx, block_start, row_in_block, concat_ws('|', c0, c1, c2, c3) AS text FROM seg""")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1-G3."""
    return G.segment(event_sheets(spark, sf_dir)).select("sheet", "row_idx", "block_start", "row_in_block", F.array_join("cells", "|").alias("text"))


@query("g04_blocks", f"""WITH {GRID_SQL} SELECT sheet, block_start, n_rows, block_no, table_name FROM named""")
def block_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.blocks(G.segment(event_sheets(spark, sf_dir))).select("sheet", "block_start", "n_rows", "block_no", "table_name")


@query("g06_header_scores", f"""WITH {GRID_SQL} SELECT sheet, block_start, row_in_block, score FROM scored""")
def header_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5, G6."""
    return G.header_scores(G.segment(event_sheets(spark, sf_dir))).select("sheet", "block_start", "row_in_block", "score")


@query(
    "g08_headers",
    f"""WITH {GRID_SQL} SELECT sheet, block_start, table_name, header_row, data_start, {round2_sql('ratio')} AS confidence FROM head""",
)
def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7, G8."""
    segmented = G.segment(event_sheets(spark, sf_dir))
    return G.headers(segmented, G.blocks(segmented)).select("sheet", "block_start", "table_name", "header_row", "data_start", "confidence")


@query(
    "g12_column_names",
    f"""WITH {GRID_SQL} SELECT sheet, table_name, col_pos, header, replace(lower(header), ' ', '_') || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS name FROM cols2""",
)
def column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10-G12, C9."""
    return G.structure(event_sheets(spark, sf_dir)).columns.select("sheet", "table_name", "col_pos", "header", "name")


@query(
    "g13_clean_rows",
    f"""WITH {GRID_SQL} SELECT sheet, table_name, row_idx, string_agg(coalesce(v, '~'), '|' ORDER BY p) AS text
FROM cells JOIN kept USING (sheet, block_start, table_name, header_row, p) GROUP BY ALL HAVING count(v) > 0""",
)
def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9, G11, G13."""
    return G.structure(event_sheets(spark, sf_dir)).rows.select("sheet", "table_name", "row_idx", F.array_join("values", "|", "~").alias("text"))


@query(
    "g14_table_counts",
    f"""WITH {GRID_SQL}, r AS (SELECT sheet, table_name, row_idx, count(v) AS f FROM cells GROUP BY 1, 2, 3)
SELECT sheet, table_name, count(*) AS row_count, (SELECT count(*) FROM cols c WHERE c.sheet = r.sheet AND c.table_name = r.table_name) AS column_count
FROM r WHERE f > 0 GROUP BY 1, 2""",
)
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.structure(event_sheets(spark, sf_dir)).tables.select("sheet", "table_name", "row_count", "column_count")


@query(
    "g09_ignored_rows",
    f"""WITH {GRID_SQL} SELECT sheet, table_name, unnest(range(data_start)) AS row_in_block FROM head
 WHERE EXISTS (SELECT 1 FROM cells WHERE cells.sheet = head.sheet AND cells.table_name = head.table_name AND v IS NOT NULL)""",
)
def ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ignored_rows(G.structure(event_sheets(spark, sf_dir)).tables).select("sheet", "table_name", "row_in_block")


@query(
    "s10_first_rows",
    f"""WITH {GRID_SQL}, r AS (SELECT sheet, table_name, row_idx, count(v) AS f FROM cells GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY sheet, table_name ORDER BY row_idx) AS sample_no FROM r WHERE f > 0)
SELECT sheet, table_name, row_idx, CAST(sample_no AS INT) AS sample_no FROM n WHERE sample_no <= 20""",
)
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preview sample, a top-20 per table."""
    return G.samples(G.structure(event_sheets(spark, sf_dir)).rows).select("sheet", "table_name", "row_idx", "sample_no")
