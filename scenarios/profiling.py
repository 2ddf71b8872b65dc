"""P: profiles of real columns, whole tables, all values as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.dates import has_time_of_day, profile_timestamp
from millrace.operators.profile import distinct_values, first_samples, profile, unpivot
from scenarios.base import positioned, query, round2_sql, table

VALUES_SQL = """
li AS (SELECT row_number() OVER () AS row_idx, * FROM lineitem),
vals AS (
  SELECT row_idx, l_partkey // 40 AS import_id, 'kind ' || (l_partkey % 10) AS "column",
    CASE WHEN row_idx % 17 = 0 THEN (CASE row_idx % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'NaN' ELSE 'null' END) ELSE
    CASE l_partkey % 10
      WHEN 0 THEN CAST(l_orderkey AS VARCHAR)
      WHEN 1 THEN l_returnflag
      WHEN 2 THEN 'u' || l_orderkey || '@mail.org'
      WHEN 3 THEN strftime(l_shipdate + to_hours(l_linenumber), '%Y-%m-%d %H:%M:%S')
      WHEN 4 THEN CASE WHEN l_linestatus = 'F' THEN 'yes' ELSE 'no' END
      WHEN 5 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
      WHEN 6 THEN CAST(l_extendedprice AS VARCHAR)
      WHEN 7 THEN '(555) 01-' || lpad(CAST(l_suppkey AS VARCHAR), 4, '0')
      WHEN 8 THEN strftime(l_shipdate, '%d/%m/%Y')
      ELSE lpad(CAST(l_suppkey AS VARCHAR), 6, '0') END END AS value
  FROM li)"""

CLEAN_SQL = """
clean AS (
  SELECT * EXCLUDE (value), CASE WHEN trim(value) <> '' AND lower(trim(value)) NOT IN ('null', 'nan') THEN trim(value) END AS v
  FROM vals)"""


def part_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``import_id, column, row_idx, value``: ten kinds of text per import."""
    li = positioned(spark, sf_dir, "lineitem")
    key, row = F.col("l_partkey"), F.col("row_idx")
    text = {
        0: F.col("l_orderkey").cast("string"),
        1: F.col("l_returnflag"),
        2: F.concat(F.lit("u"), F.col("l_orderkey").cast("string"), F.lit("@mail.org")),
        3: F.date_format(F.expr("l_shipdate + make_interval(0, 0, 0, 0, l_linenumber)"), "yyyy-MM-dd HH:mm:ss"),
        4: F.when(F.col("l_linestatus") == "F", F.lit("yes")).otherwise(F.lit("no")),
        5: F.col("l_quantity").cast("long").cast("string"),
        6: F.col("l_extendedprice").cast("string"),
        7: F.concat(F.lit("(555) 01-"), F.lpad(F.col("l_suppkey").cast("string"), 4, "0")),
        8: F.date_format("l_shipdate", "dd/MM/yyyy"),
        9: F.lpad(F.col("l_suppkey").cast("string"), 6, "0"),
    }
    value = F
    for k, expr in text.items():
        value = value.when(key % 10 == k, expr)
    blank = F.when(row % 3 == 0, F.lit(" ")).when(row % 3 == 1, F.lit("NaN")).otherwise(F.lit("null"))
    return li.select(
        "row_idx", F.floor(key / 40).alias("import_id"), F.concat(F.lit("kind "), (key % 10).cast("string")).alias("column"),
        F.when(row % 17 == 0, blank).otherwise(value).alias("value"),
    )


PROFILE_SQL = f"""
parsed AS (
  SELECT *, CASE WHEN length(v) >= 6 THEN coalesce(try_strptime(v, '%Y-%m-%d %H:%M:%S'), try_strptime(v, '%Y-%m-%d'),
    try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%m/%d/%Y')) END AS ts,
    regexp_full_match(v, '-?[0-9]+') AS int_ok, regexp_full_match(v, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') AS num_ok
  FROM clean),
folded AS (
  SELECT import_id, "column", count(v) AS n_values, count(DISTINCT v) AS n_distinct,
    coalesce(min(length(v)), 0) AS min_length, coalesce(max(length(v)), 0) AS max_length,
    coalesce(bool_and(lower(v) IN ('true','false','1','0','yes','no','t','f','y','n')), false) AND count(DISTINCT v) <= 2 AS is_boolean,
    coalesce(bool_and(int_ok), false) AS is_integer, coalesce(bool_and(int_ok OR num_ok), false) AS is_numeric,
    coalesce(bool_and(num_ok) AND bool_or(contains(v, '.')), false) AS is_decimal,
    coalesce(bool_and(CASE WHEN v IS NOT NULL THEN ts IS NOT NULL END) AND NOT coalesce(bool_or(hour(ts)+minute(ts)+second(ts) > 0), false), false) AS is_date,
    coalesce(bool_and(CASE WHEN v IS NOT NULL THEN ts IS NOT NULL END) AND bool_or(hour(ts)+minute(ts)+second(ts) > 0), false) AS is_datetime,
    coalesce(bool_and(regexp_full_match(v, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+')), false) AS is_email_like,
    coalesce(bool_and(regexp_full_match(v, '\\+?[0-9\\s\\-()]{{7,20}}') AND length(regexp_replace(v, '[^0-9]', '', 'g')) >= 7), false)
      AND NOT coalesce(bool_and(int_ok OR num_ok), false) AS is_phone_like,
    coalesce(bool_and(regexp_full_match(v, '[0-9]+')) AND (bool_or(v LIKE '0%' AND length(v) > 1)
      OR (min(length(v)) = max(length(v)) AND max(length(v)) IN (5, 6, 9))), false) AS is_numeric_string
  FROM parsed GROUP BY 1, 2),
firsts AS (SELECT import_id, "column", v, min(row_idx) AS first_row FROM clean WHERE v IS NOT NULL GROUP BY 1, 2, 3),
tops AS (SELECT *, row_number() OVER (PARTITION BY import_id, "column" ORDER BY first_row) AS rk FROM firsts),
samples AS (SELECT import_id, "column", string_agg(v, '|' ORDER BY rk) AS samples FROM tops WHERE rk <= 4 GROUP BY 1, 2)"""


@query(
    "p12_profile_imports",
    f"""WITH {VALUES_SQL}, {CLEAN_SQL}, {PROFILE_SQL}
SELECT folded.*, CASE WHEN n_values > 0 THEN {round2_sql('n_distinct / n_values')} ELSE 0.0 END AS uniqueness_ratio,
  CASE WHEN is_boolean THEN 'boolean' WHEN is_datetime THEN 'datetime' WHEN is_date THEN 'date' WHEN is_email_like THEN 'email-like'
    WHEN is_phone_like THEN 'phone-like' WHEN is_numeric_string THEN 'numeric-string' WHEN is_integer THEN 'integer'
    WHEN is_decimal THEN 'decimal' ELSE 'string' END AS inferred_type, coalesce(samples, '') AS samples
FROM folded LEFT JOIN samples USING (import_id, "column")""",
)
def profile_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile(part_values(spark, sf_dir), ["import_id"])
    return found.withColumn("samples", F.array_join("sample_values", "|")).drop("sample_values")


@query(
    "p01_clean_values",
    f"""WITH {VALUES_SQL}, {CLEAN_SQL}
SELECT import_id, "column", v, count(*) AS n, min(row_idx) AS first_row FROM clean GROUP BY 1, 2, 3""",
)
def clean_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_values(part_values(spark, sf_dir), ["import_id"])


@query(
    "p13_first_samples",
    f"""WITH {VALUES_SQL}, {CLEAN_SQL}, {PROFILE_SQL}
SELECT import_id, "column", samples FROM samples""",
)
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = first_samples(distinct_values(part_values(spark, sf_dir), ["import_id"]), ["import_id"])
    return found.select("import_id", "column", F.array_join("sample_values", "|").alias("samples"))


@query(
    "p07_parse_dates",
    """WITH v AS (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')
    WHEN 2 THEN strftime(ts, '%d/%m/%Y') ELSE strftime(ts, '%-d-%-m-%Y') END AS text, ts FROM events)
SELECT event_id, text, CASE WHEN event_id % 4 < 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
  ELSE strftime(ts, '%Y-%m-%d 00:00:00') END AS parsed, CASE WHEN event_id % 4 < 2 THEN hour(ts)+minute(ts)+second(ts) > 0 ELSE false END AS timed
FROM v""",
)
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts")
    k = F.col("event_id") % 4
    text = (
        F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(k == 2, F.date_format("ts", "dd/MM/yyyy"))
        .otherwise(F.date_format("ts", "d-M-yyyy"))
    )
    parsed = profile_timestamp(F.col("text"))
    return ev.select("event_id", text.alias("text")).select(
        "event_id", "text", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"), has_time_of_day(parsed).alias("timed")
    )


@query(
    "p02_text_lengths",
    """WITH v AS (
  SELECT 'lang' AS "column", trim(lang) AS v FROM documents UNION ALL SELECT 'source', trim(source) FROM documents
  UNION ALL SELECT 'text', trim(text, ' ' || chr(9) || chr(10) || chr(13)) FROM documents)
SELECT "column", count(*) AS n_values, min(length(v)) AS min_length, max(length(v)) AS max_length, count(DISTINCT v) AS n_distinct
FROM v WHERE v <> '' AND lower(v) NOT IN ('null', 'nan') GROUP BY 1""",
)
def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = positioned(spark, sf_dir, "documents", ["lang", "source", "text"])
    found = profile(unpivot(docs, ["lang", "source", "text"]))
    return found.select("column", "n_values", "min_length", "max_length", "n_distinct")


ORDER_VALUES_SQL = "o AS (SELECT row_number() OVER () AS row_idx, * FROM orders), vals AS (" + " UNION ALL ".join(
    f"""SELECT row_idx, 0 AS import_id, '{c}' AS "column", CAST({c} AS VARCHAR) AS value FROM o"""
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")) + ")"


@query(
    "p12_profile_orders",
    f"""WITH {ORDER_VALUES_SQL}, {CLEAN_SQL}, {PROFILE_SQL}
SELECT folded.* EXCLUDE (import_id), CASE WHEN n_values > 0 THEN {round2_sql('n_distinct / n_values')} ELSE 0.0 END AS uniqueness_ratio,
  CASE WHEN is_boolean THEN 'boolean' WHEN is_datetime THEN 'datetime' WHEN is_date THEN 'date' WHEN is_email_like THEN 'email-like'
    WHEN is_phone_like THEN 'phone-like' WHEN is_numeric_string THEN 'numeric-string' WHEN is_integer THEN 'integer'
    WHEN is_decimal THEN 'decimal' ELSE 'string' END AS inferred_type, coalesce(samples, '') AS samples
FROM folded LEFT JOIN samples USING (import_id, "column")""",
)
def profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = positioned(spark, sf_dir, "orders")
    cols = [c for c in orders.columns if c != "row_idx"]
    found = profile(unpivot(orders, cols))
    return found.withColumn("samples", F.array_join("sample_values", "|")).drop("sample_values")


@query(
    "p13_long_samples",
    """WITH d AS (SELECT row_number() OVER () AS row_idx, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS v, lang FROM documents),
firsts AS (SELECT lang, v, min(row_idx) AS first_row FROM d WHERE v <> '' AND lower(v) NOT IN ('null', 'nan') GROUP BY 1, 2),
tops AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY first_row) AS rk FROM firsts)
SELECT lang, string_agg(md5(v), '|' ORDER BY rk) AS samples FROM tops WHERE rk <= 4 GROUP BY 1""",
)
def long_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as values of one column per language; only the samples' texts are fetched."""
    docs = positioned(spark, sf_dir, "documents", ["lang", "text"])
    found = profile(unpivot(docs, ["text"], ["lang"]), ["lang"])
    return found.select("lang", F.array_join(F.transform("sample_values", lambda v: F.md5(v.cast("binary"))), "|").alias("samples"))

