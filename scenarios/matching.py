"""M: headers of many imports against their declared columns.

Two kinds of input: real names (headers and declared columns built from ``part``,
profiled over ``lineitem`` values), and line items read as scored candidates, which
gives the decision operators one row per line with exact scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import column_key, name_tokens, normalise_name
from millrace.operators import catalog as C
from millrace.operators import match as M
from millrace.operators.profile import profile
from millrace.session import stage
from scenarios.base import positioned, query, table
from scenarios.catalogs import BY, PARTS_SQL, WORDS, _case, columns, keys, references
from scenarios.profiling import CLEAN_SQL, PROFILE_SQL, VALUES_SQL, part_values

# Fixed values of the scenario: headers of the first five columns of a table.
HEADERS = {0: "record id", 1: "column 1", 2: "Email", 3: "created date", 4: "Active Flag"}

#: Fixed values of the scenario: value patterns given to headers in turn.
PART_TYPES = ("email-like", "phone-like", "datetime", "boolean", "string")

HEADERS_SQL = f"""
heads AS (
  SELECT p_partkey, p_partkey // 40 AS import_id,
    CASE WHEN (p_partkey // 10) % 4 = 0 THEN '' ELSE {_case('(p_partkey // 10) % 8', dict(enumerate(WORDS)))} END || ' ' END ||
    {_case('p_partkey % 10', HEADERS)} ELSE CASE (p_partkey // 10) % 3 WHEN 0 THEN p_name || '-' || (p_partkey % 10)
      WHEN 1 THEN split_part(p_name, ' ', 2) || '.' || split_part(p_name, ' ', 1) ELSE upper(replace(p_name, ' ', '')) END END AS header
  FROM part)"""


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    word, base = F, F
    for k, v in enumerate(WORDS):
        word = word.when(F.floor(key / 10) % 8 == k, F.lit(v + " "))
    for k, v in HEADERS.items():
        base = base.when(key % 10 == k, F.lit(v))
    style = F.floor(key / 10) % 3
    parts = F.split("p_name", " ")
    base = base.otherwise(
        F.when(style == 0, F.concat(F.col("p_name"), F.lit("-"), (key % 10).cast("string")))
        .when(style == 1, F.concat(parts[1], F.lit("."), parts[0]))
        .otherwise(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))))
    )
    prefix = F.when(F.floor(key / 10) % 4 == 0, F.lit("")).otherwise(word)
    return table(spark, sf_dir, "part").select("p_partkey", F.floor(key / 40).alias("import_id"), F.concat(prefix, base).alias("header"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiled headers: the values of a header are those of its import's kind of text."""
    heads = headers(spark, sf_dir).groupBy("import_id", F.col("header").alias("source")).agg(F.min("p_partkey").alias("src_pos"))
    kinds = profile(part_values(spark, sf_dir), BY).withColumnRenamed("column", "kind")
    heads = heads.withColumn("kind", F.concat(F.lit("kind "), (F.col("src_pos") % 10).cast("string")))
    return heads.join(kinds, ["import_id", "kind"]).drop("kind")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = columns(spark, sf_dir)
    marked = C.column_roles(C.mark_primary_keys(C.with_category(cols), keys(cols), BY), references(cols), BY)
    length = F.when(F.lower("sql_type").contains("char"), F.regexp_extract("sql_type", r"\((\d+)", 1).try_cast("int"))
    return marked.select(
        "import_id", "table", "name", F.col("p_partkey").alias("target_pos"), "sql_type", "data_type", length.alias("length"),
        "nullable", "is_identity", "has_default", "is_pk", "role",
    )


@query(
    "m01_header_names",
    f"""WITH {HEADERS_SQL}
SELECT p_partkey, header, regexp_replace(lower(header), '[\\s_.\\-]+', '', 'g') AS norm,
  array_to_string(list_filter(string_split_regex(lower(regexp_replace(header, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[\\s_.\\-]+'), lambda x: x <> ''), '|') AS words,
  replace(lower(header), ' ', '_') AS key FROM heads""",
)
def header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2, G12, C9."""
    h = F.col("header")
    return headers(spark, sf_dir).select(
        "p_partkey", "header", normalise_name(h).alias("norm"), F.array_join(name_tokens(h), "|").alias("words"), column_key(h).alias("key")
    )


@query(
    "m03_type_compatibility",
    f"""WITH {PARTS_SQL}, {VALUES_SQL}, {CLEAN_SQL}, {PROFILE_SQL},
prof AS (SELECT *, CASE WHEN is_boolean THEN 'boolean' WHEN is_datetime THEN 'datetime' WHEN is_date THEN 'date' WHEN is_email_like THEN 'email-like'
    WHEN is_phone_like THEN 'phone-like' WHEN is_numeric_string THEN 'numeric-string' WHEN is_integer THEN 'integer'
    WHEN is_decimal THEN 'decimal' ELSE 'string' END AS t FROM folded),
tgt AS (SELECT *, CASE p_partkey % 10 WHEN 0 THEN 'integer' WHEN 3 THEN 'date' WHEN 4 THEN 'boolean' WHEN 5 THEN 'integer'
  WHEN 6 THEN 'float' WHEN 8 THEN 'date' WHEN 9 THEN 'integer' ELSE 'string' END AS d,
  EXISTS (SELECT 1 FROM pks WHERE pks.import_id = cols.import_id AND lower(pks."table") = lower(cols."table") AND lower(pks."column") = lower(cols.name)) AS is_pk FROM cols)
SELECT p_partkey, "column" AS kind, CASE
  WHEN (is_pk OR is_identity) AND d = 'integer' AND NOT is_integer THEN 'SQL column is integer Primary Key / Identity but Excel values are not integers'
  WHEN d = 'integer' AND (t IN ('date','datetime','email-like','phone-like') OR (t = 'string' AND NOT is_integer)) THEN 'SQL expects integer but Excel values are ' || t
  WHEN d = 'float' AND (t IN ('date','datetime','email-like','phone-like') OR (t = 'string' AND NOT is_numeric)) THEN 'SQL expects numeric/decimal but Excel values are ' || t
  WHEN d = 'date' AND t IN ('integer','decimal','email-like','phone-like','boolean') THEN 'SQL expects date/datetime but Excel values are ' || t
  WHEN d = 'boolean' AND NOT is_boolean AND t NOT IN ('integer','boolean') THEN 'SQL expects boolean but Excel values are ' || t END AS problem
FROM tgt JOIN prof ON prof.import_id = tgt.import_id AND "column" = 'kind ' || ((p_partkey * 3 + p_partkey // 10) % 10)""",
)
def type_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("target_pos")
    tgt = targets(spark, sf_dir).withColumn("kind", F.concat(F.lit("kind "), ((key * 3 + F.floor(key / 10)) % 10).cast("string")))
    prof = profile(part_values(spark, sf_dir), BY).withColumnRenamed("column", "kind")
    return tgt.join(prof, ["import_id", "kind"]).select(key.alias("p_partkey"), "kind", M.incompatibility().alias("problem"))


NAMES_SQL = f"""
t AS (SELECT *, regexp_replace(lower(name), '[\\s_.\\-]+', '', 'g') AS tn, lower("table") AS tbl,
  list_distinct(list_filter(string_split_regex(lower(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[\\s_.\\-]+'), lambda x: x <> '')) AS tw FROM cols),
s AS (SELECT import_id, header AS source, min(p_partkey) AS src_pos, regexp_replace(lower(header), '[\\s_.\\-]+', '', 'g') AS sn,
  list_distinct(list_filter(string_split_regex(lower(regexp_replace(header, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[\\s_.\\-]+'), lambda x: x <> '')) AS sw
  FROM heads GROUP BY ALL)"""


@query(
    "m05_name_tiers",
    f"""WITH {PARTS_SQL}, {HEADERS_SQL}, {NAMES_SQL},
j AS (SELECT t.import_id, t.p_partkey, t.name, s.source, tn, sn, tbl, tw, sw,
  regexp_full_match(lower(name), '(col|column|field|attr|attribute|temp|extra|misc|custom)?_?[0-9]+') AS generic FROM t JOIN s USING (import_id)),
r AS (SELECT p_partkey, source, CASE
  WHEN generic THEN CASE WHEN tn = sn OR (contains(tn, sn) AND length(sn) >= length(tn) - 1) THEN 0.98 END
  WHEN lower(trim(name)) = lower(trim(source)) THEN 1.0 WHEN tn = sn THEN 0.98
  WHEN tbl || tn = sn OR tn = tbl || sn THEN 0.96
  WHEN len(sw) > 0 AND len(list_filter(sw, lambda x: NOT list_contains(tw, x))) = 0
    AND len(list_filter(tw, lambda x: NOT list_contains(sw, x) AND x <> tbl)) = 0 THEN 0.95 END AS score FROM j)
SELECT p_partkey, source, CAST(score AS DOUBLE) AS score FROM r WHERE score IS NOT NULL""",
)
def name_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, M6, M11 alone: types are made compatible so that only names decide."""
    tgt = targets(spark, sf_dir).withColumns({"data_type": F.lit("string"), "length": F.lit(None).cast("int")})
    heads = headers(spark, sf_dir).groupBy("import_id", F.col("header").alias("source")).agg(F.min("p_partkey").alias("src_pos"))
    plain = {"inferred_type": F.lit("string"), "sample_values": F.array().cast("array<string>"), "min_length": F.lit(1)}
    flags = {f: F.lit(False) for f in ("is_integer", "is_numeric", "is_boolean")}
    found = M.candidates(tgt, heads.withColumns({**plain, **flags}), BY)
    fixed = ("Direct match to generic column name", "Exact column name match", "Normalized column name match",
             "Compound table-prefixed match", "Entity-scoped column match")
    return found.where(F.col("reason").isin(*fixed)).select(F.col("target_pos").alias("p_partkey"), "source", "score")


@query(
    "m07_word_overlap",
    f"""WITH {PARTS_SQL}, {HEADERS_SQL}, {NAMES_SQL},
j AS (SELECT t.p_partkey, s.source, len(list_intersect(tw, sw)) AS common, len(tw) + len(sw) AS total FROM t JOIN s USING (import_id)
  WHERE list_has_any(tw, sw))
SELECT p_partkey, source, common / (total - common) AS jaccard FROM j""",
)
def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 over the pairs that share a word."""
    tgt = M.prepare_targets(columns(spark, sf_dir)).select("import_id", "p_partkey", "t_words", F.explode("t_words").alias("w"))
    heads = headers(spark, sf_dir).select("import_id", F.col("header").alias("source")).distinct()
    src = heads.withColumn("s_words", F.array_distinct(name_tokens(F.col("source"))))
    met = tgt.join(src.withColumn("w", F.explode("s_words")), ["import_id", "w"])
    once = met.where(F.col("w") == F.array_min(F.array_intersect("t_words", "s_words")))
    return once.select("p_partkey", "source", M.jaccard(F.col("t_words"), F.col("s_words")).alias("jaccard"))


@query(
    "m09_score_parts",
    f"""WITH {PARTS_SQL}, {HEADERS_SQL}, {NAMES_SQL},
j AS (SELECT t.p_partkey, s.source, tw, sw, {_case('src_pos % 5', dict(enumerate(PART_TYPES)))} END AS kind FROM t JOIN s USING (import_id)),
p AS (SELECT p_partkey, source, len(list_filter(tw, lambda x: len(list_filter(sw, lambda y: x = y OR (length(x) >= 4 AND length(y) >= 4 AND (contains(x, y) OR contains(y, x))))) > 0)) > 0 AS shared,
  CASE WHEN kind = 'email-like' AND len(list_filter(tw, lambda w: contains(w, 'mail'))) > 0 THEN 0.20
    WHEN kind = 'phone-like' AND list_has_any(tw, {list(M.PHONE_WORDS)}) THEN 0.20 WHEN kind = 'datetime' AND list_has_any(tw, {list(M.DATE_WORDS)}) THEN 0.15
    WHEN kind = 'boolean' AND list_has_any(tw, {list(M.FLAG_WORDS)}) THEN 0.15 ELSE 0.0 END::DOUBLE AS bonus FROM j)
SELECT * FROM p WHERE shared OR bonus > 0""",
)
def score_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What words and value patterns add to the sequence ratio, over every pair of an import."""
    kind = F.element_at(F.array(*map(F.lit, PART_TYPES)), (F.col("src_pos") % 5 + 1).cast("int"))
    tgt = M.prepare_targets(columns(spark, sf_dir)).select("import_id", "p_partkey", "t_words")
    heads = headers(spark, sf_dir).groupBy("import_id", F.col("header").alias("source")).agg(F.min("p_partkey").alias("src_pos"))
    src = heads.select("import_id", "source", kind.alias("inferred_type"), F.array_distinct(name_tokens(F.col("source"))).alias("s_words"))
    found = tgt.join(src, "import_id").select("p_partkey", "source", M.shares_word(F.col("t_words"), F.col("s_words")).alias("shared"), M.pattern_bonus().alias("bonus"))
    return found.where("shared OR bonus > 0")


@query("m08_candidates")
def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3-M12 end to end with the sequence ratio; no SQL counterpart of that ratio exists."""
    found = M.candidates(targets(spark, sf_dir), sources(spark, sf_dir), BY)
    return M.ranked(found, BY).withColumn("sample_values", F.array_join("sample_values", "|"))


@query("m13_match_plans")
def match_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13-M17 end to end on names and values."""
    tgt, src = stage(targets(spark, sf_dir)), stage(sources(spark, sf_dir))
    planned = M.plans(tgt, M.candidates(tgt, src, BY), BY)
    return M.one_to_one(planned, BY).drop("top")


# -- line items as scored candidates ----------------------------------------------------
SCORED_SQL = """
li AS (SELECT row_number() OVER () AS row_idx, * FROM lineitem),
cand AS (SELECT l_orderkey AS import_id, 'line ' || l_linenumber AS "column", l_linenumber AS target_pos, 'p' || l_partkey AS source,
  min(row_idx) AS src_pos, max((50 + l_quantity) / 100.0::DOUBLE) AS score FROM li GROUP BY 1, 2, 3, 4),
tgt AS (SELECT l_orderkey AS import_id, 'line ' || l_linenumber AS "column", l_linenumber AS target_pos,
  (l_orderkey + l_linenumber) % 5 = 0 AS is_identity, (l_orderkey + l_linenumber) % 5 = 1 AS has_default, (l_orderkey + l_linenumber) % 5 <> 2 AS nullable
  FROM lineitem GROUP BY ALL),
fall AS (SELECT *, CASE WHEN is_identity THEN 'DATABASE_GENERATED' WHEN has_default THEN 'DEFAULT' WHEN nullable THEN 'NULL' ELSE 'VALIDATION_ERROR' END AS fallback FROM tgt),
rk AS (SELECT *, row_number() OVER (PARTITION BY import_id, "column" ORDER BY score DESC, src_pos) AS rank FROM cand),
best AS (SELECT import_id, "column", max(CASE WHEN rank = 1 THEN source END) AS s1, max(CASE WHEN rank = 1 THEN score END) AS x1,
  max(CASE WHEN rank = 2 THEN score END) AS x2, string_agg(source, ',' ORDER BY rank) FILTER (rank <= 3) AS top FROM rk GROUP BY 1, 2),
p0 AS (SELECT fall.*, top, x1, s1, CASE WHEN x1 >= 0.9 AND (x2 IS NULL OR x1 - x2 >= 0.1::DOUBLE) THEN 'IMPORT' WHEN x1 >= 0.5 THEN 'PENDING_LLM' ELSE fallback END AS action
  FROM fall LEFT JOIN best USING (import_id, "column")),
planned AS (SELECT *, CASE WHEN action = 'IMPORT' THEN s1 END AS source, CASE WHEN action IN ('IMPORT', 'PENDING_LLM') THEN CAST(trunc(x1 * 100) AS INT)
  WHEN fallback = 'VALIDATION_ERROR' THEN 0 ELSE 100 END AS confidence FROM p0)"""

ANSWERS_SQL = """
answer AS (SELECT l_orderkey AS import_id, 'LINE ' || l_linenumber AS "column", arg_max(CASE WHEN l_partkey % 4 = 0 THEN 'NO_MATCH' ELSE 'match' END, row_idx) AS status,
  arg_max('P' || l_partkey, row_idx) AS src, arg_max(l_discount, row_idx) * 10 AS conf FROM li GROUP BY 1, 2),
settled AS (SELECT p.import_id, p."column", p.target_pos, p.fallback, p.action = 'PENDING_LLM' AS was_open,
  p.action = 'PENDING_LLM' AND a.status = 'match' AND c.source IS NOT NULL AS hit, c.source AS csource, c.score AS cscore, a.conf, p.source, p.action, p.confidence
  FROM planned p LEFT JOIN answer a ON a.import_id = p.import_id AND lower(a."column") = lower(p."column")
  LEFT JOIN rk c ON c.import_id = p.import_id AND c."column" = p."column" AND c.rank <= 3 AND lower(c.source) = lower(a.src)),
final AS (SELECT import_id, "column", target_pos, fallback, CASE WHEN hit THEN csource WHEN was_open THEN NULL ELSE source END AS source,
  CASE WHEN hit THEN 'IMPORT' WHEN was_open THEN fallback ELSE action END AS action,
  CASE WHEN hit THEN CAST(trunc((CASE WHEN conf > 0 THEN conf ELSE cscore END) * 100) AS INT) WHEN was_open THEN CASE WHEN fallback = 'VALIDATION_ERROR' THEN 0 ELSE 100 END ELSE confidence END AS confidence,
  CASE WHEN hit THEN 'LLM' WHEN action = 'IMPORT' THEN 'STANDARD' WHEN fallback = 'VALIDATION_ERROR' THEN 'NONE' ELSE 'SCHEMA_DEFAULT' END AS method FROM settled),
won AS (SELECT *, CASE WHEN action = 'IMPORT' THEN row_number() OVER (PARTITION BY import_id, source, action ORDER BY confidence DESC, target_pos) ELSE 1 END AS turn FROM final),
one AS (SELECT import_id, "column", target_pos, CASE WHEN turn = 1 THEN source END AS source, CASE WHEN turn = 1 THEN action ELSE fallback END AS action,
  confidence, CASE WHEN turn = 1 THEN method ELSE 'CONFLICT' END AS method, turn > 1 AS has_conflict FROM won)"""


def _line_source():
    return F.concat(F.lit("p"), F.col("l_partkey").cast("string"))


def line_candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = positioned(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    column = F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))
    # Numbers meet in the exchange; their text is made after it.
    found = li.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.min("row_idx").alias("src_pos"), F.max((F.col("l_quantity") + 50) / 100).alias("score"))
    found = found.select(
        F.col("l_orderkey").alias("import_id"), column.alias("column"), F.col("l_linenumber").alias("target_pos"), _line_source().alias("source"), "src_pos", "score")
    found = found.select(
        "import_id", F.lit("Lines").alias("table"), "column", "target_pos", "source", "src_pos", "score", F.lit("scored").alias("reason"),
        F.lit("string").alias("inferred_type"), F.array("source").alias("sample_values"),
    )
    turn = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    tgt = li.select("l_orderkey", "l_linenumber").distinct().select(
        F.col("l_orderkey").alias("import_id"), F.lit("Lines").alias("table"), column.alias("name"), F.col("l_linenumber").alias("target_pos"),
        F.lit("int").alias("sql_type"), F.lit("Normal").alias("role"),
        (turn == 0).alias("is_identity"), (turn == 1).alias("has_default"), (turn != 2).alias("nullable"),
    )
    return tgt, found


def line_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = positioned(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_discount"])
    return li.select(
        F.col("l_orderkey").alias("import_id"), F.lit("LINES").alias("table"),
        F.concat(F.lit(" LINE "), F.col("l_linenumber").cast("string")).alias("column"),
        F.when(F.col("l_partkey") % 4 == 0, F.lit("NO_MATCH")).otherwise(F.lit("match")).alias("status"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("source"), (F.col("l_discount") * 10).alias("confidence"),
        F.lit("seen").alias("reason"), F.col("row_idx").alias("decision_pos"),
    )


def line_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.plans(*line_candidates(spark, sf_dir), BY)


def settled_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.apply_decisions(line_plans(spark, sf_dir), line_answers(spark, sf_dir), BY)


def final_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.one_to_one(stage(settled_plans(spark, sf_dir), "plans"), BY)


def line_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of the candidates, by one exchange of their two numbers."""
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return pairs.select(F.col("l_orderkey").alias("import_id"), _line_source().alias("source"), F.lit("string").alias("inferred_type"),
                        F.array(_line_source()).alias("sample_values"))


@query("m12_ranked", f"""WITH {SCORED_SQL} SELECT import_id, "column", source, score, CAST(rank AS INT) AS rank FROM rk""")
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = line_candidates(spark, sf_dir)
    return M.ranked(found, BY).select("import_id", "column", "source", "score", "rank")


@query("m13_auto_accept", f"""WITH {SCORED_SQL} SELECT import_id, "column", source, action, confidence, coalesce(top, '') AS top FROM planned""")
def auto_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.array_join(F.transform("top", lambda c: c["source"]), ",")
    return line_plans(spark, sf_dir).select("import_id", "column", "source", "action", "confidence", top.alias("top"))


@query(
    "o16_ambiguous_lines",
    f"""WITH {SCORED_SQL}, listed AS (SELECT *, 'T' || import_id AS t FROM cand),
placed AS (SELECT *, row_number() OVER (ORDER BY source, score DESC, t, "column") AS item, row_number() OVER (PARTITION BY source ORDER BY score DESC, t, "column") AS nth FROM listed)
SELECT item, CASE WHEN nth = 1 THEN '--   Excel Column: ' || source || chr(10) ELSE '' END || '--     Candidate: ' || t || '.' || "column" || ' (Confidence: ' || score || ')' AS text FROM placed""",
)
def ambiguous_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a candidate; one list over all imports."""
    from millrace.operators.render import ambiguous_lines as lines

    _, found = line_candidates(spark, sf_dir)
    return lines(found.select("source", F.concat(F.lit("T"), F.col("import_id").cast("string")).alias("table"), "column", "score"))


@query("m14_review_queue", f"""WITH {SCORED_SQL} SELECT import_id, "column", top AS candidates FROM planned WHERE action = 'PENDING_LLM'""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform("candidates", lambda c: c["source"]), ",")
    return M.review_queue(line_plans(spark, sf_dir), BY).select("import_id", "column", shown.alias("candidates"))


@query("m15_decisions", f"""WITH {SCORED_SQL}, {ANSWERS_SQL} SELECT import_id, "column", source, action, confidence, method FROM final""")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled_plans(spark, sf_dir).select("import_id", "column", "source", "action", "confidence", "method")


@query("m17_one_to_one", f"""WITH {SCORED_SQL}, {ANSWERS_SQL} SELECT import_id, "column", source, action, confidence, method, has_conflict FROM one""")
def one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return final_plans(spark, sf_dir).select("import_id", "column", "source", "action", "confidence", "method", "has_conflict")


@query(
    "m18_conflicts",
    f"""WITH {SCORED_SQL}, {ANSWERS_SQL}
SELECT import_id, source, string_agg('[Lines].[' || "column" || ']', ', ' ORDER BY target_pos) AS targets,
 'Excel column ''' || source || ''' was matched to multiple SQL columns (' || string_agg('[Lines].[' || "column" || ']', ', ' ORDER BY target_pos) || ').' AS message
FROM final WHERE action = 'IMPORT' GROUP BY import_id, source HAVING count(*) > 1""",
)
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.conflict_report(settled_plans(spark, sf_dir), BY)


@query(
    "m19_unused_sources",
    f"""WITH {SCORED_SQL}, {ANSWERS_SQL}
SELECT DISTINCT import_id, source, 'NOT_USED' AS action FROM cand c WHERE NOT EXISTS
 (SELECT 1 FROM one WHERE one.import_id = c.import_id AND one.source = c.source)""",
)
def unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.unused_sources(line_sources(spark, sf_dir), final_plans(spark, sf_dir), BY).select("import_id", "source", "action")


@query(
    "m20_source_view",
    f"""WITH {SCORED_SQL}, {ANSWERS_SQL}, s AS (SELECT DISTINCT import_id, source FROM cand)
SELECT s.import_id, s.source, CASE WHEN o.source IS NULL THEN '' ELSE 'Lines' END AS target_table, coalesce(o."column", '') AS target_column,
  coalesce(o.action, 'NOT_USED') AS action, coalesce(o.confidence, 0) AS confidence, coalesce(o.method, 'UNRESOLVED') AS method
FROM s LEFT JOIN one o ON o.import_id = s.import_id AND o.source = s.source""",
)
def source_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = M.source_view(line_sources(spark, sf_dir), final_plans(spark, sf_dir), BY)
    return view.select("import_id", "source", "target_table", "target_column", "action", "confidence", "method")


@query(
    "m21_plans_by_table",
    f"""WITH {SCORED_SQL}, {ANSWERS_SQL}
SELECT import_id, 'Lines' AS "table", string_agg("column" || '=' || action, ',' ORDER BY target_pos) AS plans FROM one GROUP BY 1""",
)
def by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform("plans", lambda p: F.concat(p["column"], F.lit("="), p["action"])), ",")
    return M.plans_by_table(final_plans(spark, sf_dir), BY).select("import_id", "table", shown.alias("plans"))


@query(
    "m22_statistics",
    f"""WITH {SCORED_SQL}, {ANSWERS_SQL},
s AS (SELECT import_id, count(DISTINCT source) AS total FROM cand GROUP BY 1),
c AS (SELECT import_id, count(*) AS n FROM (SELECT import_id, source FROM final WHERE action = 'IMPORT' GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
o AS (SELECT import_id, count(*) FILTER (action = 'IMPORT') AS sql_columns_imported, count(*) FILTER (action = 'DATABASE_GENERATED') AS sql_columns_generated,
  count(*) FILTER (action = 'DEFAULT') AS sql_columns_default, count(*) FILTER (action = 'NULL') AS sql_columns_null,
  count(*) FILTER (action = 'VALIDATION_ERROR') AS sql_columns_validation_error, count(*) FILTER (method = 'LLM') AS review_answers,
  count(DISTINCT CASE WHEN action = 'IMPORT' THEN source END) AS mapped_excel_columns FROM one GROUP BY 1)
SELECT import_id, total AS total_excel_columns, mapped_excel_columns, total - mapped_excel_columns AS unused_excel_columns, sql_columns_imported, sql_columns_generated,
  sql_columns_default, sql_columns_null, sql_columns_validation_error, coalesce(n, 0) AS conflicts, review_answers,
  CASE WHEN review_answers = 0 THEN 'STANDARD' ELSE 'HYBRID' END AS mapping_source
FROM s JOIN o USING (import_id) LEFT JOIN c USING (import_id)""",
)
def plan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    settled = stage(settled_plans(spark, sf_dir), "plans")
    return M.statistics(line_sources(spark, sf_dir), M.one_to_one(settled, BY), M.conflict_report(settled, BY), BY)

