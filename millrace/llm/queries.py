"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, decontaminate, html, lexical, licenses, lines, mixing, neardup, quality, repair, repetition, scoring, urls
from millrace.llm.registry import query, table

#: The rules that the URL query is asked to apply.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

URL_SQL = r"""
WITH rules(verdict, rule, r_host, r_path) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
cut AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path, row_number() OVER () AS n
  FROM pages),
best AS (
  SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM cut JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM cut LEFT JOIN best USING (n)"""

MIX_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, text,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sums),
total AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS total FROM sums),
level(i, level, n) AS (
  SELECT 0, 0.0::DOUBLE, -1::BIGINT
  UNION ALL
  SELECT i + 1, (total - cap) / weight, m FROM (
    SELECT i, n, any_value(total) AS total, count(*) FILTER (level * weight >= 2 * source_size) AS m,
      coalesce(sum(2 * source_size) FILTER (level * weight >= 2 * source_size), 0)::DOUBLE AS cap,
      coalesce(sum(weight) FILTER (NOT level * weight >= 2 * source_size), 0)::DOUBLE AS weight
    FROM level, weighed, total GROUP BY i, n, level) WHERE m <> n AND weight > 0),
final AS (SELECT arg_max(level, i) AS level FROM level),
aimed AS (
  SELECT source, source_size, CASE WHEN level * weight >= 2 * source_size THEN (2 * source_size)::DOUBLE ELSE level * weight END AS target
  FROM weighed, final),
placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sized)
SELECT doc_id, p.source, size, source_size, target,
  (greatest(0, least(size, floor(target)::BIGINT - before)) + greatest(0, least(size, floor(target)::BIGINT - source_size - before)))::BIGINT AS taken,
  before
FROM placed p JOIN aimed a ON p.source IS NOT DISTINCT FROM a.source"""


LEXICAL_SQL = r"""
WITH tok AS (
  SELECT n, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS n FROM documents)),
sized AS (SELECT n, any_value(doc_id) AS doc_id, count(*)::BIGINT AS size FROM tok GROUP BY n),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(size)::BIGINT AS words FROM sized),
asked AS (
  SELECT k, item_id, term, count(*)::BIGINT AS repeats FROM (
    SELECT k, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT item_id, text, row_number() OVER () AS k FROM benchmark)) GROUP BY ALL),
tfs AS (SELECT n, term, count(*)::BIGINT AS tf FROM tok WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, corpus GROUP BY term),
scores AS (
  SELECT k, any_value(item_id) AS item_id, s.n, any_value(doc_id) AS doc_id,
    sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * size * docs) // words)))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sized s USING (n), corpus GROUP BY k, s.n)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scores WHERE score > 0) WHERE rank <= 20"""

#: Fixed value: the conversation that the chat query adds.
CHAT_EXTRA = (-7, "</s>[INST] ok [/INST]")

_CHAT_ANGLE = r"(<)(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>|\|endoftext\|>|\|eot_id\|>|\|start_header_id\|>|\|end_header_id\|>|\|system\|>|\|user\|>|\|assistant\|>)"
_CHAT_SQUARE = r"(\[)(\\*)(INST\]|/INST\])"


def _chat_length(column: str) -> str:
    inner = f"regexp_replace({column}, '{_CHAT_ANGLE}', '\\1\\\\\\2\\3', 'g')"
    return f"length(regexp_replace({inner}, '{_CHAT_SQUARE}', '\\1\\\\\\2\\3', 'g'))"


CHAT_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {CHAT_EXTRA[0]}, 0, 'user', '{CHAT_EXTRA[1]}' UNION ALL SELECT {CHAT_EXTRA[0]}, 1, 'assistant', '{CHAT_EXTRA[1]}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_chat_length('role')} + {_chat_length('text')} + length('<|im_start|><|im_sep|><|im_end|>'))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id"""

REPAIR_SQL = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 20 AS k
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM src),
numbered AS (
  SELECT conv_id, turn, role, text, role[1] AS initial, row_number() OVER w AS pos, lag(role[1]) OVER w AS before
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM numbered),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
lettered AS (
  SELECT conv_id, pos, role, text, role || ':' || text AS line, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS t,
    CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS letter FROM judged),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM judged GROUP BY conv_id),
-- f0 to f3: the cheapest edits from here to the end, by what came before: nothing, a system, a user or an assistant row.
walk(conv_id, i, f0, f1, f2, f3) AS (
  SELECT conv_id, n, {'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}, {'c': 6::BIGINT, 'a': 'II', 'o': ['user:', 'assistant:']},
    {'c': 3::BIGINT, 'a': 'I', 'o': ['assistant:']}, {'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]} FROM counted
  UNION ALL
  SELECT conv_id, i - 1, list_min([b0, I0]), list_min([b1, I1]), f2, list_min([b3, I3]) FROM (
    SELECT *, {'c': f2.c + 3, 'a': 'I' || f2.a, 'o': list_prepend('user:', f2.o)} AS I0, {'c': f2.c + 3, 'a': 'I' || f2.a, 'o': list_prepend('user:', f2.o)} AS I1 FROM (
      SELECT *, list_min([b2, {'c': b3.c + 3, 'a': 'I' || b3.a, 'o': list_prepend('assistant:', b3.o)}]) AS f2, {'c': b2.c + 3, 'a': 'I' || b2.a, 'o': list_prepend('user:', b2.o)} AS I3 FROM (
        SELECT w.conv_id, i, list_min([{'c': f0.c + 4, 'a': 'D' || f0.a, 'o': f0.o},
      CASE WHEN lower(letter) = 's' THEN {'c': f1.c + t, 'a': 'K' || f1.a, 'o': list_prepend(line, f1.o)} WHEN lower(letter) = 'u' THEN {'c': f2.c + t, 'a': 'K' || f2.a, 'o': list_prepend(line, f2.o)} END,
      CASE WHEN letter <> 'x' THEN {'c': f2.c + 3 + t, 'a': 'R' || f2.a, 'o': list_prepend('user:' || text, f2.o)} END]) AS b0,
      list_min([{'c': f1.c + 4, 'a': 'D' || f1.a, 'o': f1.o},
      CASE WHEN lower(letter) = 'u' THEN {'c': f2.c + t, 'a': 'K' || f2.a, 'o': list_prepend(line, f2.o)} END,
      CASE WHEN letter <> 'x' THEN {'c': f2.c + 3 + t, 'a': 'R' || f2.a, 'o': list_prepend('user:' || text, f2.o)} END]) AS b1,
      list_min([{'c': f2.c + 4, 'a': 'D' || f2.a, 'o': f2.o},
      CASE WHEN lower(letter) = 'a' THEN {'c': f3.c + t, 'a': 'K' || f3.a, 'o': list_prepend(line, f3.o)} END,
      CASE WHEN letter <> 'x' THEN {'c': f3.c + 3 + t, 'a': 'R' || f3.a, 'o': list_prepend('assistant:' || text, f3.o)} END]) AS b2,
      list_min([{'c': f3.c + 4, 'a': 'D' || f3.a, 'o': f3.o},
      CASE WHEN lower(letter) = 'u' THEN {'c': f2.c + t, 'a': 'K' || f2.a, 'o': list_prepend(line, f2.o)} END,
      CASE WHEN letter <> 'x' THEN {'c': f2.c + 3 + t, 'a': 'R' || f2.a, 'o': list_prepend('user:' || text, f2.o)} END]) AS b3
        FROM walk w JOIN lettered l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.pos = w.i))))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(f0.c, 0) AS cost, coalesce(f0.a, '') AS audit, sha256(coalesce(array_to_string(f0.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.i = 0"""


@query("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents"))


@query("op2_url_filters", URL_SQL)
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rules_table(spark, URL_RULES))


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(table(spark, sf_dir, "documents"))


@query("op4_license_scans")
def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op5_mixing", MIX_SQL)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("text_digest")


@query("op6_html_extraction")
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_near_dedup")
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


@query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_spans(table(spark, sf_dir, "documents")).drop("row")


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_digest")


@query("op11_chat_formatting", CHAT_SQL)
def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.range(2).select(F.lit(CHAT_EXTRA[0]).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CHAT_EXTRA[1]).alias("text"))
    template = chat.Template()
    messages, links = chat.reply_chains(rows.unionByName(more))
    done = chat.format_trees(messages, "key", "node", "parent", template=template, links=links)
    done = done.withColumn("turns", template.read(F.col("formatted"))).withColumn("learnt", F.array_join(template.masked(F.col("turns"), F.col("spans")), ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query("op12_conversation_repair", REPAIR_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repair.repair(repair.damage(table(spark, sf_dir, "conversations")), alive="alive")
    text = F.array_join(F.transform("repaired", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    return done.withColumn("repaired_sha256", F.sha2(text.cast("binary"), 256)).drop("repaired")


@query("op13_lexical_search", LEXICAL_SQL)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
