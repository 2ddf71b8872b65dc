"""Matching source columns to declared columns.

Pairs are found through shared name keys instead of a product of both sides. The
keys are complete: every pair that can reach the keep score shares one.

* ``n:`` whole normalised names, with and without the table prefix: equal,
  prefixed and placeholder matches;
* ``w:`` words: anything with a common word;
* ``g:`` four-letter pieces of longer words: containment of words;
* ``c:`` the rarest letters of a name: without a common word the score is the
  sequence ratio plus a bonus of at most 0.20, and that ratio never exceeds the
  Dice overlap of the two letter multisets, so the usual prefix-filter bound for
  set joins applies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.seqratio import sequence_ratio
from millrace.functions.text import name_tokens, normalise_name, round2, strip
from millrace.operators.catalog import unmapped_action
from millrace.operators.lookup import lookup
from millrace.session import stage, stage_facts

# Thresholds and word lists of the scoring rules.
KEEP_SCORE = 0.30
ACCEPT_SCORE = 0.90
ACCEPT_GAP = 0.10
REVIEW_SCORE = 0.50
REVIEW_CANDIDATES = 3
REVIEW_SAMPLES = 3
SHARED_WORD_FLOOR = 0.72
SCORE_CAP = 0.95
PLACEHOLDER_PATTERN = r"(?i)^(col|column|field|attr|attribute|temp|extra|misc|custom)?_?[0-9]+$"
PHONE_WORDS = ("phone", "mobile", "contact", "cell", "tel")
DATE_WORDS = ("date", "time", "created", "modified", "timestamp")
FLAG_WORDS = ("is", "has", "active", "flag", "enabled")

# Letters from rare to common; only the order of block keys depends on it.
LETTER_ORDER = "zqxjkvbpgwyfmcuhldrsnioate"
# Letters and digits that have bits, letters first.
_BITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# Type facts the compatibility rule needs.
_TARGET_TYPES = ("data_type", "is_pk", "is_identity", "length")
_SOURCE_TYPES = ("inferred_type", "is_integer", "is_numeric", "is_boolean", "min_length")
# A block key whose pairs exceed this is split over both sides.
BLOCK_PAIRS = 4_000_000
# A scope with no more pairs than this is compared as a whole.
SCOPE_PAIRS = 250_000
BLOCK_SIDE = 2_000


# -- type compatibility ----------------------------------------------------------------
def incompatibility() -> Column:
    """M3: why a source cannot fill a column; null when it can.

    The length rule applies to text columns only.
    """
    kind, found = F.col("data_type"), F.col("inferred_type")
    text_like = ("date", "datetime", "email-like", "phone-like")
    integer_bad = found.isin(*text_like) | ((found == "string") & ~F.col("is_integer"))
    float_bad = found.isin(*text_like) | ((found == "string") & ~F.col("is_numeric"))
    date_bad = found.isin("integer", "decimal", "email-like", "phone-like", "boolean")
    boolean_bad = ~F.col("is_boolean") & ~found.isin("integer", "boolean")
    short = F.col("length").between(1, 5) & (F.col("min_length") > F.col("length")) & (kind == "string")
    # The message texts.
    return (
        F.when(
            (F.col("is_pk") | F.col("is_identity")) & (kind == "integer") & ~F.col("is_integer"),
            F.lit("SQL column is integer Primary Key / Identity but Excel values are not integers"),
        )
        .when((kind == "integer") & integer_bad, F.concat(F.lit("SQL expects integer but Excel values are "), found))
        .when((kind == "float") & float_bad, F.concat(F.lit("SQL expects numeric/decimal but Excel values are "), found))
        .when((kind == "date") & date_bad, F.concat(F.lit("SQL expects date/datetime but Excel values are "), found))
        .when((kind == "boolean") & boolean_bad, F.concat(F.lit("SQL expects boolean but Excel values are "), found))
        .when(
            F.coalesce(short, F.lit(False)),
            F.concat(
                F.lit("Excel values length ("), F.col("min_length").cast("string"),
                F.lit(") exceed SQL column length ("), F.col("length").cast("string"), F.lit(")"),
            ),
        )
    )


# -- name keys ---------------------------------------------------------------------------
def letters(norm: Column) -> Column:
    """A name as a set: each letter with its occurrence number, rarest first."""
    sorted_letters = F.array_sort(F.filter(F.split(norm, ""), lambda c: c != ""))
    numbered = F.transform(
        sorted_letters,
        lambda c, i: F.struct(
            (-(i + 1 - F.array_position(sorted_letters, c))).alias("again"),
            F.instr(F.lit(LETTER_ORDER), c).alias("rank"),
            c.alias("c"),
        ),
    )
    return F.transform(F.array_sort(numbered), lambda s: F.concat(F.lit("c:"), s["c"], s["again"].cast("string")))


def letter_bits(letter_set: Column) -> Column:
    """A bit for each of the first two occurrences of a letter and the first of a digit, as one long."""

    def bit(e: Column) -> Column:
        again, at = F.substring(e, F.lit(4), F.lit(3)), F.instr(F.lit(_BITS), F.substring(e, 3, 1))
        place = F.when(again == "0", at).when((again == "-1") & at.between(1, 26), at + 36).otherwise(0)
        return F.when(place > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (place - 1).cast("int"))).otherwise(F.lit(0).cast("long"))

    return F.aggregate(letter_set, F.lit(0).cast("long"), lambda held, e: held.bitwiseOR(bit(e)))


def most_common_letters() -> Column:
    """No fewer than the letters both names have: what has a bit is counted, the rest of the shorter one is granted."""
    t, s = F.col("t_bits"), F.col("s_bits")
    return F.bit_count(t.bitwiseAND(s)) + F.least(F.length("t_norm") - F.bit_count(t), F.length("s_norm") - F.bit_count(s))


def rare_letters(letter_set: Column, least_ratio: Column) -> Column:
    """The prefix that any partner reaching ``least_ratio`` must meet."""
    n = F.size(letter_set)
    overlap = F.greatest(F.ceil(n * least_ratio / (2.0 - least_ratio)), F.lit(1))
    return F.slice(letter_set, 1, F.greatest(n - overlap + 1, F.lit(0)).cast("int"))


def word_keys(words: Column) -> Column:
    whole = F.transform(words, lambda w: F.concat(F.lit("w:"), w))
    pieces = F.flatten(
        F.transform(
            F.filter(words, lambda w: F.length(w) >= 4),
            lambda w: F.transform(
                F.sequence(F.lit(1), F.length(w) - 3), lambda i: F.concat(F.lit("g:"), F.substring(w, i, 4))
            ),
        )
    )
    return F.concat(whole, pieces)


def name_keys(*names: Column) -> Column:
    return F.transform(F.array_compact(F.array(*names)), lambda n: F.concat(F.lit("n:"), n))


def _least_ratio(strong: Column, weak: Column) -> Column:
    """The sequence ratio still needed when the best possible bonus is granted (with slack)."""
    return F.when(strong, F.lit(0.09)).when(weak, F.lit(0.14)).otherwise(F.lit(0.29))


def _has_any(words: Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in wanted]))


def prepare_targets(targets: DataFrame) -> DataFrame:
    """Names, words and block keys of declared columns (``table``, ``name`` and metadata)."""
    t = targets.withColumns({
        "t_norm": normalise_name(F.col("name")),
        "t_words": F.array_distinct(name_tokens(F.col("name"))),
        "tbl_norm": normalise_name(F.col("table")),
        "tbl_words": F.array_distinct(name_tokens(F.col("table"))),
        "placeholder": F.col("name").rlike(PLACEHOLDER_PATTERN),
    })
    mail = F.exists("t_words", lambda w: w.contains("mail"))
    strong = mail | _has_any(F.col("t_words"), PHONE_WORDS)
    weak = _has_any(F.col("t_words"), DATE_WORDS) | _has_any(F.col("t_words"), FLAG_WORDS)
    norm, tbl = F.col("t_norm"), F.col("tbl_norm")
    unprefixed = F.when(norm.startswith(tbl), F.substring(norm, F.length(tbl) + 1, F.length(norm)))
    cut_first = F.substring(norm, F.lit(2), F.length(norm))
    cut_last = F.substring(norm, F.lit(1), F.greatest(F.length(norm) - 1, F.lit(0)))
    t = t.withColumn("t_letters", letters(norm)).withColumn("t_bits", letter_bits(F.col("t_letters")))
    open_keys = F.concat(
        name_keys(norm, F.concat(tbl, norm), unprefixed), word_keys(F.col("t_words")),
        rare_letters(F.col("t_letters"), _least_ratio(strong, weak)),
    )
    keys = F.when(F.col("placeholder"), name_keys(norm, cut_first, cut_last)).otherwise(open_keys)
    return t.withColumn("t_keys", _hashed(keys))


def prepare_sources(sources: DataFrame) -> DataFrame:
    """Names, words and block keys of profiled source columns (``source`` is the header)."""
    s = sources.withColumns({
        "s_norm": normalise_name(F.col("source")),
        "s_words": F.array_distinct(name_tokens(F.col("source"))),
    })
    kind = F.col("inferred_type")
    ratio = _least_ratio(kind.isin("email-like", "phone-like"), kind.isin("date", "datetime", "boolean"))
    s = s.withColumn("s_letters", letters(F.col("s_norm"))).withColumn("s_bits", letter_bits(F.col("s_letters")))
    keys = F.concat(name_keys(F.col("s_norm")), word_keys(F.col("s_words")), rare_letters(F.col("s_letters"), ratio))
    return s.withColumn("s_keys", _hashed(keys))


def _hashed(keys: Column) -> Column:
    """Keys as longs: two keys falling together only adds a pair to be scored."""
    return F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k)))


# -- pairing -----------------------------------------------------------------------------
def pair(targets: DataFrame, sources: DataFrame, by: Sequence[str], block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """M3, M4: every compatible (declared column, source column) pair of a scope that could score.

    A pair sharing several keys is emitted once, under the smallest. A key with too
    many pairs is cut into tiles: each target row goes to the tiles of its slice,
    each source row likewise, and every pair meets in exactly one tile.
    """
    named, headed = stage(prepare_targets(targets), "match-targets"), stage(prepare_sources(sources), "match-sources")
    # A scope whose two sides are short meets as it is: fewer rows than its keys would bring together.
    sides = named.groupBy(*by).agg(F.count(F.lit(1)).alias("nt")).join(headed.groupBy(*by).agg(F.count(F.lit(1)).alias("ns")), list(by))
    short = stage(sides.where(F.col("nt") * F.col("ns") <= min(block_pairs, SCOPE_PAIRS)).select(*by), "short-scopes")
    # Short columns make many pairs: tasks follow the cores, not the bytes read.
    tasks = 4 * named.sparkSession.sparkContext.defaultParallelism
    small = named.join(short, list(by)).repartition(tasks, *by).join(headed.drop("s_keys"), list(by)).drop("t_keys").where(incompatibility().isNull())
    large = sides.where(F.col("nt") * F.col("ns") > min(block_pairs, SCOPE_PAIRS)).select(*by)
    if large.isEmpty():
        return _wanted(small, by)
    return _wanted(small, by).unionByName(_wanted(_by_keys(named.join(large, list(by)), headed.join(large, list(by)), by, block_pairs), by))


def _wanted(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    return pairs.select(*by, "table", "name", "target_pos", "placeholder", "t_norm", "t_words", "tbl_norm", "tbl_words", "t_bits",
                        "source", "src_pos", "inferred_type", "s_norm", "s_words", "s_bits")


def _by_keys(named: DataFrame, headed: DataFrame, by: Sequence[str], block_pairs: int) -> DataFrame:
    """Pairs of large scopes that share a name key."""
    # Only identities, keys and type facts travel through the key join.
    t = named.select(*by, "table", "name", "t_keys", *_TARGET_TYPES, F.explode("t_keys").alias("key"))
    s = headed.select(*by, "source", "s_keys", *_SOURCE_TYPES, F.explode("s_keys").alias("key"))
    on = [*by, "key"]
    load = (
        t.groupBy(*on).agg(F.count(F.lit(1)).alias("nt"))
        .join(s.groupBy(*on).agg(F.count(F.lit(1)).alias("ns")), on)
        .where(F.col("nt") * F.col("ns") > block_pairs)
        .select(
            *on, (F.col("nt") + F.col("ns")).alias("weight"),
            F.ceil(F.col("nt") / BLOCK_SIDE).cast("int").alias("t_cuts"),
            F.ceil(F.col("ns") / BLOCK_SIDE).cast("int").alias("s_cuts"),
        )
    )
    hot = stage_facts(load, "hot-keys")
    if hot.rows:
        facts = [(F.col(c), c) for c in on]
        one = F.lit(1)
        t = lookup(t, hot, facts, ["t_cuts", "s_cuts"], "weight", F.xxhash64("table", "name"))
        t = t.withColumn("t_tile", F.pmod(F.xxhash64("table", "name"), F.coalesce("t_cuts", one)).cast("int"))
        t = t.withColumn("s_tile", F.explode(F.sequence(F.lit(0), F.coalesce("s_cuts", one) - 1))).drop("t_cuts", "s_cuts")
        s = lookup(s, hot, facts, ["t_cuts", "s_cuts"], "weight", F.xxhash64("source"))
        s = s.withColumn("s_tile", F.pmod(F.xxhash64("source"), F.coalesce("s_cuts", one)).cast("int"))
        s = s.withColumn("t_tile", F.explode(F.sequence(F.lit(0), F.coalesce("t_cuts", one) - 1))).drop("t_cuts", "s_cuts")
        on = [*on, "t_tile", "s_tile"]
    met = t.join(s, on).where(incompatibility().isNull())
    met = met.where(F.col("key") == F.array_min(F.array_intersect("t_keys", "s_keys")))
    pairs = met.select(*by, "table", "name", "source")
    t_facts = named.select(*by, "table", "name", "target_pos", "placeholder", "t_norm", "t_words", "tbl_norm", "tbl_words", "t_bits")
    s_facts = headed.select(*by, "source", "src_pos", "inferred_type", "s_norm", "s_words", "s_bits")
    return pairs.join(t_facts, [*by, "table", "name"]).join(s_facts, [*by, "source"])


# -- scoring -----------------------------------------------------------------------------
def jaccard(a: Column, b: Column) -> Column:
    """M7 on distinct words."""
    total = F.size(F.array_union(a, b))
    return F.when(total > 0, F.size(F.array_intersect(a, b)) / total).otherwise(F.lit(0.0))


def shares_word(a: Column, b: Column) -> Column:
    """An equal word, or one containing the other with both at least 4 letters."""

    def close(x: Column, y: Column) -> Column:
        long = (F.length(x) >= 4) & (F.length(y) >= 4)
        return (x == y) | (long & (x.contains(y) | y.contains(x)))

    return F.exists(a, lambda x: F.exists(b, lambda y: close(x, y)))


def pattern_bonus() -> Column:
    """The first branch that fits."""
    words, kind = F.col("t_words"), F.col("inferred_type")
    return (
        F.when((kind == "email-like") & F.exists(words, lambda w: w.contains("mail")), F.lit(0.20))
        .when((kind == "phone-like") & _has_any(words, PHONE_WORDS), F.lit(0.20))
        .when(kind.isin("date", "datetime") & _has_any(words, DATE_WORDS), F.lit(0.15))
        .when((kind == "boolean") & _has_any(words, FLAG_WORDS), F.lit(0.15))
        .otherwise(F.lit(0.0))
    )


def score(pairs: DataFrame) -> DataFrame:
    """Add ``score`` and ``reason``; rows below the keep score are dropped.

    Whatever a name or type rule settles is settled first; only the rest is measured.
    """
    tn, sn, tbl = F.col("t_norm"), F.col("s_norm"), F.col("tbl_norm")
    tw, sw = F.col("t_words"), F.col("s_words")
    direct = (tn == sn) | (tn.contains(sn) & (F.length(sn) >= F.length(tn) - 1))
    scoped = (
        (F.size(sw) > 0) & (F.size(F.array_except(sw, tw)) == 0)
        & (F.size(F.array_except(F.array_except(tw, sw), F.col("tbl_words"))) == 0)
    )
    # Each rule: test, score, reason; the first that holds decides. Scores and reasons.
    rules = (
        (F.col("placeholder") & direct, 0.98, "Direct match to generic column name"),
        (F.col("placeholder"), 0.0, "Generic SQL column placeholder requires direct name match"),
        (F.lower(strip(F.col("name"))) == F.lower(strip(F.col("source"))), 1.0, "Exact column name match"),
        (tn == sn, 0.98, "Normalized column name match"),
        ((F.concat(tbl, tn) == sn) | (tn == F.concat(tbl, sn)), 0.96, "Compound table-prefixed match"),
        (scoped, 0.95, "Entity-scoped column match"),
        (F.length("name") <= 2, 0.0, "Short identifier requires exact match"),
    )
    fixed = F
    for test, value, reason in rules:
        fixed = fixed.when(test, F.struct(F.lit(value).alias("score"), F.lit(reason).alias("reason")))
    base = pairs.withColumn("fixed", fixed)
    base = base.withColumns({"bonus": pattern_bonus(), "shared": shares_word(tw, sw), "jac": jaccard(tw, sw)})
    overlap = 2.0 * most_common_letters() / (F.length(tn) + F.length(sn))
    hopeful = F.col("shared") | (overlap + F.col("bonus") >= 0.29)
    base = base.where(F.when(F.col("fixed").isNotNull(), F.col("fixed.score") >= KEEP_SCORE).otherwise(hopeful))

    spent = {"fixed", "bonus", "shared", "jac", "t_norm", "t_words", "tbl_norm", "tbl_words", "t_bits", "s_norm", "s_words", "s_bits", "placeholder"}
    keep = [c for c in base.columns if c not in spent]
    unsettled = F.col("fixed").isNull()
    base = base.select(*keep, "fixed", "bonus", "shared", "jac", "t_norm", "s_norm")
    # One measurement per distinct pair of names over all scopes.
    base = stage(base, "hopeful")
    measured = base.where(unsettled).groupBy("t_norm", "s_norm").agg(F.count(F.lit(1)).alias("pairs"))
    measured = stage_facts(measured.withColumn("seq", sequence_ratio(tn, sn)), "ratios")
    base = lookup(base, measured.renamed("t_norm", "m_t").renamed("s_norm", "m_s"), [(tn, "m_t"), (sn, "m_s")], ["seq"], "pairs", F.xxhash64(*[c for c in keep if c != "sample_values"]))
    seq = F.col("seq")
    best = F.greatest(seq, seq * 0.5 + F.col("jac") * 0.5)
    best = F.when(F.col("shared"), F.greatest(best, F.lit(SHARED_WORD_FLOOR))).otherwise(best)
    base = base.withColumn("final", F.least(best + F.col("bonus"), F.lit(SCORE_CAP)))
    # Reasons by score.
    reason_text = (
        F.when(F.col("final") >= 0.80, F.lit("High semantic & token similarity"))
        .when(F.col("final") >= 0.60, F.lit("Moderate token and pattern alignment"))
        .otherwise(F.lit("Semantic similarity and value compatibility"))
    )
    scored = base.select(
        *keep,
        F.when(unsettled, round2(F.col("final"))).otherwise(F.col("fixed.score")).alias("score"),
        F.when(unsettled, reason_text).otherwise(F.col("fixed.reason")).alias("reason"),
    )
    return scored.where(F.col("score") >= KEEP_SCORE)


def candidates(targets: DataFrame, sources: DataFrame, by: Sequence[str], block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Scored pairs worth keeping: ``by, table, column, source, src_pos, score, reason, ...``."""
    scored = score(pair(targets, sources, by, block_pairs)).drop("inferred_type")
    shown = scored.join(sources.select(*by, "source", "inferred_type", "sample_values"), [*by, "source"])
    return shown.select(
        *by, "table", F.col("name").alias("column"), "target_pos", "source", "src_pos", "score", "reason",
        "inferred_type", "sample_values",
    )


def ranked(found: DataFrame, by: Sequence[str], limit: int | None = None) -> DataFrame:
    """Rank within a declared column, best score first, ties in source order.

    With ``limit`` every task keeps only its own best rows before the exchange.
    """
    rank = F.row_number().over(W.partitionBy(*by, "table", "column").orderBy(F.col("score").desc(), "src_pos"))
    out = found.withColumn("rank", rank)
    return out if limit is None else out.where(F.col("rank") <= limit)


# -- decisions ---------------------------------------------------------------------------
_CHOICE = ("source", "score", "reason", "inferred_type", "sample_values")


def plans(targets: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """One plan per declared column; ``top`` holds its best three candidates."""
    # One struct key, null-safe, so that ranks, lists and the join with the columns share one exchange of the candidates.
    key = lambda name: F.struct(*by, "table", F.col(name).alias("column")).alias("__key")
    rank = F.row_number().over(W.partitionBy("__key").orderBy(F.col("score").desc(), "src_pos"))
    top = found.where(F.col("column").isNotNull()).select(key("column"), "src_pos", *_CHOICE).withColumn("rank", rank).where(F.col("rank") <= REVIEW_CANDIDATES)
    boxed = F.array_sort(F.collect_list(F.struct("rank", *_CHOICE)))
    tops = top.groupBy("__key").agg(boxed.alias("top"))
    p = targets.withColumn("__key", key("name")).join(tops, "__key", "left").drop("__key")
    best, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    clear = second.isNull() | (best["score"] - second["score"] >= ACCEPT_GAP)
    state = (
        F.when((best["score"] >= ACCEPT_SCORE) & clear, F.lit("IMPORT"))
        .when(best["score"] >= REVIEW_SCORE, F.lit("PENDING_LLM"))
        .otherwise(F.lit("SCHEMA"))
    )
    p = p.withColumn("state", state).withColumn("fallback", unmapped_action())
    imported, pending = F.col("state") == "IMPORT", F.col("state") == "PENDING_LLM"
    failed = F.col("fallback") == "VALIDATION_ERROR"
    return p.select(
        *by, "table", F.col("name").alias("column"), "target_pos", "sql_type", "role", "fallback", "top",
        F.when(imported, best["source"]).alias("source"),
        F.when(imported | pending, F.col("state")).otherwise(F.col("fallback")).alias("action"),
        F.when(imported | pending, (best["score"] * 100).cast("int")).when(failed, F.lit(0)).otherwise(F.lit(100)).alias("confidence"),
        F.when(imported, F.lit("STANDARD")).when(pending, F.lit("PENDING")).when(failed, F.lit("NONE"))
        .otherwise(F.lit("SCHEMA_DEFAULT")).alias("method"),
        F.when(imported, best["reason"]).when(pending, F.lit("Ambiguous candidates; awaiting semantic resolution"))
        .otherwise(F.concat(F.lit("No compatible Excel source; action determined by schema ("), F.col("fallback"), F.lit(")")))
        .alias("reason"),
        F.lit(False).alias("has_conflict"),
    )


def review_queue(planned: DataFrame, by: Sequence[str]) -> DataFrame:
    """Open columns with up to three candidates of three samples each."""
    shown = F.transform(
        "top",
        lambda c: F.struct(
            c["source"].alias("source"), c["inferred_type"].alias("inferred_type"),
            F.slice(c["sample_values"], 1, REVIEW_SAMPLES).alias("sample_values"),
        ),
    )
    open_plans = planned.where(F.col("action") == "PENDING_LLM")
    return open_plans.select(*by, "table", "column", "sql_type", "role", shown.alias("candidates"))


def apply_decisions(planned: DataFrame, decisions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Settle open plans with outside answers.

    ``decisions`` holds ``by, table, column, status, source, confidence, reason``. A
    match counts only when its source is one of the three candidates; the last
    answer per column counts (``decision_pos``).
    """
    latest = decisions.groupBy(*by, F.lower(F.trim("table")).alias("__t"), F.lower(F.trim("column")).alias("__c")).agg(
        F.max_by(F.struct("status", "source", "confidence", "reason"), "decision_pos").alias("d")
    )
    right = latest.select(*[F.col(b).alias(f"__{b}") for b in by], "__t", "__c", "d")
    cond = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
    cond += [F.lower("table") == F.col("__t"), F.lower("column") == F.col("__c"), F.col("action") == "PENDING_LLM"]
    p = planned.join(right, cond, "left")
    wanted = F.when(F.upper("d.status") == "MATCH", F.lower(F.trim("d.source")))
    chosen = F.get(F.filter("top", lambda c: F.lower(c["source"]) == F.col("wanted")), F.lit(0))
    p = p.withColumn("wanted", wanted).withColumn("chosen", chosen)
    is_open = F.col("action") == "PENDING_LLM"
    hit = is_open & F.col("chosen").isNotNull()
    sure = F.coalesce(F.col("d.confidence"), F.lit(0.0))
    failed = F.col("fallback") == "VALIDATION_ERROR"
    verdicts = {
        "source": F.when(hit, F.col("chosen.source")).when(is_open, F.lit(None)).otherwise(F.col("source")),
        "confidence": F.when(hit, (F.when(sure > 0, sure).otherwise(F.col("chosen.score")) * 100).cast("int"))
        .when(is_open, F.when(failed, F.lit(0)).otherwise(F.lit(100))).otherwise(F.col("confidence")),
        "method": F.when(hit, F.lit("LLM")).when(is_open & failed, F.lit("NONE")).when(is_open, F.lit("SCHEMA_DEFAULT"))
        .otherwise(F.col("method")),
        "reason": F.when(hit, F.coalesce(F.col("d.reason"), F.lit("LLM verified semantic match")))
        .when(is_open, F.concat(F.lit("No genuine match verified by LLM; schema action ("), F.col("fallback"), F.lit(")")))
        .otherwise(F.col("reason")),
        "action": F.when(hit, F.lit("IMPORT")).when(is_open, F.col("fallback")).otherwise(F.col("action")),
    }
    return p.withColumns(verdicts).drop("__t", "__c", "d", "wanted", "chosen", *[f"__{b}" for b in by])


def _claims(planned: DataFrame) -> DataFrame:
    return planned.where((F.col("action") == "IMPORT") & F.col("source").isNotNull())


def one_to_one(planned: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each source feeds the claim with the highest confidence, ties in schema order.

    The winner per source is an aggregate, so a source with many claims combines
    before the exchange.
    """
    winners = _claims(planned).groupBy(*by, F.col("source").alias("claimed")).agg(
        F.max_by(F.struct("table", "column"), F.struct("confidence", -F.col("target_pos"))).alias("winner"),
        F.count(F.lit(1)).alias("claims"),
    )
    source = F.when(F.col("action") == "IMPORT", F.col("source"))
    on = [(F.when(source.isNotNull(), F.col(b)), b) for b in by] + [(source, "claimed")]
    p = lookup(planned, winners.where(F.col("claims") > 1), on, ["winner"], "claims", F.xxhash64("table", "column"))
    lost = F.col("winner").isNotNull() & ~(
        (F.col("winner.table") == F.col("table")) & (F.col("winner.column") == F.col("column"))
    )
    return p.withColumn("lost", lost).withColumns({
        "source": F.when(F.col("lost"), F.lit(None)).otherwise(F.col("source")),
        "action": F.when(F.col("lost"), F.col("fallback")).otherwise(F.col("action")),
        "method": F.when(F.col("lost"), F.lit("CONFLICT")).otherwise(F.col("method")),
        "has_conflict": F.col("lost"),
        "conflict_message": F.when(
            F.col("lost"),
            F.concat(F.lit("Conflict with "), F.col("winner.table"), F.lit("."), F.col("winner.column"),
                     F.lit("; reverted to "), F.col("fallback")),
        ),
    }).drop("winner", "lost")


def conflict_report(planned: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sources claimed more than once, before they are resolved; targets in schema order."""
    shown = F.concat(F.lit("["), F.col("table"), F.lit("].["), F.col("column"), F.lit("]"))
    claims = _claims(planned).select(*by, "source", F.struct("target_pos", shown.alias("shown")).alias("claim"))
    listed = claims.groupBy(*by, "source").agg(F.array_sort(F.collect_list("claim")).alias("claims"))
    text = F.array_join(F.transform("claims", lambda c: c["shown"]), ", ")
    return listed.where(F.size("claims") > 1).select(
        *by, "source", text.alias("targets"),
        F.concat(F.lit("Excel column '"), F.col("source"), F.lit("' was matched to multiple SQL columns ("), text, F.lit(").")).alias("message"),
    )


def unused_sources(sources: DataFrame, planned: DataFrame, by: Sequence[str]) -> DataFrame:
    """M19."""
    used = _claims(planned).select(*by, "source").distinct()
    return sources.join(used, [*by, "source"], "left_anti").select(
        *by, "source", F.lit("NOT_USED").alias("action"), "inferred_type", "sample_values"
    )


def source_view(sources: DataFrame, planned: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each source with its first plan in schema order, or unused."""
    fields = ("table", "column", "action", "confidence", "method", "role", "reason", "has_conflict")
    first = planned.where(F.col("source").isNotNull()).groupBy(*by, "source").agg(
        F.min_by(F.struct(*fields), "target_pos").alias("plan")
    )
    v = sources.join(first, [*by, "source"], "left")
    # What an unused source shows.
    unused = {
        "table": "", "column": "", "action": "NOT_USED", "confidence": 0, "method": "UNRESOLVED", "role": "-",
        "reason": "Not mapped to any SQL column in selected table(s)", "has_conflict": False,
    }
    names = {"table": "target_table", "column": "target_column"}
    return v.select(
        *by, "source", *[F.coalesce(F.col(f"plan.{f}"), F.lit(unused[f])).alias(names.get(f, f)) for f in fields],
        "inferred_type", "sample_values",
    )


def plans_by_table(planned: DataFrame, by: Sequence[str]) -> DataFrame:
    """A table's plans in schema order; as long as its column list."""
    boxed = F.struct("target_pos", "column", "source", "action", "confidence", "method")
    return planned.groupBy(*by, "table").agg(F.array_sort(F.collect_list(boxed)).alias("plans"))


def statistics(sources: DataFrame, planned: DataFrame, conflicts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counters per scope. ``review_answers`` counts columns settled from outside."""
    action = F.col("action")
    per_plan = planned.groupBy(*by).agg(
        *[F.count_if(action == a).alias(n) for n, a in (
            ("sql_columns_imported", "IMPORT"), ("sql_columns_generated", "DATABASE_GENERATED"),
            ("sql_columns_default", "DEFAULT"), ("sql_columns_null", "NULL"),
            ("sql_columns_validation_error", "VALIDATION_ERROR"),
        )],
        F.count_if(F.col("method") == "LLM").alias("review_answers"),
    )
    used = _claims(planned).groupBy(*by, "source").agg(F.lit(1).alias("one")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("mapped_excel_columns")
    )
    per_source = sources.groupBy(*by).agg(F.count(F.lit(1)).alias("total_excel_columns"))
    clashes = conflicts.groupBy(*by).agg(F.count(F.lit(1)).alias("conflicts"))
    out = per_source
    for part in (per_plan, used, clashes):
        out = out.join(part, list(by), "left")
    counters = [c for c in out.columns if c not in by]
    out = out.fillna(0, counters)
    return out.select(
        *by, *counters, (F.col("total_excel_columns") - F.col("mapped_excel_columns")).alias("unused_excel_columns"),
        F.when(F.col("review_answers") == 0, F.lit("STANDARD")).otherwise(F.lit("HYBRID")).alias("mapping_source"),
    )
