"""URL filters: host-suffix and path-prefix expressions, hash prefixes, full digests, rule precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import Facts, stage, stage_facts

#: Hexadecimal digits of a digest that the equi-join compares.
PREFIX_DIGITS = 8
#: Rule sets up to this many bytes are sent to every task; larger ones meet the expressions in a shuffle.
BROADCAST_BYTES = 16 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """``rule, verdict, host, path`` from ``(verdict, host/path)`` pairs."""
    df = spark.createDataFrame([(v, r) for v, r in rules], "verdict string, rule string")
    cut = F.locate("/", F.col("rule"))
    host = F.when(cut > 0, F.expr("substring(rule, 1, locate('/', rule) - 1)")).otherwise(F.col("rule"))
    path = F.when(cut > 0, F.expr("substring(rule, locate('/', rule))")).otherwise(F.lit(""))
    return df.select("rule", "verdict", F.translate(host, _UPPER, _LOWER).alias("host"), path.alias("path"))


def _digest(host: Column, path: Column) -> Column:
    # The host's length keeps ("a.b", "c") and ("a.", "bc") apart.
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path).cast("binary"), 256)


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``key, host, path, rule, verdict`` for every row of ``pages``.

    A rule fits its host and all subdomains where the path starts with the rule's path. Of
    the fitting rules the longest wins (host and path together, then the longer host; a
    block before an allow that says the same). Without a fitting rule ``rule`` is null and
    the verdict is ``default``.

    Each distinct (host, path) is expanded once, only into the shapes (number of host labels,
    length of path) that some rule has, so a long path costs no more than a short one.
    Null URLs and those without ``://`` have an empty host and path, which fit no rule with a
    host. Repeated rows stay; empty tables give no rows; other columns aren't read.
    """
    rows = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    listed = rules.dropDuplicates(["host", "path", "verdict"]).select(
        "rule", "verdict", _digest(F.col("host"), F.col("path")).alias("digest"),
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("reach"), F.length("host").alias("r_host"))
    listed = listed.withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    known: Facts = stage_facts(listed, "rules")
    # Shapes are few: (labels of a host) x (lengths of a rule's path), whatever the number of rules.
    shapes = sorted((r["labels"], r["reach"]) for r in known.df.select("labels", "reach").distinct().collect())
    if not shapes:
        return rows.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    texts = rows.select("host", "path").distinct()
    depth = F.size(F.split("host", r"\."))
    listed_shapes = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("reach")) for a, b in shapes])
    wide = texts.select("host", "path", F.explode(listed_shapes).alias("s"))
    wide = wide.where((depth >= F.col("s.labels")) & (F.length("path") >= F.col("s.reach")))
    suffix = F.expr("substring_index(host, '.', -s.labels)")
    prefix = F.expr("substring(path, 1, s.reach)")
    wide = wide.select("host", "path", _digest(suffix, prefix).alias("full"))
    wide = wide.withColumn("short", F.substring("full", 1, PREFIX_DIGITS))
    side = F.broadcast(known.df) if known.bytes <= BROADCAST_BYTES else known.df
    # Most expressions end here: the short prefix is what meets in the join, the digest decides.
    found = wide.join(side, "short").where(F.col("full") == F.col("digest"))
    order = F.struct((F.col("r_host") + F.col("reach")).alias("a"), F.col("r_host").alias("b"),
                     (F.col("verdict") == "block").alias("c"), F.col("rule"), F.col("verdict"))
    best = found.groupBy("host", "path").agg(F.max(order).alias("best"))
    best = stage(best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "best"), "verdicts")
    out = rows.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return out.select(key, "host", "path", F.col("best.rule").alias("rule"),
                      F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
