"""From raw documents to a training mix, in stages that each read what the one before has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, lines, mixing, neardup, quality
from millrace.llm.registry import table
from millrace.llm.text import fresh
from millrace.session import stage

#: Words per shingle of the near-duplicate stage.
WIDTH = 5


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose identifier and text are in ``gone`` (``doc_id, text_digest``)."""
    digest = fresh(docs, "digest")
    rows, gone = docs.withColumn(digest, F.xxhash64("text")), gone.select("doc_id", "text_digest").distinct()
    same = rows["doc_id"].eqNullSafe(gone["doc_id"]) & (rows[digest] == gone["text_digest"])
    return rows.join(gone, same, "left_anti").select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    return _without(docs, judged.where("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near copies: the one with the smallest identifier. Texts are judged one by one, so
    an identifier that stands on several loses only those that are copies."""
    kept = _without(docs, neardup.near_texts(docs, width=WIDTH).where("NOT first"))
    # Rows that repeat identifier and text are a group as well.
    known, digest = F.col("doc_id").isNotNull(), fresh(docs, "digest")
    rows = kept.withColumn(digest, F.xxhash64("text"))
    if rows.where(known).groupBy("doc_id", digest).count().where("count > 1").isEmpty():
        return kept
    return rows.where(known).dropDuplicates(["doc_id", digest]).union(rows.where(~known)).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has."""
    return lines.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, neither verbatim nor reworded."""
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row per document and epoch, with the words that the epoch takes."""
    return mixing.mixed(docs)


Stage = tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]

STAGES: list[Stage] = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: The stages learn, sketch and retrieve, which SQL can't say; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
