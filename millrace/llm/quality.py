"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import owners, slices, words
from millrace.session import stage

FEATURES = ("log_words", "word_length", "symbol_share", "upper_share", "bar_share", "bang_share", "punct_share",
            "digit_share", "distinct_share", "repeat_share", "line_words", "top_share")
_LOG = 1e-4


@dataclass(frozen=True)
class Discriminant:
    """Per class: log prior, mean, and the Cholesky factor of its shrunken covariance, inverted once."""

    mean: np.ndarray
    scale: np.ndarray
    priors: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        out = np.empty((len(x), len(self.priors)))
        for k in range(len(self.priors)):
            white = (z - self.means[k]) @ self.factors[k].T
            out[:, k] = self.priors[k] - 0.5 * self.log_dets[k] - 0.5 * np.einsum("ij,ij->i", white, white)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """The posterior of the last class, 0 to 1."""
        d = self.log_density(x)
        return 1 / (1 + np.exp(np.clip(d[:, 0] - d[:, 1], -700, 700)))


def statistics(texts: pa.Array) -> np.ndarray:
    """The transformed statistics of whole texts, one row each."""
    w = words(texts)
    texts = pc.fill_null(texts, "")
    n = w.counts.astype(float)
    some, of = np.maximum(n, 1), owners(w.starts)
    rows = len(n)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(of, values, rows) if len(of) else np.zeros(rows)

    size = pc.utf8_length(w.values).to_numpy().astype(float) if len(w.values) else np.zeros(0)
    chars = np.maximum(per_text(size[w.codes]), 1)

    def share(pattern: str) -> np.ndarray:
        hits = pc.count_substring_regex(w.values, pattern).to_numpy().astype(float) if len(w.values) else np.zeros(0)
        return per_text(hits[w.codes]) / chars

    pair, times = np.unique(of.astype(np.int64) << 32 | w.codes, return_counts=True)
    distinct = np.bincount(pair >> 32, minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, pair >> 32, times)
    same = np.zeros(len(of))
    if len(of) > 1:
        same[1:] = (w.codes[1:] == w.codes[:-1]) & (of[1:] == of[:-1])
    lines = pc.add(pc.count_substring(texts, "\n"), 1).to_numpy().astype(float)
    shares = [share(r"[#*$%&<>]"), share(r"\p{Lu}"), share(r"\|"), share("!"), share(r"[.,;:?]"), share("[0-9]")]
    return np.column_stack([
        np.log1p(n), np.log1p(chars / some), *[np.log(s + _LOG) for s in shares],
        distinct / some, np.log(per_text(same) / some + _LOG), np.log1p(n / lines), top / some,
    ])


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, row, x``: the statistics of every row's whole text, and a digest of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = statistics(part.column("text"))
                flat = pa.array(x.ravel())
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "row", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text").mapInArrow(run, "doc_id long, row long, x array<double>")


def _moments(rows: DataFrame) -> DataFrame:
    """Count, sums and products per class; one row per task and class goes to the sum."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = b.column("label").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        at = np.tile(np.arange(total.shape[1]), 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], total.shape[1])), pa.array(at), pa.array(total.ravel())], ["label", "at", "v"])

    return rows.mapInArrow(run, "label long, at long, v double").groupBy("label", "at").agg(F.sum("v").alias("v"))


def train(rows: DataFrame, shrink: float = 0.05, ridge: float = 1e-3) -> Discriminant | None:
    """Fit on ``label, x`` rows. A class covariance is drawn ``shrink`` of the way to the pooled
    one, then its diagonal is raised by ``ridge``. None where a class has no rows.

    Only the moments of the two classes reach the driver: a few hundred numbers for any input.
    """
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for r in _moments(rows).collect():
        total[r["label"], r["at"]] = r["v"]
    n = total[:, 0]
    if not n.all():
        return None
    all_n = n.sum()
    mean = total[:, 1:1 + d].sum(0) / all_n
    square = total[:, 1 + d:].reshape(2, d, d)
    spread_all = np.diag(square.sum(0)) / all_n - mean**2
    scale = np.sqrt(np.where(spread_all > 1e-6 * (1 + mean**2), spread_all, 1.0))  # a constant statistic stays as it is
    means = (total[:, 1:1 + d] / n[:, None] - mean) / scale
    spread = np.empty((2, d, d))
    for k in (0, 1):
        m = total[k, 1:1 + d] / n[k]
        spread[k] = (square[k] / n[k] - np.outer(m, m)) / np.outer(scale, scale)
    pooled = (spread * n[:, None, None]).sum(0) / all_n
    factors, dets = np.empty((2, d, d)), np.empty(2)
    for k in (0, 1):
        lower = np.linalg.cholesky((1 - shrink) * spread[k] + shrink * pooled + ridge * np.eye(d))
        factors[k] = np.linalg.inv(lower)
        dets[k] = 2 * np.log(np.diag(lower)).sum()
    return Discriminant(mean, scale, np.log(n / all_n), means, factors, dets)


def fold(doc_id, parts: int):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, shrink: float = 0.05) -> DataFrame:
    """``doc_id, held_out, score, predicted, text_digest`` for every row of ``docs``.

    Learns ``labels.quality`` from all labelled rows whose fold isn't 0; a document with
    contradicting labels counts under each. Null and empty texts have the statistics of no
    words and are scored like others; a null identifier is never held out and never labelled.
    Without both classes among the labels every score is 0.5. Repeated rows are scored
    alike, an empty table gives no rows, and only ``doc_id``, ``text`` and ``quality`` are read.
    """
    known = stage(features(docs), "statistics")
    held = F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    marks = marks.where(F.col("label").isin(0, 1) & ~(fold(F.col("doc_id"), folds) == 0)).distinct()
    model = train(known.join(marks, "doc_id").select("label", "x"), shrink)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(score)], ["doc_id", "row", "score"])

    scored = known.mapInArrow(run, "doc_id long, row long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.col("row").alias("text_digest"))
