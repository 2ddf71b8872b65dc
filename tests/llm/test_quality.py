"""The discriminant against numpy's own formulas, and accuracy on held-out rows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from millrace.llm import quality


def corpus(n=400):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        words = [f"{'abcdefgh'[k % 8] * int(1 + k % 7)}" + str(k % 3 or "") for k in rng.integers(0, 300, rng.integers(5, 120))]
        good = i % 4 != 0
        if not good:
            words = [[w + "***" for w in words], [w.upper() + "!!" for w in words], ["|" for _ in words], words[:1] * len(words)][i // 4 % 4]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good)))
    return rows, labels


def test_density_is_the_gaussian_one():
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    factors = np.stack([np.linalg.inv(np.linalg.cholesky(np.cov(rng.standard_normal((d, 60))))) for _ in range(2)])
    means = rng.standard_normal((2, d))
    dets = np.array([-2 * np.log(np.diag(f)).sum() for f in factors])
    model = quality.Discriminant(np.zeros(d), np.ones(d), np.log([0.3, 0.7]), means, factors, dets)
    x = rng.standard_normal((5, d))
    for k in (0, 1):
        inv = factors[k].T @ factors[k]
        want = np.log([0.3, 0.7][k]) + 0.5 * np.linalg.slogdet(inv)[1] - 0.5 * np.einsum("ij,jk,ik->i", x - means[k], inv, x - means[k])
        assert np.allclose(model.log_density(x)[:, k], want)


def test_statistics_of_odd_texts():
    x = quality.statistics(pa.array([None, "", " \n", "A|b!", "la " * 50000]))
    assert np.isfinite(x).all() and (x[0] == x[1]).all() and x.shape == (5, len(quality.FEATURES))


def test_held_out_accuracy_and_rows(spark):
    rows, labels = corpus()
    more = [(None, "x y"), (5000, None), (5001, ""), (7, rows[7][1])]
    docs = spark.createDataFrame([(*r, 3, "q") for r in rows + more], "doc_id long, text string, score int, label string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (3, 7)], "doc_id long, quality int")
    got = quality.classify(docs, marks).collect()
    assert len(got) == len(rows) + len(more)
    truth = dict(labels)
    held = [r for r in got if r.doc_id is not None and r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q) for d, q in labels]
    scores = [sorted((r.doc_id, round(r.score, 9)) for r in quality.classify(docs, spark.createDataFrame(m, "doc_id long, quality int")).collect()) for m in (labels, flipped)]
    assert scores[0] == scores[1]


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert [(r.score, r.predicted) for r in quality.classify(docs, none).collect()] == [(0.5, 1)]
    assert quality.classify(docs.where("false"), none).collect() == []
