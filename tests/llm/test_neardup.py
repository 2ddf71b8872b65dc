"""Sketches by their estimates, components against all pairs."""

from __future__ import annotations

import re

import numpy as np
import pytest

from millrace.llm import neardup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain(rows, width):
    sets = [shingle_set(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= 80 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
            elif sets[i] and sets[j] and rows[i][0] is not None and rows[i][0] == rows[j][0]:
                label[root(i)] = root(j)  # an identifier's texts are one document
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = None if d is None else min(groups[root(i)])
        out.append((d, len(sets[i]), c, d is None or d == c))
    return sorted(out, key=str)


def corpus(seed=2):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for _ in range(14):  # groups of near copies, some in chains whose ends are no longer alike
        base = [f"w{x}" for x in rng.integers(0, 900, rng.integers(40, 200))]
        for _ in range(int(rng.integers(1, 12))):
            rows.append((n, " ".join(base)))
            n += 1
            for k in rng.integers(0, len(base), rng.integers(0, 4)):
                base[k] = f"n{rng.integers(0, 9999)}"
    shared = " ".join(f"s{k}" for k in range(60))
    rows += [(n + k, shared + " " + " ".join(f"u{x}" for x in rng.integers(0, 9999, 25 + k))) for k in range(30)]
    extra = [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "ONE two"), (9005, "one two three four five"), (9006, "one two three four five six"), (None, rows[0][1]), (0, rows[0][1])]
    rng.shuffle(rows)
    return [(int(d), t) for d, t in rows] + extra


@pytest.mark.parametrize("width", [4, 5])
def test_components_against_all_pairs(spark, width):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, regs string")
    got = sorted(map(tuple, neardup.near_duplicates(df, width).collect()), key=str)
    assert got == plain(rows, width)


def test_one_identifier_with_several_texts(spark):
    """All links of an identifier's texts count, and each text is judged by its own links."""
    rng = np.random.default_rng(12)
    prose = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows, want = [], {}
    for i in range(20):
        base = prose(80)
        near = [*base[:79], f"end{i}"]
        other = " ".join(prose(60))
        rows += [(i, " ".join(base)), (500 + i, " ".join(near)), (500 + i, other)]
        want |= {(i, " ".join(base)): True, (500 + i, " ".join(near)): False, (500 + i, other): True}
    twin = " ".join(prose(50))
    rows += [(900, twin), (900, twin), (901, twin), (None, twin), (902, ""), (902, twin)]
    want |= {(900, twin): True, (901, twin): False, (None, twin): True, (902, ""): True, (902, twin): False}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.near_duplicates(df, 5).collect()), key=str) == plain(rows, 5)
    digest = {(r.doc_id, r.h): r.text for r in df.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()}
    got = {(r.doc_id, digest[r.doc_id, r.text_digest]): r.first for r in neardup.near_texts(df, 5).collect()}
    assert got == want


def test_tiles_and_late_candidates(spark, monkeypatch):
    """With tiny tiles and bands that put almost everything into one bucket, the last step has to find the links."""
    monkeypatch.setattr(neardup, "TILE", 3)
    monkeypatch.setattr(neardup, "BAND", 1)
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.near_duplicates(df, 4).collect()), key=str) == plain(rows, 4)


def test_estimates_and_merge():
    rng = np.random.default_rng(1)
    errors = []
    for share in (0.2, 0.5, 0.8, 0.95):
        for _ in range(25):
            n = 400
            both = rng.integers(0, 1 << 63, int(n * share)).astype(np.uint64) * 2 + 1
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, n - len(both)).astype(np.uint64)])) for _ in range(2))
            h = np.concatenate([a, b])
            r = neardup.registers(h, np.array([0, len(a), len(h)]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            sizes = np.array([len(a)], float), np.array([len(b)], float)
            errors.append(neardup.estimate((r[:1] > r[1:]).sum(1).astype(float), (r[:1] < r[1:]).sum(1).astype(float), *sizes)[0] - true)
            assert neardup._compare(r[:1], r[1:], *sizes)[0] in (0, errors[-1] + true) and (true < 0.6 or neardup._compare(r[:1], r[1:], *sizes)[0] > 0)
            union = np.union1d(a, b)
            assert (neardup.merge(r[0], r[1]) == neardup.registers(union, np.array([0, len(union)]))[0]).all()
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
