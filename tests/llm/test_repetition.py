"""Suffix-array repetition against comparing all positions."""

from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_lengths(words):
    n, out = len(words), []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=16), max_size=5))
def test_repeat_lengths(docs):
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(int)
    codes = np.array([w for d in docs for w in d], np.int32)
    assert repetition.repeat_lengths(starts, codes).tolist() == [x for d in docs for x in plain_lengths(d)]


def plain(text, least=5):
    text = text or ""
    words = WORD.findall(text)
    n, spans = len(words), plain_lengths(words)
    inside = {k for i, x in enumerate(spans) if x >= least for k in range(i, i + x)}
    triples = [tuple(words[i:i + 3]) for i in range(n - 2)]
    windows = {k for i, t in enumerate(triples) if triples.count(t) > 1 for k in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = n < 50 or 100 * len(windows) > 50 * n
    longest = max(spans, default=0)
    bad = len(inside) > 0.6 * n or (longest >= 10 and longest > 0.5 * n)
    starts = sum(k - 1 not in inside for k in inside)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(windows), failed, len(inside), longest, starts, not (failed or bad))


def test_against_plain_rules(spark):
    rng = np.random.default_rng(5)
    prose = [" ".join(f"w{x}" for x in rng.integers(0, 4000, 120)) for _ in range(6)]
    part = " ".join(f"q{k}" for k in range(30))
    texts = [*prose, None, "", " \n\t", "one", "a b\na b\n \na b", "é # ü | x\x0by", part + " " + part, part + " x " + part + " y z " + part, "\n".join([prose[0][:200]] * 9),
             " ".join(["la"] * 300), prose[0] + "\n" + part + "\n" + prose[1] + "\n" + part, "a\u00a0b " * 60]
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(0, texts[0], False), (None, prose[1], None)]
    got = repetition.judge(spark.createDataFrame(rows, "doc_id long, text string, kept boolean")).collect()
    assert sorted(map(str, [(d, *plain(t)) for d, t, _ in rows])) == sorted(str(tuple(r)) for r in got)


def test_repeated_blocks_fail_and_prose_stays(spark):
    prose = " ".join(f"w{k}" for k in range(200))
    # Every window of three words is new, but runs come back in another order with one word changed.
    rows = [(1, prose), (2, prose + "\nThe usual last line stands here twice.\nThe usual last line stands here twice.")]
    got = {r.doc_id: r.kept for r in repetition.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: True}


def test_empty_table(spark):
    assert repetition.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_verdict_drops_texts_that_pass_the_base_rules(spark):
    prose = [f"w{k}" for k in range(140)]
    part = [f"q{k}" for k in range(30)]
    # A passage that returns; overlapping repeats of one word; a single short line that returns.
    texts = {1: part + prose + part, 2: prose + ["la"] * 20, 3: part[:8] + prose + part[:8]}
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    got = {r.doc_id: (r.base_failed, r.kept) for r in repetition.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (False, False), 2: (False, False), 3: (False, True)}
