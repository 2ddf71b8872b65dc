"""The mix against a plain loop, and what it promises."""

from __future__ import annotations

import hashlib
import math
import re

import pytest

from millrace.llm import mixing


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def plain(rows, share=1.5, most=2, weights=(5, 2, 1)):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    key = lambda d: int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16)
    out = []
    for s in order:
        budget, before = math.floor(target[s] + 1e-9), 0
        for d, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (key(r[0]), r[0] is not None, r[0] or 0, size(r[1]))):
            n = size(t)
            out.append((d, s, n, sizes[s], sum(max(0, min(n, budget - sizes[s] * e - before)) for e in range(most))))
            before += n
    return sorted(out, key=str), target


ROWS = [(i, " ".join(["w"] * (i * 7 % 23)) + "\x0b", s) for i, s in enumerate(["a", "b", "c", "d", None, "é", "Z", "a", "a", "a"] * 12)]
ROWS += [(None, "x y", "a"), (None, None, "b"), (5, "dup dup", "a"), (5, "dup dup", "a"), (900, "", "only empty"), (901, "word " * 3000, "d")]


def test_against_a_loop(spark):
    got = mixing.mix_sources(spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumnRenamed("nothing", "size")).collect()
    want, target = plain(ROWS)
    assert sorted(((r.doc_id, r.source, r.size, r.source_size, r.taken) for r in got), key=str) == want
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
    for s in target:
        assert sum(r.taken for r in got if r.source == s) == math.floor(target[s] + 1e-9)


def test_mixed_rows_carry_all_columns(spark):
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(ROWS)], "doc_id long, text string, source string, key int, epoch string")
    got = mixing.mixed(df).collect()
    want, _ = plain(ROWS)
    assert sum(r["taken"] for r in got) == sum(w[-1] for w in want)
    assert {r["epoch_"] for r in got} <= {1, 2} and {r["epoch"] for r in got} == {"x"}
    full = [(r["key"], r["epoch_"]) for r in got]
    assert len(full) == len(set(full))


def test_main_path_has_no_python(spark):
    plan = mixing.mix_sources(spark.createDataFrame(ROWS, "doc_id long, text string, source string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(none).collect() == [] and mixing.mixed(none).collect() == []
