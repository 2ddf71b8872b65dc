"""Ranked search against scoring every document."""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top):
    tf = [collections.Counter(tokens(t)) for _, t in docs]
    size = [sum(c.values()) for c in tf]
    n, total = sum(s > 0 for s in size), sum(size)
    df = collections.Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, _), c, s in zip(docs, tf, size, strict=True):
            score = 0
            for t in tokens(text):
                if c[t]:
                    m = 100 - 25 + 25 * s * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, k, f[3], -f[0]) for k, f in enumerate(sorted(found, key=lambda f: f[:3])[:top], 1)]
    return sorted(out, key=str)


def corpus(n=700):
    rng = np.random.default_rng(5)
    word = lambda: ["The", "of", "naïve", "Ünder", "x1", "zeta"][rng.integers(0, 6)] if rng.random() < 0.4 else f"w{int(rng.zipf(1.3)) % 4000}"
    docs = [(i, " ".join(word() + rng.choice(["", ",", "-", "_a", "\n"]) for _ in range(int(rng.integers(1, 60))))) for i in range(n)]
    docs += [(3, "the zeta"), (3, "the zeta"), (None, docs[5][1]), (None, "zeta zeta"), (n, None), (n + 1, ""), (n + 2, "--- !"), (n + 3, " zeta"), (n + 4, "rare " * 20_000), (n + 5, docs[9][1])]
    items = [(i, " ".join(word() for _ in range(int(rng.integers(1, 40))))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "nowhere"), (None, "the zeta"), (93, "rare rare zeta"), (93, "rare rare zeta"), (94, docs[5][1].upper()), (95, "the of the")]
    return docs, items


@pytest.mark.parametrize("shard_bytes", [2_000, 8 << 20])
def test_against_scoring_every_document(spark, shard_bytes):
    docs, items = corpus()
    rows = [(*d, 1, "x") for d in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int, terms string").repartition(3)
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id int, text string, doc_id int")
    index = spark.createDataFrame(lexical.build_index(df, shard_bytes).collect(), lexical.INDEX)
    for top, block in ((5, 200), (20, 1 << 20)):
        got = sorted((tuple(r) for r in lexical.rank(index, asked, top, block).collect()), key=str)
        assert got == plain(docs, items, top)


def test_blocks_are_passed_over_undecoded(monkeypatch):
    """Small blocks in process: the same ranks, and part of the postings is never decoded."""
    monkeypatch.setattr(lexical, "BLOCK", 4)
    docs, items = corpus()
    parts = [docs[i:i + 120] for i in range(0, len(docs), 120)]
    rows = [lexical.shard_row(pa.record_batch({"doc_id": pa.array([d for d, _ in p], pa.int64()), "text": pa.array([t for _, t in p], pa.string())})) for p in parts]
    whole = lexical.Corpus(sum(r[0] for r in rows), sum(r[1] for r in rows))
    names = lexical._INDEX.names
    got, decoded, held = [], 0, 0
    for item, text in items:
        w = lexical.terms(pa.array([text], pa.string()))
        if not len(w.codes):
            continue
        df = np.zeros(len(w.values), np.int64)
        shards = [lexical.Shard(dict(zip(names, r, strict=True)), whole, w.values) for r in rows]
        for r, s in zip(rows, shards, strict=True):
            df[s.own >= 0] += lexical.unpack(np.frombuffer(r[names.index("df")], np.uint8))[s.own[s.own >= 0]]
        codes, repeats = np.unique(w.codes, return_counts=True)
        heap = lexical.Heap.empty(3)
        for s in shards:
            lexical.search_shard(s, codes, repeats * whole.weights(df)[codes], heap)
            decoded += sum(len(d) for d, _ in s.decoded.values())
            held += sum(len(s.blocks(t, s.first[t], s.first[t + 1])[0]) for t in s.own[s.own >= 0])
        got += [(item, k, None if no else int(i), int(x)) for k, (x, no, i) in enumerate(zip(heap.score, heap.no_id, heap.ids, strict=True), 1)]
    assert sorted(got, key=str) == plain(docs, items, 3)
    assert decoded < 0.6 * held


def test_numbers_come_back():
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(0, 1 << k, 300) for k in (1, 7, 8, 14, 15, 30, 40)] + [[0, 127, 128, 16383, 16384]])
    data, ends = lexical.pack(values)
    assert (lexical.unpack(data) == values).all() and ends[-1] == len(data)
    assert len(lexical.unpack(data[:0])) == 0 and len(lexical.pack(values[:0])[0]) == 0


def test_terms_of_bytes():
    texts = ["A-b_c9\x7fÉ é x", None, "", "\x00\n", "Ab" * 3]
    w = lexical.terms(pa.array(["pad", *texts])[1:])
    got = [[w.values[int(c)].as_py() for c in w.codes[a:b]] for a, b in zip(w.starts[:-1], w.starts[1:], strict=True)]
    assert got == [tokens(t) for t in texts]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert lexical.ranked(docs, one.withColumnRenamed("doc_id", "item_id")).collect() == []
    assert lexical.ranked(one, items).collect() == []
