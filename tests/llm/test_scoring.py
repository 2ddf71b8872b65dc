"""The model's counts, base score and mixture against plain dictionaries."""

from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import pytest

from millrace.llm import scoring
from millrace.session import stage

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), " "]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    names = [f"W{k}" for k in range(40)] + ["Ä\u00a0x", "É"]
    texts = [" ".join(rng.choice(names, int(rng.integers(1, 60)), p=None)) + "\x0b" for _ in range(150)]
    return [(k, t, "x") for k, t in enumerate(texts)] + [(150, None, "x"), (151, "", "x"), (None, "W1 W2", "x"), (3, texts[3], "x")]


def test_base_score_and_counts(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = scoring.score(df).collect()
    count = collections.Counter()
    for d, t, _ in rows:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n,
                   round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t, _ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_score_is_the_mixture_of_plain_estimates(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    fixed = np.random.default_rng(1).dirichlet([1, 1, 1], scoring.BUCKETS)
    monkeypatch.setattr(scoring, "learn_weights", lambda *a, **k: fixed)
    word, pair = collections.Counter(), collections.Counter()
    for d, t, _ in rows:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            ws = tokens(t)
            word.update(ws)
            pair.update(zip([" ", *ws[:-1]], ws, strict=True))
    n, v = sum(word.values()), len(word)

    def plain(t):
        ws, total = tokens(t), 0.0
        for a, b in zip([" ", *ws[:-1]], ws, strict=True):
            w = fixed[0 if not word[a] else 1 + int(math.log2(word[a]))]
            total += math.log10((w[0] * pair[a, b] / word[a] if word[a] else 0) + w[1] * word[b] / n + w[2] / (v + 1))
        return total

    want = collections.Counter((d, round(plain(t), 6)) for d, t, _ in rows)
    assert collections.Counter((r.doc_id, round(r.score, 6)) for r in scoring.score(df).collect()) == want


def test_weights_reach_the_likelihood_of_a_plain_em(spark, rows):
    """Expectation-maximisation over every deleted token one by one, from kept counts."""
    df = spark.createDataFrame(rows * 3, "doc_id long, text string, extra string")
    bodies = stage(scoring.blocks(df), "blocks")
    answered = stage(scoring.counts(bodies, 7), "counts")
    n = answered.where("kind = 'w'").groupBy().sum("tokens", "tokens_apart", "types").first()
    got = scoring.learn_weights(bodies, answered, n[0] - n[1], n[2], rounds=30)
    assert np.allclose(got.sum(1), 1) and (got >= 0).all() and (got[:, 2] > 0).all()
    texts = {d: t for d, t, _ in rows}
    flags = {r.doc_id: r.deleted for r in df.selectExpr(
        "doc_id", "pmod(xxhash64('deleted', doc_id), 16) = 0 AND NOT coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 7) = 2, false) AS deleted").collect()}
    word, pair, held = collections.Counter(), collections.Counter(), []
    for d, t, _ in rows * 3:
        if d is not None and zlib.crc32(str(d).encode()) % 7 == 2:
            continue
        ws = tokens(texts[d])
        steps = list(zip([" ", *ws[:-1]], ws, strict=True))
        if flags[d]:
            held += steps
        else:
            word.update(ws)
            pair.update(steps)
    total = sum(word.values())

    def likelihood(weights):
        out = 0.0
        for a, b in held:
            w = weights[0 if not word[a] else 1 + int(math.log2(word[a]))]
            out += math.log((w[0] * pair[a, b] / word[a] if word[a] else 0) + w[1] * word[b] / total + w[2] / (n[2] + 1))
        return out

    assert held
    best = likelihood(got)
    for other in ([0.4, 0.4, 0.2], [0.05, 0.9, 0.05], [0.9, 0.05, 0.05]):
        assert best >= likelihood(np.tile(other, (scoring.BUCKETS, 1))) - 1e-6


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    for values in (np.zeros(0, np.uint64), np.array([0, 5], np.uint64), np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64)) * 2):
        assert (scoring.unpack(scoring.pack(values, True), True) == values).all()
        assert (scoring.unpack(scoring.pack(values)) == values).all()


def test_empty_table(spark):
    assert scoring.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shards_cost_a_block_no_more_than_its_keys():
    """As many shards as a corpus of a million million tokens asks for: a block still yields a row per key at most, in one pass."""
    import time

    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 64, 200_000, np.uint64))
    for bits in (6, 17, 31):
        start = time.perf_counter()
        shard, at = scoring._cuts(keys, bits)
        assert time.perf_counter() - start < 0.5
        assert len(shard) == len(at) - 1 <= min(len(keys), 1 << bits) and (np.diff(shard) > 0).all() and at[-1] == len(keys)
        assert (np.repeat(shard, np.diff(at)) == (keys >> np.uint64(64 - bits)).astype(np.int64)).all()
    assert [len(x) for x in scoring._cuts(keys[:0], 6)] == [0, 1]
