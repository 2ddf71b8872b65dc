"""Verbatim and reworded items are found, texts of the same words are not; parts against plain numpy."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import decontaminate as dec


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j] + 1 if x == y else 0, row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=15), st.lists(st.integers(-1, 6), max_size=25))
def test_ordered_share(pattern, region):
    assert dec.ordered_share(np.array(pattern), np.array(region)) == lcs(pattern, region) / len(pattern)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=6), st.sampled_from([dec.WINDOW, dec.STRIDE]))
def test_passages_cover_whole_texts(lengths, stride):
    of, start, end = dec.passages(np.array(lengths, np.int64), stride)
    base = np.concatenate([[0], np.cumsum(lengths)]).astype(int)
    for t, n in enumerate(lengths):
        own = [(s - base[t], e - base[t]) for o, s, e in zip(of, start, end, strict=True) if o == t]
        assert {k for s, e in own for k in range(s, e)} == set(range(n))
        assert all(e - s <= dec.WINDOW for s, e in own)


def corpus():
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(3000)]
    prose = lambda n: " ".join(rng.choice(words[:2000], n))
    items = [(k, " ".join(rng.choice(words, int(rng.integers(12, 90)))) + ". " + " ".join(rng.choice(words, 6)) + ".") for k in range(30)]
    docs, truth = [], set()
    for i in range(150):
        text = prose(int(rng.integers(30, 400)))
        if i % 5 == 0:
            k = int(rng.integers(0, 30))
            own = items[k][1].split()
            if i % 10 == 0:  # reworded: every sixth word replaced, one in ten left out
                own = [w if j % 6 else "other" for j, w in enumerate(own) if j % 10 != 3]
            text = f"{prose(40).capitalize()} {' '.join(own)} {text}"
            truth.add((i, k))
        docs.append((i, text))
    return docs, items, truth


def test_found_and_left_alone(spark):
    docs, items, truth = corpus()
    shuffled = " ".join(np.random.default_rng(0).permutation(items[3][1].split()))
    docs += [(500, None), (501, ""), (502, shuffled), (503, items[0][1].upper()), (503, items[0][1].upper()), (None, items[1][1])]
    truth |= {(503, 0), (None, 1)}
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([*items, (77, None), (78, ""), (79, "..."), (None, None)], "item_id long, text string")
    got = dec.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth
    assert sum(r.doc_id == 503 for r in got) == 2
    assert all(r.lcs_share >= 0.55 and r.cosine >= 0.35 and 0 <= r.start_word < r.stop_word for r in got)
    # Blocks of some items each find the same.
    again = dec.contaminated(d, b, block_words=200).collect()
    assert {(r.doc_id, r.item_id) for r in again} == truth


def test_cosine_search_reaches_all_close_passages(spark):
    """Recall of the latent space against full TF-IDF cosines."""
    docs, items, _ = corpus()
    vocabulary, known = dec.encode_items(items)
    coded = dec.stage(dec.encode(spark.createDataFrame(docs, "doc_id long, text string"), vocabulary), "encoded")
    terms = dec.weigh(coded, known, len(vocabulary))
    basis = dec.latent_basis(coded, terms, known)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-3)
    n = int((terms.row >= 0).sum())

    def dense(codes, start, end):
        of, term, value = terms.vectors(codes, start, end)
        out = np.zeros((len(start), n))
        out[of, term] = value
        return out

    codes = np.concatenate([np.frombuffer(r.codes, np.int32) for r in coded.collect()])
    lengths = np.array([len(r.codes) // 4 for r in coded.collect()])
    _, start, end = dec.passages(lengths, dec.STRIDE)
    q_codes, _, q_start, q_end = dec._item_passages(known)
    p, q = dense(codes, start, end), dense(q_codes, q_start, q_end)
    full = p @ q.T
    latent = q @ basis
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    near = (p @ basis) @ latent.T
    wanted = full >= 0.35
    assert wanted.sum() > 20 and (near[wanted] >= 0.35).mean() >= 0.95


def test_many_short_items_in_one_benchmark(spark):
    """Far more passages than latent dimensions of a block: items planted in long texts are found all the same."""
    rng = np.random.default_rng(21)
    words = np.array([f"w{k}" for k in range(6000)])
    odds = 1 / np.arange(20, 6020)
    prose = lambda n: " ".join(rng.choice(words, n, p=odds / odds.sum()))
    items = [(k, prose(int(rng.integers(15, 24))) + ".") for k in range(1100)]
    docs = [(k, f"{prose(150)} {items[k][1]} {prose(150)}") for k in range(0, 1100, 4)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dec.contaminated(d, b).collect()}
    assert len({(k, k) for k, _ in docs} & got) >= 0.99 * len(docs)


def test_nothing_to_find(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert dec.contaminated(d, b).collect() == []
    assert dec.contaminated(d.where("false"), spark.createDataFrame([(1, "a b c d")], "item_id long, text string")).collect() == []
