"""The pipeline on a planted corpus, stage by stage, and its registration."""

from __future__ import annotations

import math

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import mixing
from millrace.llm.queries import URL_RULES
from millrace.llm.registry import ORACLES, QUERIES
from tests_llm_helpers import plain_components, plain_mix, plain_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(rng, n):
    words = [f"{'lorem ipsum dolor amet sed elit tempor magna'.split()[k % 8]}{k}" for k in rng.integers(0, 3000, n)]
    return ". ".join(" ".join(words[i:i + 12]).capitalize() for i in range(0, n, 12)) + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    texts, kind = {}, {}
    passage = prose(rng, 72)
    items = [(k, prose(rng, 30)) for k in range(5)]
    for i in range(240):
        texts[i], kind[i] = prose(rng, int(rng.integers(60, 150))), "clean"
    for i in range(240, 300):
        texts[i], kind[i] = " ".join(w + ["***", "&&&", "!!"][i % 3] for w in prose(rng, 80).upper().split()), "junk"
    for i in range(300, 320):
        texts[i], kind[i] = texts[i - 300].replace("Lorem", "Ipsum", 1) + " tail", "near"
    for i in range(320, 330):
        texts[i], kind[i] = f"{prose(rng, 60)}\n{passage}\n{prose(rng, 60)}", "repeat"
    for i in range(330, 340):
        texts[i], kind[i] = f"{prose(rng, 48)} {items[i % 5][1]} {prose(rng, 48)}", "leak"
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t)) for i, t in texts.items()] + [(5, texts[5], "en", "c", 0), (None, None, None, None, None), (None, "", "x", "a", 0)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(k != "junk"), 0) for i, k in kind.items() if i % 2 or k == "junk"]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, texts, kind, passage, items


@pytest.fixture(scope="module")
def staged(spark, corpus, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{corpus[0]}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        before = docs
        path = str(tmp_path_factory.mktemp(name)) + "/out"
        step(spark, docs, corpus[0]).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = (before.collect(), docs.collect(), docs.columns)
    return out


def test_columns_stay(staged):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontamination", "mixing"]
    assert all(staged[n][2] == COLUMNS for n in list(staged)[:-1]) and staged["mixing"][2] == [*COLUMNS, "epoch", "taken"]


def test_quality_stage(staged, corpus):
    kind = corpus[2]
    kept = {r.doc_id for r in staged["quality"][1]}
    assert not any(kind[d] == "junk" for d in kept if d is not None)
    assert sum(k != "junk" and d not in kept for d, k in kind.items()) <= 5


def test_near_dedup_stage(staged):
    before, after, _ = staged["near_dedup"]
    want = {d for d, _, c, kept in plain_components([(r.doc_id, r.text) for r in before], 5) if kept and d is not None}
    got = [r.doc_id for r in after if r.doc_id is not None]
    assert sorted(got) == sorted(want)
    assert sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before)


def test_substring_stage(staged, corpus):
    before, after, _ = staged["substring_dedup"]
    passage = corpus[3]
    assert len(before) == len(after)
    holders = sorted(r.doc_id for r in after if passage.split(".")[2] in (r.text or ""))
    assert holders == [min(r.doc_id for r in before if passage in (r.text or ""))]
    touched = {s[0] for s in plain_spans([(r.doc_id, r.text) for r in before], 25)}
    texts = {r.doc_id: r.text for r in before}
    assert all((r.text == texts[r.doc_id]) == (r.doc_id not in touched) for r in after if r.doc_id is not None)


def test_decontamination_stage(staged, corpus):
    before, after, _ = staged["decontamination"]
    leaks = {r.doc_id for r in before if any(t in (r.text or "") for _, t in corpus[4])}
    assert leaks and {r.doc_id for r in before} - {r.doc_id for r in after} == leaks


def test_mixing_stage(staged):
    before, after, _ = staged["mixing"]
    want, target = plain_mix([(r.doc_id, r.text, r.source) for r in before])
    assert sum(r.taken for r in after) == sum(w[-1] for w in want)
    for s, t in target.items():
        assert sum(r.taken for r in after if r.source == s) == math.floor(t + 1e-9)
    assert mixing.WEIGHTS == (5, 2, 1)


def test_run_gives_the_same_rows(spark, staged, corpus):
    got = corpus_pipeline.run(spark, corpus[0]).collect()
    assert sorted(map(str, got)) == sorted(map(str, staged["mixing"][1]))


def test_clashing_identifiers_lose_no_clean_text(spark, tmp_path):
    """Every identifier has a clean text and a second one that a stage rejects: each stage drops just that one."""
    rng = np.random.default_rng(3)
    clean = {i: prose(rng, 90) for i in range(120)}
    items = [(0, prose(rng, 30))]
    junk = {i: " ".join(w + "***" for w in prose(rng, 80).upper().split()) for i in range(40)}
    near = {i: clean[i - 40] + " tail" for i in range(40, 80)}
    leak = {i: f"{prose(rng, 48)} {items[0][1]} {prose(rng, 48)}" for i in range(80, 120)}
    rows = [(i, t, "en", "a", len(t)) for part in (clean, junk, near, leak) for i, t in part.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(1000 + i, int(i % 2), 0) for i in range(120)]
    marked = [(1000 + i, prose(rng, 90) if i % 2 else " ".join(w + "***" for w in prose(rng, 80).upper().split()), "en", "b", 0) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs.union(spark.createDataFrame(marked, docs.schema))
    texts = lambda df: {(r.doc_id, r.text) for r in df.where("doc_id < 1000").collect()}
    left = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    want = set(clean.items()) | set(near.items()) | set(leak.items())
    assert texts(left) == want
    left = corpus_pipeline.drop_near_duplicates(spark, left, str(tmp_path))
    want -= set(near.items())
    assert texts(left) == want
    assert texts(corpus_pipeline.drop_contaminated(spark, left, str(tmp_path))) == set(clean.items())


def test_registration():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    numbers = sorted(int(n[2:].split("_")[0]) for n in names if n[2:3].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in names
    assert set(ORACLES) <= set(QUERIES) and {"op2_url_filters", "op5_mixing", "op11_chat_formatting", "op12_conversation_repair", "op13_lexical_search"} <= set(entry.oracle_sql())
    assert len(URL_RULES) == 5
