"""Repeated units against a plain pass over all documents in order."""

from __future__ import annotations

import collections
import re

import numpy as np

from millrace.llm import lines


def plain(rows, least):
    """Removed spans per (doc, text), each text once."""
    texts = collections.OrderedDict.fromkeys((float("inf") if d is None else d, t) for d, t in rows)
    first = {}
    parts = {}
    for d, t in texts:
        own, pos = [], 0
        t = t or ""
        for m in [*re.finditer(r"\s*\n\s*|(?<=[.!?])[ \t]+", t), None]:
            a, b = pos, m.start() if m else len(t)
            if t[a:b].split():
                own.append((a, b, " ".join(t[a:b].lower().split())))
            pos = m.end() if m else len(t)
        parts[d, t] = own
        for *_, u in own:
            first[u] = min(first.get(u, d), d)
    out = []
    for (d, t), own in parts.items():
        seen, run = set(), []
        for a, b, u in [*own, (0, 0, None)]:
            if u is not None and (u in seen or first[u] < d):
                run.append((a, b, len(u.split()), first[u]))
            else:
                if sum(r[2] for r in run) >= least:
                    out.append((None if d == float("inf") else d, run[0][0], run[-1][1], sum(r[2] for r in run), len(run), [None if k == float("inf") else k for k in sorted({r[3] for r in run})]))
                run = []
            seen.add(u)
    return sorted(out, key=str)


def corpus():
    rng = np.random.default_rng(11)
    sentences = [" ".join(f"W{x}" for x in rng.integers(0, 500, rng.integers(1, 20))) + rng.choice([".", "!", ""]) for _ in range(60)]
    texts = []
    for _ in range(60):
        own = [sentences[k] if rng.random() < 0.4 else " ".join(f"v{x}" for x in rng.integers(0, 9999, 8)) + "." for k in rng.integers(0, 60, 12)]
        texts.append("".join(u + rng.choice([" ", "\n", "\n\n", " \t"]) for u in own))
    return [*enumerate(texts), (7, texts[7]), (61, None), (62, ""), (63, " \n "), (None, texts[3]), (64, texts[5].upper())]


def test_against_a_plain_pass(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, kept string")
    for least in (1, 12, 25):
        got = sorted(((r.doc_id, r.start, r.stop, r.words, r.units, r.kept_in) for r in lines.repeated_spans(df, least).collect()), key=str)
        assert got == plain(rows, least)


def test_texts_without_their_repeats(spark):
    passage = " ".join(f"p{k}" for k in range(60)) + "."
    rows = [(2, f"Own words here. {passage} More own words.", 1), (1, f"First.\n{passage}\nEnd.", 2), (3, passage, 3), (4, "Own words here.", 4), (5, None, 5), (6, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int").selectExpr("*", "length(text) AS n_chars")
    got = {r.doc_id: (r.text, r.n_chars, r.key) for r in lines.remove_repeats(df).collect()}
    assert got == {1: (rows[1][1], len(rows[1][1]), 2), 2: ("Own words here. More own words.", 31, 1), 3: ("", 0, 3), 4: ("Own words here.", 15, 4), 5: (None, None, 5), 6: ("", 0, 6)}


def test_spans_restore_the_text(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = collections.defaultdict(list)
    for r in lines.repeated_spans(df, 12).where("doc_id IS NOT NULL").collect():
        spans[r.doc_id].append((r.start, r.stop))
    for d, t in rows:
        for a, b in spans.get(d, []):
            assert t[a:b] == t[a:b].strip() and t[a:b]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lines.repeated_spans(none).collect() == [] and lines.remove_repeats(none).collect() == []


def test_passages_inside_sentences(spark):
    """A repeated passage without sentence ends of its own goes whole, wherever it begins; the earliest one stays."""
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(f"u{x}" for x in rng.integers(0, 10**6, n))
    passage = prose(50)
    texts = {1: f"{prose(40)} {passage} {prose(30)}. End.", 2: f"Start {prose(7)} {passage.upper()}, {prose(9)}", 3: f"A {passage} b {prose(70)} c {passage} d",
             4: f"{prose(20)}. {' '.join(passage.split()[:49])}"}
    texts[5] = " ".join(["again"] * 200)
    df = spark.createDataFrame([*texts.items(), (None, passage)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.remove_repeats(df).collect()}
    last = passage.split()[-1]
    assert got[1] == texts[1] and got[None] == ""
    assert got[2] == texts[2].replace(" ".join(passage.upper().split()[:-1]) + " ", "")  # "word," isn't the passage's last word
    assert got[3] == texts[3].replace(passage + " ", "") and last not in got[3]
    assert len(got[5].split()) < 200 and set(got[5].split()) == {"again"}
    spans = {r.doc_id: (r.words, r.kept_in) for r in lines.repeated_spans(df).where("doc_id = 2 OR doc_id IS NULL").collect()}
    assert spans == {2: (49, [1]), None: (50, [1])}


def test_no_stretch_of_fifty_words_survives_twice(spark):
    """Texts cut from one stream at random borders, so that later holders share more of a run than the first one:
    of what stays in a text, no 50 words that follow one another stand in an earlier one; all that goes is repeated."""
    rng = np.random.default_rng(8)
    stream = [f"s{x}" for x in rng.integers(0, 10**6, 900)]
    texts = {}
    for d in range(90):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            a, n = int(rng.integers(0, 850)), int(rng.integers(20, 160))
            parts += stream[a:a + n] + [f"own{d}_{k}" for k in range(int(rng.integers(0, 40)))]
        texts[d] = "  ".join(parts) if d % 3 else " ".join(parts).upper()
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    gone = collections.defaultdict(list)
    for r in lines.repeated_spans(df).collect():
        gone[r.doc_id].append((r.start, r.stop))
    seen50, seen25, left = set(), set(), 0
    for d, t in texts.items():
        found = [(m.start(), m[0].lower(), any(a <= m.start() < b for a, b in gone[d])) for m in re.finditer(r"\S+", t)]
        ws = [w for _, w, _ in found]
        before = {tuple(ws[k:k + 25]): k for k in range(len(ws) - 25, -1, -1)}  # first places in this text
        for k in range(len(ws) - 49):
            if not any(g for *_, g in found[k:k + 50]):
                assert tuple(ws[k:k + 50]) not in seen50, (d, k)
        for k, (_, _, g) in enumerate(found):
            if g:
                near = [x for x in range(max(0, k - 24), k + 1) if len(ws[x:x + 25]) == 25]
                assert any(tuple(ws[x:x + 25]) in seen25 or before[tuple(ws[x:x + 25])] < x for x in near), (d, k)
        left += sum(not g for *_, g in found)
        seen50 |= {tuple(ws[k:k + 50]) for k in range(len(ws) - 49)}
        seen25 |= set(before)
    assert left < 0.6 * sum(len(t.split()) for t in texts.values())


def test_units_in_bytes_as_in_text():
    """The vectorised borders are those of the pattern, in code points, and digests depend on words in order alone."""
    import pyarrow as pa
    import xxhash

    from millrace.llm.text import words

    rng = np.random.default_rng(4)
    bits = ["a.", "b", "É!", "naïve?", " ", "  ", "\n", "\t", " \n ", ".", "\U0001f600", "B", "x y", "", "\r\n", "\x0b"]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 30)))) for _ in range(1500)] + ["", " ", "\n", "a", " a ", "a. "]
    w = words(pa.array(texts))
    lanes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(v.lower()) for v in w.values.to_pylist()), np.uint64).reshape(-1, 2)[w.codes]
    text, number, start, stop, counts, hi, lo, again = lines.unit_digests(*lines._plain_bytes(pa.array(["pad", *texts])[1:]), w.starts, lanes)
    got, same, seen = collections.defaultdict(list), {}, set()
    for t, n, a, b, c, x, y, r in zip(text, number, start, stop, counts, hi, lo, again, strict=True):
        assert n == len(got[t])
        got[t].append((int(a), int(b)))
        own = tuple(re.findall(r"[^\x20\x09-\x0D]+", texts[t][a:b].lower()))
        assert len(own) == c and same.setdefault(own, (x, y)) == (x, y) and r == ((t, own) in seen)
        seen.add((t, own))
    assert len(set(same.values())) == len(same)
    # A space that the pattern leaves behind a border's spaces, such as a vertical tab, doesn't belong to the next unit here.
    trim = lambda t, a, b: (a + len(t[a:b]) - len(t[a:b].lstrip("\t\n\x0b\x0c\r ")) if a else a, b)
    for i, t in enumerate(texts):
        assert got.get(i, []) == [trim(t, a, b) if k else (a, b) for k, (a, b) in enumerate(lines.units(t))], repr(t)
