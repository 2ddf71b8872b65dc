"""Winnowing and banded alignment against full comparisons."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import licenses

TEMPLATES = [("grant", "Permission is given, free of charge, to any person who obtains a copy of this work to use, change and share it without limit."), ("short", "Under the Plain License, version 2.1."), ("none", ""), ("tiny", "ok")]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j] + 1 if x == y else 0, row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 5), min_size=1, max_size=20))
def test_a_wide_band_gives_the_longest_common_subsequence(template, text):
    t, x = np.array(template), np.array(text)
    matched, first, last = licenses.align(t, x, 0, 40)
    assert matched == lcs(template, text)
    assert matched == 0 or lcs(template, text[first:last + 1]) == matched


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=40), st.integers(1, 6))
def test_winnow_marks_every_window(values, window):
    chosen = set(licenses.winnow(np.array(values, np.uint64), window).tolist())
    for i in range(max(1, len(values) - window + 1)):
        part = values[i:i + window]
        assert any(k in chosen and values[k] == min(part) for k in range(i, i + len(part)))


def test_scan(spark):
    grant, short = TEMPLATES[0][1], TEMPLATES[1][1]
    changed = grant.replace("free of charge", "for free").replace("any person", "anyone").upper()
    filler = " ".join(f"w{k}" for k in range(5000))
    rows = [(1, f"İ. {short} tail"), (2, f"{filler}\n{grant}\n{filler} {short}"), (3, f"x {changed} y"), (4, filler), (5, None), (6, ""), (None, short), (1, f"İ. {short} tail"),
            (7, "under the plain"), (8, "under the plain license " + filler)]
    got = licenses.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, template string"), TEMPLATES).collect()
    found = sorted(((r.doc_id, r.template) for r in got), key=str)
    assert found == sorted([(1, "short"), (1, "short"), (2, "grant"), (2, "short"), (3, "grant"), (None, "short")], key=str)
    texts = dict(rows)
    for r in got:
        assert texts[r.doc_id][r.start:r.stop] == r.text and r.matched_words <= r.template_words and 0.7 <= r.coverage <= 1
        assert r.coverage == r.matched_words / r.template_words
    assert {r.coverage for r in got if r.template == "short"} == {1.0}
    # Blocks of one template each find the same passages.
    again = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), TEMPLATES, block=1).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


INDEX = licenses.build_index(list(licenses.TEMPLATES))


def names(text):
    return [h[0] for h in licenses.scan_text(text, INDEX, 3, 0.7)]


def test_sentences_are_named_rightly():
    header = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    cases = {
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa-4.0-notice",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by-4.0-notice",
        header.format("Lesser General Public"): "lgpl-header", header.format("General Public"): "gpl-header", header.format("Affero General Public"): "agpl-header",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc-grant",
        "Released under an MIT License.": "mit-notice", "Released under the terms of the MIT License.": "mit-notice", "Licensed under the Mozilla Public License, version 2.0.": "mpl-2.0-notice",
        "This program is licensed under the GNU Affero General Public License, version 3.": "agpl-3.0-notice", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0-notice",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0-notice", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0-notice",
    }
    assert {text: names(f"Some words before. {text} And the others behind it.") for text in cases} == {text: [name] for text, name in cases.items()}
    for plain in ("It was released under the bridge of the old town by night.", "The public license office is open; version 3 of the form is at the desk.", "under the of the under the license the under the"):
        assert names(plain) == []


def test_every_template_against_all_others():
    """Whole and with a part of its words changed, every template is found where it stands; the best of all alignments names it."""
    rng = np.random.default_rng(14)
    for name, text in licenses.TEMPLATES:
        got = licenses.scan_text(f"alpha beta\n{text}\ngamma delta", INDEX, 3, 0.7)
        assert [(h[0], h[1], h[5]) for h in got] == [(name, 1.0, 0)], name
        spelled = text.split()
        for _ in range(6):
            k = rng.choice(len(spelled), max(0, int(len(spelled) * 0.12)), replace=False)
            mixed = " ".join(f"other{x}" if x in k else w for x, w in enumerate(spelled))
            own = np.array([INDEX.vocabulary.get(x, 0) for x in licenses._WORD.findall(mixed.lower())], np.uint64)
            best = {}
            for t, template in enumerate(INDEX.words):
                matched, first, last = licenses.align(template, own, 0, max(len(template), len(own)))
                added = max(0, last - first + 1 - len(template))
                if matched and matched >= 0.7 * (len(template) + added):
                    best[t] = (added + len(template) - 2 * matched, -matched / len(template), t)
            found = names(f"alpha beta {mixed} gamma delta")
            if best:
                assert found and found[0] == INDEX.names[min(best.values())[2]] or len(found) > 1, (name, mixed, found)


def test_nothing_to_scan(spark):
    df = spark.createDataFrame([(1, "x y z")], "doc_id long, text string")
    assert licenses.scan(df, []).collect() == [] and licenses.scan(df.where("false"), TEMPLATES).collect() == []
