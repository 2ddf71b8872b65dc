"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import mix

_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
          "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software")
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.")
_COMMONS = "This work is licensed under a Creative Commons {} 4.0 International License."

#: Templates: whole short licenses, and the headers and notices of all. Fixed values, public wording; a name may have several texts.
TEMPLATES = (
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0-notice", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-notice", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0-notice", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("gpl-header", _FREE.format("General Public License", "3")),
    ("gpl-2.0-header", _FREE.format("General Public License", "2")),
    ("lgpl-header", _FREE.format("Lesser General Public License", "3")),
    ("lgpl-2.1-header", _FREE.format("Lesser General Public License", "2.1").replace("program is free software:", "library is free software;")),
    ("agpl-header", _FREE.format("Affero General Public License", "3")),
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Released under the terms of the MIT License."),
    ("mit-notice", "Licensed under the MIT License."),
    ("mit-grant", _GRANT),
    ("mit", _GRANT + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
     "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
     "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
     "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all "
     "copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-notice", "Released under the ISC License."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-2-clause", _BSD),
    ("bsd-3-clause", _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-notice", "Released under the BSD License."),
    ("mpl-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0-notice", "Licensed under the Mozilla Public License, version 2.0."),
    ("mpl-2.0-notice", "Licensed under the MPL 2.0."),
    ("epl-2.0-header", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
     "compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to "
     "anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("cc0-notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc-by-4.0-notice", _COMMONS.format("Attribution")),
    ("cc-by-sa-4.0-notice", _COMMONS.format("Attribution-ShareAlike")),
    ("cc-by-nc-4.0-notice", _COMMONS.format("Attribution-NonCommercial")),
    ("cc-by-nd-4.0-notice", _COMMONS.format("Attribution-NoDerivatives")),
    ("cc-by-nc-sa-4.0-notice", _COMMONS.format("Attribution-NonCommercial-ShareAlike")),
    ("cc-by-4.0-notice", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0-notice", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
)
#: Templates of up to this many words are also found by any two neighbouring words: a match of 0.7 keeps two such.
SHORT = 14
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
SCHEMA = "doc_id long, template string, coverage double, start int, stop int, matched_words int, added_words int, template_words int, text string"


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    out = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for k in range(width):
        out = mix(out + hashes[k:k + len(out)] + np.uint64(1))
    return out


def winnow(fingerprints: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of every window, the rightmost of equals."""
    n = len(fingerprints)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(fingerprints[::-1]))]) if n else np.zeros(0, int)
    view = np.lib.stride_tricks.sliding_window_view(fingerprints[::-1], window)
    return np.unique(n - 1 - (np.arange(len(view)) + view.argmin(1)))


@dataclass(frozen=True)
class Index:
    """The templates' words by number and the inverted index of their winnowed fingerprints."""

    vocabulary: dict[str, int]
    names: list[str]
    words: list[np.ndarray]
    keys: np.ndarray
    template: np.ndarray
    position: np.ndarray
    pair_keys: np.ndarray
    pair_template: np.ndarray
    pair_position: np.ndarray


def _inverted(entries: list[tuple[np.ndarray, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints in order, each with its template and place, from ``fingerprints, template, places``."""
    if not entries:
        return np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int)
    key = np.concatenate([k for k, _, _ in entries])
    of, at = np.concatenate([np.full(len(k), t) for k, t, _ in entries]), np.concatenate([p for *_, p in entries])
    order = np.argsort(key, kind="stable")
    return key[order], of[order], at[order]


def build_index(templates: list[tuple[str, str]], width: int = 3, window: int = 3) -> Index:
    """Index some templates. A text that shares ``width + window - 1`` words in a row with one meets it here, or
    two words in a row with a short one; a template needs ``width`` words to be found."""
    vocabulary: dict[str, int] = {}
    names, texts, entries, pairs = [], [], [], []
    for name, text in templates:
        w = np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in _WORD.findall((text or "").lower())], np.uint64)
        if len(w) < width:
            continue
        g = grams(w, width)
        chosen = winnow(g, window)
        entries.append((g[chosen], len(names), chosen))
        if len(w) <= SHORT:
            pairs.append((grams(w, 2), len(names), np.arange(len(w) - 1)))
        names.append(name)
        texts.append(w)
    return Index(vocabulary, names, texts, *_inverted(entries), *_inverted(pairs))


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Global alignment of the template with ``text`` inside a band around the diagonal ``text = template + shift``.

    Returns matched words, first and last matched word of the text (-1 without a match). Words
    of the template may be missing and words of the text be added; the alignment maximises
    matches, then prefers the earliest start. One row of the band per template word.
    """
    n, m = len(template), len(text)
    span = 2 * band + 1
    # Best (matches, -first, last) of a path that ends at or left of each band cell.
    score = np.zeros(span, np.int64)
    first = np.full(span, -1)
    last = np.full(span, -1)
    for i in range(n):
        lo = i + shift - band
        cells = np.arange(lo, lo + span)
        hit = (cells >= 0) & (cells < m)
        hit[hit] = text[cells[hit]] == template[i]
        # Cell c of this row: from c of the row before (both step on), from c + 1 (template word missing).
        up = np.append(score[1:], 0), np.append(first[1:], -1), np.append(last[1:], -1)
        diag = score + hit
        dfirst = np.where(hit & (first < 0), cells, first)
        dlast = np.where(hit, cells, last)
        better = diag >= up[0]
        new = np.where(better, diag, up[0])
        nf, nl = np.where(better, dfirst, up[1]), np.where(better, dlast, up[2])
        best = np.maximum.accumulate(new)
        source = np.maximum.accumulate(np.where(np.concatenate([[True], new[1:] > best[:-1]]), np.arange(span), 0))
        score, first, last = new[source], nf[source], nl[source]
    k = int(np.argmax(score))
    return int(score[k]), int(first[k]), int(last[k])


def scan_text(text: str | None, index: Index, width: int, least: float, band_share: float = 0.25):
    """Matches of one whole text: ``name, coverage, start, stop, matched, added, words`` with offsets in code points."""
    low = (text or "").lower()
    if len(low) != len(text or ""):  # lower-casing can lengthen a text; offsets need equal lengths
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    known = index.vocabulary.get
    w = np.array([known(x, 0) for x in _WORD.findall(low)], np.uint64)  # 0: a word of no template
    if len(w) < 2 or not len(index.keys):
        return []
    found = []
    seeds: dict[int, set[int]] = {}
    for g, keys, template, position in ((grams(w, width), index.keys, index.template, index.position),
                                        (grams(w, 2), index.pair_keys, index.pair_template, index.pair_position)):
        lo, hi = np.searchsorted(keys, g, "left"), np.searchsorted(keys, g, "right")
        for p in np.flatnonzero(hi > lo):
            for e in range(lo[p], hi[p]):
                t = int(template[e])
                words = index.words[t]
                if len(words) <= SHORT:
                    # Around a pair of common words there must be enough of the template's words at all.
                    near = w[max(0, p - len(words) - 2):p + len(words) + 3]
                    if np.isin(words, near).sum() < least * len(words):
                        continue
                seeds.setdefault(t, set()).add(int(p - position[e]))
    for t, shifts in seeds.items():
        template = index.words[t]
        band = max(2, int(len(template) * band_share))
        done = None
        for shift in sorted(shifts):
            if done is not None and shift <= done:
                continue
            done = shift + band  # seeds of the same place lie in one band
            matched, first, last = align(template, w, shift + band // 2, band)
            # Words between the first and the last match beyond the template's number say that something was put in.
            added = max(0, last - first + 1 - len(template))
            if matched and matched >= least * (len(template) + added):
                found.append((t, matched, first, last, added))
    # Of overlapping matches the one with the most words stays, those put in or missing counted against it, then the better covered, then the earlier template.
    found.sort(key=lambda f: (f[4] + len(index.words[f[0]]) - 2 * f[1], -f[1] / len(index.words[f[0]]), f[0], f[2]))
    kept: list[tuple[int, int, int, int, int]] = []
    for f in found:
        if all(f[3] < k[2] or f[2] > k[3] for k in kept):
            kept.append(f)
    kept.sort(key=lambda f: f[2])
    spans = [m.span() for m in _WORD.finditer(low)] if kept else []
    return [(index.names[t], matched / len(index.words[t]), spans[a][0], spans[b][1], matched, added, len(index.words[t])) for t, matched, a, b, added in kept]


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, width: int = 3, window: int = 3, least: float = 0.7,
         block: int = 2_000) -> DataFrame:
    """One row per license passage found in the whole texts of ``docs``: ``doc_id, template,
    coverage`` (share of the template's words, in order), ``start, stop`` (code points), ``matched_words, added_words``
    (by how many words the passage is longer than the template), ``template_words`` and the passage itself. At least
    ``least`` of the template's and the added words must match, so an inserted word tells two licenses apart.

    The templates are the stated query set. They are compared in blocks of ``block`` templates,
    so what is sent to a task is bounded; every block meets all texts. Passages of one text that
    overlap within a block count once, as the longest match.

    Null and empty texts, empty templates and tables give no rows; repeated rows give repeated
    results; only ``doc_id`` and ``text`` are read.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    parts = None
    for i in range(0, max(len(templates), 1), block):
        index = build_index(list(templates[i:i + block]), width, window)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            for b in batches:
                rows = [(d, *hit, t[hit[2]:hit[3]]) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)
                        for hit in scan_text(t, index, width, least)]
                cols = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
        parts = found if parts is None else parts.union(found)
    return parts
