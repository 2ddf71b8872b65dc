"""Quality rules: repeated substrings of a text's words, from a suffix array and its longest common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import owners, slices, words

_SPACE = r"[\x20\x09-\x0D]"
_SYMBOL = r"[#*$%&|<>]"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, covered_words long, longest_repeat long, n_spans long, kept boolean"
)


def repeat_lengths(starts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For every word position, the length in words of the longest run beginning there that
    occurs again in the same text (occurrences may overlap).

    One suffix array serves the whole batch: suffixes are ranked by prefix doubling, the text
    being the first sort key, so suffixes of different texts are never neighbours with a
    common prefix. Only suffixes still tied go on to the next doubling. Neighbours' longest
    common prefixes come from the stored ranks, longest power first; a suffix's longest
    repeated prefix is the larger of its two neighbours' values, the height of the
    innermost LCP interval that holds it.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.repeat(starts[1:], np.diff(starts))
    first = owners(starts).astype(np.int64) << 32 | codes
    rank = np.unique(first, return_inverse=True)[1].astype(np.int64)
    levels = [rank]
    order = np.argsort(rank, kind="stable")
    # A rank is the position of its class's first member, so classes can be split without renumbering others.
    rank = np.empty(n, np.int64)
    sorted_rank = levels[0][order]
    head = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels = [rank]
    step = 1
    while True:
        at = rank[order]
        tied = np.zeros(n, bool)
        equal = at[1:] == at[:-1]
        tied[1:] |= equal
        tied[:-1] |= equal
        where = np.flatnonzero(tied)
        if not len(where):
            break
        suffix = order[where]
        after = suffix + step
        second = np.where(after < ends[suffix], rank[np.minimum(after, n - 1)] + 1, 0)
        key = np.lexsort((second, at[where]))
        suffix, second, group = suffix[key], second[key], at[where][key]
        order[where] = suffix
        head = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        rank = rank.copy()
        rank[suffix] = where[np.maximum.accumulate(np.where(head, np.arange(len(where)), 0))]
        levels.append(rank)
        step *= 2
    # A class of level k agrees on 2**k words, where that many are left.
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        fits = (a[live] + step <= ends[order[live]]) & (b[live] + step <= ends[order[live + 1]])
        hit = live[fits]
        hit = hit[levels[k][np.minimum(a[hit], n - 1)] == levels[k][np.minimum(b[hit], n - 1)]]
        lcp[hit] += step
        a[hit] += step
        b[hit] += step
    best = np.zeros(n, np.int64)
    best[order[:-1]] = lcp
    best[order[1:]] = np.maximum(best[order[1:]], lcp)
    return best


def cover(best: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of ``least`` words or more: the union of the repeats' spans."""
    n = len(best)
    edge = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(best >= least)
    np.add.at(edge, long, 1)
    np.add.at(edge, long + best[long], -1)
    return np.cumsum(edge[:n]) > 0


def _dup_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lists = pc.split_pattern(texts, "\n")
    lines, of = lists.values, owners(lists.offsets.to_numpy())
    with_word = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    lines, of = lines.filter(pa.array(with_word)), of[with_word].astype(np.int64)
    code = lines.dictionary_encode().indices.to_numpy()
    distinct = np.unique(of << 32 | code)
    rows = len(texts)
    return np.bincount(of, minlength=rows) - np.bincount(distinct >> 32, minlength=rows)


def judge(docs: DataFrame, least_words: int = 5, max_covered: float = 0.2, max_longest: float = 0.1,
          long_repeat: int = 10) -> DataFrame:
    """One row per row of ``docs``: base measures, repetition measures, and ``kept``.

    ``covered_words`` lie in a repeat of ``least_words`` or more, in ``n_spans`` separate
    spans; ``longest_repeat`` counts words. A text that passes the base rules is dropped where
    more than ``max_covered`` of its words are covered, or where its longest repeat has
    ``long_repeat`` words and more than ``max_longest`` of the text. Words in repeats of three or more
    count in the base rules, whose limit is half of the text: limits from there on would drop nothing more.

    Null and empty texts have no words and fail the base rules. Whole texts are measured; a
    task works on some megabytes of texts at once, or on one longer text. Repeated rows are
    judged alike, an empty table gives no rows, only ``doc_id`` and ``text`` are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                texts = pc.fill_null(part.column("text"), "")
                w = words(texts)
                n, of, rows = w.counts, owners(w.starts), part.num_rows
                best = repeat_lengths(w.starts, w.codes)
                blank = pc.count_substring_regex(texts, _SPACE).to_numpy()
                symbols = pc.count_substring_regex(texts, _SYMBOL).to_numpy().astype(np.int64)
                chars = pc.utf8_length(texts).to_numpy().astype(np.int64) - blank
                windows = np.bincount(of[cover(best, 3)], minlength=rows)
                inside = cover(best, least_words)
                begins = inside.copy()
                begins[1:] &= ~(inside[:-1] & (of[1:] == of[:-1]))
                covered = np.bincount(of[inside], minlength=rows)
                spans = np.bincount(of[begins], minlength=rows)
                longest = np.zeros(rows, np.int64)
                np.maximum.at(longest, of, best)
                failed = (n < 50) | (100 * windows > 50 * n)
                bad = (covered > max_covered * n) | ((longest >= long_repeat) & (longest > max_longest * n))
                cols = [n, chars, symbols, _dup_lines(texts), windows, failed, covered, longest, spans, ~(failed | bad)]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c) for c in cols]], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
