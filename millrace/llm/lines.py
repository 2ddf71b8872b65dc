"""Substring dedup: digests of normalised units, the earliest occurrence kept, the rest removed by offset."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.text import fresh, mix, owners, slices, words
from millrace.session import stage

#: The bytes of ASCII white space, and of the marks that end a sentence.
_SPACE, _ENDS = np.zeros(256, np.bool_), np.zeros(256, np.bool_)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ENDS[[*b".!?"]] = True
#: Units end at a line break, or at spaces and tabs behind a full stop, question or exclamation mark.
_BORDER = re.compile(r"[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*|(?<=[.!?])[ \t]+")
_LAST = (1 << 63) - 1
#: Words of a window, and how many neighbouring windows leave one anchor at least: every run of
#: ``WINDOW + CHOICE - 1`` = 50 words has an anchor, wherever it begins.
WINDOW, CHOICE = 25, 26

#: Units have all columns. Anchors have ``hi`` null; their word position is ``n``, their hash ``lo``, and ``start`` is the first
#: position of that hash in the same text, where it is an earlier one, or -1.
DIGESTS = "doc_id long, row long, n int, start int, stop int, words int, hi long, lo long, again boolean"
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()),
                      ("words", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("again", pa.bool_())])
_STEP = np.uint64(0x9E3779B97F4A7C15)


def units(text: str | None) -> Iterator[tuple[int, int]]:
    """``start, stop`` of every unit with a word, in code points."""
    text = text or ""
    pos = 0
    while pos < len(text):
        m = _BORDER.search(text, pos)
        stop, after = (m.start(), m.end()) if m else (len(text), len(text))
        if _ASCII_WORD.search(text, pos, stop):
            yield pos, stop
        pos = after


def _plain_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins and the last ends."""
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    ends = np.append(0, np.cumsum(sizes))
    first = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset] if len(texts) else 0
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[int(first):int(first) + int(ends[-1])] if data is not None and ends[-1] else np.zeros(0, np.uint8)
    return raw, ends


def unit_digests(raw: np.ndarray, ends: np.ndarray, starts: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, number, start, stop, words, two digests and repeat mark of every unit of a batch.

    ``starts`` has each text's first word, ``lanes`` two hashes for every word, whatever its case. A digest is the
    sum of the unit's words' hashes mixed with their places: 128 bits that depend on the words and their order alone.
    """
    n = len(lanes)
    space = _SPACE[raw]
    edge = np.zeros(len(raw) + 1, np.bool_)
    edge[ends] = True
    word = ~space
    begin = np.flatnonzero(word & (np.append(True, space[:-1]) | edge[:-1]))
    end = np.flatnonzero(word & (np.append(space[1:], True) | edge[1:])) + 1
    of = owners(starts)
    breaks = np.append(0, np.cumsum(raw == 10))
    closing = np.append(of[1:] != of[:-1], True)
    gap_end = np.where(closing, ends[of + 1], np.append(begin[1:], 0))
    after = raw[np.minimum(end, len(raw) - 1)]
    border = (breaks[gap_end] > breaks[end]) | (_ENDS[raw[end - 1]] & (gap_end > end) & ((after == 32) | (after == 9)))
    opens = np.append(True, closing[:-1] | border[:-1])
    first = np.flatnonzero(opens)
    counts = np.diff(np.append(first, n))
    last = first + counts - 1
    text = of[first]
    new_text = np.append(True, text[1:] != text[:-1])
    # What surrounds a text's first and last unit belongs to it, unless a line break or a sentence's end stands between.
    led = new_text & (breaks[begin[first]] == breaks[ends[text]])
    start = np.where(led, ends[text], begin[first])
    stop = np.where(closing[last] & ~border[last], ends[text + 1], end[last])
    points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    base = points[ends[text]]
    place = (np.arange(n) - np.repeat(first, counts)).astype(np.uint64)
    both = []
    with np.errstate(over="ignore"):
        for lane in (0, 1):
            total = np.add.reduceat(mix(lanes[:, lane] + place * _STEP), first)
            both.append(mix(total + counts.astype(np.uint64) * _STEP))
    number = np.arange(len(first)) - np.repeat(np.flatnonzero(new_text), np.diff(np.append(np.flatnonzero(new_text), len(first))))
    order = np.lexsort((number, both[1], both[0], text))
    again = np.zeros(len(first), np.bool_)
    a, b = order[1:], order[:-1]
    again[a] = (text[a] == text[b]) & (both[0][a] == both[0][b]) & (both[1][a] == both[1][b])
    return text, number, points[start] - base, points[stop] - base, counts, both[0], both[1], again


def anchors(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, word position, first equal position (or -1) and hash of the chosen windows: the smallest hash of every ``CHOICE`` neighbours.

    Which windows of a passage are chosen depends on the passage alone, so its copies share their anchors.
    """
    n, width = len(h), 1
    if n < WINDOW + CHOICE - 1:
        return (*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64))
    with np.errstate(over="ignore"):
        while width < WINDOW:
            step = min(width, WINDOW - width)
            h, width = mix(h[:len(h) - step] * _STEP + h[step:]), width + step
    of = owners(starts)
    at = []
    for i in range(0, len(h) - CHOICE + 1, 1 << 16):
        view = np.lib.stride_tricks.sliding_window_view(h[i:i + (1 << 16) + CHOICE - 1], CHOICE)
        # Neighbours lie in one text.
        inside = of[i:i + len(view)] == of[i + WINDOW + CHOICE - 2:][:len(view)]
        at.append(np.unique((view.argmin(1) + np.arange(len(view)) + i)[inside]))
    pos = np.unique(np.concatenate(at))
    of, pos, h = of[pos], pos - starts[of[pos]], h[pos]
    order = np.lexsort((pos, h, of))
    of, pos, h = of[order], pos[order], h[order]
    new = np.ones(len(of), np.bool_)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    own = pos[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(of) else pos
    return of, pos, np.where(new, -1, own), h


def digest_rows(docs: DataFrame) -> DataFrame:
    """Units and anchors of every text, in one pass over the texts. ``row`` tells texts apart that share an identifier;
    ``again`` marks a unit whose digest came earlier in the same text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = pc.fill_null(part.column("text"), "")
                w = words(texts)
                if not len(w.codes):
                    continue
                digest = xxhash.xxh3_128_digest
                lanes = np.frombuffer(b"".join(digest(v.lower()) for v in w.values.to_pylist()), np.uint64).reshape(-1, 2)[w.codes]
                text, *rest = unit_digests(*_plain_bytes(texts), w.starts, lanes)
                yield _digest_batch(part, text, rest)
                text, pos, own, h = anchors(lanes[:, 0], w.starts)
                yield _digest_batch(part, text, [pos, own, None, None, None, h, None])

    return _keyed(docs).mapInArrow(run, DIGESTS)


def _digest_batch(part: pa.RecordBatch, text: np.ndarray, columns: list[np.ndarray | None]) -> pa.RecordBatch:
    at = pa.array(text)
    made = [part.column("doc_id").take(at), part.column("row").take(at)]
    for field, c in zip(list(_DIGESTS)[2:], columns, strict=True):
        c = c.view(np.int64) if c is not None and c.dtype == np.uint64 else c
        made.append(pa.nulls(len(text), field.type) if c is None else pa.array(c).cast(field.type))
    return pa.RecordBatch.from_arrays(made, schema=_DIGESTS)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64("text").alias("row"), "text")


def _texts(docs: DataFrame, wanted: DataFrame, label: str) -> DataFrame:
    """``doc_id, row, text`` of the wanted texts, each once."""
    own = _keyed(docs).join(wanted.select("doc_id", "row").distinct(), ["doc_id", "row"])
    return stage(own.groupBy("doc_id", "row").agg(F.first("text").alias("text")), label)


def extend(text: str, other: str | None, pairs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``start, stop, words`` of the runs around pairs of equal positions, as far as the words agree.

    Without ``other`` the run is compared with an earlier place of the same text, which it doesn't overlap.
    """
    where = [m.span() for m in _ASCII_WORD.finditer(text)]
    mine = [text[a:b].lower() for a, b in where]
    theirs = mine if other is None else [m[0].lower() for m in _ASCII_WORD.finditer(other)]
    out, done = [], 0
    for p, q in sorted(pairs):
        if p + WINDOW <= done or mine[p:p + WINDOW] != theirs[q:q + WINDOW]:
            continue
        lo, hi = 0, WINDOW
        room = lambda: other is not None or q + hi < p - lo  # noqa: B023, E731
        while lo < min(p, q) and mine[p - lo - 1] == theirs[q - lo - 1] and room():
            lo += 1
        while p + hi < len(mine) and q + hi < len(theirs) and mine[p + hi] == theirs[q + hi] and room():
            hi += 1
        out.append((where[p - lo][0], where[p + hi - 1][1], lo + hi))
        done = p + hi
    return out


def passages(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """``doc_id, row, start, stop, words, kept``: word runs that an earlier text, or the same one earlier, holds.

    Every run of 50 or more words has an anchor here, wherever it begins and ends, which is extended to
    the exact borders of the run shared with the anchor's first holder. A later holder may share more; what is left of
    that run then has anchors of its own as soon as 50 of its words follow one another. So without these runs no
    text keeps a stretch of 50 words that an earlier one holds.
    """
    all_anchors = digests.where("hi IS NULL").select("doc_id", "row", F.col("n").alias("pos"), F.col("start").alias("own"), F.col("lo").alias("h"))
    first = all_anchors.where("own < 0").groupBy("h").agg(F.min(F.struct("doc_id", "row", "pos")).alias("k"), F.count(F.lit(1)).alias("n"))
    first = stage(first.where("n > 1").select("h", "k"), "anchors")
    met = all_anchors.join(first, "h", "left").withColumn("other", F.coalesce(F.col("doc_id") > F.col("k.doc_id"), F.lit(False)))
    met = met.where(F.col("other") | ((F.col("own") >= 0) & (F.col("pos") >= F.col("own") + WINDOW)))
    k = lambda c, same: F.when(F.col("other"), F.col(f"k.{c}")).otherwise(F.col(same))
    met = met.select("doc_id", "row", "pos", "other", k("doc_id", "doc_id").alias("kept"), k("row", "row").alias("kept_row"), k("pos", "own").alias("at"))
    met = met.groupBy("doc_id", "row", "other", "kept", "kept_row").agg(F.collect_set(F.struct("pos", "at")).alias("pairs"))
    met = stage(met, "met")
    wanted = met.select("doc_id", "row").union(met.where("other").select("kept", "kept_row"))
    texts = _texts(docs, wanted, "texts")
    both = met.join(texts, ["doc_id", "row"]).join(texts.select(F.col("doc_id").alias("kept"), F.col("row").alias("kept_row"), F.col("text").alias("theirs")), ["kept", "kept_row"])
    both = both.select("doc_id", "row", "kept", "other", "text", "theirs", F.col("pairs.pos").alias("pos"), F.col("pairs.at").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                out = []
                for r in part.to_pylist():
                    found = extend(r["text"], r["theirs"] if r["other"] else None, list(zip(r["pos"], r["at"], strict=True)))
                    out += [(r["doc_id"], r["row"], *x, r["kept"]) for x in found]
                yield _batch(out, _PASSAGES)

    return both.mapInArrow(run, "doc_id long, row long, start int, stop int, words int, kept long")


_ASCII_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PASSAGES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("words", pa.int32()), ("kept", pa.int64())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("words", pa.int64()), ("units", pa.int64()), ("kept_in", pa.list_(pa.int64()))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def joined(text: str, spans: list[tuple[int, int, list[int]]]) -> list[tuple[int, int, int, int, list[int]]]:
    """``start, stop, words, units, kept_in`` of spans ``start, stop, kept_in``; those with no word between them are one."""
    merged: list[list] = []
    for a, b, kept in sorted(spans):
        if merged and (a <= merged[-1][1] or not text[merged[-1][1]:a].strip()):
            merged[-1][1] = max(b, merged[-1][1])
            merged[-1][2] |= set(kept)
        else:
            merged.append([a, b, set(kept)])
    all_units = list(units(text))
    return [(a, b, len(text[a:b].split()), sum(x < b and a < y for x, y in all_units), sorted(kept)) for a, b, kept in merged]


def repeated_spans(docs: DataFrame, least_words: int = 25) -> DataFrame:
    """``doc_id, row, start, stop, words, units, kept_in``: what to remove, one row per span.

    Two kinds of repeats are removed. Units are lines cut into sentences. A unit repeats where its
    digest occurs in a document of a smaller ``doc_id``, or earlier in the same text; the earliest
    stays. Runs of repeated units that follow one another are one span; spans of fewer than
    ``least_words`` words stay in the text, so that a common short line alone harms no document.
    Passages are word runs, wherever they begin and end: all of 50 words or more, and shorter
    ones down to ``WINDOW`` words where they have an anchor. Overlapping spans are one. ``units``
    counts the units that a span touches; ``kept_in`` lists the documents where its parts were found first.

    Rows that share an identifier count as one document with several texts; equal rows lose
    the same spans. Null identifiers rank last. Null, empty and wordless texts have no units.
    Only ``doc_id`` and ``text`` are read.

    A digest meets others only as a map-side combined minimum, then in a join with one row
    per repeated digest, whose hot rows Spark can split.
    """
    digests = stage(digest_rows(docs), "digests")
    whole = stage(_unit_spans(digests.where("hi IS NOT NULL"), least_words), "unit-spans")
    runs = stage(passages(docs, digests).where(F.col("words") >= least_words), "passages")
    per_text = whole.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "stop", "kept_in")).alias("whole"))
    more = runs.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "stop", F.array("kept").alias("kept_in"))).alias("runs"))
    more = more.join(per_text, ["doc_id", "row"], "left").withColumn("whole", F.coalesce("whole", F.expr("filter(runs, r -> false)")))
    # Runs inside a span of whole units add nothing to it.
    more = more.withColumn("runs", F.expr("filter(runs, r -> NOT exists(whole, w -> w.start <= r.start AND r.stop <= w.stop))"))
    more = stage(more.where("size(runs) > 0"), "more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                out = []
                for r in part.to_pylist():
                    spans = [(x["start"], x["stop"], x["kept_in"]) for x in [*r["whole"], *r["runs"]]]
                    out += [(r["doc_id"], r["row"], *x) for x in joined(r["text"], spans)]
                yield _batch(out, _SPANS)

    mended = more.join(_texts(docs, more, "more-texts"), ["doc_id", "row"]).select("doc_id", "row", "whole", "runs", "text")
    mended = mended.mapInArrow(run, "doc_id long, row long, start int, stop int, words long, units long, kept_in array<long>")
    spans = whole.join(more.select("doc_id", "row"), ["doc_id", "row"], "left_anti").unionByName(mended)
    shown = lambda c: F.nullif(c, F.lit(_LAST))
    return spans.withColumn("doc_id", shown(F.col("doc_id"))).withColumn("kept_in", F.transform("kept_in", shown))


def _unit_spans(all_units: DataFrame, least_words: int) -> DataFrame:
    """Runs of repeated whole units; null identifiers are ``_LAST``."""
    all_units = all_units.withColumnRenamed("n", "unit")
    first = all_units.where(~F.col("again")).groupBy("hi", "lo").agg(F.min("doc_id").alias("kept"), F.count(F.lit(1)).alias("n"))
    # Written, so that the join below has two plain exchanges and a digest with many rows can be split.
    first = stage(first.where("n > 1").select("hi", "lo", "kept"), "repeated")
    met = all_units.join(first, ["hi", "lo"], "left").where(F.col("again") | (F.col("doc_id") > F.col("kept")))
    met = met.withColumn("kept", F.coalesce(F.least("kept", "doc_id"), "doc_id"))
    # All that follows looks at one text's units, so one exchange serves it.
    met = met.select("doc_id", "row", "unit", "start", "stop", "words", "kept").repartition("doc_id", "row")
    # Equal rows of the input bring equal units; they count once.
    gone = met.groupBy("doc_id", "row", "unit", "start", "stop", "words").agg(F.min("kept").alias("kept"))
    run = F.col("unit") - F.row_number().over(W.partitionBy("doc_id", "row").orderBy("unit"))
    spans = gone.withColumn("run", run).groupBy("doc_id", "row", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("words"),
        F.count(F.lit(1)).alias("units"), F.array_sort(F.collect_set("kept")).alias("kept_in"))
    return spans.where(F.col("words") >= least_words).drop("run")


def cut(text: str | None, starts, stops) -> str | None:
    """The text without the spans and the white space that follows each."""
    if text is None or starts is None:
        return text
    out, pos = [], 0
    for start, stop in sorted(zip(starts, stops, strict=True)):
        out.append(text[pos:start])
        while stop < len(text) and text[stop].isspace():
            stop += 1
        pos = stop
    return "".join([*out, text[pos:]])


def remove_repeats(docs: DataFrame, least_words: int = 25) -> DataFrame:
    """The rows of ``docs`` without their repeated spans, all columns as they were but ``text``
    (and ``n_chars``, if there is one). A row whose text is nothing but repeats keeps an empty text."""
    spans = repeated_spans(docs, least_words)
    key, starts, stops = (fresh(docs, c) for c in ("key", "starts", "stops"))
    # One row per text; a text's spans are bounded by its length.
    per = spans.groupBy("doc_id", "row").agg(F.collect_list("start").alias(starts), F.collect_list("stop").alias(stops))
    per = per.select(F.struct("doc_id", "row").alias(key), starts, stops)

    @F.pandas_udf("string")
    def cut_all(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in parts:
            yield pd.Series([cut(*x) for x in zip(*batch, strict=True)], dtype=object)

    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"))
    out = docs.withColumn(key, own).join(per, key, "left").withColumn("text", cut_all("text", starts, stops)).select(docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
