"""Benchmark decontamination: a randomised SVD of TF-IDF passages, cosine candidates, then ordered-word and answer checks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import slices, words
from millrace.session import stage

#: Words of a passage, and between the starts of two passages that are searched.
WINDOW, STRIDE = 64, 32
#: Latent dimensions (and item passages) of a block of items, and the extra columns of the random test matrix.
RANK, EXTRA = 256, 16
#: Terms that stand in more than this share of passages carry no weight, unless an item has few rarer ones.
MAX_SHARE, LEAST_TERMS = 0.005, 12
#: Rows of a partial sum that travel as one record, and the groups of tasks whose records are added first: at a million
#: tasks and 272 columns neither of the two steps holds more than 150 MB of records in one group.
CHUNK, GROUPS = 64, 1024
SCHEMA = "doc_id long, text_digest long, item_id long, cosine double, lcs_share double, answer_share double, start_word int, stop_word int"

#: Fixed value: what is stripped from both ends of a word.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\u00a1\u00ab\u00b7\u00bb\u00bf\u2013\u2014\u2018\u2019\u201c\u201d\u201e\u2026"


def plain(words: pa.Array) -> pa.Array:
    """Words in lower case, without punctuation at their ends."""
    return pc.utf8_trim(pc.utf8_lower(words), characters=EDGES)


@dataclass(frozen=True)
class Item:
    """A benchmark item: its words by number, and where its answer (the last sentence or sentences) begins."""

    item_id: int
    codes: np.ndarray
    answer: np.ndarray


def _answer_start(text: str, least: int = 5) -> int:
    """Words of the text before its answer: the shortest run of closing sentences with ``least`` words."""
    sentences = [s.split() for s in re.split(r"(?<=[.!?])\s+|\n+", text)]
    total = sum(map(len, sentences))
    taken = 0
    for s in reversed(sentences):
        taken += len(s)
        if taken >= least:
            break
    return total - taken


def encode_items(rows: list[tuple[int, str]]) -> tuple[dict[str, int], list[Item]]:
    vocabulary: dict[str, int] = {}
    items = []
    for item_id, text in rows:
        own = plain(pa.array((text or "").split(), pa.string())).to_pylist()
        codes = [vocabulary.setdefault(w, len(vocabulary)) if w else -1 for w in own]
        start = _answer_start(text or "")
        whole, answer = (np.array([c for c in part if c >= 0], np.int32) for part in (codes, codes[start:]))
        if len(whole):
            items.append(Item(item_id, whole, answer))
    return vocabulary, items


def encode(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """``doc_id, text_digest, codes``: every word of every text as the number of its benchmark term, or -1."""

    terms = pa.array(list(vocabulary), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"))
                known = pc.fill_null(pc.index_in(plain(w.values), terms), -1).to_numpy().astype(np.int32)
                flat = known[w.codes] if len(w.codes) else np.zeros(0, np.int32)
                codes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((w.starts * 4).tobytes()), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_digest"), codes.cast(pa.binary())], ["doc_id", "text_digest", "codes"])

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_digest"), "text")
    return own.mapInArrow(run, "doc_id long, text_digest long, codes binary")


def passages(lengths: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end (within the concatenated words) of every passage; the last one of a text may be short."""
    count = np.maximum(1, -(-(lengths - (WINDOW - stride)) // stride)) * (lengths > 0)
    of = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    base = np.concatenate([[0], np.cumsum(lengths)])
    start = base[of] + nth * stride
    return of, start, np.minimum(start + WINDOW, base[of + 1])


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw = batch.column("codes")
    lengths = np.array([len(b) for b in raw.to_pylist()], np.int64) // 4
    return np.frombuffer(b"".join(raw.to_pylist()), np.int32), lengths


@dataclass(frozen=True)
class Terms:
    """Weights of the benchmark's terms; ``row`` numbers those that have one, else -1."""

    idf: np.ndarray
    row: np.ndarray

    def vectors(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit TF-IDF vectors of passages, sparse: passage, term row, value (sorted by passage and term)."""
        at = np.flatnonzero((codes >= 0) & (self.row[codes] >= 0))
        lo, hi = np.searchsorted(at, start), np.searchsorted(at, end)
        n = hi - lo
        of = np.repeat(np.arange(len(start)), n)
        pick = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        term = self.row[codes[at[pick]]]
        key, tf = np.unique(of * len(self.row) + term, return_counts=True)
        of, term = key // len(self.row), key % len(self.row)
        value = np.sqrt(tf) * self.idf[term]
        norm = np.sqrt(np.bincount(of, value**2, len(start)))
        return of, term, value / norm[of]


def project(of: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """Rows of a sparse matrix (sorted by row ``of``) times ``basis``.

    Some hundred rows at a time, longest first: step ``j`` adds every row's ``j``-th entry, so the sum stays in the cache.
    """
    out, value = np.zeros((n, basis.shape[1]), np.float32), value.astype(np.float32)
    for first in range(0, n, 256):
        rows = min(n - first, 256)
        lo, hi = np.searchsorted(of, [first, first + rows])
        if lo == hi:
            continue
        count = np.bincount(of[lo:hi] - first, minlength=rows)
        order = np.argsort(-count, kind="stable")
        start, count = (lo + np.cumsum(count) - count)[order], count[order]
        total = np.zeros((rows, basis.shape[1]), np.float32)
        for j in range(count[0]):
            m = np.searchsorted(-count, -j)
            at = start[:m] + j
            total[:m] += basis[term[at]] * value[at, None]
        out[first + order] = total
    return out


def _gather(of: np.ndarray, term: np.ndarray, value: np.ndarray, y: np.ndarray, into: np.ndarray) -> None:
    """``into += transpose(sparse) @ y``."""
    order = np.argsort(term, kind="stable")
    of, term, value = of[order], term[order], value[order]
    for a in range(0, len(of), 65_536):
        t = term[a:a + 65_536]
        head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        into[t[head]] += np.add.reduceat(y[of[a:a + 65_536]] * value[a:a + 65_536, None].astype(np.float32), head, 0)


def _total(coded: DataFrame, shape: tuple[int, ...], add: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The sum over all tasks of an array of ``shape``, to which ``add(sum, codes, lengths)`` adds a batch.

    A task sends one record per ``CHUNK`` rows of its sum; records of a chunk are added in two steps, first within
    groups of tasks, each in the order of tasks, so that reruns agree. The array's size is set by the benchmark block alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape, np.float64), False
        for batch in batches:
            for part in slices(batch, "codes", 8 << 20):
                some = True
                add(total, *_texts(part))
        if some:
            task = TaskContext.get().partitionId()
            blobs = [total[i:i + CHUNK].tobytes() for i in range(0, len(total), CHUNK)]
            cols = [range(len(blobs)), [task % GROUPS] * len(blobs), [task] * len(blobs), blobs]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["chunk", "part", "task", "v"])

    def fold(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("task").to_numpy(), kind="stable")
        blobs = table.column("v")
        total = np.zeros(len(blobs[0].as_py()) // 8, np.float64)
        for i in order:
            total += np.frombuffer(blobs[int(i)].as_buffer(), np.float64)
        part = table.column("part").slice(0, 1)
        # In the second step a group of tasks stands for its tasks.
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "part": part, "task": part, "v": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, part int, task int, v binary"
    parts = coded.select("codes").mapInArrow(run, schema).groupBy("chunk", "part").applyInArrow(fold, schema)
    rows = parts.groupBy("chunk").applyInArrow(fold, schema).collect()
    flat = b"".join(r["v"] for r in sorted(rows, key=lambda r: r["chunk"]))
    return np.frombuffer(flat, np.float64).reshape(shape) if flat else np.zeros(shape)


def weigh(coded: DataFrame, items: list[Item], n_terms: int) -> Terms:
    """Inverse document frequencies over all passages of the corpus."""

    def add(total: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> None:
        of, start, _ = passages(lengths, WINDOW)
        total[n_terms, 0] += len(of)
        at = np.flatnonzero(codes >= 0)
        passage, term = np.searchsorted(start, at, "right") - 1, codes[at]
        # Keys of some passages at a time stay small and sort within the cache.
        step = max(1, (1 << 31) // n_terms // 4096)
        edges = np.searchsorted(passage, np.arange(0, len(start) + step, step))
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            key = np.sort(((passage[a:b] - step * k) * n_terms + term[a:b]).astype(np.int32))
            new = np.concatenate([[True], key[1:] != key[:-1]])[:len(key)]
            total[:n_terms, 0] += np.bincount(key[new] % n_terms, minlength=n_terms)

    counts = _total(coded, (n_terms + 1, 1), add)[:, 0]
    share = counts[:n_terms] / max(counts[n_terms], 1)
    idf = np.log((1 + counts[n_terms]) / (1 + counts[:n_terms])) + 1
    used = share <= MAX_SHARE
    for item in items:
        own = np.unique(item.codes)
        used[own[np.argsort(share[own], kind="stable")[:LEAST_TERMS]]] = True
    row = np.full(n_terms + 1, -1)
    row[:n_terms][used] = np.arange(used.sum())
    return Terms(idf[used], row)


def _item_passages(items: list[Item]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(i.codes) for i in items])
    return np.concatenate([i.codes for i in items]), *passages(lengths, WINDOW)


def latent_basis(coded: DataFrame, terms: Terms, items: list[Item], seed: int = 7) -> np.ndarray:
    """The leading right singular vectors (terms x rank) of the matrix of all passages, corpus and benchmark.

    Randomised range finder with one pass for ``AtA @ omega`` and one for the small Gram matrix of
    its range. A benchmark passage weighs as much as all corpus passages together share out to
    it, so directions that only the benchmark has are among the leading ones.
    """
    n = int((terms.row >= 0).sum())
    q_codes, _, q_start, q_end = _item_passages(items)
    # A dimension per item passage: with fewer, short passages of the corpus fall out of the space and miss the least cosine.
    rank = min(len(q_start), n)
    wide = min(n, rank + EXTRA)
    own = terms.vectors(q_codes, q_start, q_end)

    def mass(total: np.ndarray, codes: np.ndarray, lengths: np.ndarray, basis: np.ndarray, square: bool) -> None:
        _, start, end = passages(lengths, WINDOW)
        for a in range(0, len(start), 16_384):
            s, e = start[a:a + 16_384], end[a:a + 16_384]
            of, term, value = terms.vectors(codes, s, e)
            y = project(of, term, value, len(s), basis)
            if square:
                total[:wide] += y.T @ y
            else:
                _gather(of, term, value, y, total[:n])
            total[-1, 0] += len(s)

    def both(basis: np.ndarray, square: bool) -> np.ndarray:
        rows = (wide if square else n) + 1
        total = _total(coded, (rows, wide), lambda t, c, k: mass(t, c, k, basis, square)).copy()
        weight = max(1.0, total[-1, 0] / max(len(q_start), 1))
        y = project(*own, len(q_start), basis)
        more = np.zeros((rows - 1, wide))
        if square:
            more += y.T @ y
        else:
            _gather(*own, y, more)
        return total[:-1] + weight * more

    omega = np.random.default_rng(seed).standard_normal((n, wide)).astype(np.float32)
    q = np.linalg.qr(both(omega, False))[0].astype(np.float32)
    _, u = np.linalg.eigh(both(q, True))
    return (q @ u[:, ::-1][:, :rank]).astype(np.float32)


def ordered_share(pattern: np.ndarray, region: np.ndarray) -> float:
    """Length of the longest common subsequence over the pattern's length (bit-parallel)."""
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern.tolist()):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    v = full
    for c in region.tolist():
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return (len(pattern) - v.bit_count()) / len(pattern)


def search(coded: DataFrame, terms: Terms, items: list[Item], basis: np.ndarray, least_cosine: float, lcs: float,
           weak_lcs: float, answer: float) -> DataFrame:
    q_codes, q_of, q_start, q_end = _item_passages(items)
    latent = project(*terms.vectors(q_codes, q_start, q_end), len(q_start), basis)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "codes", 8 << 20):
                codes, lengths = _texts(part)
                base = np.concatenate([[0], np.cumsum(lengths)])
                of, start, end = passages(lengths, STRIDE)
                best: dict[tuple[int, int], tuple] = {}
                for a in range(0, len(start), 8_192):
                    s, e = start[a:a + 8_192], end[a:a + 8_192]
                    sparse = terms.vectors(codes, s, e)
                    # The passage's own length is 1, so what lies outside the latent space lowers the cosine.
                    cosine = project(*sparse, len(s), basis) @ latent.T
                    for p, k in zip(*np.nonzero(cosine >= least_cosine), strict=True):
                        item, text = items[q_of[k]], of[a + p]
                        reach = len(item.codes) // 2
                        inside = q_start[k] - q_start[np.searchsorted(q_of, q_of[k])]
                        lo = max(base[text], s[p] - reach - inside)
                        hi = min(base[text + 1], max(e[p], s[p] - inside + len(item.codes)) + reach)
                        region = codes[lo:hi]
                        share = ordered_share(item.codes, region)
                        if share < weak_lcs:
                            continue
                        closing = ordered_share(item.answer, region) if len(item.answer) else 0.0
                        if share >= lcs or closing >= answer:
                            found = (share, closing, float(cosine[p, k]), -int(s[p] - base[text]), int(e[p] - base[text]))
                            pair = (int(text), int(q_of[k]))
                            best[pair] = max(best.get(pair, found), found)
                ids, digests = part.column("doc_id").to_pylist(), part.column("text_digest").to_pylist()
                rows = [(ids[t], digests[t], items[i].item_id, f[2], f[0], f[1], -f[3], f[4]) for (t, i), f in best.items()]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                kinds = [pa.int64()] * 3 + [pa.float64()] * 3 + [pa.int32()] * 2
                cols = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return coded.mapInArrow(run, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, least_cosine: float = 0.35, lcs: float = 0.7, weak_lcs: float = 0.55,
                 answer: float = 0.8, block_words: int = 20_000) -> DataFrame:
    """One row per document and benchmark item that it holds, verbatim or reworded: ``doc_id,
    text_digest, item_id, cosine, lcs_share, answer_share, start_word, stop_word``.

    All passages of all whole texts are searched. A passage is a candidate for an item where
    the cosine in the latent space reaches ``least_cosine``. Around it, ``lcs_share`` of the item's
    words must stand in order: ``lcs`` of them, or ``weak_lcs`` together with ``answer`` of the words of
    the item's closing sentence.

    The benchmark is the stated query set; it is taken in blocks of about ``block_words`` words and at most
    ``RANK`` passages (a longer item is a block of its own), each with its own terms and a latent space
    of as many dimensions as it has passages, and all texts meet every block. Null and empty items
    match nothing; null and empty texts hold nothing; repeated rows give repeated results; an
    empty table gives no rows. Only ``doc_id, text`` and ``item_id, text`` are read.
    """
    found, block, size, held = None, [], 0, 0
    listed = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL").orderBy("item_id", "text")
    blocks: list[list[tuple[int, str]]] = []
    for r in listed.toLocalIterator():
        n = len(r["text"].split())
        count = len(passages(np.array([n]), WINDOW)[0])
        if block and (size >= block_words or held + count > RANK):
            blocks.append(block)
            block, size, held = [], 0, 0
        block.append((r["item_id"], r["text"]))
        size, held = size + n, held + count
    for rows in [*blocks, block]:
        vocabulary, items = encode_items(rows)
        if not items:
            continue
        coded = stage(encode(docs, vocabulary), "encoded")
        terms = weigh(coded, items, len(vocabulary))
        basis = latent_basis(coded, terms, items)
        part = stage(search(coded, terms, items, basis, least_cosine, lcs, weak_lcs, answer), "contaminated")
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if found is None else found
