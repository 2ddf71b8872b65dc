"""Ranked lexical search: a sharded inverted index with block maxima, searched by Block-Max MaxScore."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.text import Words, owners, slices, words
from millrace.session import scratch_path, stage

#: Postings of a block: what is decoded at once and has one list of possible maxima.
BLOCK = 128
#: The scale of term weights and of a posting's share, and the length and frequency constants of the score.
WEIGHT_SCALE, SHARE_SCALE = 1000, 1_000_000_000
LENGTH_BASE, LENGTH_SHARE, TF_SCALE, TF_DAMP = 100, 25, 1000, 12

#: Terms are runs of ASCII letters, digits and characters beyond ASCII; all other bytes separate them. A-Z are lower-cased.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

#: Columns of numbers are packed (``pack``). ``term_bytes`` and ``df`` have a number per term, ``last``, ``block_bytes`` and ``best``
#: (how many pairs) one per block, ``best_tf`` and ``best_size`` one per pair.
_PACKED = ("sizes", "term_bytes", "df", "last", "block_bytes", "best", "best_tf", "best_size")
INDEX = "docs long, words long, ids binary, no_id binary, terms binary, postings binary, " + ", ".join(f"{c} binary" for c in _PACKED)
_INDEX = pa.schema([("docs", pa.int64()), ("words", pa.int64()), *[(c, pa.binary()) for c in ("ids", "no_id", "terms", "postings", *_PACKED)]])
#: Bytes of a row group of a written index: what a reader has in memory at once.
ROW_GROUP = 16 << 20
HEAP = "item long, score long, no_id boolean, doc_id long"
RANKED = "item_id long, rank int, doc_id long, score long"


def terms(texts: pa.Array) -> Words:
    """The terms of every text, as codes into the distinct ones."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return words(texts)
    ends = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1]
    plain = data[int(ends[0]):int(ends[-1])].to_pybytes().translate(_TERM_BYTES)
    own = pa.py_buffer((ends - ends[0]).astype(kind).tobytes())
    return words(pa.Array.from_buffers(texts.type, len(texts), [None, own, pa.py_buffer(plain)], null_count=0))


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-byte code of non-negative numbers (low bits first, the high bit says that more follow), and the end of each."""
    values = values.astype(np.int64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 6):
        sizes += values >= 1 << 7 * k
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(sizes.max(initial=0))):
        at = np.flatnonzero(sizes > k)
        more = (sizes[at] > k + 1).astype(np.int64) << 7
        out[ends[at] - sizes[at] + k] = (values[at] >> 7 * k) & 127 | more
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    """The numbers of ``pack``."""
    if not len(data):
        return np.zeros(0, np.int64)
    closing = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], closing[:-1] + 1])
    low = data.astype(np.int64) & 127
    if len(closing) < len(data):
        low <<= 7 * (np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))))
    return np.add.reduceat(low, starts)


def shard_row(batch: pa.RecordBatch) -> list[object] | None:
    """The index of a batch of texts: one row, or none where no text has a term.

    Documents get ordinals in the order of their identifiers. A term's postings (ordinal gaps and
    frequencies) stand in blocks. A block's score bound depends on the whole corpus, so the block keeps its
    undominated pairs of frequency and document size instead, from which any corpus' exact maximum follows.
    """
    w = terms(batch.column("text"))
    counts = w.counts
    kept = np.flatnonzero(counts)
    if not len(kept):
        return None
    ids = batch.column("doc_id")
    no_id = pc.is_null(ids).to_numpy(zero_copy_only=False)
    ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    order = kept[np.lexsort((ids[kept], no_id[kept]))]
    ordinal = np.zeros(len(counts), np.int64)
    ordinal[order] = np.arange(len(order))
    sizes = counts[order].astype(np.int64)
    n = len(order)
    # Codes by spelling, so that a shard's terms are sorted.
    rank = np.empty(len(w.values), np.int64)
    by_text = pc.array_sort_indices(w.values).to_numpy()
    rank[by_text] = np.arange(len(by_text))
    keys, tf = np.unique(rank[w.codes] * n + ordinal[owners(w.starts)], return_counts=True)
    term, doc = keys // n, keys % n
    df = np.bincount(term, minlength=len(by_text))
    ends = np.cumsum(df)
    inside = np.arange(len(keys)) - np.repeat(ends - df, df)
    opens = inside % BLOCK == 0
    block_start = np.flatnonzero(opens)
    block = np.cumsum(opens) - 1
    gap = np.diff(doc, prepend=-1)
    gap[inside == 0] = doc[inside == 0] + 1
    data, byte_ends = pack(np.column_stack([gap, tf]).ravel())
    block_stop = np.append(block_start[1:], len(keys))
    # Undominated: in order of size, only what has a higher frequency than all before it in the block.
    pick = np.lexsort((-tf, sizes[doc], block))
    high = tf[pick] + block[pick] * (int(tf.max()) + 1)
    top = np.maximum.accumulate(high)
    best = np.ones(len(pick), bool)
    best[1:] = (high[1:] > top[:-1])
    pick = pick[best]
    spelled = w.values.take(pa.array(by_text))
    numbers = (sizes, pc.binary_length(spelled).to_numpy(), df, doc[block_stop - 1], np.diff(byte_ends[2 * block_stop - 1], prepend=0),
               np.bincount(block[pick]), tf[pick], sizes[doc[pick]])
    return [n, int(sizes.sum()), ids[order].tobytes(), no_id[order].tobytes(), "".join(spelled.to_pylist()).encode(), data.tobytes(),
            *[pack(a)[0].tobytes() for a in numbers]]


def shard_terms(row: dict[str, object]) -> pa.Array:
    """A shard's terms, in the order of their numbers."""
    ends = np.append(0, np.cumsum(unpack(np.frombuffer(row["term_bytes"], np.uint8))))
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(row["terms"]))


def build_index(docs: DataFrame, shard_bytes: int = 4 << 20) -> DataFrame:
    """A row per shard of about ``shard_bytes`` of text (a longer text is a shard of its own); all rows of ``docs`` are indexed.

    Shards are independent and mergeable: nothing in them depends on other documents. No exchange.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", shard_bytes):
                row = shard_row(part)
                if row is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _INDEX, strict=True)], schema=_INDEX)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, and all their terms."""

    docs: int
    words: int

    def damp(self, sizes: np.ndarray) -> np.ndarray:
        return LENGTH_BASE - LENGTH_SHARE + LENGTH_SHARE * sizes * self.docs // max(self.words, 1)

    def weights(self, df: np.ndarray) -> np.ndarray:
        return np.floor(WEIGHT_SCALE * np.log((2 * self.docs + 2) / (2 * df + 1))).astype(np.int64)


def share(tf: np.ndarray, damp: np.ndarray) -> np.ndarray:
    return SHARE_SCALE * tf // (TF_SCALE * tf + TF_DAMP * damp)


class Shard:
    """One index row opened for one corpus: bounds are at hand, postings are decoded on demand and kept."""

    def __init__(self, row: dict[str, object], corpus: Corpus, vocabulary: pa.Array):
        get = lambda c: unpack(np.frombuffer(row[c], np.uint8))
        ends = lambda counts: np.append(0, np.cumsum(counts))
        self.ids, self.no_id = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["no_id"], np.bool_)
        self.damp = corpus.damp(get("sizes"))
        self.first, self.last, self.at = ends(-(-get("df") // BLOCK)), get("last"), ends(get("block_bytes"))
        bounds = share(get("best_tf"), corpus.damp(get("best_size")))
        self.block_max = np.maximum.reduceat(bounds, ends(get("best"))[:-1])
        self.term_max = np.maximum.reduceat(self.block_max, self.first[:-1])
        self.postings = np.frombuffer(row["postings"], np.uint8)
        #: For every term of the vocabulary its number here, or -1.
        self.own = pc.fill_null(pc.index_in(vocabulary, value_set=shard_terms(row)), -1).to_numpy(zero_copy_only=False)
        self.decoded: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def blocks(self, term: int, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Ordinals and shares of a term's blocks from ``start`` to ``stop``."""
        key = (start, stop)
        if key not in self.decoded:
            both = unpack(self.postings[self.at[start]:self.at[stop]])
            doc = np.cumsum(both[::2]) + (self.last[start - 1] if start > self.first[term] else -1)
            self.decoded[key] = doc, share(both[1::2], self.damp[doc])
        return self.decoded[key]


@dataclass
class Heap:
    """The best documents of one item so far, best first: score, then identifier (null last)."""

    top: int
    score: np.ndarray
    no_id: np.ndarray
    ids: np.ndarray

    @classmethod
    def empty(cls, top: int) -> Heap:
        return cls(top, np.zeros(0, np.int64), np.zeros(0, np.bool_), np.zeros(0, np.int64))

    @property
    def least(self) -> int:
        """What a document must score at least: as much as the last one, which a smaller identifier still replaces."""
        return max(1, int(self.score[-1])) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        score, no_id, ids = np.append(self.score, score), np.append(self.no_id, no_id), np.append(self.ids, ids)
        best = np.lexsort((ids, no_id, -score))[:self.top]
        self.score, self.no_id, self.ids = score[best], no_id[best], ids[best]


def search_shard(shard: Shard, codes: np.ndarray, weights: np.ndarray, heap: Heap) -> None:
    """Block-Max MaxScore over one shard; ``codes`` are vocabulary numbers, ``weights`` count repeats in the item.

    Lists stand in the order of their bounds. As long as the bounds of the lowest ones together stay
    below what the heap asks for, these are not essential: no document enters through them alone.
    Candidates come from the others; for each non-essential list, highest bound first, a candidate must pass
    with the list's bound, then with the maximum of the block it would stand in, before the block is decoded.
    """
    own = shard.own[codes]
    weights, own = weights[own >= 0], own[own >= 0]
    if not len(own):
        return
    bound = weights * shard.term_max[own]
    order = np.argsort(bound, kind="stable")
    own, weights, below = own[order], weights[order], np.append(0, np.cumsum(bound[order]))
    least = heap.least
    essential = int(np.searchsorted(below[1:], least, "left"))
    if essential == len(own):
        return
    total = np.zeros(len(shard.ids), np.int64)
    for t, weight in zip(own[essential:], weights[essential:], strict=True):
        doc, part = shard.blocks(t, shard.first[t], shard.first[t + 1])
        total[doc] += weight * part
    # Every posting has a share above 0; a term of weight 0 adds nothing, so documents of score 0 drop out here.
    found = np.flatnonzero(total)
    score = total[found]
    for j in range(essential - 1, -1, -1):
        t, weight = own[j], weights[j]
        passed = score + below[j + 1] >= least
        found, score = found[passed], score[passed]
        start, stop = shard.first[t], shard.first[t + 1]
        block = start + np.searchsorted(shard.last[start:stop], found)
        there = block < stop
        most = np.where(there, weight * shard.block_max[np.minimum(block, stop - 1)], 0)
        passed = score + most + below[j] >= least
        found, score, block, there = found[passed], score[passed], block[passed], there[passed]
        if not len(found):
            return
        for b in np.unique(block[there]):
            doc, part = shard.blocks(t, b, b + 1)
            mine = np.flatnonzero(block == b)
            at = np.minimum(np.searchsorted(doc, found[mine]), len(doc) - 1)
            score[mine] += np.where(doc[at] == found[mine], weight * part[at], 0)
    passed = score >= least
    found, score = found[passed], score[passed]
    heap.add(score, shard.no_id[found], shard.ids[found])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def frequencies(index: DataFrame, vocabulary: pa.Array) -> np.ndarray:
    """In how many documents each term of the vocabulary stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for row in _shards(batches):
            own = pc.fill_null(pc.index_in(vocabulary, value_set=shard_terms(row)), -1).to_numpy(zero_copy_only=False)
            total[own >= 0] += unpack(np.frombuffer(row["df"], np.uint8))[own[own >= 0]]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    # A row per term of one block of items, which bounds it.
    for r in index.select("terms", "term_bytes", "df").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def search(index: DataFrame, corpus: Corpus, texts: list[str], top: int) -> DataFrame:
    """``item, score, no_id, doc_id``: every task's best documents for each text of a block, by its place there."""
    w = terms(pa.array(texts, pa.string()))
    if not len(w.codes):
        return index.sparkSession.createDataFrame([], HEAP)
    vocabulary = w.values
    weight = corpus.weights(frequencies(index, vocabulary))
    items = []
    for k, n in enumerate(w.counts):
        codes, repeats = np.unique(w.codes[w.starts[k]:w.starts[k] + n], return_counts=True)
        items.append((codes, repeats * weight[codes]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The heaps go from shard to shard, so later shards face higher thresholds.
        heaps = [Heap.empty(top) for _ in items]
        for row in _shards(batches):
            shard = Shard(row, corpus, vocabulary)
            for (codes, weights), heap in zip(items, heaps, strict=True):
                search_shard(shard, codes, weights, heap)
        cols = [np.repeat(np.arange(len(heaps)), [len(h.score) for h in heaps]), *[np.concatenate([getattr(h, c) for h in heaps]) for c in ("score", "no_id", "ids")]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["item", "score", "no_id", "doc_id"])

    return index.drop("docs", "words").mapInArrow(run, HEAP)


def rank(index: DataFrame, items: DataFrame, top: int = 20, block_bytes: int = 1 << 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: every item's ``top`` best documents of an index that ``build_index`` made.

    The items (``item_id, text``) are the stated query set; they are taken in blocks of about ``block_bytes`` of text (a
    longer item is a block of its own), and every shard meets every block. A task hands on ``top`` rows an
    item, and the heaps of all tasks are merged by a rank whose limit Spark applies before the exchange too.

    Equal scores stand by ascending ``doc_id``, null last; only scores above 0 count. A repeated item is
    ranked for each of its rows. Null and empty items, and those whose terms no document has, give no rows; so does
    an empty index.
    """
    spark = items.sparkSession
    sums = index.agg(F.sum("docs"), F.sum("words")).first()
    corpus = Corpus(sums[0] or 0, sums[1] or 0)
    parts = []
    listed = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").orderBy("item_id", "text")

    def close(block: list[tuple[int | None, str]]) -> None:
        if not block or not corpus.docs:
            return
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], "item long, item_id long")
        order = W.partitionBy("item").orderBy(F.col("score").desc(), "no_id", "doc_id")
        # Staged before the ranks: the search runs once, and its rows are few.
        heaps = stage(search(index, corpus, [t for _, t in block], top), "heaps")
        best = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        # One block's names; the block bounds them.
        best = best.join(F.broadcast(names), "item")
        parts.append(best.select("item_id", "rank", F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "score"))

    block, size = [], 0
    for r in listed.toLocalIterator():
        n = len(r["text"])
        if block and size + n > block_bytes:
            close(block)
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    close(block)
    if not parts:
        return spark.createDataFrame([], RANKED)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def ranked(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """``rank`` over a fresh index of ``docs`` (``doc_id, text``; other columns aren't read).

    Null and empty texts, and those without a term, are in no list and don't count as documents. Rows that share an
    identifier are documents of their own. The index is written to the shared folder, so its shards outlive executors.
    """
    at = scratch_path(docs.sparkSession, "index")
    build_index(docs).write.option("parquet.block.size", ROW_GROUP).parquet(at)
    return rank(docs.sparkSession.read.schema(INDEX).parquet(at), items, top)
