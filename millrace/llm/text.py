"""Words of whole texts in Arrow batches: shared by the operators that work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Fixed value: the word pattern that the operators share.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@dataclass(frozen=True)
class Words:
    """The words of a batch of texts: text ``i`` holds ``codes[starts[i]:starts[i + 1]]``,
    and ``values[code]`` is a word's text."""

    starts: np.ndarray
    codes: np.ndarray
    values: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash per distinct word."""
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(v, seed) for v in self.values.to_pylist()), np.uint64, len(self.values))


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Split texts at ASCII white space; a null text has no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy()
    flat = lists.values
    full = pc.binary_length(flat).to_numpy() > 0
    kept = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(full, out=kept[1:])
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return Words(kept[offsets], coded.indices.to_numpy().astype(np.int32), coded.dictionary)


def owners(starts: np.ndarray) -> np.ndarray:
    """For every word, the index of its text."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def slices(batch: pa.RecordBatch, column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``limit`` bytes at most;
    a longer value is a run of its own, so a task's memory follows its longest text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (constants of the splitmix64 generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(hashes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and the text each belongs to.

    A text of fewer words, but at least one, gives its whole sequence as one run.
    """
    counts = np.diff(starts)
    with np.errstate(over="ignore"):
        n = len(hashes)
        rolled = np.zeros(n, np.uint64)
        reach = np.repeat(np.minimum(counts, width), counts)
        ends = np.repeat(starts[1:], counts)
        at = np.arange(n)
        for k in range(width):
            inside = (k < reach) & (at + k < ends)
            nxt = hashes[np.minimum(at + k, n - 1)] if n else hashes
            rolled = np.where(inside, mix(rolled + nxt + np.uint64(0x9E3779B97F4A7C15)), rolled)
    whole = (at + reach <= ends) & ((counts >= width).repeat(counts) | (at == np.repeat(starts[:-1], counts)))
    return rolled[whole], owners(starts)[whole]
