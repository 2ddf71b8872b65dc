"""MinHash near-dedup with SetSketch registers: banded candidates, joint likelihood estimate, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.text import mix, shingles, slices, words
from millrace.session import stage

#: Registers per sketch, the base of their spacing, and the rate of the exponential variables. The closer the
#: base to 1, the rarer equal registers of unrelated sets: 0.5 % each at 1.02, so bands of four hardly ever meet by chance.
REGISTERS, BASE, RATE = 128, 1.02, 20.0
TOP = 65_535
#: Registers per band. At a similarity of 0.8 two texts share no band with a probability of 1e-8.
BAND = 4
#: Candidates are verified from this far below the similarity asked for: 4.5 standard errors of the estimate.
MARGIN = 0.16
#: Members of a bucket, and their shingles, that one task compares with one another; larger buckets are cut into tiles.
TILE, TILE_SHINGLES = 2_000, 1_000_000

_rng = np.random.default_rng(20260701)
_A = (_rng.integers(0, 1 << 32, REGISTERS, np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, REGISTERS, np.uint64).astype(np.uint32)


def registers(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SetSketch registers of non-empty sets: ``floor(1 - log_b x)`` of the smallest exponential
    variable of each register, from 0 up. The sketch of a union is the maximum of the sketches."""
    n = len(starts) - 1
    least = np.full((n, REGISTERS), 0xFFFFFFFF, np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    # Some sets at a time, so that a chunk stays in the processor's cache.
    edges = [0]
    while edges[-1] < n:
        edges.append(max(edges[-1] + 1, int(np.searchsorted(starts, starts[edges[-1]] + 65_536, "right")) - 1))
    with np.errstate(over="ignore"):
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            part, at = low[starts[i]:starts[j]], starts[i:j] - starts[i]
            for k in range(REGISTERS):
                least[i:j, k] = np.minimum.reduceat(part * _A[k] + _B[k], at)
    x = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def estimate(greater: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity of greatest likelihood, given how many registers of the first are greater
    and less than the second's, and both sets' sizes. Searched on a grid of 100 values."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = np.linspace(0, 1, 101)[None, :] * top
    up, down = _p(u - v * j), _p(v - u * j)
    tiny = 1e-12
    same = REGISTERS - greater - less
    ll = greater[:, None] * np.log(up + tiny) + less[:, None] * np.log(down + tiny) + same[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return np.take_along_axis(j, ll.argmax(1)[:, None], 1)[:, 0]


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, shingle) pairs of a batch: shingle hashes and the borders of texts."""
    w = words(texts, lower=True)
    if not len(w.codes):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h, of = shingles(w.hashes()[w.codes], w.starts, width)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=len(texts)))])


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, row, n, hi, lo, regs`` per row: set size, a 128-bit digest of the set, registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                h, starts = _sets(part.column("text"), width)
                n = np.diff(starts)
                full = np.flatnonzero(n)
                hi, lo = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                regs = np.zeros((len(n), REGISTERS), np.uint16)
                if len(full):
                    at = starts[:-1][full]
                    with np.errstate(over="ignore"):
                        hi[full] = np.add.reduceat(mix(h + np.uint64(11)), at).view(np.int64)
                        lo[full] = np.add.reduceat(mix(h + np.uint64(29)), at).view(np.int64)
                    regs[full] = registers(h, np.append(at, len(h)))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * REGISTERS), len(n), [None, pa.py_buffer(regs.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(n), pa.array(hi), pa.array(lo), packed],
                                                 ["doc_id", "row", "n", "hi", "lo", "regs"])

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")
    return own.mapInArrow(run, "doc_id long, row long, n long, hi long, lo long, regs binary")


def _bands(sets: DataFrame) -> DataFrame:
    """``bucket, id`` per set and band; a bucket is a band's number and values."""
    keys = [F.xxhash64(F.lit(k), F.substring("regs", 2 * k * BAND + 1, 2 * BAND)) for k in range(REGISTERS // BAND)]
    return sets.select(F.explode(F.array(*keys)).alias("bucket"), "id")


def _compare(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Estimates for rows of ``a`` and ``b``; 0 where they are far apart."""
    greater, less = (a > b).sum(1), (a < b).sum(1)
    out = np.zeros(len(greater))
    # With fewer than half of the registers equal the likelihood has its maximum far below any threshold in use.
    near = np.flatnonzero(2 * (greater + less) <= REGISTERS)
    out[near] = estimate(*(x[near].astype(float) for x in (greater, less, n_a, n_b)))
    return out


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist() if isinstance(column, pa.Array) else column), np.uint16).reshape(-1, REGISTERS)


def _likely(pairs: DataFrame, sets: DataFrame, percent: int, least: float) -> DataFrame:
    """Pairs ``a, b`` whose sizes allow the similarity and whose estimate reaches ``least``, with it."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("r_a"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("r_b"))
    sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    met = pairs.join(left, "a").join(right, "b").where(sized).select("a", "b", "n_a", "n_b", "r_a", "r_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = [b.column(c).to_numpy() for c in ("n_a", "n_b")]
            got = _compare(_matrix(b.column("r_a")), _matrix(b.column("r_b")), *n)
            keep = got >= least
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep)), pa.array(got[keep])], ["a", "b", "j"])

    return met.mapInArrow(run, "a long, b long, j double")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity; only texts that take part are read on."""
    used = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = used.join(sets.select("id", "doc_id", "row"), "id")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text").join(wanted, ["doc_id", "row"])
    texts = stage(texts.groupBy("id").agg(F.first("text").alias("text")), "texts")
    met = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("t_a")), "a")
    met = met.join(texts.select(F.col("id").alias("b"), F.col("text").alias("t_b")), "b").select("a", "b", "t_a", "t_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t_a", 4 << 20):
                (h, s), (g, t) = (_sets(part.column(c), width) for c in ("t_a", "t_b"))
                both = np.zeros(part.num_rows, np.int64)
                for i in range(part.num_rows):
                    both[i] = len(np.intersect1d(h[s[i]:s[i + 1]], g[t[i]:t[i + 1]], assume_unique=True))
                whole = np.diff(s) + np.diff(t) - both
                keep = pa.array((100 * both >= percent * whole) & (both > 0))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def _full_sets(ids: DataFrame, sets: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``id, set`` of the wanted texts, the set as ascending 64-bit hashes."""
    wanted = ids.join(sets.select("id", "doc_id", "row"), "id")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text").join(wanted, ["doc_id", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                h, s = _sets(part.column("text"), width)
                packed = pa.array([h[i:j].tobytes() for i, j in zip(s[:-1], s[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), packed], ["id", "set"])

    return texts.select("id", "text").mapInArrow(run, "id long, set binary").groupBy("id").agg(F.first("set").alias("set"))


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Links between different components inside the buckets, by the full sets.

    ``rows``: ``bucket, id, set, component, size, shingles`` of buckets with several components,
    the last two summed over the bucket. A bucket of more than ``TILE`` members or ``TILE_SHINGLES``
    shingles is cut into tiles, every two of which meet in a task of their own. A member is held
    against all others at once through the tile's inverted index of shingles; members of one
    component aren't compared, and one link per member and other component is returned, so
    the result doesn't grow with the square of a group.
    """
    tiles = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")
    rows = rows.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("id", "set", "component", "bucket", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("s"), "tile")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, tile = pdf["id"].to_numpy(), pdf["tile"].to_numpy()
        n = pdf["set"].map(len).to_numpy() // 8
        h = np.frombuffer(b"".join(pdf["set"]), np.uint64)
        of, starts = np.repeat(np.arange(len(ids)), n), np.concatenate([[0], np.cumsum(n)])
        _, code, sizes = np.unique(pdf["component"].to_numpy(), return_inverse=True, return_counts=True)
        order = np.argsort(h, kind="stable")
        distinct, place, width = np.unique(h, return_inverse=True, return_counts=True)
        holder, first = of[order], np.cumsum(width) - width
        out: list[tuple[int, int]] = []
        # Members of the largest component are compared only from the others' side.
        for i in np.flatnonzero(code != sizes.argmax()):
            own = place[starts[i]:starts[i + 1]]
            reach = width[own]
            at = np.repeat(first[own] - (np.cumsum(reach) - reach), reach) + np.arange(reach.sum())
            both = np.bincount(holder[at], minlength=len(ids))
            other = (code != code[i]) & (100 * both >= percent * (n + n[i] - both))
            if key[1] != key[2]:
                other &= tile != tile[i]
            k = np.flatnonzero(other)
            if len(k):
                k = k[np.unique(code[k], return_index=True)[1]]
                out += [(min(ids[i], ids[x]), max(ids[i], ids[x])) for x in k]
        return pd.DataFrame(sorted(set(out)), columns=["a", "b"]).astype("int64")

    return met.groupBy("bucket", "t", "s").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``: the document's part of ``near_texts``."""
    return near_texts(docs, width, percent).select("doc_id", "n_shingles", "component_id", "kept")


def near_texts(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_digest, first`` for every row of ``docs``.

    A text's set holds its distinct runs of ``width`` lower-cased words; a shorter text is one
    run, a text without words has no set and no link. Two texts are linked where their sets'
    intersection is at least ``percent`` of the union, by the full sets. ``component_id`` is the
    smallest identifier reachable over links.

    1. Texts of equal sets form a class, which goes on as one set.
    2. Every band of a sketch names a bucket. Each member meets the bucket's smallest one;
       the joint likelihood estimate drops pairs far below the threshold; the best pair of
       every member is verified first, then those that still join different components.
    3. In buckets that still hold several components, members of different components are
       compared by their full sets, so no link is lost to the choice of step 2.

    An identifier with several texts has all their links, so they share its ``component_id``. Texts are judged one by
    one by ``first``: of the texts that links alone connect, it marks the one of the smallest identifier (then digest).

    Null identifiers are linked with nothing and kept, with a null component. Repeated rows
    give repeated results. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
    """
    rows = stage(sketches(docs, width), "sketches")
    full = rows.where("n > 0 AND doc_id IS NOT NULL")
    least = percent / 100 - MARGIN
    sets = full.groupBy("n", "hi", "lo").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("regs").alias("regs"))
    # A set is a node with a number of its own: identifiers may clash.
    sets = sets.select(F.monotonically_increasing_id().alias("id"), F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row"), "n", "hi", "lo", "regs")
    sets = stage(sets, "sets")

    bands = _bands(sets)
    heads = bands.groupBy("bucket").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stage(bands.join(heads, "bucket"), "buckets")
    star = shared.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    likely = stage(_likely(star, sets, percent, least), "likely")
    best = likely.groupBy("b").agg(F.max(F.struct("j", -F.col("a"))).alias("m")).select((-F.col("m.col2")).alias("a"), "b")
    links = stage(_verified(best, sets, docs, width, percent), "links")
    found = components(links)

    own = found.select(F.col("id").alias("a"), F.col("component").alias("c_a")), found.select(F.col("id").alias("b"), F.col("component").alias("c_b"))
    rest = likely.join(own[0], "a", "left").join(own[1], "b", "left")
    rest = rest.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b").join(best, ["a", "b"], "left_anti")
    links = stage(links.union(_verified(stage(rest, "rest"), sets, docs, width, percent)), "links")
    found = components(links)

    # Pairs with a bucket's first member are settled; what is left are its other members among themselves.
    placed = shared.where("size > 2 AND id <> head").join(found, "id", "left")
    placed = placed.join(sets.select("id", "n"), "id").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    placed = stage(placed, "placed")
    several = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members"),
                                           F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).where("x <> y")
    # Buckets of the same members are compared once.
    several = several.groupBy("members", "size", "x", "y", "shingles").agg(F.min("bucket").alias("bucket")).select("bucket", "size", "shingles")
    met = stage(placed.join(several, "bucket"), "several")
    full_sets = stage(_full_sets(met.select("id").distinct(), sets, docs, width), "full-sets")
    links = stage(links.union(_across(met.join(full_sets, "id"), percent)), "links")
    found = components(links)

    placed = sets.join(found, "id", "left").select("id", "doc_id", "row", "n", "hi", "lo", F.coalesce("component", "id").alias("c"))
    placed = placed.withColumn("d", F.col("c"))
    own = F.struct("n", "hi", "lo")
    clash = full.groupBy("doc_id").agg(F.min(own).alias("x"), F.max(own).alias("y")).where("x <> y")
    clash = stage(clash.select("doc_id"), "clashes")
    if not clash.isEmpty():
        held = full.join(clash, "doc_id").select("doc_id", "n", "hi", "lo").distinct().join(sets.select("n", "hi", "lo", "id"), ["n", "hi", "lo"])
        held = stage(held.select("doc_id", "id"), "held")
        more = held.join(held.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").where("id <> a").select("a", F.col("id").alias("b"))
        wide = components(links.union(more)).withColumnRenamed("component", "w")
        placed = placed.join(wide, "id", "left").withColumn("d", F.coalesce("w", "id")).drop("w")
    placed = stage(placed, "placed")
    texts = placed.groupBy("c").agg(F.min(F.struct("doc_id", "row")).alias("head"))
    documents = placed.groupBy("d").agg(F.min("doc_id").alias("least"))
    named = placed.join(texts, "c").join(documents, "d").select("n", "hi", "lo", "head", "least")
    known = F.col("doc_id").isNotNull()
    out = rows.join(named, ["n", "hi", "lo"], "left").withColumn("component_id", F.coalesce(F.when(known, F.col("least")), "doc_id"))
    first = F.col("head").isNull() | ~known | (F.struct("doc_id", "row") == F.col("head"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
                      F.col("row").alias("text_digest"), first.alias("first"))
