"""LM scoring: deleted interpolation of word and word-pair estimates by context-frequency buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import mix, slices, words
from millrace.session import stage

#: Bytes of text in a block: the unit whose distinct words and pairs are counted together.
BLOCK_BYTES = 12 << 20
#: Most tokens per shard of the counts, which sets how many keys a task counts at once.
SHARD_TOKENS = 1_000_000
#: Buckets of the context's frequency: unseen, 1, 2-3, 4-7, ...
BUCKETS = 48
#: The end of a text, counted as a token, also stands before the first word. No word hashes from a blank.
END = np.uint64(xxhash.xxh3_64_intdigest(" "))

_codec = "zstd"


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Unsigned integers as compressed byte planes, the low bytes first; ascending values as differences."""
    wide = values.astype(np.uint64)
    if ascending and len(wide):
        wide = np.concatenate([wide[:1], wide[1:] - wide[:-1]])
    planes = np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8).T)
    used = max(1, 8 - next((k for k in range(8) if planes[7 - k].any()), 8))
    raw = bytes([used]) + planes[:used].tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, _codec, asbytes=True)


def unpack(blob: bytes, ascending: bool = False) -> np.ndarray:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), _codec, asbytes=True)
    used = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(used, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :used] = planes.T
    out = wide.view(np.uint64).ravel()
    return np.cumsum(out, dtype=np.uint64) if ascending else out


def _pairs(keys: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash per token of the pair (token before, token); before the first stands an end."""
    own = keys[codes]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[starts[:-1]] = END
    with np.errstate(over="ignore"):
        return mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(own))


def blocks(docs: DataFrame) -> DataFrame:
    """``block, deleted, ids, held, lengths, keys, codes, tokens``: runs of texts with their distinct words.

    Texts of the deleted part, which the weights are learned on, make up blocks of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                for deleted in (False, True):
                    own = part.filter(part.column("deleted") if deleted else pc.invert(part.column("deleted")))
                    if not own.num_rows:
                        continue
                    w = words(own.column("text"), lower=True)
                    hashes = np.append(w.hashes(), END)
                    n = w.counts + 1
                    starts = np.concatenate([[0], np.cumsum(n)])
                    token = np.full(starts[-1], len(hashes) - 1)
                    inside = np.ones(starts[-1], bool)
                    inside[starts[1:] - 1] = False
                    token[inside] = w.codes
                    keys, place = np.unique(hashes, return_inverse=True)
                    codes = place[token]
                    ids = own.column("doc_id")
                    known = ids.is_valid().to_numpy(zero_copy_only=False)
                    numbers = ids.fill_null(0).to_numpy().view(np.uint64)
                    name += 1
                    held = own.column("held").to_numpy(zero_copy_only=False)
                    row = [name, deleted, pack(numbers), pack(known), pack(held), pack(n), pack(keys, True), pack(codes), int(starts[-1])]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    names = ["block", "deleted", "ids", "known", "held", "lengths", "keys", "codes", "tokens"]
    kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 6, pa.int64()]
    id_text = F.col("doc_id").cast("string").cast("binary")
    held = F.coalesce(F.pmod(F.crc32(id_text), F.lit(7)) == 2, F.lit(False))
    apart = F.pmod(F.xxhash64(F.lit("deleted"), "doc_id"), F.lit(16)) == 0
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held"), (apart & ~held).alias("deleted"))
    return own.mapInArrow(run, "block long, deleted boolean, ids binary, known binary, held binary, lengths binary, keys binary, codes binary, tokens long")


def _distinct(body: dict) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Per kind (``w`` words, ``p`` pairs) the block's keys in order and each token's place among them; lengths; held."""
    keys, codes = unpack(body["keys"], True), unpack(body["codes"]).astype(np.int64)
    n, held = unpack(body["lengths"]).astype(np.int64), unpack(body["held"]).astype(bool)
    starts = np.concatenate([[0], np.cumsum(n)])
    pairs, place = np.unique(_pairs(keys, codes, starts), return_inverse=True)
    return {"w": (keys, codes), "p": (pairs, place)}, n, held


def _cuts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards, equal ranges of hash values named by their first ``bits`` bits, that hold some of the ascending
    keys, and the borders of each in them. The work follows the number of keys, whatever the number of shards."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[:len(shard)])
    return shard[first], np.append(first, len(keys))


def counts(bodies: DataFrame, bits: int) -> DataFrame:
    """For every block, kind and shard (of ``2 ** bits``) the training counts of the block's keys, in their order.

    A block asks once for each distinct key and brings its own count along, so a frequent word
    is as many rows as there are blocks, and one exchange counts and answers. ``types`` and
    ``tokens`` are a shard's totals, on its first row.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.to_pylist():
                both, n, held = _distinct(body)
                learns = np.repeat(~held, n)
                for kind, (keys, place) in both.items():
                    own = np.bincount(place[learns], minlength=len(keys))
                    full, at = _cuts(keys, bits)
                    parts = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                    cols = [[kind] * len(full), full.tolist(), [body["block"]] * len(full), [body["deleted"]] * len(full),
                            [pack(keys[i:j], True) for i, j in parts], [pack(own[i:j]) for i, j in parts]]
                    kinds = [pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                                     ["kind", "shard", "block", "deleted", "keys", "own"])

    def answer(asked: pa.Table) -> pa.Table:
        deleted = asked.column("deleted").to_pylist()
        keys = [unpack(b, True) for b in asked.column("keys").to_pylist()]
        own = np.concatenate([unpack(b) for b in asked.column("own").to_pylist()]).astype(float)
        sizes = [len(k) for k in keys]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, own, len(distinct))
        apart = np.bincount(place, own * np.repeat(deleted, sizes), len(distinct))
        at = np.concatenate([[0], np.cumsum(sizes)])
        rows = range(len(sizes))
        first = [i == 0 for i in rows]
        return pa.table({
            "block": asked.column("block"), "kind": asked.column("kind"), "shard": asked.column("shard"), "deleted": asked.column("deleted"),
            "total": pa.array([pack(total[place[at[i]:at[i + 1]]]) for i in rows], pa.binary()),
            "apart": pa.array([pack(apart[place[at[i]:at[i + 1]]]) if deleted[i] else None for i in rows], pa.binary()),
            "types": pa.array([int((total > 0).sum()) * f for f in first], pa.int64()),
            "tokens": pa.array([int(total.sum()) * f for f in first], pa.int64()),
            "tokens_apart": pa.array([int(apart.sum()) * f for f in first], pa.int64()),
        })

    asked = bodies.mapInArrow(ask, "kind string, shard int, block long, deleted boolean, keys binary, own binary")
    return asked.groupBy("kind", "shard").applyInArrow(
        answer, "block long, kind string, shard int, deleted boolean, total binary, apart binary, types long, tokens long, tokens_apart long")


def _joined(body: pa.Table, answers: pa.Table, columns: tuple[str, ...]):
    """A block's tokens with their counts: per column the context's, the word's and the pair's."""
    both, n, held = _distinct(body.slice(0, 1).to_pylist()[0])
    got = {}
    for kind, (keys, place) in both.items():
        own = sorted((r for r in answers.to_pylist() if r["kind"] == kind), key=lambda r: r["shard"])
        for c in columns:
            per_key = np.concatenate([unpack(r[c]) for r in own]).astype(np.int64)
            if len(per_key) != len(keys):
                raise RuntimeError("a block's counts are incomplete")
            got[kind, c] = per_key[place]
            if kind == "w":
                end = per_key[np.searchsorted(keys, END)]
                before = np.concatenate([[end], got[kind, c][:-1]])
                before[np.concatenate([[0], np.cumsum(n)[:-1]])] = end
                got["v", c] = before
    return got, n, held


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(int), BUCKETS - 1), 0)


def learn_weights(bodies: DataFrame, answered: DataFrame, kept_tokens: int, types: int, rounds: int = 20) -> np.ndarray:
    """Weights (bucket x pair, word, uniform) by expectation-maximisation on the deleted part.

    Estimates come from the kept part alone. Tokens of the deleted part with the same counts
    count as one row with a weight; every round is one aggregate over those rows.
    """

    def tokens(body: pa.Table, answers: pa.Table) -> pa.Table:
        if not body.num_rows:
            return empty
        got, _, _ = _joined(body, answers, ("total", "apart"))
        pair, context, word = (got[k, "total"] - got[k, "apart"] for k in "pvw")
        bucket = _bucket(context)
        context = np.where(pair > 0, context, 0)  # without the pair only the bucket of the context counts
        rows, times = np.unique(np.column_stack([bucket, pair, context, word]), axis=0, return_counts=True)
        return pa.table({**{c: rows[:, i] for i, c in enumerate(("bucket", "pair", "context", "word"))}, "times": times})

    empty = pa.table({c: pa.array([], pa.int64()) for c in ("bucket", "pair", "context", "word", "times")})
    left, right = bodies.where("deleted").groupBy("block"), answered.where("deleted").groupBy("block")
    held = left.cogroup(right).applyInArrow(tokens, "bucket long, pair long, context long, word long, times long")
    held = stage(held.groupBy("bucket", "pair", "context", "word").agg(F.sum("times").alias("times")), "deleted")
    parts = [F.when(F.col("pair") > 0, F.col("pair") / F.col("context")).otherwise(0.0), F.col("word") / F.lit(max(kept_tokens, 1)), F.lit(1 / (types + 1))]
    held = held.select("bucket", "times", *[p.alias(f"p{i}") for i, p in enumerate(parts)])

    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    weights[0] = [0, 0.8, 0.2]
    for _ in range(rounds):
        w = [F.element_at(F.array(*[F.lit(float(x)) for x in weights[:, i]]), (F.col("bucket") + 1).cast("int")) * F.col(f"p{i}") for i in range(3)]
        total = w[0] + w[1] + w[2]
        sums = held.groupBy("bucket").agg(*[F.sum(F.col("times") * x / total).alias(f"s{i}") for i, x in enumerate(w)]).collect()
        seen = np.zeros((BUCKETS, 3))
        for r in sums:
            seen[r["bucket"]] = [r["s0"], r["s1"], r["s2"]]
        # A uniform share stays, so no text has a probability of nothing; a bucket without tokens follows its neighbour.
        new = weights.copy()
        full = seen.sum(1) > 0
        new[full] = seen[full] / seen[full].sum(1, keepdims=True)
        new = np.maximum(new, [0, 0, 1e-6])
        new /= new.sum(1, keepdims=True)
        moved = np.abs(new - weights)[full].max(initial=0)
        weights = new
        if moved < 1e-4:
            break
    for k in range(2, BUCKETS):
        if not full[k] and full[k - 1]:
            weights[k], full[k] = weights[k - 1], True
    return weights


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Learns from all rows whose ``crc32(doc_id) mod 7`` isn't 2. A token's probability mixes the
    maximum-likelihood estimates of the pair (word before, word), of the word, and a uniform one
    over the known types and one unknown type, by weights that depend on the context's
    frequency bucket. The weights are learned on a deleted sixteenth of the training rows, with
    estimates from the others; scores use the counts of all training rows.

    A null or empty text is the end token alone. A null identifier is a training row.
    Repeated rows count and are scored each; without training rows every token is unknown
    and the score is the uniform one. An empty table gives no rows. Only ``doc_id`` and
    ``text`` are read. Words are compared by 64-bit hashes.
    """
    bodies = stage(blocks(docs), "blocks")
    size = bodies.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    # 64 shards at least, and so many that each has ``SHARD_TOKENS`` tokens at most.
    bits = max(6, int(size // SHARD_TOKENS).bit_length())
    answered = stage(counts(bodies, bits), "counts")
    sums = {r["kind"]: r for r in answered.groupBy("kind").agg(F.sum("types").alias("types"), F.sum("tokens").alias("n"), F.sum("tokens_apart").alias("apart")).collect()}
    n, types, apart = (sums["w"]["n"], sums["w"]["types"], sums["w"]["apart"]) if sums else (0, 0, 0)
    weights = learn_weights(bodies, answered, n - apart, types)

    def judge(body: pa.Table, answers: pa.Table) -> pa.Table:
        got, lengths, held = _joined(body, answers, ("total",))
        row = body.slice(0, 1).to_pylist()[0]
        pair, context, word = (got[k, "total"] for k in "pvw")
        own = weights[_bucket(context)]
        p = own[:, 0] * pair / np.maximum(context, 1) + own[:, 1] * word / max(n, 1) + own[:, 2] / (types + 1)
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        ids = pa.array(unpack(row["ids"]).view(np.int64), mask=~unpack(row["known"]).astype(bool))
        return pa.table({
            "doc_id": ids, "held_out": held, "n_tokens": lengths, "n_known": np.add.reduceat((word > 0).astype(np.int64), at),
            "train_tokens": np.full(len(lengths), n, np.int64),
            "base_score": np.add.reduceat(np.log10((word + 1) / (n + types + 1)), at), "score": np.add.reduceat(np.log10(p), at),
        })

    return bodies.groupBy("block").cogroup(answered.select("block", "kind", "shard", "total").groupBy("block")).applyInArrow(
        judge, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
