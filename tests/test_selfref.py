"""Self references against judging the rows one by one."""

from __future__ import annotations

import random

from millrace.operators.selfref import accept_in_order

SCHEMA = "row_idx long, key0 string, ref0 string, key1 string, ref1 string"


def one_by_one(rows, refs):
    """Accepted rows: each is judged by the keys of the rows accepted before it."""
    held, accepted = {i: set() for i in refs}, []
    for row in sorted(rows):
        if all(row[2 + 2 * i] is None or not held[i] or row[2 + 2 * i] in held[i] for i in refs):
            accepted.append(row[0])
            for i in refs:
                held[i] |= {row[1 + 2 * i]} - {None}
    return accepted


def accepted_rows(spark, rows, refs):
    facts = accept_in_order(spark.createDataFrame(rows, SCHEMA), refs)
    starts = {i: {r["key"]: r["since"] for r in facts[i][0].df.collect()} for i in refs}
    first = {i: facts[i][1] for i in refs}

    def passes(row, i):
        ref = row[2 + 2 * i]
        return ref is None or first[i] is None or row[0] <= first[i] or starts[i].get(ref, row[0]) < row[0]

    return [r[0] for r in sorted(rows) if all(passes(r, i) for i in refs)]


def made(seed, n, keys, copies):
    rng = random.Random(seed)
    names = [f"k{k}" for k in range(keys)]
    free = list(names)
    rng.shuffle(free)
    rows = []
    for i in range(n):
        own = [rng.choice([*names, None]) if copies else (free.pop() if free and rng.random() < 0.8 else None) for _ in range(2)]
        rows.append((i * 3, own[0], rng.choice([None, *names]), own[1], rng.choice([None, None, *names])))
    return rows


def test_single_keys_by_chains(spark):
    for seed in range(4):
        rows = made(seed, 40, 60, False)
        assert accepted_rows(spark, rows, [0]) == one_by_one(rows, [0])


def test_keys_in_several_rows_and_two_references(spark):
    for seed in range(3):
        rows = made(seed, 30, 8, True)
        assert accepted_rows(spark, rows, [0]) == one_by_one(rows, [0])
        assert accepted_rows(spark, rows, [0, 1]) == one_by_one(rows, [0, 1])


def test_first_keys_in_different_rows(spark):
    rows = [(1, "a", None, None, "zz"), (2, "b", "nope", "x", None), (3, "c", "a", "y", "x"), (4, None, "a", None, "x"), (5, "d", "c", "z", "y"), (6, None, "d", None, "q")]
    assert accepted_rows(spark, rows, [0, 1]) == one_by_one(rows, [0, 1])


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from millrace.operators import selfref

    rounds = []
    plain = selfref.stage
    monkeypatch.setattr(selfref, "stage", lambda df, label="stage": (rounds.append(label), plain(df, label))[1])
    n = 100_000
    rows = spark.range(n).selectExpr("id AS row_idx", "cast(id as string) AS key0", "CASE WHEN id > 0 THEN cast(id - 1 as string) END AS ref0", "cast(null as string) AS key1", "cast(null as string) AS ref1")
    facts = selfref.accept_in_order(rows, [0])
    assert facts[0][0].rows == n - 1 and rounds.count("selfref-step") < 20
