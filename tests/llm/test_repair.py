"""Structure repair against plain dynamic programming over all edits."""

from __future__ import annotations

import random
import re
import sys
from functools import cache

from millrace.llm import repair

sys.setrecursionlimit(20_000)  # of the plain version below


def plain_edits(letters):
    """Least cost and, among equals, least initials; the state is the role's initial before."""

    @cache
    def best(i, last, inserted):
        options = [(0, "")] if i == len(letters) and last in ("", "a") else []
        after = "a" if last == "u" else "u"
        if inserted < 4:
            c, a = best(i, after, inserted + 1)
            options.append((c + 3, "I" + a))
        if i < len(letters):
            x = letters[i]
            c, a = best(i + 1, last, 0)
            options.append((c + 4, "D" + a))
            if x != "x":
                more = 3 if x.isupper() else 0
                if (last, x.lower()) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    c, a = best(i + 1, x.lower(), 0)
                    options.append((c + more, "K" + a))
                c, a = best(i + 1, after, 0)
                options.append((c + 3 + more, "R" + a))
        return min(options, default=(10**9, ""))

    return best(0, "", 0)


def test_auction_finds_the_least_edits():
    rng = random.Random(1)
    cases = ["", "x", "s", "u", "a", "o", "S", "U", "A", "O"] + ["".join(rng.choices("xsuaoSUAO", k=rng.randrange(2, 12))) for _ in range(3000)]
    cases += ["".join(rng.choices("uaUAx", [4, 4, 1, 1, 1], k=n)) for n in (31, 32, 33, 64, 150, 200)] + ["u" * 130, "x" * 130, "a" * 65, "su" + "au" * 90]
    for c in cases:
        cost, audit, rows, roles = repair.edits(c)
        assert (cost, audit) == plain_edits(c), c
        kept = "".join(r[0] if r else c[i].lower() for i, r in zip(rows, roles, strict=True))
        assert re.fullmatch("(s?(ua)+)?", kept)
        assert [i for i in rows if i >= 0] == sorted({i for i in rows if i >= 0}) and not any(c[i] == "x" for i in rows if i >= 0)


def test_work_follows_the_number_of_rows(monkeypatch):
    """A long conversation full of faults takes as many steps per row as a short one."""
    steps = []
    out = repair.Lattice.out
    monkeypatch.setattr(repair.Lattice, "out", lambda self, node: steps.append(node) or out(self, node))
    cost = {}
    for n in (1_000, 8_000):
        steps.clear()
        repair.Lattice("".join(random.Random(n).choices("uaUAxo", k=n))).solve()
        cost[n] = len(steps) / n
    assert cost[8_000] < 1.3 * cost[1_000]


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    count, seen, letters = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), ""
    for _, role, text in rows:
        core = text.strip("\t\n\x0b\x0c\r ")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        letter = "x" if fault in ("blank", "duplicate") else role[0] if role[:1] in ("s", "u", "a") and role else "o"
        letters += letter.upper() if fault == "truncated" else letter
        if fault:
            count[fault] += 1
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = plain_edits(letters)
    made, i, last = [], 0, ""
    for e in audit:
        role = "assistant" if last[:1] == "u" else "user"
        if e == "I":
            made.append((role, ""))
        elif e != "D":
            made.append((rows[i][1] if e == "K" else role, rows[i][2]))
        if e != "D":
            last = made[-1][0]
        i += e != "I"
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count.values(), illegal, cost, audit, made)


def test_against_plain_rows(spark):
    rng = random.Random(9)
    texts = [None, "", " \t\n", "Done.", "Done. \n", "cut off", "a?!", "é", "\x85", "same text!", "x" * 50_000 + "."]
    rows = {c: [(rng.choice([None, 0, 1, 2, 3, 7, 9]), rng.choice(["user", "assistant", "system", "tool", None, "", "upper"]), rng.choice(texts)) for _ in range(rng.randrange(1, 12))]
            for c in [None, *range(60)]}
    flat = [(c, *r, True, "k", 1) for c, rs in rows.items() for r in rs] + [(77, 1, "user", "gone.", False, "k", 1), (3, 1, "user", "gone.", None, "k", 1)]
    df = spark.createDataFrame(flat, "conv_id long, turn int, role string, text string, here boolean, key string, pos int")
    got = {r.conv_id: (*r[1:8], [tuple(m) for m in r.repaired]) for r in repair.repair(df, alive="here").collect()}
    assert got == {c: plain_repair(rs) for c, rs in rows.items()} | {77: (0, 0, 0, 0, 0, 0, "", [])}


def test_damage_by_checksum(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(20) for t in range(10)] + [(None, None, None, None)]
    got = [tuple(r) for r in repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        one = (c, t, "user" if k == 4 else role, "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text, k != 0)
        want += [one] * (2 if k == 3 else 1)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(repair.damage(none), alive="alive").collect() == []
