"""Conversation structure repair: cheapest edits by an auction for shortest paths over the lattice of rows and roles."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What the edits cost, and what a truncated row that stays costs besides.
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: States of a conversation: nothing yet, after a system row, after a user row, after an assistant row; 0 and 3 may end it.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that an inserted or reroled row takes in each state, and the state behind it.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Rows between the origins that are settled first, from the last to the first.
BLOCK = 32
#: Signatures up to this length are remembered by a worker.
REMEMBERED = 64


def _arcs(letter: str, state: int) -> tuple[tuple[str, int, int, int], ...]:
    """``edit, cost, rows passed, next state`` out of a node, in the order of the edits' initials.

    A row's letter is ``x`` where it has to go, else its role's initial (``o``: none of s, u, a), in upper case where it is truncated.
    """
    after = NEXT[state][1]
    out = [("D", DELETE, 1, state)] if letter else []
    out.append(("I", INSERT, 0, after))
    if letter and letter != "x":
        more = TRUNCATED if letter.isupper() else 0
        if (state, letter.lower()) in KEEP:
            out.append(("K", more, 1, KEEP[state, letter.lower()]))
        out.append(("R", REROLE + more, 1, after))
    return tuple(out)


ARCS = {(c, s): _arcs(c, s) for c in ["", *"xsuaoSUAO"] for s in range(4)}
#: What a row costs at least, whatever is done with it.
LEAST = {c: DELETE if c == "x" else TRUNCATED if c.isupper() else 0 for c in "xsuaoSUAO"}


class Lattice:
    """Nodes are (rows passed, state), numbered ``4 * rows + state``, and one goal behind the last row.

    Prices never exceed the distance to the goal, and ``price[i] <= cost(i, j) + price[j]`` on every arc. A path grows
    from its origin while the last node's price equals its cheapest arc's cost and price ahead, and shrinks after raising
    the price where it doesn't. Where the path ends in a settled node, all its prices are exact distances and its
    nodes are settled too.
    """

    def __init__(self, letters: str):
        self.letters, self.goal = letters, 4 * (len(letters) + 1)
        self.price = [0] * (self.goal + 1)
        self.settled = [False] * self.goal + [True]

    def out(self, node: int) -> list[tuple[str, int, int]]:
        """``edit, cost, node`` of the arcs out of a node, by the edit's initial; the end comes first."""
        row, state = divmod(node, 4)
        last = row == len(self.letters)
        ends = [("", 0, self.goal)] if last and state in (START, ASSISTANT) else []
        return ends + [(e, c, 4 * (row + d) + s) for e, c, d, s in ARCS["" if last else self.letters[row], state]]

    def settle(self, origin: int) -> None:
        price, settled, path = self.price, self.settled, [origin]
        while not settled[path[-1]]:
            i = path[-1]
            least, j = min((c + price[j], j) for _, c, j in self.out(i))
            if price[i] < least:
                price[i] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(j)
        for i in path:
            settled[i] = True

    def solve(self) -> tuple[int, str]:
        """The least cost, and of the edits that have it those whose initials are least in ASCII order."""
        n, price = len(self.letters), self.price
        borders = [*range(0, n, BLOCK), n]
        for state in range(4):
            self.settle(4 * n + state)
        # From the last block to the first. A path from a block's first row ends at the next block, whose distances are known,
        # and the block's prices begin with the least of these and what its rows cost in any case; so work follows the rows.
        for start, stop in zip(borders[-2::-1], borders[:0:-1]):
            ahead = min(price[4 * stop:4 * stop + 4])
            for row in range(stop - 1, start - 1, -1):
                ahead += LEAST[self.letters[row]]
                price[4 * row:4 * row + 4] = [ahead] * 4
            for state in range(4):
                self.settle(4 * start + state)
        node, audit = START, []
        while node != self.goal:
            for edit, cost, j in self.out(node):
                # Tight by prices that may still be low: the arc counts if it is tight once its head is settled.
                if self.price[node] == cost + self.price[j]:
                    self.settle(j)
                    if self.price[node] == cost + self.price[j]:
                        audit.append(edit)
                        node = j
                        break
        return self.price[START], "".join(audit)


def edits(letters: str) -> tuple[int, str, list[int], list[str | None]]:
    """Cost and audit of the cheapest edits; for every row of the repaired conversation the row it
    comes from (-1: inserted) and its new role (None: as it was)."""
    cost, audit = Lattice(letters).solve()
    row, state = 0, START
    rows: list[int] = []
    roles: list[str | None] = []
    for edit in audit:
        role, after = NEXT[state]
        if edit != "D":
            rows.append(-1 if edit == "I" else row)
            roles.append(None if edit == "K" else role)
            state = KEEP[state, letters[row].lower()] if edit == "K" else after
        row += edit != "I"
    return cost, audit, rows, roles


@lru_cache(1 << 14)
def _short_edits(letters: str) -> tuple[int, str, list[int], list[str | None]]:
    return edits(letters)


def _solved(signatures: pd.Series) -> pd.DataFrame:
    found = [_short_edits(s) if len(s) <= REMEMBERED else edits(s) for s in signatures]
    return pd.DataFrame(found, columns=["cost", "audit", "at", "roles"])


def repair(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", alive: str | None = None) -> DataFrame:
    """One row per conversation: ``key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired``.

    Rows stand by ``order``, null first, then by role and text. ``gaps`` counts the numbers missing between the
    first and the last of ``order``. A row is ``blank`` without a character but white space, else ``duplicate``
    if its role and text came earlier, else ``truncated`` if its last such character is none of ``.!?``. ``illegal``
    counts neighbours whose roles' initials aren't su, ua or au. ``audit`` has the initials of the cheapest edits
    (Keep, Rerole, Delete, Insert) after which the initials read ``(s?(ua)+)?``, the least in ASCII order
    among equals; ``repaired`` is what they leave, ``array<struct<role, text>>``.

    Null roles and texts are one space. Null keys are one conversation. Rows whose ``alive`` column is
    false count for nothing, but their conversation stays in the result: without rows all counts and the cost are 0. An
    empty table gives no rows; other columns aren't read.

    Rows are exchanged once, by conversation; all windows and the grouping use that. Python sees one letter per row, never a text.
    A conversation is one value of the result, so it has to fit a row.
    """
    live = F.coalesce(F.col(alive), F.lit(False)) if alive else F.lit(True)
    r = rows.select(F.col(key).alias("key"), F.col(order).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                    F.coalesce(F.col(text), F.lit(" ")).alias("text"), live.alias("live"))
    by = W.partitionBy("key", "live").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    initial = F.substring("role", 1, 1)
    r = r.withColumn("initial", initial).repartition("key")
    r = r.withColumns({"pos": F.row_number().over(by), "before": F.lag("initial").over(by), "turn_before": F.lag("turn").over(by)})
    again = F.row_number().over(W.partitionBy("key", "live", "role", "text").orderBy("pos")) > 1
    r = r.withColumn("again", again)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = F.when(blank, "blank").when(F.col("again"), "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    r = r.withColumn("fault", fault)
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").otherwise(F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o"))
    letter = F.when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    new_turn = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))
    illegal = F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")
    count = lambda c: F.count_if(F.col("live") & c)
    turn = F.when(F.col("live"), F.col("turn"))
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - count(new_turn), F.lit(0))
    kept = F.when(F.col("live"), F.struct("pos", letter.alias("letter"), "role", "text"))
    out = r.groupBy("key").agg(gaps.alias("gaps"), *[count(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in ("blank", "duplicate", "truncated")],
                               count(illegal).alias("illegal"), F.array_sort(F.collect_list(kept)).alias("rows"))
    solved = F.pandas_udf(_solved, "cost long, audit string, at array<int>, roles array<string>")
    out = out.withColumn("done", solved(F.array_join(F.col("rows.letter"), "")))
    old = lambda i: F.get(F.col("rows"), i)
    made = F.zip_with("done.at", "done.roles", lambda i, new: F.struct(
        F.coalesce(new, old(i)["role"]).alias("role"), F.when(i < 0, F.lit("")).otherwise(old(i)["text"]).alias("text")))
    return out.select(F.col("key").alias(key), "gaps", "blank", "duplicate", "truncated", "illegal", "done.cost", "done.audit", made.alias("repaired"))


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, alive``: rows with one fault each for a part of them, chosen by a checksum.

    Of twenty remainders, 0 drops the row (``alive`` is false), 1 empties its text, 2 takes its full
    stops, exclamation and question marks, 3 repeats it, 4 makes it a user's. Nulls count as one space.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))) % 20
    made: Column = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    role = F.when(fault == 4, F.lit("user")).otherwise(shown("role"))
    times = F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), made.alias("text"), (fault != 0).alias("alive"), F.explode(times).alias("_copy")).drop("_copy")
