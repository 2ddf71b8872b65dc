"""Chat formatting: reply trees, their best branches, and one training text per branch. DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import stage


@dataclass(frozen=True)
class Template:
    """``open`` role ``head`` text ``close`` for every turn.

    Control strings inside roles and texts get ``mark`` behind their first character, and one more where some stand
    there already, so that no text can open or close a turn and every text can be read back.
    The defaults are fixed values: control strings that chat templates commonly use.
    """

    open: str = "<|im_start|>"
    head: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|eot_id|>",
                               "<|start_header_id|>", "<|end_header_id|>", "<|system|>", "<|user|>", "<|assistant|>")
    mark: str = "\\"

    def __post_init__(self) -> None:
        controls = self.controls
        for a in controls:
            if len(a) < 2 or self.mark in a:
                raise ValueError(f"control string {a!r} is too short or holds the mark")
            if any(a != b and b in a or any(a.endswith(b[:k]) for k in range(1, len(b))) for b in controls):
                raise ValueError(f"control string {a!r} overlaps another")

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((self.open, self.head, self.close, *self.others)))

    def _places(self, marks: str) -> str:
        """``marks`` between a control string's first character and its rest."""
        rests: dict[str, list[str]] = {}
        for c in self.controls:
            rests.setdefault(c[0], []).append(re.escape(c[1:]))
        return "|".join(marks.format(first=re.escape(f), rest="|".join(r), mark=re.escape(self.mark)) for f, r in rests.items())

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self._places("(?<={first}){mark}*(?={rest})"), re.escape(self.mark) + "$0")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self._places("(?<={first}){mark}(?={mark}*(?:{rest}))"), "")

    def read(self, formatted: Column) -> Column:
        """``array<struct<role, text, piece>>``: the turns of a formatted conversation, and what each looks like there without ``close``."""
        pieces = F.split(formatted, re.escape(self.close), -1)
        pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

        def turn(piece: Column) -> Column:
            body = F.substring(piece, len(self.open) + 1, 2**31 - 1)
            role = F.substring_index(body, self.head, 1)
            text = F.substring(body, F.length(role) + len(self.head) + 1, F.lit(2**31 - 1))
            return F.struct(self.unescaped(role).alias("role"), self.unescaped(text).alias("text"), piece.alias("piece"))

        return F.transform(pieces, turn)

    def masked(self, turns: Column, spans: Column) -> Column:
        """The unescaped texts under the loss mask, from what ``read`` gave and the spans beside it."""
        both = F.filter(F.arrays_zip(turns.alias("turn"), spans.alias("span")), lambda x: x["span"]["loss"])
        place = lambda x, c: (x["span"][c] - x["span"]["start"]).cast("int")
        return F.transform(both, lambda x: self.unescaped(
            F.substring(x["turn"]["piece"], place(x, "text_start") + 1, place(x, "text_stop") - place(x, "text_start"))))


def _jumps(links: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables ``key, up, gain``, the k-th one from a node to its ancestor 2^k levels up and the scores of the nodes passed,
    ``up`` included; and the nodes without a root, if any.

    Each table is the one before joined with itself. A node drops out where the root is nearer, so short trees are
    done after few rounds. When a round loses no node, those left are on a cycle or below one.
    """
    up = links.select(F.col("key").alias("up"), F.col("score").alias("gain"))
    step = stage(links.where("up IS NOT NULL").select("key", "up").join(up, "up").select("key", "up", "gain"), "jump")
    out, n = [], step.count()
    while n:
        out.append(step)
        further = step.select(F.col("key").alias("up"), F.col("up").alias("far"), F.col("gain").alias("more"))
        step = stage(step.join(further, "up").select("key", F.col("far").alias("up"), (F.col("gain") + F.col("more")).alias("gain")), "jump")
        left = step.count()
        if left == n:
            return out, step.select("key")
        n = left
    return out, None


def branches(messages: DataFrame, tree: str, node: str, parent: str, score: str | None = None, best: int = 1) -> DataFrame:
    """``tree, leaf, branch_rank, branch_score, turn_no, key``: a row per node on each tree's ``best`` branches.

    A branch leads from a root (no parent, or one that its tree doesn't hold) to a leaf (nobody's parent). Its
    score is the mean of its nodes' scores (null and absent scores count 0); longer branches, then smaller leaves,
    go first among equals. Nodes on a cycle, and those below, have no root and are on no branch.

    Self-joins double the reach of upward pointers, so rounds grow with the logarithm of the depth. Leaves climb by these
    tables to their roots and are ranked before any path is written out; then only the chosen leaves' paths are
    enumerated, again by doubling, every node once. Only identifiers and scores travel.
    """
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    key, above = F.struct(F.col(tree).alias("tree"), F.col(node).alias("node")), F.struct(F.col(tree).alias("tree"), F.col(parent).alias("node"))
    rows = messages.select(key.alias("key"), F.when(F.col(parent).isNotNull(), above).alias("up"), value.alias("score"))
    # Rows that repeat a node have one place: the first parent, the highest score.
    rows = stage(rows.groupBy("key").agg(F.min("up").alias("up"), F.max("score").alias("score")), "nodes")
    jumps, lost = _jumps(rows)
    parents = rows.where("up IS NOT NULL").select(F.col("up").alias("key")).distinct()
    leaves = rows.join(parents, "key", "left_anti").select(F.col("key").alias("leaf"), F.col("key").alias("at"), "score", F.lit(0).cast("long").alias("depth"))
    if lost is not None:
        leaves = leaves.join(lost.select(F.col("key").alias("leaf")), "leaf", "left_anti")
    for k in reversed(range(len(jumps))):
        leaves = leaves.join(jumps[k].withColumnRenamed("key", "at"), "at", "left").select(
            "leaf", F.coalesce("up", "at").alias("at"), (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
            (F.col("depth") + F.when(F.col("up").isNotNull(), 1 << k).otherwise(0)).alias("depth"))
    leaves = leaves.withColumn("branch_score", F.col("score") / (F.col("depth") + 1))
    order = W.partitionBy("leaf.tree").orderBy(F.col("branch_score").desc(), F.col("depth").desc(), "leaf.node")
    chosen = leaves.withColumn("branch_rank", F.row_number().over(order)).where(F.col("branch_rank") <= best)
    front = stage(chosen.select("leaf", "depth", "branch_rank", "branch_score"), "branches").withColumn("at", F.col("leaf"))
    front = front.withColumn("turn_no", F.col("depth"))
    for k in reversed(range(len(jumps))):
        far = F.struct(F.col("up").alias("at"), (F.col("turn_no") - (1 << k)).alias("turn_no"))
        both = F.when(F.col("up").isNull(), F.array(F.struct("at", "turn_no"))).otherwise(F.array(F.struct("at", "turn_no"), far))
        front = front.join(jumps[k].select(F.col("key").alias("at"), "up"), "at", "left").withColumn("both", F.explode(both)).select(
            "leaf", "branch_rank", "branch_score", "both.at", "both.turn_no")
    return front.select("leaf.tree", F.col("leaf.node").alias("leaf"), "branch_rank", "branch_score", "turn_no", F.col("at").alias("key"))


def format_trees(messages: DataFrame, tree: str, node: str, parent: str, role: str = "role", text: str = "text", score: str | None = None,
                 best: int = 1, loss_roles: Sequence[str] = ("assistant",), template: Template = Template(), links: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """``tree, leaf, branch_rank, branch_score, formatted, spans``: one training text for each of a tree's ``best`` branches.

    ``spans`` has a struct per turn, in order: ``start, stop`` of the turn, ``text_start, text_stop`` of its escaped text
    (code points in ``formatted``, counted from 0), and ``loss``, whether the text is learnt (its role is among ``loss_roles``).
    The parents and scores may stand in a table of their own, ``links``; texts then meet nothing but the chosen paths.

    Null roles and texts are empty. Rows that repeat a node are turns of their own, one after another by role and
    text. Null trees are one tree; a null node is a node that nobody replies to. An empty table gives no rows; other
    columns aren't read. A branch's text is one value, so one conversation has to fit a row; nothing else is gathered.
    """
    paths = branches(messages if links is None else links, tree, node, parent, score, best)
    rows = messages.select(F.struct(F.col(tree).alias("tree"), F.col(node).alias("node")).alias("key"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                           F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Escaped behind the exchange, so that each text passes it once.
    rows = rows.join(paths, "key").drop("key").repartition("tree", "leaf").withColumn("_role", template.escaped(F.col("role"))).withColumn("_text", template.escaped(F.col("text")))
    head = F.concat(F.lit(template.open), "_role", F.lit(template.head))
    rows = rows.select("tree", "leaf", "branch_rank", "branch_score", "turn_no", "role", "text", head.alias("head"), "_text")
    by = W.partitionBy("tree", "leaf").orderBy("turn_no", "role", "text")
    size = F.length("head") + F.length("_text") + len(template.close)
    rows = rows.withColumn("nth", F.row_number().over(by)).withColumn("stop", F.sum(size).over(by.rowsBetween(W.unboundedPreceding, 0)))
    start, text_stop = F.col("stop") - size, F.col("stop") - len(template.close)
    span = F.struct(start.alias("start"), "stop", (text_stop - F.length("_text")).alias("text_start"), text_stop.alias("text_stop"),
                    F.col("role").isin(*loss_roles).alias("loss"))
    turn = F.struct("nth", F.concat("head", "_text", F.lit(template.close)).alias("piece"), span.alias("span"))
    out = rows.groupBy("tree", "leaf").agg(F.first("branch_rank").alias("branch_rank"), F.first("branch_score").alias("branch_score"),
                                           F.array_sort(F.collect_list(turn)).alias("turns"))
    return out.select("tree", "leaf", "branch_rank", "branch_score", F.array_join(F.col("turns.piece"), "").alias("formatted"), F.col("turns.span").alias("spans"))


def reply_chains(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``key, node, role, text`` and ``key, node, parent``: conversations as trees where every row replies to the one before it.

    Rows stand by ``order`` (null first), then role and a digest of the text; rows equal in all share a node. Only
    that much of a row is exchanged and sorted, never its text.
    """
    place = F.struct(F.col(order).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    rows = rows.select(F.col(key).alias("key"), place.alias("node"), F.col(role).alias("role"), F.col(text).alias("text"))
    nodes = rows.select("key", "node").distinct()
    return rows, nodes.withColumn("parent", F.lag("node").over(W.partitionBy("key").orderBy("node")))
