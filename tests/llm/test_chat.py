"""Reply trees against a plain recursion, and exact round trips of the template."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import chat
from millrace.llm.queries import op11_chat_formatting

SCHEMA = "tree string, node long, parent long, role string, text string, score double, leaf string, key int"


def plain(rows, best):
    """(tree, leaf) -> rank and (role, text) turns of the best branches."""
    trees = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in rows:
        trees[r[0]][r[1]].append(r)
    out = {}
    for tree, nodes in trees.items():
        up = {n: min((r[2] for r in rs if r[2] is not None), default=None) for n, rs in nodes.items()}
        score = {n: max((r[5] or 0.0) for r in rs) for n, rs in nodes.items()}
        found = []
        for leaf in set(nodes) - {p for p in up.values() if p is not None}:
            path, at = [], leaf
            while at not in path:
                path.append(at)
                if up[at] is None or up[at] not in nodes:
                    break
                at = up[at]
            else:
                continue
            found.append((-sum(score[n] for n in path) / len(path), -len(path), (leaf is not None, leaf or 0), leaf, path[::-1]))
        for rank, (*_, leaf, path) in enumerate(sorted(found)[:best], 1):
            out[tree, leaf] = rank, [t for n in path for t in sorted((r[3] or "", r[4] or "") for r in nodes[n])]
    return out


def forest():
    rng = random.Random(4)
    rows = []
    for tree in ["a", "b", None]:
        for n in range(60):
            parent = None if rng.random() < 0.1 else rng.randrange(n) if n and rng.random() < 0.9 else 999
            rows.append((tree, n, parent, rng.choice(["user", "assistant", "tool"]), f"text {tree} {n} <|im_end|>", rng.choice([None, 0.5, 1.0, 2.0])))
    rows += [("deep", n, n - 1 if n else None, ["user", "assistant"][n % 2], f"t{n}", None) for n in range(70)]
    rows += [("loop", 1, 2, "user", "x", 9.0), ("loop", 2, 1, "user", "y", 9.0), ("loop", 3, 2, "user", "below", 9.0), ("loop", 4, None, "user", "alone", 0.0)]
    rows += [("deep", 5, 4, "user", "said twice", None), ("deep", 5, 4, "user", "said twice", None), ("odd", None, None, None, None, None), ("odd", 2, 1, "", "", 1.0)]
    return [(*r, "clash", 1) for r in rows]


@pytest.mark.parametrize("best", [1, 3])
def test_against_a_plain_recursion(spark, best):
    rows = forest()
    df = spark.createDataFrame(rows, SCHEMA)
    template = chat.Template()
    done = chat.format_trees(df, "tree", "node", "parent", score="score", best=best, template=template).withColumn("turns", template.read(F.col("formatted")))
    got = {}
    for r in done.withColumn("learnt", template.masked(F.col("turns"), F.col("spans"))).collect():
        turns = [(t.role, t.text) for t in r.turns]
        got[r.tree, r.leaf] = r.branch_rank, turns
        assert r.learnt == [t for role, t in turns if role == "assistant"]
        assert [s.start for s in r.spans] == [0, *[s.stop for s in r.spans][:-1]] and r.spans[-1].stop == len(r.formatted)
    assert got == plain(rows, best)


def test_no_text_opens_or_closes_a_turn(spark):
    template = chat.Template()
    rng = random.Random(7)
    parts = [*template.controls, "\\", "\\\\", "<", "[", "|", ">", "]", "INST]", "im_end", "é", "\U0001f600", "$0", "\\$", "\n", "", "<\\|im_end|>", "[\\\\INST]"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(2000)] + ["", "\\" * 5000, "<" * 5000, "<" + "\\" * 5000 + "|im_end|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", template.escaped(F.col("t")).alias("e"), template.unescaped(template.escaped(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in template.controls)


def test_overlapping_control_strings_are_refused():
    for bad in ({"close": "<|"}, {"others": ("im_sep",)}, {"others": (">x<",)}, {"open": "a\\b"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_chains_keep_every_row(spark):
    rows = [(1, None, "user", "first"), (1, 3, "assistant", "b"), (1, 3, "assistant", "b"), (1, 3, "assistant", "a"), (1, 9, None, None), (None, 0, "user", "x" * 100_000), (2, 0, "user", "")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, parent string")
    messages, links = chat.reply_chains(df)
    done = chat.format_trees(messages, "key", "node", "parent", links=links).withColumn("turns", chat.Template().read(F.col("formatted")))
    got = {r.tree: [(t.role, t.text) for t in r.turns] for r in done.collect()}
    assert got[None] == [("user", "x" * 100_000)] and got[2] == [("user", "")]
    assert got[1][0] == ("user", "first") and sorted(got[1][1:4]) == [("assistant", "a"), ("assistant", "b"), ("assistant", "b")] and got[1][4] == ("", "")


def test_empty_table_and_native_plan(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.format_trees(none, "tree", "node", "parent").collect() == []
    spark.createDataFrame([(1, 0, "user", "hi", 1)], "conv_id int, turn int, role string, text string, tree int").write.parquet(f"{tmp_path}/conversations.parquet")
    df = op11_chat_formatting(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))
    got = {r.conv_id: r for r in df.collect()}
    assert set(got) == {1, -7} and got[-7].n_turns == 2 and got[-7].loss_chars == len("</s>[INST] ok [/INST]") and got[1].loss_chars == 0
