"""What a script leaves on the disk, and the routes that keep it small."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.operators import lookup, prefix
from millrace.operators import render as R
from millrace.operators.validate import validate
from millrace.session import Steps, discard, shared_dir, stage, staging
from millrace.target import Column, ForeignKey, Table, fill
from scenarios import all_queries

SF = "/root/testdata/sf0.001"


def held(spark):
    return set(os.listdir(shared_dir(spark)) if os.path.isdir(shared_dir(spark)) else [])


def labels_since(spark, before):
    return [name.rsplit("-", 1)[0] for name in held(spark) - before]


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_compact_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    kept = spark.range(500).repartition(3, "id")
    staged = stage(kept.withColumn("t", F.col("id").cast("string")), "small", compact=True)
    assert not shuffle_files(spark) - before
    assert staged.count() == 500 and kept.count() == 500
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    assert session.stage_parts([staged.where("id < 200"), staged.where("id >= 200").select("t", "id")], "parts").exceptAll(staged).isEmpty()


def test_steps_and_staging_delete_what_is_read_no_more(spark):
    before = held(spark)
    with staging(spark) as kept:
        steps, at = Steps("step"), spark.range(10)
        for _ in range(3):
            at = steps([at.where(F.col("id") % 2 == k).withColumn("id", F.col("id") + 1) for k in (0, 1)])
        last = kept(stage(at, "last"))
        steps.done()
        assert labels_since(spark, before) == ["last"]
        stage(at.sparkSession.range(3), "other")
    assert labels_since(spark, before) == ["last"] and sorted(r["id"] for r in last.collect()) == list(range(3, 13))
    discard(last)
    assert not labels_since(spark, before)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
def test_a_script_leaves_its_lines_alone(spark):
    with staging(spark):
        before = held(spark)
        lines = all_queries()["o12_script"](spark, SF)
        assert labels_since(spark, before) == ["script"]
        assert lines.where("section = 1 AND part = 3").count() == lines.where("text LIKE '%INSERT INTO%'").count() > 0


@pytest.mark.parametrize(("n", "size", "most"), [(40, 7, 4000), (900, 7, 4000), (900, 50, 1000), (64, 16, 64), (1, 5, 9)])
def test_statements_over_bucket_borders(spark, monkeypatch, n, size, most):
    """Buckets of 16 positions, sparse and full: batches inside one and batches over several."""
    monkeypatch.setattr(prefix, "BITS", 4)
    at = sorted(random.Random(n * size).sample(range(most), n))
    rows = spark.createDataFrame([(i, f"v{i}") for i in random.Random(1).sample(at, n)], "row_idx long, V string").repartition(3)
    table = Table("T", (Column("V", "varchar(9)"),))
    got = R.statements(rows, table, fill({"T": {"v": "V"}}), batch_size=size).orderBy("batch").collect()
    parts = [at[i:i + size] for i in range(0, n, size)]
    assert [(r["batch"], r["n_rows"]) for r in got] == [(i, len(p)) for i, p in enumerate(parts)]
    for r, p in zip(got, parts):
        assert r["text"] == "INSERT INTO [dbo].[T]\n(\n    [V]\n)\nVALUES\n" + ",\n".join(f"(\n    'v{i}'\n)" for i in p) + ";"


def test_rows_move_to_their_numbers_without_their_text(spark):
    rows = spark.range(1, 3000).select(F.col("id").alias("row_idx"), F.col("id").cast("string").alias("V"))
    plan = R.statements(rows, Table("T", (Column("V", "varchar(9)"),)), fill({"T": {"v": "V"}}))._jdf.queryExecution().executedPlan()
    moved = [line for line in plan.toString().split("\n") if "Exchange hashpartitioning(__bucket" in line]
    texts = [line for line in plan.toString().split("\n") if "Exchange hashpartitioning(batch" in line]
    assert moved and len(texts) == 1


@pytest.mark.parametrize("limit", [None, 0])
def test_verdicts_of_wide_facts_in_steps(spark, monkeypatch, limit):
    """Conflicts and two references looked up one after another, once by broadcast and once moving the rows."""
    if limit is not None:
        monkeypatch.setattr(lookup, "BROADCAST_BYTES", limit)
        monkeypatch.setattr("millrace.operators.validate.BROADCAST_BYTES", limit)
    dock = Table("Dock", (Column("Code", "varchar(4)", False), Column("Town", "varchar(9)", False)), ("Code",))
    ship = Table("Ship", (Column("Hull", "int", False), Column("Line", "varchar(9)", False)), ("Hull",))
    call = Table("Call", (Column("No", "int", False), Column("Code", "varchar(4)"), Column("Hull", "int")), ("No",),
                 (ForeignKey("Code", "Dock", "Code"), ForeignKey("Hull", "Ship", "Hull")))
    rows = [(i, str(i // 2 if i < 6 else i), f"d{i % 4}", None if i % 4 == 3 else f"t{i % 4}", str(i % 3), None if i % 3 == 2 else "l") for i in range(1, 41)]
    rows += [(41, *rows[-1][1:])]
    sheet = spark.createDataFrame(rows, "row_idx long, n string, c string, t string, h string, l string")
    maps = {"Dock": {"c": "Code", "t": "Town"}, "Ship": {"h": "Hull", "l": "Line"}, "Call": {"n": "No", "c": "Code", "h": "Hull"}}
    with staging(spark):
        before = held(spark)
        result = validate(sheet, [call, dock, ship], fill(maps))
        left = labels_since(spark, before)
        assert not any(name.startswith(("tuples", "met")) for name in left)
        check = result.checks["call"]
        assert check.tuples.agg({"copies": "sum"}).first()[0] == 41
        conflicts = {2, 3, 4, 5}
        want = {i for i, n, c, _, h, _ in rows if i in conflicts or c == "d3" or h == "2"}
        assert {r["row_index"] for r in check.rejected.collect()} == want
        firsts = [r[0] for r in check.valid.select("row_idx").orderBy("row_idx").collect()]
        assert firsts == [i for i in range(1, 41) if i not in want]
        check.write_failing()
        assert {r["row_index"] for r in check.fk_errors.collect()} == {i for i in want if i not in conflicts}
        assert sorted(r["row_index"] for r in check.pk_errors.collect()) == [3, 5]
        left = labels_since(spark, before)
        assert "met-call" not in left


def test_a_slice_without_rows(spark, monkeypatch):
    """All rows hold one key, so the other slices of a wide lookup are empty."""
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    one = Table("One", (Column("K", "int", False), Column("V", "varchar(9)", False)), ("K",))
    sheet = spark.createDataFrame([(i, "7", f"v{i}") for i in range(1, 30)], "row_idx long, k string, v string")
    check = validate(sheet, [one], fill({"One": {"k": "K", "v": "V"}})).checks["one"]
    assert (check.accepted.rows, check.judged.count(), check.conflicts.rows) == (0, 29, 1)
    assert sorted(r["row_index"] for r in check.pk_errors.collect()) == list(range(2, 30))
    assert check.counts.first()["rejected_rows"] == 29
