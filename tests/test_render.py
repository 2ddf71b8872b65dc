from __future__ import annotations

import pytest

from millrace.operators import render as R
from millrace.operators.validate import validate
from millrace.plans.intake import choose_tables, generate
from millrace.target import Action, Column, ForeignKey, Table, fill


def staged(spark, rows, *cols):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "row_idx long, " + ", ".join(f"{c} string" for c in cols))


def text_of(generated):
    return "\n".join(r["text"] for r in R.ordered(generated.script).collect())


CUSTOMER = Table("Customer", (Column("Customer_ID", "integer", True, True), Column("Customer_Name", "varchar(9)", False), Column("Address")), ("Customer_ID",))


@pytest.mark.parametrize("n, batches", [(1, 1), (10, 1), (999, 1), (1000, 1), (1001, 2), (4280, 5)])
def test_batches(spark, n, batches):
    rows = spark.range(1, n + 1).selectExpr("id AS row_idx", "concat('C', id) AS name", "concat('A', id) AS addr")
    f = fill({"Customer": {"name": "Customer_Name", "addr": "Address"}})
    valid = validate(rows, [CUSTOMER], f).checks["customer"].valid
    got = R.statements(valid, CUSTOMER, f).orderBy("batch").collect()
    assert len(got) == batches and sum(r["n_rows"] for r in got) == n
    assert all(r["text"].count("INSERT INTO [dbo].[Customer]") == 1 for r in got)
    assert got[-1]["text"].endswith(f"    'C{n}',\n    'A{n}'\n);")


def test_statement_text(spark):
    """Unmapped columns of a table are spelled out as NULL, in declared order."""
    plant = Table("Plant", (Column("Genus", "varchar(40)", False), Column("Height"), Column("Zone", "int"), Column("Seen", "date")))
    rows = staged(spark, [("Salix", "7"), ("Acer", None)], "g", "z")
    got = text_of(generate(rows, [plant], {"Plant": {"g": "Genus", "z": "Zone"}}))
    head = "INSERT INTO [dbo].[Plant]\n(\n    [Genus],\n    [Height],\n    [Zone],\n    [Seen]\n)\nVALUES\n"
    assert head + "(\n    'Salix',\n    NULL,\n    7,\n    NULL\n),\n(\n    'Acer',\n    NULL,\n    NULL,\n    NULL\n);" in got
    assert "-- Columns in INSERT Statement: 4" in got and got.endswith("COMMIT;\n")


LOAN = Table("Loan", (
    Column("Loan_No", "int", False, True), Column("Member", "int"), Column("Taken_On", "datetime", False), Column("Desk", "int", False), Column("Fee", "decimal(8,3)"),
    Column("State", "varchar(20)", False), Column("Stamped", "datetime", False, False, True)), ("Loan_No",))


@pytest.mark.parametrize("spelling", ["list", "pairs", "dotted", "nested"])
def test_actions_decide_their_columns(spark, spelling):
    plan = {"Member": ("NULL", {}), "Taken_On": ("EXCEL", {"raw_data_key": "day"}), "Desk": ("CUSTOM_VALUE", {"custom_value": 12}),
            "Fee": ("CUSTOM_VALUE", {"custom_value": "0.250"}), "State": ("CUSTOM_VALUE", {"custom_value": "it's out"})}
    full = {c: {"action": kind, **more} for c, (kind, more) in plan.items()}
    actions = {"list": [{"table": "Loan", "sql_column": c, **a} for c, a in full.items()], "pairs": {("Loan", c): a for c, a in full.items()},
               "dotted": {f"Loan.{c}": a for c, a in full.items()}, "nested": {"Loan": full}}[spelling]
    rows = staged(spark, [("2026-03-01 00:00:00", "5", "x"), ("2026-03-01 09:05:00", "6", "y")], "day", "member", "desk")
    got = generate(rows, [LOAN], {"Loan": {"member": "Member", "desk": "Desk"}}, actions)
    body = text_of(got)
    body = body[body.index("VALUES"):]
    tail = "    12,\n    0.250,\n    'it''s out',\n    DEFAULT\n)"
    assert f"(\n    NULL,\n    '2026-03-01',\n{tail},\n(\n    NULL,\n    '2026-03-01 09:05:00',\n{tail};" in body
    assert got.validation.stats.first()["total_valid_rows"] == 2
    assert "Loan_No -> DATABASE_GENERATED" in text_of(got) and "[Loan_No]" not in text_of(got)


@pytest.mark.parametrize(("dialect", "number", "switched"), [("tsql", True, True), ("tsql", False, False), ("postgres", True, False)])
def test_the_identity_switch_needs_values_and_its_dialect(spark, dialect, number, switched):
    depot = Table("Depot", (Column("Gate", "NVARCHAR(8)"), Column("Seq", "BIGINT", False, True)), ("Seq",))
    mapped = {"g": "Gate"} | ({"s": "Seq"} if number else {})
    got = text_of(generate(staged(spark, [("A", "70"), ("B", "71")], "g", "s"), [depot], {"Depot": mapped}, dialect=dialect))
    for state in ("ON", "OFF"):
        assert (f"SET IDENTITY_INSERT [dbo].[Depot] {state};" in got) == switched
    assert ("IDENTITY_INSERT" in got) == switched


def test_a_script_with_parents_quotes_and_a_report(spark):
    """Declared child first, one table without rows, one orphan, a quote in a text, a left-over header."""
    lot = Table("Lot", (Column("Lot_Code", "CHAR(3)", False), Column("Keeper")), ("Lot_Code",))
    crate = Table("Crate", (Column("Tag", "INT", False), Column("Lot_Code", "CHAR(3)", False)), ("Tag",), (ForeignKey("Lot_Code", "Lot", "Lot_Code"),))
    spare = Table("Spare", (Column("Part", "INT", False),), ("Part",))
    rows = staged(spark, [("501", "L1", "L1", "O'Hara"), ("502", "L9", None, None)], "tag", "of", "lot", "keeper")
    maps = {"Crate": {"tag": "Tag", "of": "Lot_Code"}, "Lot": {"lot": "Lot_Code", "keeper": "Keeper"}}
    got = text_of(generate(rows, [crate, spare, lot], maps, dialect="mysql", include_report=True, unmapped=["weight"]))
    order = [got.index(x) for x in ("START TRANSACTION;", "INSERT INTO `Lot`", "'O''Hara'", "INSERT INTO `Crate`")]
    assert order == sorted(order) and "`Spare`" not in got
    for line in ("-- [Table: Crate] Rejected Rows: 1", "FOREIGN KEY ERROR: Row 2 - Foreign key violation: Column 'Lot_Code' value 'L9'", "-- Excel Column: weight",
                 "--   keeper -> Keeper [MATCHED]"):
        assert line in got


def test_order_is_sampled_by_place_alone(spark):
    """Sort borders come from sampled keys that meet at the driver: no statement text may be among them."""
    from pyspark.sql import functions as F

    place = ("section", "table_pos", "part", "item")
    rows = spark.range(600).select(*[(F.xxhash64("id", F.lit(c)) % 4 + 4).alias(c) for c in place], F.col("id").cast("string").alias("text"))
    plan = R.ordered(rows)._jdf.queryExecution().executedPlan().toString()
    borders = [line for line in plan.split("\n") if "rangepartitioning" in line]
    assert borders and not any("text#" in line for line in borders)
    got = [tuple(r) for r in R.ordered(rows.repartition(7)).collect()]
    assert got == sorted(got) and len(got) == 600


def test_selection_errors():
    with pytest.raises(ValueError, match="at least one"):
        choose_tables([CUSTOMER], [" "])
    with pytest.raises(ValueError, match="'Nope' was not found"):
        choose_tables([CUSTOMER], ["Nope"])
    assert choose_tables([CUSTOMER], ["customer "]) == [CUSTOMER]


def test_reports_read_failing_rows_once_written(spark):
    rows = staged(spark, [("1", "a"), ("1", "a"), ("2", " "), ("2", " "), ("3", "b"), ("3", "c")], "k", "n")
    club = Table("Club", (Column("No", "int", False), Column("Town", "varchar(9)", False)), ("No",))
    result = validate(rows, [club], fill({"Club": {"k": "No", "n": "Town"}}))
    report = R.rejection_report(result)
    assert "Join" not in report._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["kind"], r["row_index"]) for r in report.collect()) == [("NOT NULL ERROR", 3), ("NOT NULL ERROR", 4), ("PRIMARY KEY CONFLICT", 6)]
