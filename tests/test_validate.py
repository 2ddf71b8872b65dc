from __future__ import annotations

import pytest

from millrace.operators.validate import missing_required, validate
from millrace.target import Action, Column, ForeignKey, Table, fill, load_order

SCHEMA = "row_idx long, a string, b string, c string, d string"


def run(spark, rows, tables, maps, **options):
    return validate(spark.createDataFrame([(i, *r, *[None] * (4 - len(r))) for i, r in enumerate(rows, 1)], SCHEMA), tables, fill(maps), **options)


def outcome(check):
    """Accepted rows, and the rejected with their kind."""
    return [r["row_idx"] for r in check.valid.orderBy("row_idx").collect()], {r["row_index"]: r["error_type"] for r in check.rejected.collect()}


CONFLICT, INVALID = "PRIMARY_KEY_CONFLICT", "VALIDATION_ERROR"


def test_keys_with_one_and_with_several_values(spark):
    shop = Table("Shop", (Column("No", "int"), Column("Town")), ("No",))
    rows = [("1", "Ulm"), ("1", "Ulm"), (" 2", "Bonn"), ("2 ", "Bonn"), ("3", "Kiel"), ("3", "Jena"), (None, "Ulm"), (" ", "Ulm")]
    check = run(spark, rows, [shop], {"Shop": {"a": "No", "b": "Town"}}).checks["shop"]
    # Keys are compared trimmed, tuples as they are: ' 2' and '2 ' are two spellings of one key.
    assert outcome(check) == ([1, 7, 8], {3: CONFLICT, 4: CONFLICT, 5: CONFLICT, 6: CONFLICT})
    counts = check.counts.first()
    assert (counts["source_rows"], counts["valid_rows"], counts["rejected_rows"], counts["duplicate_rows"], counts["pk_conflict_keys"]) == (8, 3, 4, 1, 2)
    assert [(r["row_index"], r["conflicting_with_row"]) for r in check.pk_errors.orderBy("row_index").collect()] == [(4, 3), (6, 5)]


def test_required_cells(spark):
    item = Table("Item", (Column("Code", "varchar(5)", False), Column("Note"), Column("Made", "date", False, False, True)), ())
    check = run(spark, [("a", None, None), (" ", "x", "d"), (None, "x", "d"), ("b", " ", "d"), ("a", None, None)], [item], {"Item": {"a": "Code", "b": "Note", "c": "Made"}}).checks["item"]
    assert outcome(check) == ([1, 4], {2: INVALID, 3: INVALID})
    assert sorted((r["row_index"], r["column"]) for r in check.null_errors.collect()) == [(2, "Code"), (3, "Code")]


PARENTS = Table("Nest", (Column("K", "int"), Column("V")), ("K",))


@pytest.mark.parametrize("spelled", ["Nest", "[dbo].[Nest]", '"app"."nest"', "`NEST`"])
def test_references_to_accepted_parents(spark, spelled):
    child = Table("Egg", (Column("Id"), Column("Nest_No", "int")), (), (ForeignKey("Nest_No", spelled, "K"),))
    rows = [("1", "x", "e1", "1"), ("2", "x", "e2", " 1 "), ("2", "y", "e3", "2"), ("3", "z", "e4", "9"), ("3", "z", "e5", None)]
    got = run(spark, rows, [child, PARENTS], {"Nest": {"a": "K", "b": "V"}, "Egg": {"c": "Id", "d": "Nest_No"}})
    # Nest 2 stands in conflict, so it isn't accepted and can't be referred to.
    assert [t.name for t in got.order] == ["Nest", "Egg"]
    assert outcome(got.checks["nest"]) == ([1, 4], {2: CONFLICT, 3: CONFLICT})
    assert outcome(got.checks["egg"]) == ([1, 2, 5], {3: INVALID, 4: INVALID})
    assert [r["value"] for r in got.checks["egg"].fk_errors.orderBy("row_index").collect()] == ["2", "9"]


def test_open_and_closed_world(spark):
    child = Table("Egg", (Column("Id"), Column("Nest_No", "int")), (), (ForeignKey("Nest_No", "Nest", "K"),))
    maps = {"Egg": {"c": "Id", "d": "Nest_No"}}
    rows = [("1", "x", "e1", "1"), ("2", "x", "e2", None)]
    assert outcome(run(spark, rows, [child, PARENTS], maps).checks["egg"]) == ([1, 2], {})
    assert outcome(run(spark, rows, [child, PARENTS], maps, open_world=False).checks["egg"]) == ([2], {1: INVALID})


def test_not_a_number_is_a_missing_value(spark):
    t = Table("Log", (Column("Level", "float", False), Column("Tag")), ())
    rows = spark.createDataFrame([(1, 1.5, "a"), (2, float("nan"), "b"), (3, None, "c")], "row_idx long, level double, tag string")
    assert outcome(validate(rows, [t], fill({"Log": {"level": "Level", "tag": "Tag"}})).checks["log"]) == ([1], {2: INVALID, 3: INVALID})


def test_self_references_in_row_order(spark):
    t = Table("Part", (Column("Id", "int", False), Column("Up", "int")), ("Id",), (ForeignKey("Up", "Part", "Id"),))
    rows = [("5", "77"), ("1", None), ("2", "1"), ("3", "4"), ("4", "2"), ("6", "3"), ("7", "5"), ("8", "8")]
    check = run(spark, rows, [t], {"Part": {"a": "Id", "b": "Up"}}).checks["part"]
    # Nothing is known in row 1; 3 comes before its 4, 6 stands on the rejected 3, 8 on itself.
    assert outcome(check) == ([1, 2, 3, 5, 7], {4: INVALID, 6: INVALID, 8: INVALID})


def test_required_columns_and_messages(spark):
    t = Table("Inv", (Column("Code", "varchar(5)", False), Column("Cost", "decimal(10,2)", False), Column("Lvl", "int")), ("Code",))
    assert missing_required(t, fill({"Inv": {"a": "Code"}})) == ["Cost"]
    assert missing_required(t, fill({"Inv": {"a": "Code"}}, {"Inv.Cost": {"action": "CUSTOM", "custom_value": "5"}})) == []
    assert missing_required(t, fill({"Inv": {"a": "Code"}}, {"Inv": {"Cost": {"action": "CUSTOM", "custom_value": " "}}})) == ["Cost"]
    rows = spark.createDataFrame([(1, "x", None, None, None)], SCHEMA)
    got = validate(rows, [t], fill({"Inv": {"a": "Code"}}))
    assert got.invalid == {"Inv": "Table [Inv] cannot be generated: Missing required columns (Cost) with no default in Excel data."}
    assert got.rejected.isEmpty() and got.stats.first()["missing_required_count"] == 1


def test_actions_only_table_collapses_to_one_row(spark):
    t = Table("Log", (Column("A", "varchar(5)", False),))
    rows = spark.createDataFrame([(i, "x", None, None, None) for i in range(1, 5)], SCHEMA)
    got = validate(rows, [t], fill({}, [{"table": "log", "sql_column": "a", "action": "DEFAULT"}]))
    assert [r["row_idx"] for r in got.checks["log"].valid.collect()] == [1]


def test_four_spellings_of_actions():
    want = {("t", "c"): Action("NULL")}
    for spelled in ({("T", "C"): {"action": "NULL"}}, {"T.C": {"action": "NULL"}}, {"T": {"C": {"action": "NULL"}}}, [{"table": "T", "column": "C", "action": "NULL"}]):
        assert fill({}, spelled).actions == want


def test_user_action_overrides_match():
    f = fill({"T": {"old": "C", "x": "D"}}, {("T", "C"): {"action": "EXCEL", "raw_data_key": "new"}, ("T", "D"): {"action": "NULL"}})
    assert f.source("t", "c") == "new" and f.source("t", "d") is None


def test_load_order_by_parents_then_schema():
    """(table, parents) as declared, and the order they load in; a loop and what hangs on it keep schema order at the end."""
    cases = [("Leg Voyage Ship", {"Leg": "Voyage", "Voyage": "Ship"}, "Ship Voyage Leg"), ("X Y Z W", {"X": "Y", "Y": "X", "W": "X"}, "Z X Y W"), ("Solo", {"Solo": "Solo"}, "Solo")]
    for names, ups, want in cases:
        tables = [Table(n, (), (), (ForeignKey("up", ups[n], "key"),) if n in ups else ()) for n in names.split()]
        assert " ".join(t.name for t in load_order(tables)) == want


def test_reports_come_from_the_verdicts(spark):
    """Rows of tuples seen once need no join; with repeated tuples the reports are those of the join of all rows."""
    import random
    from dataclasses import replace

    up = Table("Up", (Column("k", "int", False), Column("v", nullable=False)), ("k",))
    down = Table("Down", (Column("d", "int", False), Column("u", "int"), Column("n", nullable=False)), ("d",), (ForeignKey("u", "Up", "k"),))
    maps = {"Up": {"k": "k", "v": "v"}, "Down": {"d": "d", "u": "k", "n": "n"}}
    rng = random.Random(11)
    some = [(i, rng.choice(["1", "2", " 2", "3", None]), rng.choice(["a", "b", " "]), str(rng.randrange(60)), rng.choice(["x", None, ""])) for i in range(1, 201)]
    some += [(200 + i, *row[1:]) for i, row in enumerate(some[:40], 1)]
    once = [(i, str(i // 2), f"v{i}" if i % 5 else None, str(i // 3), str(i) if i % 4 else None) for i in range(1, 61)]
    layout = "row_idx long, k string, v string, d string, n string"
    for rows, joins in ((some, True), (once, False)):
        result = validate(spark.createDataFrame(rows, layout), [up, down], fill(maps))
        for check in result.checks.values():
            plain = replace(check, repeats=None)
            for member in ("rejected", "pk_errors", "fk_errors", "null_errors"):
                got, want = getattr(check, member), getattr(plain, member)
                assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
                assert joins or "Join" not in got._jdf.queryExecution().executedPlan().toString()
        assert all(c.rejected.count() and c.pk_errors.count() for c in result.checks.values())
