"""Rules as rows against the plans per table, catalog by catalog."""

from __future__ import annotations

import random

import pytest

from millrace.operators import bulk
from millrace.operators.validate import missing_required, missing_required_message, validate
from millrace.plans.merge import merge, normalise_actions
from millrace.target import Column, ForeignKey, Table, fill

BY = ["import_id"]
HEADERS = "pqrstu"
#: Tables by catalog: a chain with a composite key, a loop of two with one behind it, and one that nothing fills.
CATALOGS = {
    "chain": [
        Table("Leaf", (Column("id", "int", False), Column("up", nullable=False), Column("Top"), Column("note")), ("ID",), (ForeignKey("Up", "[dbo].[Mid]", "Code"), ForeignKey("top", "Root", "k"))),
        Table("Root", (Column("k", "int", False), Column("seq", "int", False, True), Column("at", "date", False, default=True)), ("k",)),
        Table("Mid", (Column("Code", nullable=False), Column("part", nullable=False), Column("root")), ("part", "code"), (ForeignKey("root", "ROOT", "K"), ForeignKey("code", "Mid", "code"))),
        Table("Unused", (Column("x", nullable=False),)),
    ],
    "loop": [
        Table("A", (Column("a"), Column("b")), ("a",), (ForeignKey("b", "B", "b"),)),
        Table("B", (Column("b"), Column("a", nullable=False)), (), (ForeignKey("a", "A", "a"),)),
        Table("C", (Column("c", nullable=False), Column("b"), Column("must", nullable=False)), (), (ForeignKey("b", "B", "b"),)),
        Table("D", (Column("d", nullable=False),)),
    ],
}
SOURCES = {
    "chain": {"Leaf": {"p": "ID", "q": "up", "r": "TOP", "u": "note"}, "Root": {"r": "k", "t": "seq"}, "Mid": {"q": "code", "s": "part", "r": "root"}},
    "loop": {"A": {"p": "a", "q": "b"}, "B": {"q": "b", "p": "a"}, "C": {"r": "c", "q": "b"}},
}
ACTIONS = {"chain": [("Leaf", "note", "NULL", None, None)], "loop": [("C", "MUST", "custom_value", None, "7"), ("D", "d", "CUSTOM", None, " ")]}


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(3)
    value = lambda: rng.choice([None, "", " ", *"12345678", " 1", "2 "])
    sheets = {c: [tuple(value() for _ in HEADERS) for _ in range(120)] for c in CATALOGS}
    for rows in sheets.values():
        rows += rows[:15]
    cols, keys, fks, found, acts = [], [], [], [], []
    for name, tables in CATALOGS.items():
        for n, t in enumerate(tables):
            cols += [(name, t.name, i, c.name, c.nullable, c.identity, c.default, n) for i, c in enumerate(t.columns)]
            keys += [(name, t.name.upper(), i, k) for i, k in enumerate(t.primary_key)]
            fks += [(name, t.name, f.column, f.parent_table, f.parent_column, i) for i, f in enumerate(t.foreign_keys)]
        found += [(name, t, c, s, i) for t, pairs in SOURCES[name].items() for i, (s, c) in enumerate(pairs.items())]
        acts += [(name, *a, i) for i, a in enumerate(ACTIONS[name])]
    flags = "nullable boolean, is_identity boolean, has_default boolean, table_pos int"
    columns = spark.createDataFrame(cols, f"import_id string, table string, col_pos int, name string, {flags}")
    actions = normalise_actions(spark.createDataFrame(acts, "import_id string, table string, column string, action string, source string, custom_value string, pos int"), BY)
    sources = merge(spark.createDataFrame(found, "import_id string, table string, column string, source string, pos int"), actions, BY)
    rules = bulk.declared(columns, sources, actions, BY)
    places = columns.selectExpr("import_id", "lower(table) AS table_key", "table_pos").distinct()
    rules = rules.join(places, ["import_id", "table_key"])
    rows = [(c, i, dict(zip(HEADERS, r, strict=True))) for c, rs in sheets.items() for i, r in enumerate(rs, 1)]
    got = bulk.validate_tables(
        spark.createDataFrame(rows, "import_id string, row_idx long, cells map<string, string>"), rules,
        spark.createDataFrame(keys, "import_id string, table string, pk_pos int, column string"),
        spark.createDataFrame(fks, "import_id string, child_table string, child_column string, parent_table string, parent_column string, fk_pos int"), BY)
    want = {}
    for name, rs in sheets.items():
        sheet = spark.createDataFrame([(i, *r) for i, r in enumerate(rs, 1)], "row_idx long, " + ", ".join(f"{h} string" for h in HEADERS))
        named = [{"table": t, "column": c, "action": a, "source": s, "custom_value": v} for t, c, a, s, v in ACTIONS[name]]
        want[name] = validate(sheet, CATALOGS[name], fill(SOURCES[name], named), self_fk="off")
    return got, want, rules


def test_counts_and_invalid_tables(both):
    got, want, _ = both
    plain = sorted((n, *r) for n, v in want.items() for r in v.table_counts.collect())
    assert sorted(map(tuple, got.counts.collect())) == plain and len(plain) == 6
    assert sorted(map(tuple, got.invalid.collect())) == sorted((n, *kv) for n, v in want.items() for kv in v.invalid.items())


def test_rejected_and_accepted_rows(both):
    got, want, _ = both
    fields = ("table", "row_index", "error_type", "reason")
    plain = sorted((n, *[r[f] for f in fields]) for n, v in want.items() for r in v.rejected.collect())
    assert sorted(tuple(r[f] for f in ("import_id", *fields)) for r in got.rejected.collect()) == plain and len(plain) > 300
    rows = {(r["import_id"], r["table"], r["row_idx"], *r["values"]) for r in got.accepted.collect()}
    assert rows == {(n, c.table.name, *r) for n, v in want.items() for c in v.checks.values() for r in c.valid.collect()}


def test_required_columns(both):
    f = fill(SOURCES["loop"], [{"table": "D", "column": "d", "action": "CUSTOM", "custom_value": " "}])
    plain = {t.name: missing_required(t, f) for t in CATALOGS["loop"]}
    assert plain == {"A": [], "B": [], "C": ["must"], "D": ["d"]}
    got = {(r["import_id"], r["table"]): (r["missing"], r["reason"]) for r in bulk.missing_required(both[2], BY).collect()}
    assert got == {("loop", "D"): (["d"], missing_required_message("D", ["d"]))}


def test_fill_rules_of_one_table(both):
    got = {(r["table"], r["column"]): (r["rule"], r["source"], r["text"]) for r in bulk.fill_rules(both[2], BY).where("import_id = 'chain'").collect()}
    assert got["Leaf", "note"] == ("NULL", None, "NULL (Explicit NULL)") and got["Leaf", "Top"] == ("EXCEL", "r", "EXCEL [r] (Mapped)")
    assert got["Root", "seq"][0] == "EXCEL" and got["Root", "at"] == ("DEFAULT", None, "DEFAULT (Schema constraint)")
    assert not any(t == "Unused" for t, _ in got)


def test_no_rows_and_no_tables(spark, both):
    _, _, rules = both
    none = spark.createDataFrame([], "import_id string, row_idx long, cells map<string, string>")
    keys = spark.createDataFrame([], "import_id string, table string, pk_pos int, column string")
    fks = spark.createDataFrame([], "import_id string, child_table string, child_column string, parent_table string, parent_column string, fk_pos int")
    empty = bulk.validate_tables(none, rules, keys, fks, BY)
    assert empty.rejected.isEmpty() and {r["source_rows"] for r in empty.counts.collect()} == {0} and empty.invalid.count() == 7
    assert bulk.validate_tables(none, rules.limit(0), keys, fks, BY).counts.collect() == []


def test_tuples_stay_narrow(both):
    """Names and reference texts are met by rejected tuples alone; a tuple seen once is reported without its slice."""
    got = both[0]
    assert set(got.tuples.columns) == {"cat", "shape", "row_idx", "copies", "values", "mark", "n_empty"}
    assert set(got.lost.columns) == {"cat", "shape", "row_idx", "copies", "n_empty", "n", "value"}
    assert got.specs.select("cat", "shape").distinct().count() == got.specs.count() == 6


def test_written_out_places_equal_array_functions(spark, monkeypatch):
    rows = [(1, 1, [" a", "\u00a0", None], [1, 2], [1, 2, 3]), (1, 2, ["b ", "c", ""], [2, 1], [3]), (1, 3, ["x", None, " "], [], None), (1, 3, ["x", "\ty\u2003", "z"], [2], [2])]
    df = spark.createDataFrame(rows, "cat long, shape long, values array<string>, required array<int>, pk array<int>")
    asked = lambda: df.select(bulk._mark(3).isNull(), bulk._n_empty(2)).collect()
    plain = asked()
    monkeypatch.setattr(bulk, "UNROLLED", 0)
    assert plain == asked() and [tuple(r) for r in plain] == [(True, 1), (True, 0), (True, 0), (False, 0)]


def test_slices_with_a_key_of_their_own_are_tuples_as_they_stand(spark, monkeypatch):
    rows = [(1, 1, 1, ["a", "x"], 10, 0), (1, 1, 2, ["b", "x"], 20, 0), (1, 1, 3, ["b", "y"], 20, 0), (1, 1, 4, ["c", ""], 30, 1), (1, 1, 5, ["", "z"], None, 0)]
    df = spark.createDataFrame(rows, "cat long, shape long, row_idx long, values array<string>, mark long, n_empty int")
    once, others = bulk._apart(df)
    assert [tuple(r) for r in once.select("row_idx", "copies").collect()] == [(1, 1)] and sorted(r["row_idx"] for r in others.collect()) == [2, 3, 4, 5]
    monkeypatch.setattr(bulk, "BROADCAST_MARKS", 0)
    wide = bulk._apart(df)
    assert wide[0].isEmpty() and wide[0].schema.names == once.schema.names and wide[1].count() == 5


def test_only_slices_that_meet_or_lack_something_are_grouped(both):
    got = both[0]
    assert got.once.where("mark IS NULL OR n_empty > 0 OR copies > 1").isEmpty() and not got.once.isEmpty()
    assert got.several.join(got.once, "mark", "left_semi").isEmpty() and got.slices.count() + got.once.count() == got.tuples.agg({"copies": "sum"}).first()[0]
