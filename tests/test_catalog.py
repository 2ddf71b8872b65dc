from __future__ import annotations

import random

from millrace.operators import catalog as C
from millrace.target import Column, ForeignKey, Table, from_catalog, load_order

BY = ["import_id"]


def test_load_order_agrees_with_the_plain_one(spark):
    rng = random.Random(11)
    tables, fks, want = [], [], {}
    for import_id in range(8):
        names = [f"T{i}" for i in rng.sample(range(30), rng.randint(3, 12))]
        plain = []
        for pos, n in enumerate(names):
            ups = [rng.choice(names) for _ in range(rng.choice([0, 1, 1, 2]))]
            tables.append((import_id, n, pos))
            fks += [(import_id, n, u) for u in ups]
            plain.append(Table(n, (), (), tuple(ForeignKey("x", u, "x") for u in ups)))
        want[import_id] = [t.name for t in load_order(plain)]
    got = C.load_order(
        spark.createDataFrame(tables, "import_id int, table string, table_pos int"),
        spark.createDataFrame(fks, "import_id int, child_table string, parent_table string"), BY,
    ).orderBy("import_id", "position").collect()
    for import_id, names in want.items():
        assert [r["table"] for r in got if r["import_id"] == import_id] == names


def test_metadata_of_two_linked_tables(spark):
    flags = "nullable boolean, is_identity boolean, has_default boolean"
    declared = [("m", "Harbour", 1, "UN_Code", "CHAR(5)", False, False, False), ("m", "Harbour", 2, "Title", "TEXT", True, False, True),
                ("m", "Pilotage", 1, "Slot", "BIGINT", False, True, False), ("m", "Pilotage", 2, "At_Port", "CHAR(5)", True, False, False)]
    cols = spark.createDataFrame(declared, f"import_id string, table string, col_pos int, name string, sql_type string, {flags}")
    keys = spark.createDataFrame([("m", "HARBOUR", 1, "un_code"), ("m", "pilotage", 1, "Slot")], "import_id string, table string, pk_pos int, column string")
    link = ("m", "Pilotage", "At_Port", "Harbour", "UN_Code", 1)
    fks = spark.createDataFrame([link], "import_id string, child_table string, child_column string, parent_table string, parent_column string, fk_pos int")
    related = C.related_tables(cols.groupBy("import_id", "table").count(), fks, BY).select("table", "related_tables").collect()
    assert sorted(map(tuple, related)) == [("Harbour", ["Pilotage"]), ("Pilotage", ["Harbour"])]
    lists = C.primary_key_lists(cols, keys, BY).collect()
    assert sorted((r["table"].lower(), r["primary_key"]) for r in lists) == [("harbour", "UN_Code"), ("pilotage", "Slot")]
    roles = C.column_roles(C.mark_primary_keys(cols, keys, BY), fks, BY).where("name IN ('At_Port', 'UN_Code')").orderBy("name").collect()
    assert [r["role"] for r in roles] == ["FK (References Harbour.UN_Code)", "PK"]
    pilotage, harbour = from_catalog(cols, keys, fks, ["pilotage", "Harbour"])
    assert pilotage == Table("Pilotage", (Column("Slot", "BIGINT", False, True, False), Column("At_Port", "CHAR(5)", True)), ("Slot",), (ForeignKey(*link[2:5]),))
    assert harbour.columns[1] == Column("Title", "TEXT", default=True)
