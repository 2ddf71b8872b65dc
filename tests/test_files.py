from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import grid as G
from millrace.plans import ledger as L
from millrace.plans.intake import source_profiles, upload
from millrace.session import scratch_path
from millrace.sources import grids as S
from millrace.sources import store
from millrace.target import Column, Table


def grid_of(spark, rows, sheet="My Sheet"):
    return spark.createDataFrame([("f", sheet, i, r) for i, r in enumerate(rows)], "source string, sheet string, row_idx long, cells array<string>")


def test_two_blocks_with_headers(spark):
    rows = [["Report", None, None], [None] * 3, ["Name", "Age", None], ["Ann", "31", None], ["Bob", "25", None], [None] * 3, [None] * 3,
            ["1", "2", "3"], ["4", "5", "6"], [None] * 3, ["tail", None, None]]
    got = G.structure(grid_of(spark, rows))
    tables = {r["table_name"]: r for r in got.tables.collect()}
    assert {k: (t["block_start"], t["header_row"], t["row_count"]) for k, t in tables.items()} == {"my_sheet_1": (2, 0, 2), "my_sheet_2": (7, -1, 2)}
    cols = {(r["table_name"], r["col_pos"]): (r["header"], r["name"]) for r in got.columns.collect()}
    assert cols == {("my_sheet_1", 0): ("Name", "name"), ("my_sheet_1", 1): ("Age", "age"),
                    ("my_sheet_2", 0): ("Column_1", "column_1"), ("my_sheet_2", 1): ("Column_2", "column_2"), ("my_sheet_2", 2): ("Column_3", "column_3")}
    table = G.wide(got.rows, got.columns, ("f", "My Sheet"), "my_sheet_1").orderBy("row_idx").collect()
    assert [(r["name"], r["age"]) for r in table] == [("Ann", "31"), ("Bob", "25")]
    assert [r["row_in_block"] for r in G.ignored_rows(got.tables).collect()] == [0]


def test_whole_sheet_fallback_and_repeated_names(spark):
    rows = [["A b", "A B", "Unnamed: 2"], [None] * 3, ["x", "y", "z"]]
    got = G.structure(grid_of(spark, rows))
    assert [r["table_name"] for r in got.tables.collect()] == ["my_sheet"]
    names = [r["name"] for r in got.columns.orderBy("col_pos").collect()]
    assert names == ["a_b", "a_b_2", "column_3"]
    assert [r["values"] for r in got.rows.collect()] == [["x", "y", "z"]]


def test_csv_lines(spark, tmp_path):
    (tmp_path / "in.csv").write_text('a,b,c\n1,2\n\n  \n1,2,3,4\n"x, ""y""",,NA\n1,2,\n1,2,3,\n')
    got = S.csv_grid(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [r["cells"] for r in got] == [["a", "b", "c"], ["1", "2", None], ['x, "y"', None, None], ["1", "2", None]]
    assert [r["row_idx"] for r in got] == [0, 1, 2, 3] and got[0]["sheet"] == "CSV Data"


def cells_of(spark, folder):
    return [r["cells"] for r in S.csv_grid(spark, str(folder)).orderBy("row_idx").collect()]


def test_quotes_inside_bare_fields(spark, tmp_path):
    (tmp_path / "in.csv").write_text('size 5",wide 6"\nx,y\nz,w\n"p"q,r"s"\n')
    assert cells_of(spark, tmp_path) == [['size 5"', 'wide 6"'], ["x", "y"], ["z", "w"], ["pq", 'r"s"']]


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "in.csv").write_text('a,b\n"one\n\n, ""two""",3\nx"y,"4\n5"\n6,7\n')
    assert cells_of(spark, tmp_path) == [["a", "b"], ['one\n\n, "two"', "3"], ['x"y', "4\n5"], ["6", "7"]]


def test_line_breaks_over_file_blocks(spark, tmp_path):
    (tmp_path / "in.csv").write_text("k,v\n" + "".join(f'{i},"a\nb{i}"\n' if i % 3 else f"{i},c\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = cells_of(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[1:] == [[str(i), f"a\nb{i}" if i % 3 else "c"] for i in range(3000)]


def test_unclosed_quotes_are_refused(spark, tmp_path):
    (tmp_path / "in.csv").write_text('a,b\n1,"x\n2,3\n')
    with pytest.raises(ValueError, match="line 2 .*never closed"):
        S.csv_grid(spark, str(tmp_path))


def test_extensions_in_any_case_and_workbooks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1\n")
    (tmp_path / "B.CSV").write_text("2\n")
    (tmp_path / "c.JSON").write_text('[{"v": 12345678.9, "w": true}]')
    (tmp_path / "d.tsv").write_text("3\n")
    (tmp_path / "noending").write_text("4\n")
    got = sorted((r["sheet"], r["row_idx"], r["cells"]) for r in S.read_grids(spark, str(tmp_path)).collect())
    assert got == [("CSV Data", 0, ["1"]), ("CSV Data", 0, ["2"]), ("Data", 0, ["3"]), ("Data", 0, ["4"]), ("JSON Data", 0, ["v", "w"]), ("JSON Data", 1, ["12345678.9", "true"])]
    (tmp_path / "e.XLSX").write_bytes(b"PK")
    with pytest.raises(ValueError, match="cell tables"):
        S.read_grids(spark, str(tmp_path))


def test_cache_ids_stay_text(spark):
    path = scratch_path(spark, "cache")
    store.write_cache(spark.createDataFrame([(1, "007", "t"), (2, "7", "t")], "v int, import_id string, table_name string"), path)
    assert [tuple(r) for r in store.read_cache(spark, path, "007", "t").collect()] == [(1, "007", "t")]


def test_positions_over_many_blocks(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text("".join(f"{k}-{i}\n" for i in range(4000 + 700 * k)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        from millrace.sources.positions import read_lines

        got = read_lines(spark, str(tmp_path))
        wrong = got.where(F.split("line", "-")[1].cast("long") != F.col("row_no")).count()
        assert wrong == 0 and got.count() == 3 * 4000 + 700 * 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_array_and_inspection(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}]))
    (tmp_path / "in.csv").write_text("h1,h2\n1,2\n")
    grid = S.read_grids(spark, str(tmp_path))
    cells = {(r["sheet"], r["row_idx"]): r["cells"] for r in grid.collect()}
    assert cells[("JSON Data", 0)] == ["a", "b"] and cells[("JSON Data", 2)] == ["2", None] and cells[("CSV Data", 1)] == ["1", "2"]
    files = {r["file_name"]: r for r in S.inspect_files(spark, str(tmp_path), S.inspect(grid)).collect()}
    assert files["in.csv"]["file_size_bytes"] == 10 and files["in.json"]["total_sheets"] == 1
    assert files["in.json"]["sheets"][0]["rows"] == 2 and files["in.csv"]["sheets"][0]["columns"] == 2


def test_upload_profiles_and_ledger(spark):
    cache, book = scratch_path(spark, "cache"), scratch_path(spark, "ledger")
    rows = [["Cust Name", "Mail"], ["Ann", "a@b.org"], ["Bob", "b@b.org"]]
    found = upload(spark, grid_of(spark, rows), "i1", "in.csv", cache, book)
    upload(spark, grid_of(spark, rows), "i2", "two.csv", cache, book)
    assert store.read_cache(spark, cache, "i1", "my_sheet").count() == 2
    assert store.read_cache(spark, cache, "i1", "nope").count() == 0
    kinds = {r["header"]: (r["source_key"], r["inferred_type"]) for r in source_profiles(found).collect()}
    assert kinds == {"Cust Name": ("cust_name", "string"), "Mail": ("mail", "email-like")}
    ledger = spark.read.parquet(book)
    assert [r["file_name"] for r in L.history(ledger).collect()] == ["two.csv", "in.csv"]
    assert L.find_import(ledger, "i1").first()["status"] == "PENDING"
    store.close_import(spark, book, "i1", None, "first attempt")
    store.close_import(spark, book, "i1", spark.createDataFrame([(9, 8, 1, 0)], "total_records long, successful_records long, failed_records long, duplicate_records long"))
    store.close_import(spark, book, "i2", None, "no rows")
    ledger = spark.read.parquet(book)
    assert [(r["import_id"], r["status"], r["error_message"], r["seq"]) for r in L.history(ledger).collect()] == [("i2", "FAILED", "no rows", 1), ("i1", "COMPLETED", None, 2)]
    assert L.find_import(ledger, "i1").first()["total_records"] == 9 and ledger.count() == 5 and L.find_import(ledger, "i3").isEmpty()


def test_a_stray_cell_far_away(spark):
    """A gap of a thousand million rows is two rows of the grid; positions tell the rest."""
    far = 10**9
    cells = [("f", "S", r, c, f"{r} {c}") for r in (3, 4) for c in (0, 1)] + [("f", "S", far, 0, "stray"), ("f", "T", far, 1, "alone")]
    grid = S.cell_grid(spark.createDataFrame(cells, "source string, sheet string, row_idx long, col_pos int, value string"))
    assert sorted((r["sheet"], r["row_idx"]) for r in grid.collect()) == [*[("S", k) for k in (0, 2, 3, 4, 5, far - 1, far)], *[("T", k) for k in (0, far - 1, far)]]
    found = G.blocks(G.segment(grid))
    assert sorted((r["sheet"], r["block_start"], r["n_rows"]) for r in found.collect()) == [("S", 3, 2), ("T", 0, far + 1)]
    assert {r["sheet"]: (r["rows"], r["is_empty"]) for r in S.inspect(grid).collect()} == {"S": (far, False), "T": (far, False)}


def test_stored_table_grows_without_reading_its_rows(spark, tmp_path):
    import shutil

    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame([(i, *x) for i, x in enumerate(r)], "row_idx long, n string, s string")
    store.grow_table(spark, path, rows(("1", "a"), ("x", "b")), {"n": "integer"})
    shutil.rmtree(f"{path}/rows/__load=1")
    got = store.grow_table(spark, path, rows(("7", "c")).withColumnRenamed("s", "more"), {"n": "string"})
    assert got.columns == ["id", "n", "s", "more"] and [tuple(r) for r in got.collect()] == [(3, 7, None, "c")]
    # A load that broke off before its line in the log doesn't count, and the next one takes its place.
    got.limit(0).select("n").write.parquet(f"{path}/rows/__load=3")
    spark.createDataFrame([(99,)], "n long").write.mode("append").parquet(f"{path}/rows/__load=3")
    assert store.read_table(spark, path).count() == 1
    assert [r["id"] for r in store.grow_table(spark, path, rows(("8", "d")), {}).orderBy("id").collect()] == [3, 4]
    with pytest.raises(ValueError, match="primary key"):
        store.grow_table(spark, path, rows(("1", "a")).withColumnRenamed("n", "ID"), {})
    with pytest.raises(ValueError, match="no table"):
        store.read_table(spark, str(tmp_path / "none"))
    keyed = store.grow_table(spark, str(tmp_path / "k"), rows(("1", "a")).withColumnRenamed("n", "ID"), {"ID": "integer"}, ("ID",))
    assert keyed.columns == ["ID", "s"] and keyed.first()["ID"] == 1


def test_an_unclosed_quote_is_named_before_lines_are_gathered(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n"two\nlines",1\n3,"open\n' + "filler\n" * 50)
    (tmp_path / "b.csv").write_text('x\n"closed"\n')
    with pytest.raises(ValueError, match=r"begins in line 4 of .*a\.csv is never closed"):
        S.csv_grid(spark, str(tmp_path))


def test_cell_table_brings_blank_rows_back(spark):
    cells = spark.createDataFrame([("f", "S", 1, 0, "a"), ("f", "S", 1, 2, "c"), ("f", "S", 4, 1, "b")], "source string, sheet string, row_idx long, col_pos int, value string")
    got = {r["row_idx"]: r["cells"] for r in S.cell_grid(cells).collect()}
    blank = [None] * 3
    assert got == {0: blank, 1: ["a", None, "c"], 2: blank, 3: blank, 4: [None, "b", None]}


def test_an_import_leaves_its_script_and_nothing_staged(spark, tmp_path, monkeypatch):
    from millrace import session
    from millrace.plans.intake import run_import

    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path / "shared"))
    book, out = str(tmp_path / "book"), str(tmp_path / "script")
    store.append_import(spark, book, "i1", "boats.csv")
    boat = Table("Boat", (Column("Hull", "int", False), Column("Name")), ("Hull",))
    rows = spark.createDataFrame([(1, "7", "Gull"), (2, "8", "Tern"), (3, None, "Lost")], "row_idx long, hull string, name string")
    plans = spark.createDataFrame([("Boat", "Hull", "hull", "IMPORT", 0), ("Boat", "Name", "name", "IMPORT", 1)], "table string, column string, source string, action string, target_pos int")
    heads = spark.createDataFrame([("hull",), ("name",)], "source string")
    stats = run_import(rows, [boat], plans, heads, book, "i1", out)
    assert (stats["total_valid_rows"], stats["total_rejected_rows"]) == (2, 1)
    text = "\n".join(r["value"] for r in spark.read.text(out).collect())
    assert "INSERT INTO [dbo].[Boat]" in text and "'Gull'" in text
    assert L.find_import(spark.read.parquet(book), "i1").first()["status"] == "COMPLETED"
    with pytest.raises(ValueError, match="at least one"):
        run_import(rows, [boat], plans, heads, book, "i1", out, selected=[" "])
    assert L.find_import(spark.read.parquet(book), "i1").first()["status"] == "FAILED"
    assert not [p for p in (tmp_path / "shared").iterdir()]
