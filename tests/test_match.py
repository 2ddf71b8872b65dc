from __future__ import annotations

import random
import re

from millrace.operators import match as M
from millrace.operators.profile import profile, unpivot
from millrace.plans.intake import auto_match, targets_of
from pyspark.sql import functions as F

BY = ["import_id"]
TARGET = "import_id int, table string, name string, sql_type string, nullable boolean, is_identity boolean, has_default boolean, length int"


def targets(spark, rows, pks=(), fks=()):
    """rows: (table, name, type, flags) with flags among nn, id, def, pk."""
    data, keys = [], []
    for pos, (table, name, kind, flags) in enumerate(rows):
        size = re.search(r"\((\d+)\)", kind)
        data.append((1, table, name, kind, "nn" not in flags, "id" in flags, "def" in flags, int(size[1]) if size and "char" in kind.lower() else None))
        if "pk" in flags:
            keys.append((1, table, 1, name))
    cols = spark.createDataFrame(data, TARGET).withColumn("target_pos", F.monotonically_increasing_id())
    order = {(r[0], r[1]): i for i, r in enumerate(rows)}
    pos = spark.createDataFrame([(t, n, i) for (t, n), i in order.items()], "table string, name string, p int")
    cols = cols.drop("target_pos").join(pos, ["table", "name"]).withColumnRenamed("p", "target_pos")
    k = spark.createDataFrame(keys or [(0, "-", 0, "-")], "import_id int, table string, pk_pos int, column string")
    f = spark.createDataFrame([(0, "-", "-", "-", "-", 0)], "import_id int, child_table string, child_column string, parent_table string, parent_column string, fk_pos int")
    return targets_of(cols, k, f, BY)


def sources(spark, table):
    names = list(table)
    height = max(len(v) for v in table.values())
    rows = [(i, *[table[n][i] if i < len(table[n]) else None for n in names]) for i in range(height)]
    schema = "row_idx int, " + ", ".join(f"`{n}` string" for n in names)
    prof = profile(unpivot(spark.createDataFrame(rows, schema), names)).withColumnRenamed("column", "source").withColumn("import_id", F.lit(1))
    pos = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "source string, src_pos int")
    return prof.join(pos, "source")


def plans_of(spark, rows, table):
    got = auto_match(targets(spark, rows), sources(spark, table), BY)
    return got, {r["column"]: r for r in got.plans.collect()}


def test_unspecific_names_attract_nothing(spark):
    """A loose source column stays unused beside unspecific targets, which are filled by their declarations."""
    declared = [("Berth", "Berth_No", "BIGINT", "pk id nn"), ("Berth", "Column7", "VARCHAR(9)", ""), ("Berth", "Quay_Name", "NVARCHAR(60)", "nn"),
                ("Berth", "Remarks", "VARCHAR(300)", ""), ("Berth", "Booked_On", "DATE", "def"), ("Berth", "Depth_M", "DECIMAL(5,1)", "")]
    got, plans = plans_of(spark, declared, {"Depth_M": ["7.5", "11.0"], "Captains_Gossip": ["storm ahead", "none"], "Quay_Name": ["North Mole", "Old Pier"]})
    rows = sorted((c, p["action"], p["source"]) for c, p in plans.items())
    assert rows == [("Berth_No", "DATABASE_GENERATED", None), ("Booked_On", "DEFAULT", None), ("Column7", "NULL", None), ("Depth_M", "IMPORT", "Depth_M"),
                    ("Quay_Name", "IMPORT", "Quay_Name"), ("Remarks", "NULL", None)]
    assert {p["confidence"] for p in plans.values() if p["action"] == "IMPORT"} == {100}
    assert {r["source"]: r["action"] for r in got.view.collect()} == {"Captains_Gossip": "NOT_USED", "Depth_M": "IMPORT", "Quay_Name": "IMPORT"}
    assert [r["source"] for r in got.unused.collect()] == ["Captains_Gossip"]
    assert got.statistics.select("total_excel_columns", "mapped_excel_columns", "sql_columns_imported", "mapping_source").first() == (3, 2, 2, "STANDARD")


def test_nothing_fills_a_required_column(spark):
    _, plans = plans_of(spark, [("Crane", "Jib_Length", "FLOAT", "nn"), ("Crane", "Serial", "VARCHAR(12)", "pk nn"), ("Crane", "Yard", "TEXT", "")], {"Serial": ["K-9", "K-12"]})
    missing = plans.pop("Jib_Length")
    assert (missing["action"], missing["confidence"], missing["method"]) == ("VALIDATION_ERROR", 0, "NONE")
    assert {c: p["action"] for c, p in plans.items()} == {"Serial": "IMPORT", "Yard": "NULL"}


# Written-out scores: (table, declared name, source name, found type) -> score, or None below the keep score.
SCORES = {
    ("Customer", "Zip", "zip", "string"): 1.0,
    ("Customer", "Order_Date", "order date", "string"): 0.98,
    ("Customer", "Name", "customer name", "string"): 0.96,
    ("Customer", "CustomerName", "Name", "string"): 0.96,
    ("Customer", "Customer_Home_Town", "town home", "string"): 0.95,
    ("Customer", "Column1", "column-1", "string"): 0.98,
    ("Customer", "Column1", "colour", "string"): None,
    ("Customer", "id", "cust_id", "string"): None,
    ("Customer", "Email_Address", "contact email", "email-like"): 0.92,
    ("Customer", "Phone_Nbr", "office phone", "phone-like"): 0.92,
    ("Customer", "Created_At", "date created", "date"): 0.87,
    ("Customer", "Created_At", "date created", "string"): 0.72,
    ("Customer", "Is_Active", "active state", "boolean"): 0.87,
    ("Customer", "qwrt", "mmmm", "string"): None,
    ("Customer", "abcd", "abxy", "string"): 0.5,
    ("Customer", "abcdef", "abcxyz", "string"): 0.5,
    ("Customer", "shipment", "equipment", "string"): 0.71,
}


def tables_for(spark, pairs):
    names = sorted({(t, n) for t, n, *_ in pairs})
    heads = sorted({(s, k) for *_, s, k in pairs})
    tgt = spark.createDataFrame([(1, t, n, i) for i, (t, n) in enumerate(names)], "import_id int, table string, name string, target_pos int").withColumns(
        {"data_type": F.lit("string"), "length": F.lit(None).cast("int"), "is_pk": F.lit(False), "is_identity": F.lit(False)})
    src = spark.createDataFrame([(1, s, i, k) for i, (s, k) in enumerate(heads)], "import_id int, source string, src_pos int, inferred_type string").withColumns(
        {"is_integer": F.lit(False), "is_numeric": F.lit(False), "is_boolean": F.lit(False), "min_length": F.lit(1), "sample_values": F.array(F.lit("v"))})
    return tgt, src


def test_written_scores(spark):
    for kind in sorted({k[3] for k in SCORES}):
        own = {k: v for k, v in SCORES.items() if k[3] == kind}
        found = {(r["column"], r["source"]): r["score"] for r in M.candidates(*tables_for(spark, own), BY).collect()}
        assert {k: found.get((k[1], k[2])) for k in own} == own


def made_names(seed, n):
    rng = random.Random(seed)
    words = ["order", "date", "cust", "name", "Total", "isActive", "mail", "zip", "qty", "created", "x1", "col2", "phone", "amt", "is", "at"]
    return list(dict.fromkeys(rng.choice("_ -.").join(rng.sample(words, rng.randint(1, 3))) if rng.random() < 0.6 else
                              "".join(rng.choice("abcdeinorst_") for _ in range(rng.randint(1, 14))) or "q" for _ in range(n)))


def test_keys_bring_together_what_a_whole_scope_does(spark, monkeypatch):
    """No pair is missed by the key route: same rows and scores as comparing whole scopes."""
    kinds = ["string", "email-like", "phone-like", "date", "boolean"]
    pairs = [("Customer", t, s, kinds[i % 5]) for i, (t, s) in enumerate(zip(made_names(1, 60), made_names(2, 60)))]
    tgt, src = tables_for(spark, pairs)

    def run(scope, tile=M.BLOCK_PAIRS):
        monkeypatch.setattr(M, "SCOPE_PAIRS", scope)
        return sorted(tuple(r)[1:8] for r in M.candidates(tgt, src, BY, tile).collect())

    whole = run(10**9)
    assert len(whole) > 100 and run(0) == whole and run(0, 200) == whole
    scores = [r[5] for r in whole]
    assert all(0.30 <= x <= 1.0 for x in scores) and max(x for x in scores if x not in (1.0, 0.98, 0.96)) <= 0.95


def test_decisions_and_conflicts(spark):
    plan = "import_id int, table string, column string, target_pos int, sql_type string, role string, fallback string, source string, action string, confidence int, method string, reason string, has_conflict boolean"
    rows = [
        (1, "T", "a", 0, "int", "Normal", "NULL", None, "PENDING_LLM", 60, "PENDING", "", False),
        (1, "T", "b", 1, "int", "Normal", "VALIDATION_ERROR", None, "PENDING_LLM", 55, "PENDING", "", False),
        (1, "T", "c", 2, "int", "Normal", "DEFAULT", "s1", "IMPORT", 98, "STANDARD", "", False),
    ]
    top = F.array(F.struct(F.lit(1).alias("rank"), F.lit("s1").alias("source"), F.lit(0.57).alias("score"), F.lit("r").alias("reason"),
                           F.lit("string").alias("inferred_type"), F.array(F.lit("v")).alias("sample_values")))
    planned = spark.createDataFrame(rows, plan).withColumn("top", top)
    answers = spark.createDataFrame(
        [(1, "t", "A", "MATCH", "S1", 0.0, "ok", 1), (1, "T", "b", "MATCH", "elsewhere", 0.9, "", 2)],
        "import_id int, table string, column string, status string, source string, confidence double, reason string, decision_pos int",
    )
    settled = M.apply_decisions(planned, answers, BY)
    got = {r["column"]: r for r in settled.collect()}
    assert (got["a"]["action"], got["a"]["source"], got["a"]["confidence"], got["a"]["method"]) == ("IMPORT", "s1", int(0.57 * 100), "LLM")
    assert (got["b"]["action"], got["b"]["confidence"], got["b"]["method"]) == ("VALIDATION_ERROR", 0, "NONE")
    final = {r["column"]: r for r in M.one_to_one(settled, BY).collect()}
    assert (final["c"]["action"], final["a"]["action"], final["a"]["method"], final["a"]["source"]) == ("IMPORT", "NULL", "CONFLICT", None)
    report = M.conflict_report(settled, BY).collect()
    assert [r["message"] for r in report] == ["Excel column 's1' was matched to multiple SQL columns ([T].[a], [T].[c])."]


def test_plans_exchange_their_candidates_once(spark):
    """Ranks, lists and the join with the columns meet in one exchange; a scope may be null."""
    kinds = "scope string, table string, name string, target_pos int, sql_type string, role string, is_identity boolean, has_default boolean, nullable boolean"
    columns = spark.createDataFrame([(s, "T", c, i, "int", "Normal", False, False, True) for s in ("a", None) for i, c in enumerate("xy")], kinds)
    found = spark.createDataFrame([(s, "T", "x", f"h{i}", i, 0.5 + i / 10, "r", "string", [f"h{i}"]) for s in ("a", None) for i in range(5)],
                                  "scope string, table string, column string, source string, src_pos int, score double, reason string, inferred_type string, sample_values array<string>")
    planned = M.plans(columns, found, ["scope"])
    got = {(r["scope"], r["column"]): (r["action"], r["source"], [c["source"] for c in r["top"] or []]) for r in planned.collect()}
    want = {(s, "x"): ("PENDING_LLM", None, ["h4", "h3", "h2"]) for s in ("a", None)} | {(s, "y"): ("NULL", None, []) for s in ("a", None)}
    assert got == want
    plan = planned._jdf.queryExecution().sparkPlan().toString()
    assert "coalesce" not in plan[plan.index("Join"):].split("\n")[0]


def test_letter_bits_never_undercount(spark):
    """The letters granted to a pair reach those its letter sets share, and travel as one number."""
    names = ["", "a", "aaa", "customer_name", "Kunde Nr 11", "straße", "名前", "e-mail 2 22 222", "zzzzyyyxx", "0123456789", "Mississippi", "a%b$a"]
    cols = spark.createDataFrame([("t", n) for n in names], "table string, name string")
    heads = spark.createDataFrame([(n, "string") for n in names], "source string, inferred_type string")
    t, s = M.prepare_targets(cols).drop("placeholder"), M.prepare_sources(heads)
    met = t.crossJoin(s).select(M.most_common_letters().alias("most"), F.size(F.array_intersect("t_letters", "s_letters")).alias("both"), F.least(F.length("t_norm"), F.length("s_norm")).alias("all"))
    rows = met.collect()
    assert len(rows) == len(names) ** 2 and all(r["both"] <= r["most"] <= r["all"] for r in rows)
    assert not any(c.endswith("_letters") for c in M._wanted(t.crossJoin(s).withColumns({"target_pos": F.lit(1), "placeholder": F.lit(False), "src_pos": F.lit(1)}), []).columns)
