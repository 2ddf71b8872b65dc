"""The three steps of an import: upload, match, generate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import catalog as C
from millrace.operators import grid as G
from millrace.operators import match as M
from millrace.operators.lookup import lookup
from millrace.operators.profile import profile
from millrace.operators.render import BATCH_ROWS, script
from millrace.operators.validate import Validation, validate
from millrace.plans.ledger import counters
from millrace.plans.merge import duplicate_targets, matches_of, merge, normalise_actions, unmapped_sources
from millrace.session import stage, staging
from millrace.sources.store import append_import, close_import, write_cache, write_script
from millrace.target import Fill, Table, fill


def upload(spark: SparkSession, grid: DataFrame, import_id: str, file_name: str, cache: str, ledger: str) -> G.Structured:
    """Find, clean and cache every table of the grids, and note the import."""
    found = G.structure(grid)
    write_cache(found.rows.withColumn("import_id", F.lit(import_id)), cache)
    append_import(spark, ledger, import_id, file_name)
    return found


def column_values(found: G.Structured) -> DataFrame:
    """Cleaned rows as ``source, sheet, table_name, column, row_idx, value`` for profiling."""
    keys = [*G.SHEET, "table_name"]
    order = found.columns.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_pos", "name"))), lambda c: c["name"]).alias("names")
    )
    order = order.join(found.tables.select(*keys, "row_count"), keys)
    named = lookup(found.rows, order, [(F.col(k), k) for k in keys], ["names"], "row_count", F.col("row_idx"))
    cells = named.where("names IS NOT NULL").select(*keys, "row_idx", F.explode(F.arrays_zip("names", "values")).alias("c"))
    return cells.select(*keys, "row_idx", F.col("c.names").alias("column"), F.col("c.values").alias("value"))


def source_profiles(found: G.Structured) -> DataFrame:
    """Headers with their profiles; each cleaned table is a scope of its own."""
    keys = [*G.SHEET, "table_name"]
    heads = found.columns.select(*keys, F.col("name").alias("column"), F.col("header").alias("source_header"), F.col("col_pos").alias("src_pos"))
    profiled = profile(column_values(found), keys).join(heads, [*keys, "column"])
    return profiled.withColumn("source_key", F.col("column")).drop("column").withColumnRenamed("source_header", "header")


@dataclass(frozen=True)
class Matching:
    candidates: DataFrame
    queue: DataFrame
    plans: DataFrame
    conflicts: DataFrame
    unused: DataFrame
    view: DataFrame
    statistics: DataFrame


def auto_match(targets: DataFrame, sources: DataFrame, by: Sequence[str], decisions: DataFrame | None = None) -> Matching:
    """Score, accept, settle with outside decisions if given, and make one-to-one."""
    targets, sources = stage(targets, "targets"), stage(sources, "sources")
    found = stage(M.candidates(targets, sources, by), "candidates")
    planned = M.plans(targets, found, by)
    queue = M.review_queue(planned, by)
    if decisions is None:
        # Without answers every open column falls back to what its schema allows.
        decisions = planned.limit(0).select(
            *by, "table", "column", F.lit("").alias("status"), F.lit("").alias("source"), F.lit(0.0).alias("confidence"),
            F.lit("").alias("reason"), F.lit(0).alias("decision_pos"),
        )
    settled = stage(M.apply_decisions(planned, decisions, by), "settled")
    conflicts = M.conflict_report(settled, by)
    plans = stage(M.one_to_one(settled, by), "plans")
    return Matching(
        found, queue, plans, conflicts, M.unused_sources(sources, plans, by), M.source_view(sources, plans, by),
        M.statistics(sources, plans, conflicts, by),
    )


def check_targets(matched: DataFrame, by: Sequence[str]) -> None:
    """A1 as the gate before rendering: names all conflicts, in order. There are at most as many as declared columns."""
    bad = sorted(r["message"] for r in duplicate_targets(matched, by).select("message").collect())
    if bad:
        raise ValueError("Cannot generate SQL with unresolved mapping conflicts: " + "; ".join(bad))


def choose_tables(tables: Sequence[Table], selected: Sequence[str] | None) -> list[Table]:
    """C6 for one plan: unknown or empty selections are errors."""
    if selected is None:
        return list(tables)
    wanted = [s.strip() for s in selected if s.strip()]
    if not wanted:
        raise ValueError("Please select at least one target table.")
    known = {t.key for t in tables}
    for s in wanted:
        if s.lower() not in known:
            raise ValueError(f"Selected table '{s}' was not found in the uploaded schema.")
    return [t for t in tables if t.key in {s.lower() for s in wanted}]


@dataclass(frozen=True)
class Generated:
    validation: Validation
    script: DataFrame
    fill: Fill


def generate(
    staged: DataFrame,
    tables: Sequence[Table],
    mappings: Mapping[str, Mapping[str, str]],
    actions: object = None,
    selected: Sequence[str] | None = None,
    dialect: str = "tsql",
    batch_size: int = BATCH_ROWS,
    include_report: bool = False,
    unmapped: Sequence[str] = (),
) -> Generated:
    """Validate the staged rows and render the accepted ones."""
    chosen = choose_tables(tables, selected)
    filled = fill(mappings, actions)
    result = validate(staged, chosen, filled)
    numeric = [c for c, kind in G.schema_types(staged).items() if kind in ("integer", "float")]
    lines = script(result, filled, dialect, True, batch_size, include_report, unmapped, None, numeric)
    return Generated(result, lines, filled)


def fill_of(merged: DataFrame, actions: DataFrame) -> Fill:
    """The decisions of one import as a ``Fill``: ``merge``'s result and normalised actions, both of a schema's size."""
    mappings: dict[str, dict[str, str]] = {}
    for r in merged.select("table_key", "column", "source").collect():
        mappings.setdefault(r["table_key"], {})[r["source"]] = r["column"]
    chosen = [
        {"table": r["table"], "sql_column": r["column"], "action": r["action"], "raw_data_key": r["source"], "custom_value": r["custom_value"]}
        for r in actions.select("table", "column", "action", "source", "custom_value").collect()
    ]
    return fill(mappings, chosen)


NO_ACTIONS = "table string, column string, action string, source string, custom_value string, pos long"


def load(
    staged: DataFrame,
    tables: Sequence[Table],
    plans: DataFrame,
    headers: DataFrame,
    ledger: str,
    import_id: str,
    actions: DataFrame | None = None,
    selected: Sequence[str] | None = None,
    candidates: DataFrame | None = None,
    dialect: str = "tsql",
    batch_size: int = BATCH_ROWS,
) -> Generated:
    """From plans and user actions to the load script of one import, noted in the ledger.

    ``plans`` and ``headers`` (``source``) are one import's; ``actions`` holds ``table, column,
    action, source, custom_value, pos``. Plans that claim one column twice stop the load, and
    the ledger says so.
    """
    spark = staged.sparkSession
    try:
        matched = matches_of(plans, [])
        check_targets(matched, [])
        given = normalise_actions(spark.createDataFrame([], NO_ACTIONS) if actions is None else actions, [])
        merged = stage(merge(matched, given, []), "merged")
        chosen = choose_tables(tables, selected)
        filled = fill_of(merged, given)
        unused = [r["source"] for r in unmapped_sources(headers, merged, []).orderBy("source").collect()]
        result = validate(staged, chosen, filled)
        numeric = [c for c, kind in G.schema_types(staged).items() if kind in ("integer", "float")]
        lines = script(result, filled, dialect, True, batch_size, True, unused, candidates, numeric)
        close_import(spark, ledger, import_id, counters(result, import_id))
    except Exception as failure:
        close_import(spark, ledger, import_id, None, str(failure))
        raise
    return Generated(result, lines, filled)


def run_import(staged: DataFrame, tables: Sequence[Table], plans: DataFrame, headers: DataFrame, ledger: str, import_id: str, script_path: str, **options: object) -> dict[str, int]:
    """``load`` with its script written to ``script_path``; returns the totals (V13) and leaves no staged table behind.

    Everything that the steps staged goes when the script is written, or when the load fails; what was staged before
    stays. ``options`` are those of ``load``.
    """
    with staging(staged.sparkSession):
        done = load(staged, tables, plans, headers, ledger, import_id, **options)
        write_script(done.script, script_path)
        return done.validation.stats.first().asDict()


def targets_of(columns: DataFrame, keys: DataFrame, fks: DataFrame, by: Sequence[str]) -> DataFrame:
    """C1, C2, C5 together: declared columns ready for matching."""
    return C.column_roles(C.mark_primary_keys(C.with_category(columns), keys, by), fks, by)
