"""The declared target: tables, columns, keys, and what fills each column.

A target schema is metadata of the size of a Spark schema, so the operators that
build one plan per table take it as plain objects. Catalogs of many schemas are
DataFrames (``operators.catalog``); ``from_catalog`` reads the selected tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.kinds import category_of


@dataclass(frozen=True)
class Column:
    name: str
    sql_type: str = "varchar"
    nullable: bool = True
    identity: bool = False
    default: bool = False

    @property
    def category(self) -> str:
        return category_of(self.sql_type)


def plain_name(table: str) -> str:
    """A table name without schema and quotes, in lower case."""
    return table.rsplit(".", 1)[-1].strip("[]`\"").lower()


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent_table: str
    parent_column: str

    @property
    def parent_key(self) -> str:
        return plain_name(self.parent_table)


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    schema: str = "dbo"

    @property
    def key(self) -> str:
        return self.name.lower()


@dataclass(frozen=True)
class Action:
    """What fills a target column: EXCEL, NULL, CUSTOM_VALUE, DATABASE_DEFAULT, DATABASE_GENERATED."""

    kind: str
    source: str | None = None
    value: object = None

    @property
    def is_custom(self) -> bool:
        return self.kind.upper() in ("CUSTOM_VALUE", "CUSTOM")

    @property
    def is_default(self) -> bool:
        return self.kind.upper() in ("DEFAULT", "DATABASE_DEFAULT")

    @property
    def is_null(self) -> bool:
        return self.kind.upper() == "NULL"

    @property
    def has_value(self) -> bool:
        return self.value is not None and self.value == self.value and str(self.value).strip() != ""


@dataclass(frozen=True)
class Fill:
    """Source column per target column, and user actions, both keyed in lower case."""

    sources: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    actions: Mapping[tuple[str, str], Action] = field(default_factory=dict)

    def source(self, table: str, column: str) -> str | None:
        return self.sources.get(table.lower(), {}).get(column.lower())

    def action(self, table: str, column: str) -> Action | None:
        return self.actions.get((table.lower(), column.lower()))

    def covers(self, table: str) -> bool:
        return bool(self.sources.get(table.lower())) or any(t == table.lower() for t, _ in self.actions)


def fill(mappings: Mapping[str, Mapping[str, str]], actions: object = None) -> Fill:
    """``mappings`` is ``{table: {source: target column}}``.

    ``actions`` comes in any of four spellings (A6): a list of records, or a
    mapping keyed by ``(table, column)``, by ``"table.column"``, or nested. An action
    decides its column alone: a source it names replaces the match, any other action
    removes it.
    """
    sources: dict[str, dict[str, str]] = {}
    for table, pairs in mappings.items():
        chosen = sources.setdefault(table.lower(), {})
        for src, tgt in pairs.items():
            chosen[tgt.lower()] = src
    chosen_actions = {a.target: a.action for a in _spelled(actions or ())}
    for (table, column), act in chosen_actions.items():
        if act.is_custom or act.is_default or act.is_null:
            sources.get(table, {}).pop(column, None)
        elif act.source:
            sources.setdefault(table, {})[column] = act.source
    return Fill(sources, chosen_actions)


#: The names under which a record of an action may give its column and its source, the first one present counting.
COLUMN_FIELDS, SOURCE_FIELDS = ("sql_column", "column"), ("raw_data_key", "source", "excel_column", "excel_source")


@dataclass(frozen=True)
class _Spelled:
    """One action as somebody wrote it: the path to its column, and what stands there."""

    path: tuple[str, ...]
    said: object

    @property
    def target(self) -> tuple[str, str]:
        """Table and column in lower case; a path of one name is cut at its first dot."""
        table, column = self.path if len(self.path) == 2 else self.path[0].split(".", 1)
        return table.lower(), column.lower()

    @property
    def action(self) -> Action:
        if isinstance(self.said, Action):
            return self.said
        said = {"action": self.said} if isinstance(self.said, str) else self.said
        source = next(filter(None, map(said.get, SOURCE_FIELDS)), None)
        return Action(str(said.get("action") or ""), source, said.get("custom_value"))


def _spelled(actions: Mapping | Iterable, path: tuple[str, ...] = ()) -> list[_Spelled]:
    """Every spelling as a list of paths: records name theirs, mappings are walked down to it."""
    if not isinstance(actions, Mapping):
        named = [(r, r.get("table"), next(filter(None, map(r.get, COLUMN_FIELDS)), None)) for r in actions]
        return [_Spelled((str(table), str(column)), r) for r, table, column in named if table and column]
    found: list[_Spelled] = []
    for key, said in actions.items():
        here = (*path, *map(str, key)) if isinstance(key, tuple) else (*path, str(key))
        complete = len(here) == 2 or "." in here[0]
        found += [_Spelled(here, said)] if complete else _spelled(said, here)
    return found


def load_order(tables: Iterable[Table]) -> list[Table]:
    """C7 for the handful of tables of one plan: parents first, cyclic rest last.

    A table is placed right after the last of its parents; ties keep schema order.
    """
    tables = list(tables)
    rank = {t.key: i for i, t in enumerate(tables)}
    parents = {
        t.key: {fk.parent_key for fk in t.foreign_keys if fk.parent_key in rank} - {t.key}
        for t in tables
    }
    placed: dict[str, int] = {}
    wave = [t.key for t in tables if not parents[t.key]]
    while wave:
        for name in wave:
            placed[name] = len(placed)
        ready = [k for k in rank if k not in placed and parents[k] <= placed.keys()]
        wave = sorted(ready, key=lambda k: (max(placed[p] for p in parents[k]), rank[k]))
    rest = [k for k in rank if k not in placed]
    by_key = {t.key: t for t in tables}
    return [by_key[k] for k in [*placed, *rest]]


def from_catalog(columns: DataFrame, keys: DataFrame, fks: DataFrame, tables: list[str]) -> list[Table]:
    """Read the selected tables' declarations; the result is as small as a schema."""
    wanted = [t.lower() for t in tables]
    pick = F.lower("table").isin(wanted)
    cols: dict[str, list] = {}
    for r in columns.where(pick).orderBy("table", "col_pos").toLocalIterator():
        cols.setdefault(r["table"], []).append(
            Column(r["name"], r["sql_type"], r["nullable"], r["is_identity"], r["has_default"])
        )
    pks: dict[str, list] = {}
    for r in keys.where(pick).orderBy("table", "pk_pos").toLocalIterator():
        pks.setdefault(r["table"].lower(), []).append(r["column"])
    links: dict[str, list] = {}
    for r in fks.where(F.lower("child_table").isin(wanted)).toLocalIterator():
        links.setdefault(r["child_table"].lower(), []).append(
            ForeignKey(r["child_column"], r["parent_table"], r["parent_column"])
        )
    found = [
        Table(t, tuple(c), tuple(pks.get(t.lower(), ())), tuple(links.get(t.lower(), ()))) for t, c in cols.items()
    ]
    return sorted(found, key=lambda t: wanted.index(t.key))
