"""A referentially complete subset from one condition.

Phase one goes from the root rows to all rows that refer to them, to a fixpoint;
phase two adds the rows that those refer to, to a fixpoint. Rows added by phase two
pull in no children. Only keys travel: a round is semi and anti joins on them,
its new keys are settled, so plans stay short and a lost executor repeats one round, and
the tables that a round reaches are done side by side. Whole rows are read once, at the end, by one
semi join for each table. Rows of a table without any key can't be fetched again by one, so they are settled whole.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import row_identity
from ..plans.meta import SchemaError, SchemaMeta, TableMeta
from ..sources.io import Source, settle

MOST_ROWS = 200_000
_ID = "__identity"


def parse_root(text: str, schema: SchemaMeta) -> tuple[TableMeta, str]:
    """'<table> WHERE <condition>'; the table's name may be bare if only one schema has it."""
    parts = re.split(r"\s+where\s+", " " + text + " ", maxsplit=1, flags=re.I)
    if len(parts) < 2:
        raise SchemaError(f"a root needs the form '<table> WHERE <condition>': {text}")
    name, condition = parts[0].strip(), parts[1].strip()
    if not name:
        raise SchemaError("the root names no table")
    if not condition:
        raise SchemaError("the root has an empty condition")
    table = schema.find(name)
    if table is None:
        raise SchemaError(f"the root names an unknown table {name}")
    return table, condition


def _keys(rows: DataFrame, columns: list[str]) -> DataFrame:
    named = rows.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(columns)])
    return named.dropna().distinct()


def matching(df: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """Rows of df whose columns are among the keys (named __0, __1 ...)."""
    return df.join(keys, [F.col(f"`{c}`") == F.col(f"__{i}") for i, c in enumerate(columns)], "left_semi")


def _identified(df: DataFrame, t: TableMeta) -> DataFrame:
    return df.withColumn(_ID, F.sha2(row_identity(df, t.identity()), 256)).dropDuplicates([_ID])


class _Walk:
    """Rows held so far, by table: their keys and the columns that lead on."""

    def __init__(self, source: Source, schema: SchemaMeta, most: int | None) -> None:
        self.source, self.schema, self.edges, self.most = source, schema, schema.edges(), most
        self.held: dict[str, list[DataFrame]] = {}
        self.total = 0

    def columns(self, t: TableMeta) -> list[str] | None:
        """What travels: the primary key and both ends of foreign keys; all columns of a table without one."""
        if not t.primary_key:
            return None
        ends = [c for child, fk, parent in self.edges for c in (*(fk.columns if child is t else ()), *(fk.ref_columns if parent is t else ()))]
        return list(dict.fromkeys([*t.primary_key, *ends]))

    def new(self, t: TableMeta, offered: list[DataFrame]) -> DataFrame:
        """The rows offered that aren't held yet, settled."""
        rows = reduce(DataFrame.unionByName, offered)
        if t.primary_key:
            rows = rows.dropDuplicates(t.primary_key) if len(offered) > 1 else rows
            key = t.primary_key
        else:
            rows, key = _identified(rows, t), [_ID]
        if old := self.held.get(t.qualified):
            rows = rows.join(reduce(DataFrame.unionByName, old).select(*[F.col(f"`{k}`") for k in key]), key, "left_anti")
        return settle(rows, "subset")

    def add(self, offers: dict[str, list[DataFrame]]) -> dict[str, DataFrame]:
        """Settles what is offered to each table, the tables side by side; gives the tables with new rows."""

        def one(name: str) -> tuple[str, DataFrame, int]:
            rows = self.new(self.schema[name], offers[name])
            return name, rows, rows.count()

        if not offers:
            return {}
        target = inheritable_thread_target(SparkSession.getActiveSession())(one)
        with ThreadPoolExecutor(min(8, len(offers))) as pool:
            done = [f.result() for f in [pool.submit(target, name) for name in offers]]
        out = {}
        for name, rows, n in done:
            self.total += n
            own = self.held.setdefault(name, [])
            if n or not own:
                own.append(rows)
            if n:
                out[name] = rows
        if self.most is not None and self.total > self.most:
            raise SchemaError(f"the subset has more than {self.most} rows; nothing was written")
        return out

    def go(self, frontier: dict[str, DataFrame], to_children: bool) -> None:
        while frontier:
            offers: dict[str, list[DataFrame]] = {}
            for child, fk, parent in self.edges:
                near, far = (parent, child) if to_children else (child, parent)
                if near.qualified in frontier:
                    near_cols, far_cols = (fk.ref_columns, fk.columns) if to_children else (fk.columns, fk.ref_columns)
                    keys = _keys(frontier[near.qualified], near_cols)
                    offers.setdefault(far.qualified, []).append(matching(self.source.scan(far, self.columns(far)), far_cols, keys))
            frontier = self.add(offers)

    def rows(self, name: str) -> DataFrame:
        t, own = self.schema[name], reduce(DataFrame.unionByName, self.held[name])
        if not t.primary_key:
            return own.drop(_ID)
        keys = own.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(t.primary_key)])
        return matching(self.source.scan(t), t.primary_key, keys)


def subset(source: Source, schema: SchemaMeta, root: str, most_rows: int | None = MOST_ROWS) -> dict[str, DataFrame]:
    """{qualified table: rows}; tables that the subset doesn't reach are left out. A table without any key holds each different row once. most_rows=None: no cap."""
    table, condition = parse_root(root, schema)
    walk = _Walk(source, schema, most_rows)
    names = walk.columns(table)
    first = source.scan(table, condition=condition)
    walk.go(walk.add({table.qualified: [first if names is None else first.select(*[F.col(f"`{c}`") for c in names])]}), True)
    walk.go({name: reduce(DataFrame.unionByName, own) for name, own in walk.held.items()}, False)
    return {name: walk.rows(name) for name in walk.held}
