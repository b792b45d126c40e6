"""The shape of real data: row counts, null fractions, children per parent."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.meta import SchemaError, SchemaMeta
from ..sources.io import Source

VERSION = 1


@dataclass
class Profile:
    rows: dict[str, int] = field(default_factory=dict)
    nulls: dict[str, dict[str, float]] = field(default_factory=dict)  # only fractions above 0
    children: dict[str, dict[str, list[tuple[int, int]]]] = field(default_factory=dict)  # table -> foreign key -> (children, parents)

    def to_yaml(self) -> str:
        return yaml.safe_dump({"version": VERSION, "rows": self.rows, "nulls": self.nulls, "children": {t: {k: [list(x) for x in v] for k, v in own.items()} for t, own in self.children.items()}}, sort_keys=True)

    @classmethod
    def from_yaml(cls, text: str) -> Profile:
        body = yaml.safe_load(text) or {}
        if body.get("version") != VERSION:
            raise SchemaError(f"profile version {body.get('version')} can't be read, only {VERSION}")
        return cls(body.get("rows") or {}, body.get("nulls") or {}, {t: {k: [tuple(x) for x in v] for k, v in own.items()} for t, own in (body.get("children") or {}).items()})


def null_fractions(df: DataFrame) -> DataFrame:
    """(column_name, null_rows, total_rows): all columns in one pass."""
    cols = df.columns
    row = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"__{i}") for i, c in enumerate(cols)])
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__{i}").alias("null_rows"), F.col("__n").alias("total_rows")) for i, c in enumerate(cols)])
    return row.select(F.inline(each))


def cardinality(parent: DataFrame, ref: list[str], child: DataFrame, own: list[str]) -> DataFrame:
    """(child_count, parent_count), with the parents that have no child.

    The children are counted by key before the join, so a parent with very many
    of them is one row in it.
    """
    n = child.dropna(subset=own).groupBy(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(own)]).agg(F.count("*").alias("__n"))
    keys = parent.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(ref)])
    met = keys.join(n, [f"__{i}" for i in range(len(own))], "left").select(F.coalesce("__n", F.lit(0)).cast("long").alias("child_count"))
    return met.groupBy("child_count").agg(F.count("*").alias("parent_count"))


def capture(source: Source, schema: SchemaMeta) -> Profile:
    out = Profile()
    for t in schema.tables:
        rows = null_fractions(source.scan(t)).collect()  # one row for each column
        total = rows[0]["total_rows"] if rows else 0
        out.rows[t.qualified] = total
        own = {r["column_name"]: r["null_rows"] / total for r in rows if total and r["null_rows"]}
        if own:
            out.nulls[t.qualified] = own
    for child, fk, parent in schema.edges():
        counted = cardinality(source.scan(parent, fk.ref_columns), fk.ref_columns, source.scan(child, fk.columns), fk.columns)
        hist = sorted((r["child_count"], r["parent_count"]) for r in counted.collect())  # one row for each different count
        out.children.setdefault(child.qualified, {})[fk.name] = hist
    return out
