"""Constraint checks and verification: Spark enforces none, so these end every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import Config
from ..plans.meta import ForeignKeyMeta, SchemaError, SchemaMeta, TableMeta
from . import mask


def orphans(child: DataFrame, fk: ForeignKeyMeta, parent: DataFrame) -> DataFrame:
    """Child rows whose reference has no parent; a reference with a null part is none."""
    keys = parent.select(*[F.col(f"`{r}`").alias(f"__{i}") for i, r in enumerate(fk.ref_columns)])
    on = [F.col(f"`{c}`") == F.col(f"__{i}") for i, c in enumerate(fk.columns)]
    return child.dropna(subset=list(fk.columns)).join(keys, on, "left_anti")


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n) of keys that more than one row has; a null part never collides."""
    name = "n"
    while name in columns:
        name = "_" + name
    return df.dropna(subset=columns).groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count("*").alias(name)).where(F.col(name) > 1)


def violations(frames: dict[str, DataFrame], schema: SchemaMeta) -> list[str]:
    """What the frames break: NOT NULL (one pass for a table), UNIQUE, foreign keys and checks that Spark can evaluate."""
    out = []
    for t in schema.tables:
        df = frames.get(t.qualified)
        if df is None:
            continue
        must = [c.name for c in t.columns if not c.nullable and c.name in df.columns]
        if must:
            row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in must]).first()
            out += [f"{t.qualified}.{c}: {row[c]} nulls" for c in must if row[c]]
        for name, cols in t.unique_sets():
            if all(c in df.columns for c in cols) and duplicates(df, cols).limit(1).count():
                out.append(f"{t.qualified}: {name} ({', '.join(cols)}) isn't unique")
        for c in t.columns:
            if c.name in df.columns and (c.check_min is not None or c.check_max is not None or c.check_allowed):
                x, bad = F.col(f"`{c.name}`"), F.lit(False)
                bad = bad | (x < c.check_min) if c.check_min is not None else bad
                bad = bad | (x > c.check_max) if c.check_max is not None else bad
                bad = bad | ~x.isin(c.check_allowed) if c.check_allowed else bad
                if df.where(bad).limit(1).count():
                    out.append(f"{t.qualified}.{c.name}: a value breaks its check")
    for child, fk, parent in schema.edges():
        a, b = frames.get(child.qualified), frames.get(parent.qualified)
        if a is not None and b is not None and orphans(a, fk, b).limit(1).count():
            out.append(f"{child.qualified}: {fk.name} has rows without a parent in {parent.qualified}")
    return out


def enforce(frames: dict[str, DataFrame], schema: SchemaMeta) -> None:
    if found := violations(frames, schema):
        raise SchemaError("; ".join(found))


def verify_masked(df: DataFrame, t: TableMeta, config: Config) -> DataFrame:
    """(column_name, mask, rows_checked, issues): one aggregation over a masked table.

    redact: values that aren't the redacted one; hash: values that don't look like a
    hash; fake: 1 where all of two or more values are the same one, which is suspect.
    Columns with json_paths are passed by.
    """
    aggs, checks = [F.count("*").alias("__rows")], []
    for c in t.columns:
        if c.name not in df.columns or config.column(t.qualified, c.name).json_paths:
            continue
        way = mask.strategy(t, c, config)
        if way == "none":
            continue
        x, at = F.col(f"`{c.name}`"), f"__{len(checks)}"
        if way == "redact":
            kind = df.schema[c.name].dataType
            issue = F.count_if(x.isNotNull()) if c.nullable else F.count_if(~x.eqNullSafe(mask.redacted(c, kind)))
        elif way == "hash":
            issue = F.count_if(x.isNotNull() & ~x.rlike("^masked_[0-9a-f]{24}$"))
        else:
            issue = ((F.count(x) >= 2) & (F.count_distinct(x) == 1)).cast("long")
        aggs.append(issue.alias(at))
        checks.append((c.name, way, at))
    row = df.agg(*aggs)
    if not checks:
        return row.select(F.lit("").alias("column_name"), F.lit("").alias("mask"), F.col("__rows").alias("rows_checked"), F.lit(0).cast("long").alias("issues")).limit(0)
    each = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(w).alias("mask"), F.col("__rows").alias("rows_checked"), F.col(a).alias("issues")) for n, w, a in checks])
    return row.select(F.inline(each))
