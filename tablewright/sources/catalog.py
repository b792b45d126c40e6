"""A SchemaMeta from a database's catalog.

The queries ask PostgreSQL's catalog for flat rows; `from_frames` turns such rows
into metadata and needs no database. The rows are as many as columns and
constraints, so they are collected.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..plans.checks import narrow_all
from ..plans.meta import CheckMeta, ColumnMeta, ForeignKeyMeta, SchemaMeta, TableMeta, UniqueMeta, narrow_lengths
from .io import JdbcSource

_OWN = "n.nspname NOT IN ('pg_catalog', 'information_schema') AND c.relkind IN ('r', 'p') AND NOT c.relispartition"
_NAMES = "(SELECT array_to_string(array_agg(a.attname ORDER BY u.i), chr(31)) FROM unnest({keys}) WITH ORDINALITY u(k, i) JOIN pg_attribute a ON a.attrelid = {table} AND a.attnum = u.k)"

#: Name of a frame, and the query whose rows it has. Lists of names are joined by the unit separator.
QUERIES = {
    "columns": f"""
        SELECT n.nspname AS schema_name, c.relname AS table_name, a.attname AS column_name, a.attnum AS place, NOT a.attnotnull AS nullable,
               t.typname AS type_name, t.typtype::text AS type_kind, b.typname AS base_name, e.typname AS element_name,
               CASE WHEN coalesce(b.typname, e.typname, t.typname) IN ('varchar', 'bpchar') AND a.atttypmod > 4 THEN a.atttypmod - 4 END AS max_length,
               CASE WHEN t.typname = 'numeric' AND a.atttypmod > 4 THEN (a.atttypmod - 4) >> 16 END AS precision,
               CASE WHEN t.typname = 'numeric' AND a.atttypmod > 4 THEN (a.atttypmod - 4) & 65535 END AS scale,
               CASE WHEN t.typname = 'vector' AND a.atttypmod > 0 THEN a.atttypmod END AS dimensions,
               a.attidentity <> '' AS is_identity, a.attgenerated = 's' AS is_generated, pg_get_expr(d.adbin, d.adrelid) AS expression
        FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace
        JOIN pg_attribute a ON a.attrelid = c.oid AND a.attnum > 0 AND NOT a.attisdropped
        JOIN pg_type t ON t.oid = a.atttypid
        LEFT JOIN pg_type b ON t.typtype = 'd' AND b.oid = t.typbasetype
        LEFT JOIN pg_type e ON t.typcategory = 'A' AND e.oid = t.typelem
        LEFT JOIN pg_attrdef d ON d.adrelid = c.oid AND d.adnum = a.attnum
        WHERE {_OWN}""",
    "constraints": f"""
        SELECT n.nspname AS schema_name, c.relname AS table_name, k.conname AS constraint_name, k.contype::text AS kind,
               {_NAMES.format(keys="k.conkey", table="k.conrelid")} AS column_names, rn.nspname AS ref_schema, r.relname AS ref_table,
               {_NAMES.format(keys="k.confkey", table="k.confrelid")} AS ref_columns, k.condeferrable AS deferrable, k.condeferred AS deferred, pg_get_constraintdef(k.oid) AS definition
        FROM pg_constraint k JOIN pg_class c ON c.oid = k.conrelid JOIN pg_namespace n ON n.oid = c.relnamespace
        LEFT JOIN pg_class r ON r.oid = k.confrelid LEFT JOIN pg_namespace rn ON rn.oid = r.relnamespace
        WHERE {_OWN} AND k.contype IN ('p', 'u', 'f', 'c')""",
    "indexes": f"""
        SELECT n.nspname AS schema_name, c.relname AS table_name, x.relname AS index_name,
               {_NAMES.format(keys="i.indkey::int2[]", table="i.indrelid")} AS column_names
        FROM pg_index i JOIN pg_class c ON c.oid = i.indrelid JOIN pg_namespace n ON n.oid = c.relnamespace JOIN pg_class x ON x.oid = i.indexrelid
        WHERE {_OWN} AND i.indisunique AND i.indpred IS NULL AND i.indexprs IS NULL AND NOT EXISTS (SELECT 1 FROM pg_constraint k WHERE k.conindid = i.indexrelid)""",
    "enums": "SELECT t.typname AS type_name, e.enumlabel AS label, e.enumsortorder AS place FROM pg_enum e JOIN pg_type t ON t.oid = e.enumtypid",
}


def introspect(source: JdbcSource, schemas: tuple[str, ...] = ("public",)) -> SchemaMeta:
    return from_frames({name: source.table(f"({q}) q") for name, q in QUERIES.items()}, schemas)


def _list(text: str | None) -> list[str]:
    return text.split("\x1f") if text else []


def from_frames(frames: Mapping[str, DataFrame], schemas: tuple[str, ...] = ("public",)) -> SchemaMeta:
    labels: dict[str, list[str]] = {}
    for r in sorted(frames["enums"].collect(), key=lambda r: (r.type_name, r.place)):
        labels.setdefault(r.type_name, []).append(r.label)
    tables: dict[tuple[str, str], TableMeta] = {}
    for r in sorted(frames["columns"].collect(), key=lambda r: (r.schema_name, r.table_name, r.place)):
        if r.schema_name not in schemas:
            continue
        t = tables.setdefault((r.schema_name, r.table_name), TableMeta(r.table_name, r.schema_name))
        kind = {"e": "enum", "d": "domain", "c": "composite"}.get(r.type_kind, "array" if r.element_name else r.type_name)
        c = ColumnMeta(r.column_name, kind, bool(r.nullable), r.max_length, r.precision, r.scale, r.dimensions, identity=bool(r.is_identity), domain_of=r.base_name, element=r.element_name, composite=kind == "composite")
        c.enum = labels.get(r.element_name or r.base_name or r.type_name)
        if r.is_generated:
            c.stored_generated = r.expression
        elif r.expression:
            c.default, c.serial = r.expression, r.expression.startswith("nextval(")
        t.columns.append(c)
    for r in sorted(frames["constraints"].collect(), key=lambda r: r.constraint_name):
        t = tables.get((r.schema_name, r.table_name))
        if t is None:
            continue
        if r.kind == "p":
            t.primary_key = _list(r.column_names)
        elif r.kind == "u":
            t.unique.append(UniqueMeta(r.constraint_name, _list(r.column_names)))
        elif r.kind == "f":
            t.foreign_keys.append(ForeignKeyMeta(r.constraint_name, _list(r.column_names), f"{r.ref_schema}.{r.ref_table}", _list(r.ref_columns), bool(r.deferrable), bool(r.deferred)))
        else:
            t.checks.append(CheckMeta(r.constraint_name, r.definition))
    for r in sorted(frames["indexes"].collect(), key=lambda r: r.index_name):
        if (t := tables.get((r.schema_name, r.table_name))) is not None:
            t.unique.append(UniqueMeta(r.index_name, _list(r.column_names)))
    schema = SchemaMeta([tables[k] for k in sorted(tables)])
    narrow_all(schema)
    narrow_lengths(schema)
    return schema
