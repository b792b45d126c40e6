"""What Spark's file catalog can't hold: keys, foreign keys, uniqueness and checks of tables.

A SchemaMeta lives on the driver and is read from a YAML sidecar, DDL text or a
catalog. It is as large as the schema, never as the data.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

import yaml

#: Types whose values are text; masks and name rules look at these.
TEXT_TYPES = {"text", "varchar", "bpchar", "name", "citext", "string"}
INT_TYPES = {"int2", "int4", "int8"}


class SchemaError(ValueError):
    """A schema, plan or configuration that can't be carried out; raised before any read."""


@dataclass
class ColumnMeta:
    name: str
    type: str = "text"
    nullable: bool = True
    max_length: int | None = None
    precision: int | None = None
    scale: int | None = None
    vector_dimensions: int | None = None
    identity: bool = False
    serial: bool = False
    stored_generated: str | None = None  # its expression
    default: str | None = None
    enum: list[str] | None = None
    domain_of: str | None = None  # base type of a domain, one level
    element: str | None = None  # element type of a one-dimensional array
    composite: bool = False
    check_min: int | None = None
    check_max: int | None = None
    check_allowed: list[str] | None = None
    check_null_escape: bool = False
    check_like_prefix: str | None = None

    @property
    def text_like(self) -> bool:
        return (self.domain_of or self.type) in TEXT_TYPES

    @property
    def server_assigned(self) -> bool:
        return self.identity or self.serial or self.stored_generated is not None

    @property
    def sequence_backed(self) -> bool:
        return self.identity or self.serial


@dataclass
class ForeignKeyMeta:
    name: str
    columns: list[str]
    ref_table: str
    ref_columns: list[str]
    deferrable: bool = False
    initially_deferred: bool = False
    logical: bool = False


@dataclass
class UniqueMeta:
    name: str
    columns: list[str]
    primary: bool = False


@dataclass
class CheckMeta:
    name: str
    definition: str


@dataclass
class TableMeta:
    name: str
    schema: str = "public"
    columns: list[ColumnMeta] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    foreign_keys: list[ForeignKeyMeta] = field(default_factory=list)
    unique: list[UniqueMeta] = field(default_factory=list)
    checks: list[CheckMeta] = field(default_factory=list)

    @property
    def qualified(self) -> str:
        return f"{self.schema}.{self.name}"

    def column(self, name: str) -> ColumnMeta:
        for c in self.columns:
            if c.name == name:
                return c
        raise SchemaError(f"table {self.qualified} has no column {name}")

    def has(self, name: str) -> bool:
        return any(c.name == name for c in self.columns)

    def is_key(self, name: str) -> bool:
        """Member of the primary key, or owner of a foreign key."""
        return name in self.primary_key or any(name in fk.columns for fk in self.foreign_keys)

    def identity(self) -> list[str]:
        """Columns that tell rows apart: the primary key, else the first unique constraint, else the whole row."""
        if self.primary_key:
            return list(self.primary_key)
        return list(self.unique[0].columns) if self.unique else [c.name for c in self.columns]

    def unique_sets(self) -> list[tuple[str, list[str]]]:
        out = [("primary key", list(self.primary_key))] if self.primary_key else []
        return out + [(u.name, list(u.columns)) for u in self.unique if set(u.columns) != set(self.primary_key)]


@dataclass
class SchemaMeta:
    tables: list[TableMeta] = field(default_factory=list)

    def __getitem__(self, name: str) -> TableMeta:
        found = self.find(name)
        if found is None:
            raise SchemaError(f"unknown table {name}")
        return found

    def find(self, name: str) -> TableMeta | None:
        """By qualified name, or by a bare name that only one schema has."""
        exact = [t for t in self.tables if t.qualified == name]
        bare = exact or [t for t in self.tables if t.name == name]
        if len(bare) > 1:
            raise SchemaError(f"table name {name} is ambiguous: {', '.join(sorted(t.qualified for t in bare))}")
        return bare[0] if bare else None

    def edges(self) -> list[tuple[TableMeta, ForeignKeyMeta, TableMeta]]:
        """(child, foreign key, parent); keys to tables outside the schema are left out."""
        out = []
        for t in self.tables:
            for fk in t.foreign_keys:
                parent = self.find(fk.ref_table)
                if parent is not None:
                    out.append((t, fk, parent))
        return out

    def to_yaml(self) -> str:
        def lean(x):
            if isinstance(x, dict):
                return {k: lean(v) for k, v in x.items() if v is not None and v != [] and (v is not False or k == "nullable")}
            return [lean(v) for v in x] if isinstance(x, list) else x

        return yaml.safe_dump(lean(asdict(self)), sort_keys=True)

    @classmethod
    def from_yaml(cls, text: str) -> SchemaMeta:
        kinds = {"columns": ColumnMeta, "foreign_keys": ForeignKeyMeta, "unique": UniqueMeta, "checks": CheckMeta}

        def build(kind, body):
            known = {f.name for f in fields(kind)}
            if unknown := set(body) - known:
                raise SchemaError(f"unknown keys in the schema file: {', '.join(sorted(unknown))}")
            return kind(**{k: [build(kinds[k], x) for x in v] if kind is TableMeta and k in kinds else v for k, v in body.items()})

        body = yaml.safe_load(text) or {}
        return cls([build(TableMeta, t) for t in body.get("tables", [])])


def narrow_lengths(schema: SchemaMeta) -> None:
    """A referenced text column must be short enough for each column that refers to it."""
    moved = True
    while moved:
        moved = False
        for child, fk, parent in schema.edges():
            for own, ref in zip(fk.columns, fk.ref_columns):
                if not parent.has(ref):
                    continue
                a, b = child.column(own).max_length, parent.column(ref)
                if a is not None and (b.max_length is None or a < b.max_length):
                    b.max_length, moved = a, True


def _table(name: str, columns: str, pk=(), fks=(), unique=()) -> TableMeta:
    cols = []
    for part in columns.split(","):
        n, kind = part.split()
        base, _, size = kind.partition("(")
        p = [int(x) for x in size.rstrip(")").split(";")] if size else []
        cols.append(ColumnMeta(n, base, nullable=n not in pk, precision=p[0] if p else None, scale=p[1] if len(p) > 1 else None))
    keys = [ForeignKeyMeta(f"{name}_{c}_fkey", [c], f"public.{p}", [r]) for c, p, r in fks]
    return TableMeta(name, "public", cols, list(pk), keys, [UniqueMeta(f"{name}_{c}_key", [c]) for c in unique])


def testdata_schema() -> SchemaMeta:
    """Metadata of the driver's tables."""
    return SchemaMeta([
        _table("region", "r_regionkey int4,r_name text", ["r_regionkey"]),
        _table("nation", "n_nationkey int4,n_name text,n_regionkey int4", ["n_nationkey"], [("n_regionkey", "region", "r_regionkey")]),
        _table("customer", "c_custkey int8,c_name text,c_nationkey int4,c_acctbal float8,c_mktsegment text", ["c_custkey"], [("c_nationkey", "nation", "n_nationkey")], ["c_name"]),
        _table("supplier", "s_suppkey int8,s_name text,s_nationkey int4,s_acctbal float8", ["s_suppkey"], [("s_nationkey", "nation", "n_nationkey")]),
        _table("part", "p_partkey int8,p_name text,p_brand text,p_type text,p_size int4,p_retailprice float8", ["p_partkey"]),
        _table("orders", "o_orderkey int8,o_custkey int8,o_orderstatus text,o_totalprice float8,o_orderdate timestamp,o_orderpriority text", ["o_orderkey"], [("o_custkey", "customer", "c_custkey")]),
        _table("lineitem", "l_orderkey int8,l_partkey int8,l_suppkey int8,l_linenumber int4,l_quantity float8,l_extendedprice float8,l_discount float8,l_tax float8,l_returnflag text,l_linestatus text,l_shipdate timestamp", [], [("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey")]),
        _table("events", "event_id int8,ts timestamp,user_id int8,event_type text,value float8,props json", ["event_id"], [("user_id", "customer", "c_custkey")]),
    ])
