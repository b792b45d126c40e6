"""Configuration: seed, row counts, strategies, masks, logical foreign keys."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml

from .meta import ForeignKeyMeta, SchemaError, SchemaMeta

MASKS = ("fake", "hash", "redact", "none")
STRATEGIES = ("mask", "generate")
EPOCH_END = "2025-01-01"  # generated dates end here, so that a seed gives the same data on any day


@dataclass
class ColumnConfig:
    generator: str | None = None
    mask: str | None = None
    json_paths: dict[str, str] = field(default_factory=dict)


@dataclass
class LogicalKey:
    columns: list[str]
    ref_table: str
    ref_columns: list[str]


@dataclass
class TableConfig:
    rows: int | None = None
    strategy: str = "mask"
    columns: dict[str, ColumnConfig] = field(default_factory=dict)
    logical_foreign_keys: list[LogicalKey] = field(default_factory=list)


@dataclass
class Config:
    version: int = 1
    seed: str = "default"
    tables: dict[str, TableConfig] = field(default_factory=dict)

    def table(self, qualified: str) -> TableConfig:
        return self.tables.get(qualified) or TableConfig()

    def column(self, qualified: str, column: str) -> ColumnConfig:
        return self.table(qualified).columns.get(column) or ColumnConfig()

    @classmethod
    def from_yaml(cls, text: str) -> Config:
        body = yaml.safe_load(text) or {}
        out = cls(body.get("version", 1), str(body.get("seed", "default")))
        for name, t in (body.get("tables") or {}).items():
            t = t or {}
            if "rows" not in t:
                raise SchemaError(f"{name}: a listed table needs `rows`")
            if t.get("strategy", "mask") not in STRATEGIES:
                raise SchemaError(f"{name}: unknown strategy {t['strategy']}")
            columns = {c: ColumnConfig(x.get("generator"), x.get("mask"), dict(x.get("json_paths") or {})) for c, x in (t.get("columns") or {}).items()}
            for c, x in columns.items():
                for m in [x.mask, *x.json_paths.values()]:
                    if m is not None and m not in MASKS:
                        raise SchemaError(f"{name}.{c}: unknown mask {m}")
            keys = [LogicalKey(k["columns"], k["ref_table"], k["ref_columns"]) for k in t.get("logical_foreign_keys") or []]
            out.tables[name] = TableConfig(t["rows"], t.get("strategy", "mask"), columns, keys)
        return out

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return cls.from_yaml(f.read())

    def to_yaml(self, schema: SchemaMeta | None = None) -> str:
        """With a schema, each table's checks stand above it as comments."""
        lines = [f"version: {self.version}", f"seed: {self.seed}", "tables:" if self.tables else "tables: {}"]
        for name in sorted(self.tables):
            t, meta = self.tables[name], schema.find(name) if schema else None
            lines += [f"  # check {c.name}: {c.definition}" for c in (meta.checks if meta else [])]
            body: dict = {"rows": t.rows, "strategy": t.strategy}
            if t.columns:
                body["columns"] = {c: {k: v for k, v in (("generator", x.generator), ("mask", x.mask), ("json_paths", x.json_paths)) if v} for c, x in sorted(t.columns.items())}
            if t.logical_foreign_keys:
                body["logical_foreign_keys"] = [vars(k) for k in t.logical_foreign_keys]
            lines += ["  " + x for x in yaml.safe_dump({name: body}, sort_keys=True).splitlines()]
        return "\n".join(lines) + "\n"


def merge_logical_keys(schema: SchemaMeta, config: Config) -> None:
    """Every logical foreign key is checked before the first one is added."""
    new = []
    for name in sorted(config.tables):
        keys = config.tables[name].logical_foreign_keys
        if not keys:
            continue
        table = schema.find(name)
        if table is None:
            raise SchemaError(f"logical foreign key on unknown table {name}")
        for i, k in enumerate(keys):
            parent = schema.find(k.ref_table)
            if len(k.columns) != len(k.ref_columns) or not k.columns:
                raise SchemaError(f"{name}: a logical foreign key has {len(k.columns)} columns and refers to {len(k.ref_columns)}")
            if parent is None:
                raise SchemaError(f"{name}: a logical foreign key refers to unknown table {k.ref_table}")
            for owner, columns in ((table, k.columns), (parent, k.ref_columns)):
                for c in columns:
                    owner.column(c)
            label = table.qualified.replace(".", "_").replace(" ", "_")
            new.append((table, ForeignKeyMeta(f"logical_fk_{label}_{i}", list(k.columns), parent.qualified, list(k.ref_columns), logical=True)))
    for table, fk in new:
        if all(x.name != fk.name for x in table.foreign_keys):
            table.foreign_keys.append(fk)


def rows_for(config: Config, profile_rows: dict[str, int], qualified: str) -> int:
    """Configured (0 counts), else the profile's if positive, else 100."""
    own = config.tables.get(qualified)
    if own is not None and own.rows is not None:
        return own.rows
    return profile_rows.get(qualified, 0) or 100


def validate_hybrid(schema: SchemaMeta, config: Config) -> None:
    """A masked table must not refer to a generated one, and a cycle must have one strategy."""
    from .graph import plan_insertion

    way = lambda t: config.table(t).strategy
    for child, fk, parent in schema.edges():
        if child is not parent and way(child.qualified) == "mask" and way(parent.qualified) == "generate":
            raise SchemaError(f"{child.qualified}.{fk.name}: a masked table refers to {parent.qualified}, whose rows are generated")
    for group in plan_insertion(schema):
        if len(group.tables) > 1 and len({way(t) for t in group.tables}) > 1:
            raise SchemaError(f"tables {', '.join(group.tables)} form a cycle and need one strategy")
