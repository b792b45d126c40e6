"""Command line: python -m tablewright.cli <command> ... Exit code 0, or 1 with the reason on standard error."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import classify, clone, mask, profile
from .operators.generate import generate
from .plans import graph
from .plans.config import Config, TableConfig, merge_logical_keys, rows_for
from .plans.meta import SchemaError, SchemaMeta
from .sources import catalog, migrate
from .sources.io import FileSystem, JdbcSource, ParquetSource, Source, execute, is_url, jdbc_url, load_schema, next_values, sequence_statements, write_jdbc, write_parquet


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tablewright")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *options: str):
        p = sub.add_parser(name)
        for o in options:
            flag = o.endswith("?")
            p.add_argument(f"--{o.rstrip('?!')}", action="store_true" if flag else "store", required=o.endswith("!"))
        p.add_argument("--schema", action="append")
        return p

    # --source and --target are a folder of Parquet or a database's URL; a database tells its schema itself, for a folder --schema-file does
    add("init", "schema-file", "source", "config!")
    add("plan", "schema-file", "source", "config")
    add("up", "schema-file", "target!", "config", "seed", "profile")
    add("profile", "schema-file", "source!", "output!")
    add("clone", "schema-file", "source!", "target!", "root", "config", "strict?", "lockfile")
    add("snapshot", "schema-file", "source!", "output!", "root", "config")
    add("restore", "schema-file", "file!", "target!")
    add("mask", "schema-file", "source!", "staging!", "config", "batches", "dry-run?", "yes?", "resume?", "max-batches", "skip-verify?", "strict?", "lockfile", "json?", "apply?")
    add("classify", "schema-file", "source", "write?", "check?", "json?", "lockfile")
    add("policy-list")
    add("policy-apply", "name!", "schema-file", "source", "config!", "force?")
    add("migrate-snaplet", "input!", "output!", "seed-ts")
    add("migrate-neosync", "input!", "output!")
    return top


def _text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _write(path: str, text: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _config(path: str | None) -> Config:
    return Config.load(path) if path else Config()


def init_config(schema: SchemaMeta) -> Config:
    """100 rows for each table, and the masks that the names suggest."""
    out = Config(tables={t.qualified: TableConfig(rows=100) for t in schema.tables})
    classify.apply_policy(schema, out, "pii")
    return out


def format_count(n: int) -> str:
    return f"{n:,}"


def format_bytes(n: int) -> str:
    """Units: fixed values."""
    size, unit, units = float(n), 0, ["B", "KiB", "MiB", "GiB", "TiB"]
    while size >= 1024 and unit < len(units) - 1:
        size, unit = size / 1024, unit + 1
    return f"{size:.1f} {units[unit]}" if unit else f"{n} {units[0]}"


def schema_of(args: argparse.Namespace, spark: SparkSession) -> SchemaMeta:
    """From the schema file, or from the catalog of the database that the command reads, else of the one it writes."""
    if getattr(args, "schema_file", None):
        return load_schema(spark, args.schema_file)
    for place in (getattr(args, "source", None), getattr(args, "target", None)):
        if is_url(place):
            return catalog.introspect(JdbcSource(spark, jdbc_url(place)), tuple(args.schema or ["public"]))
    raise SchemaError("a schema is needed: --schema-file, or a database's URL")


def source_of(place: str, spark: SparkSession) -> Source:
    return JdbcSource(spark, jdbc_url(place)) if is_url(place) else ParquetSource(spark, place)


def write(spark: SparkSession, frames: dict[str, DataFrame], target: str, schema: SchemaMeta) -> None:
    """To a folder, with the sequences' next values beside the tables; or to a database, parents first, with its sequences set."""
    if is_url(target):
        write_jdbc(frames, target, [n for g in graph.plan_insertion(schema) for n in g.tables])
        execute(spark, target, sequence_statements(json.loads(next_values(frames, schema))))
        return
    write_parquet(frames, target)
    written = {n: spark.read.schema(df.schema).parquet(f"{target}/{n}.parquet") for n, df in frames.items()}
    FileSystem(spark).write(f"{target}/next_values.json", next_values(written, schema))


def init_report(schema: SchemaMeta, source: Source | None) -> str:
    """What the schema holds, its sensitive columns, and the sensitive keys in a sample of its JSON documents."""
    columns = [(t, c) for t in schema.tables for c in t.columns]
    groups = graph.plan_insertion(schema)
    json_columns = [(t, c) for t, c in columns if c.type in mask.JSON]
    counts = {"tables": len(schema.tables), "foreign keys": sum(len(t.foreign_keys) for t in schema.tables), "enum columns": sum(c.type == "enum" for _, c in columns), "JSON columns": len(json_columns), "cyclic groups": sum(len(g.tables) > 1 for g in groups), "checks": sum(len(t.checks) for t in schema.tables)}
    lines = [f"{n} {what}" for what, n in counts.items() if n]
    found = [(f"{t.name}.{c.name}", kind) for t, c in columns if (kind := classify.sensitivity(c.name))]
    lines += ["sensitive columns:", *[f"  {n}  {kind}" for n, kind in found]] if found else []
    keys = [(f"{t.name}.{c.name}.{path}", kind) for t, c in json_columns if source is not None for path, kind in mask.sensitive_keys(source.scan(t, [c.name]), c.name)]
    return "\n".join([*lines, *(["sensitive keys in JSON documents (names only, from a sample):", *[f"  {n}  {kind}" for n, kind in keys]] if keys else [])])


def plan_report(schema: SchemaMeta, config: Config | None = None) -> str:
    """The order of insertion with the rows to generate where a configuration says them, and the tree of dependencies."""
    n = lambda t: f" ({format_count(rows_for(config, {}, t))} rows)" if config else ""
    lines = [f"{i + 1}. {g.kind}: {', '.join(t + n(t) for t in g.tables)}" for i, g in enumerate(graph.plan_insertion(schema))]
    tree = ["  " * n.depth + n.table + (" (cycle)" if n.cyclic else "") for n in graph.dependency_tree(schema)]
    return "\n".join([*lines, "", *tree])


def run(args: argparse.Namespace, spark: SparkSession) -> str:
    if args.command == "policy-list":
        return "\n".join(f"{n}: {len(r)} rules" for n, r in sorted(classify.POLICIES.items()))
    if args.command.startswith("migrate"):
        got = migrate.from_neosync(_text(args.input)) if args.command.endswith("neosync") else migrate.from_snaplet(_text(args.input), _text(args.seed_ts) if args.seed_ts else None)
        _write(args.output, got.config.to_yaml())
        return "\n".join(got.notes)
    schema = schema_of(args, spark)
    lock = getattr(args, "lockfile", None) or "classification.lock.yaml"
    strict = lock if getattr(args, "strict", False) else None
    if args.command == "init":
        _write(args.config, init_config(schema).to_yaml(schema))
        return init_report(schema, source_of(args.source, spark) if args.source else None)
    if args.command == "plan":
        config = _config(args.config)
        merge_logical_keys(schema, config)
        return plan_report(schema, config)
    if args.command == "policy-apply":
        config = _config(args.config)
        done = classify.apply_policy(schema, config, args.name, args.force)
        for t in schema.tables:
            if t.qualified in config.tables and config.tables[t.qualified].rows is None:
                config.tables[t.qualified].rows = 100
        _write(args.config, config.to_yaml(schema))
        return "\n".join(f"{t}.{c}: {m}" for t, c, m, _ in done)
    if args.command == "classify":
        found, old = classify.classify(schema), classify.load_lock(lock)
        if args.check:
            classify.strict_gate(schema, lock)
        if args.write:
            classify.write_lock(found, lock)
        return json.dumps({"tables": found, "drift": bool(old is not None and classify.diff(old, found))}, sort_keys=True)
    config = _config(getattr(args, "config", None))
    if args.command == "up":
        config.seed = args.seed or config.seed
        merge_logical_keys(schema, config)
        shape = profile.Profile.from_yaml(_text(args.profile)) if args.profile else None
        frames = generate(spark, schema, config, shape)
        write(spark, frames, args.target, schema)
        return "\n".join(f"{n}: {format_count(df.count())}" for n, df in sorted(frames.items()))
    if args.command == "restore":
        frames = clone.restore(spark, args.file, schema)
        write(spark, frames, args.target, schema)
        return "\n".join(sorted(frames))
    source = source_of(args.source, spark)
    if args.command == "profile":
        _write(args.output, profile.capture(source, schema).to_yaml())
        return args.output
    if args.command == "clone":
        frames = clone.clone(spark, source, schema, config, args.root, strict)
        write(spark, frames, args.target, schema)
        return "\n".join(sorted(frames))
    if args.command == "snapshot":
        got = clone.snapshot(spark, source, schema, config, args.output, args.root)
        return f"{json.dumps(got, sort_keys=True)}\n{format_bytes(FileSystem(spark).size(args.output))}"
    out = clone.mask_in_place(spark, source, schema, config, args.staging, int(args.batches or 8), args.resume, int(args.max_batches) if args.max_batches else None, args.dry_run, args.yes, not args.skip_verify, strict)
    if out.issues:
        print(out.to_json())
        raise SchemaError(f"{len(out.issues)} masked columns failed verification")
    if args.apply and out.complete:
        clone.update_in_place(spark, args.staging, schema, config, args.source) if is_url(args.source) else clone.publish(spark, args.staging, args.source)
    return out.to_json() if args.json else "\n".join(f"{t}: {format_count(x['rows'])} rows" for t, x in sorted(out.tables.items()))


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(run(args, spark))
    except (SchemaError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

__all__ = ["FileSystem", "format_bytes", "format_count", "init_config", "init_report", "main", "plan_report", "run", "schema_of"]
