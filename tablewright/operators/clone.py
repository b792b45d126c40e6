"""Clone, hybrid clone, snapshot, restore, and masking in place."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.config import Config, merge_logical_keys, validate_hybrid
from ..plans.meta import ColumnMeta, SchemaError, SchemaMeta, TableMeta
from ..sources.io import FileSystem, Source, next_values, update_jdbc
from . import classify, mask
from .constraints import verify_masked
from .generate import Generator
from .subset import MOST_ROWS, subset

VERSION = 1


def _columns(t: TableMeta) -> list[str]:
    """A clone carries all columns but those that are computed from others."""
    return [c.name for c in t.columns if c.stored_generated is None]


def clone(spark: SparkSession, source: Source, schema: SchemaMeta, config: Config, root: str | None = None, strict_lock: str | None = None, most_rows: int | None = MOST_ROWS) -> dict[str, DataFrame]:
    """{table: masked rows}: of the whole source, or of the subset that `root` names. Tables with strategy `generate` get synthetic rows that refer to the masked parents; their real rows are never read."""
    if strict_lock is not None:
        classify.strict_gate(schema, strict_lock)
    merge_logical_keys(schema, config)
    mask.validate(schema, config)
    validate_hybrid(schema, config)
    made = {t.qualified for t in schema.tables if config.table(t.qualified).strategy == "generate"}
    real = SchemaMeta([t for t in schema.tables if t.qualified not in made])
    if root is not None:
        rows = subset(source, real, root, most_rows)
        rows = {n: df.select(*[c for c in _columns(schema[n]) if c in df.columns]) for n, df in rows.items()}
    else:
        rows = {t.qualified: source.scan(t, _columns(t)) for t in real.tables}
    out = {n: mask.mask_table(df, schema[n], config) for n, df in rows.items()}
    if made:
        gen = Generator(spark, schema, config, parents=out)
        out |= {n: df for n, df in gen.run(made).items() if n in made}
    return out


def snapshot(spark: SparkSession, source: Source, schema: SchemaMeta, config: Config, path: str, root: str | None = None, compression: str = "gzip") -> dict:
    """Masked tables as Parquet, with a manifest that is written last: a folder without one isn't a snapshot."""
    if any(config.table(t.qualified).strategy == "generate" for t in schema.tables):
        raise SchemaError("a snapshot holds real, masked rows; tables with strategy generate can't be in it")
    frames = clone(spark, source, schema, config, root)
    for name, df in frames.items():
        df.write.option("compression", compression).parquet(f"{path}/tables/{name}")
    written = {n: spark.read.parquet(f"{path}/tables/{n}") for n in frames}
    manifest = {"version": VERSION, "tables": {n: {"columns": df.columns, "rows": df.count()} for n, df in written.items()}, "next_values": json.loads(next_values(written, schema))}
    FileSystem(spark).write(f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def restore(spark: SparkSession, path: str, target: SchemaMeta) -> dict[str, DataFrame]:
    """{table: rows} with the target's column order; a table that the snapshot lacks is empty. Columns must be the same sets."""
    fs = FileSystem(spark)
    if not fs.exists(f"{path}/manifest.json"):
        raise SchemaError(f"{path} is no snapshot: it has no manifest")
    manifest = json.loads(fs.read(f"{path}/manifest.json"))
    if manifest.get("version") != VERSION:
        raise SchemaError(f"snapshot version {manifest.get('version')} can't be read, only {VERSION}")
    out = {}
    for t in target.tables:
        entry, want = manifest["tables"].get(t.qualified), _columns(t)
        if entry is None:
            out[t.qualified] = spark.createDataFrame([], T.StructType([T.StructField(c, T._parse_datatype_string(spark_type(t.column(c)))) for c in want]))
        else:
            check_columns(t, entry["columns"], want)
            out[t.qualified] = spark.read.parquet(f"{path}/tables/{t.qualified}").select(*[f"`{c}`" for c in want])
    return out


def spark_type(c: ColumnMeta) -> str:
    """The type of a column's values in a DataFrame; text for those without one of their own."""
    kind = c.domain_of or c.type
    if kind == "array":
        return f"array<{spark_type(ColumnMeta(c.name, c.element or 'text', precision=c.precision, scale=c.scale))}>"
    if kind == "numeric":
        return f"decimal({min(c.precision, 38)},{min(c.scale or 0, 38)})" if c.precision else "decimal(38,18)"
    own = {"bool": "boolean", "int2": "smallint", "int4": "int", "int8": "bigint", "oid": "bigint", "float4": "float", "float8": "double", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "bytea": "binary", "vector": "array<float>"}
    return own.get(kind, "string")


def check_columns(t: TableMeta, have: list[str], want: list[str]) -> None:
    if missing := sorted(set(want) - set(have)):
        raise SchemaError(f"{t.qualified}: the snapshot lacks column {', '.join(missing)}")
    if extra := sorted(set(have) - set(want)):
        raise SchemaError(f"{t.qualified}: the target lacks column {', '.join(extra)}")


# ------------------------------------------------------------- masking in place
@dataclass
class Report:
    tables: dict[str, dict] = field(default_factory=dict)
    issues: list[dict] = field(default_factory=list)
    complete: bool = True

    def to_json(self) -> str:
        return json.dumps({"tables": self.tables, "issues": self.issues, "complete": self.complete}, sort_keys=True)


def plan_in_place(schema: SchemaMeta, config: Config) -> dict[str, list[str]]:
    """{table: masked columns} of the tables with work; each needs a primary key to cut batches by."""
    out = {}
    for t in schema.tables:
        work = [c.name for c in t.columns if config.column(t.qualified, c.name).json_paths or mask.strategy(t, c, config) != "none"]
        if work and not t.primary_key:
            raise SchemaError(f"{t.qualified} has no primary key; masking in place needs one")
        if work:
            out[t.qualified] = work
    return out


def _fingerprint(t: TableMeta, config: Config, columns: list[str]) -> str:
    """What decides a table's masked values: a run may only go on where this is the same."""
    own = {c: vars(config.column(t.qualified, c)) | {"way": mask.strategy(t, t.column(c), config), "type": t.column(c).type, "max_length": t.column(c).max_length} for c in columns}
    return hashlib.sha256(json.dumps([config.seed, t.primary_key, own], sort_keys=True).encode()).hexdigest()


def mask_in_place(spark: SparkSession, source: Source, schema: SchemaMeta, config: Config, staging: str, batches: int = 8, resume: bool = False, max_batches: int | None = None, dry_run: bool = False, confirm: bool = False, verify: bool = True, strict_lock: str | None = None) -> Report:
    """Masks every table with work into `staging`, batch by batch; the source isn't touched until the caller swaps the folders (`publish`) or writes the keyed updates.

    A batch is the rows whose key hashes to its number. A pass reads the table once, for all batches that are due (up to `max_batches` in a
    run), writes them into a folder of its own and is entered in the manifest when it is whole, so a resumed run masks each row exactly
    once: it reads the immutable source and passes by the batches that are entered. It must have the seed, masks and keys of the runs before.
    """
    if strict_lock is not None:
        classify.strict_gate(schema, strict_lock)
    merge_logical_keys(schema, config)
    mask.validate(schema, config)
    plan, out, fs = plan_in_place(schema, config), Report(), FileSystem(spark)
    if dry_run:
        out.tables = {n: {"columns": cols, "rows": source.scan(schema[n], schema[n].primary_key).count()} for n, cols in plan.items()}
        out.complete = False
        return out
    if not confirm:
        raise SchemaError("masking in place was not confirmed")
    at = f"{staging}/manifest.json"
    done: dict[str, dict] = json.loads(fs.read(at)) if fs.exists(at) else {}
    if done and not resume:
        raise SchemaError(f"{staging} has existing progress; resume it or choose another folder")
    for name, entry in done.items():
        if name not in plan or entry["masks"] != _fingerprint(schema[name], config, plan[name]):
            raise SchemaError(f"{name}: its seed, masks or key are other ones than in the run to resume")
    ran = 0
    for name in sorted(plan):
        t = schema[name]
        entry = done.setdefault(name, {"passes": {}, "of": batches, "completed": False, "masks": _fingerprint(t, config, plan[name])})
        if entry["completed"]:
            continue
        df = source.scan(t)
        entered = {k for own in entry["passes"].values() for k in own}
        due = [k for k in range(entry["of"]) if k not in entered]
        now = due if max_batches is None else due[: max(0, max_batches - ran)]
        if now:
            folder = f"{staging}/{name}/pass-{uuid.uuid4().hex}"
            number = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in t.primary_key]), F.lit(entry["of"]))
            mask.mask_table(df.where(number.isin(now)) if len(now) < entry["of"] else df, t, config).write.parquet(folder)
            entry["passes"][folder] = now
            fs.write(at, json.dumps(done, sort_keys=True))
            ran += len(now)
        if len(now) < len(due):
            out.complete = False
            return out
        masked = staged(spark, staging, name)
        before, after = df.count(), masked.count()
        if before != after:
            raise SchemaError(f"{name}: {before} rows were read and {after} written")
        entry["completed"] = True
        fs.write(at, json.dumps(done, sort_keys=True))
        out.tables[name] = {"columns": plan[name], "rows": after}
        if verify:
            found = verify_masked(masked, t, config).where("issues > 0").collect()  # at most one row for each column
            out.issues += [{"table": name, "column": r["column_name"], "mask": r["mask"], "issues": r["issues"]} for r in found]
    return out


def staged(spark: SparkSession, staging: str, table: str) -> DataFrame:
    """A staged table: exactly the passes that the manifest enters."""
    entry = json.loads(FileSystem(spark).read(f"{staging}/manifest.json"))[table]
    return spark.read.parquet(*sorted(entry["passes"]))


def _completed(spark: SparkSession, staging: str) -> list[str]:
    done = json.loads(FileSystem(spark).read(f"{staging}/manifest.json"))
    if open_ := sorted(n for n, entry in done.items() if not entry["completed"]):
        raise SchemaError(f"{', '.join(open_)}: masking isn't complete")
    return sorted(done)


def publish(spark: SparkSession, staging: str, folder: str) -> dict[str, str]:
    """Puts the staged tables in the place of the source's Parquet; {table: where the old one went}. Each table is written beside the old one first, so two renames are all that a crash can come between."""
    fs, out = FileSystem(spark), {}
    for name in _completed(spark, staging):
        target = next((p for p in (f"{folder}/{name}.parquet", f"{folder}/{name.rpartition('.')[2]}.parquet") if fs.exists(p)), f"{folder}/{name}.parquet")
        mark = uuid.uuid4().hex[:12]
        staged(spark, staging, name).write.parquet(f"{target}.new-{mark}")
        out[name] = f"{target}.before-{mark}"
        if fs.exists(target):
            fs.rename(target, out[name])
        fs.rename(f"{target}.new-{mark}", target)
    return out


def update_in_place(spark: SparkSession, staging: str, schema: SchemaMeta, config: Config, url: str, **options: str) -> dict[str, list[str]]:
    """Writes the staged masks to the database by keyed updates, a transaction for each table; {table: columns}."""
    plan, out = plan_in_place(schema, config), {}
    for name in _completed(spark, staging):
        update_jdbc(staged(spark, staging, name), url, name, schema[name].primary_key, plan[name], **options)
        out[name] = plan[name]
    return out


def keyset_page(df: DataFrame, key: list[str], after: list | None, n: int) -> DataFrame:
    """The next n rows behind a key, in key order. Each key part is compared only where those before it are equal."""
    if after is not None:
        condition = F.lit(False)
        for i in range(len(key)):
            same = F.lit(True)
            for c, v in zip(key[:i], after[:i]):
                same = same & (F.col(f"`{c}`") == F.lit(v))
            condition = condition | (same & (F.col(f"`{key[i]}`") > F.lit(after[i])))
        df = df.where(condition)
    return df.orderBy(*[f"`{c}`" for c in key]).limit(n)


def merge_updates(df: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """df with the values that `changes` has for its keys; its other columns stay."""
    new = [c for c in changes.columns if c not in key]
    named = changes.select(*[F.col(f"`{c}`") for c in key], F.struct(*[F.col(f"`{c}`") for c in new]).alias("__new"))
    met = df.join(named, key, "left")
    return met.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.`{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])
