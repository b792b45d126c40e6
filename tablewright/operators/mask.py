"""Deterministic masking: one select over a table's original columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import generators
from ..functions.hashing import NUL, canon, h, pick, row_identity
from ..plans.config import MASKS, ColumnConfig, Config
from ..plans.meta import ColumnMeta, SchemaError, SchemaMeta, TableMeta
from .classify import sensitivity

JSON = {"json", "jsonb"}
HASH_LENGTH = 31  # masked_ and 24 hex digits
APART = 17  # a dash and 16 hex digits of the row's hash, which keep a unique column's fakes apart
#: Literals that redact a column which takes no null: fixed values.
_ZERO = {"bool": False, "int2": 0, "int4": 0, "int8": 0, "numeric": 0, "float4": 0.0, "float8": 0.0}
_TEXT_REDACTABLE = generators.TEXT_TYPES


def strategy(t: TableMeta, c: ColumnMeta, config: Config) -> str:
    """Keys stay; else the configured mask; else a fake where the name is sensitive."""
    own = config.column(t.qualified, c.name)
    if t.is_key(c.name):
        return "none"
    return own.mask or ("fake" if sensitivity(c.name) and not own.json_paths else "none")


def validate(schema: SchemaMeta, config: Config) -> None:
    """Everything that masking can't carry out, before any read."""
    for t in schema.tables:
        for name, own in sorted((config.tables.get(t.qualified).columns if t.qualified in config.tables else {}).items()):
            c, at = t.column(name), f"{t.qualified}.{name}"
            unique = any(name in u.columns for u in t.unique)
            if own.json_paths:
                if t.is_key(name):
                    raise SchemaError(f"{at}: json_paths on a key column")
                if c.type not in JSON:
                    raise SchemaError(f"{at}: json_paths on a column that isn't JSON")
                if own.mask:
                    raise SchemaError(f"{at}: json_paths and mask exclude each other")
                if any(not part for p in own.json_paths for part in p.split(".")):
                    raise SchemaError(f"{at}: a JSON path has an empty part")
            if own.mask and own.mask not in MASKS:
                raise SchemaError(f"{at}: unknown mask {own.mask}")
            if own.generator and own.generator not in generators.GENERATORS:
                raise SchemaError(f"{at}: unknown generator {own.generator}")
            if own.mask and own.mask != "none" and t.is_key(name):
                raise SchemaError(f"{at}: a key column can't be masked; its values are what rows refer to")
            if own.mask == "redact" and unique:
                raise SchemaError(f"{at}: redact would make a unique column's values equal")
            if own.mask == "redact" and not c.nullable:
                if c.type not in _TEXT_REDACTABLE | JSON | _ZERO.keys() | {"date", "timestamp", "timestamptz", "array"}:
                    raise SchemaError(f"{at}: there is no redacted value of type {c.type}, and the column takes no null")
                if c.max_length is not None and c.max_length < len("REDACTED"):
                    raise SchemaError(f"{at}: REDACTED is longer than {c.max_length} characters")
            if own.mask == "hash":
                if not c.text_like:
                    raise SchemaError(f"{at}: hash gives text, the column is {c.type}")
                if c.max_length is not None and c.max_length < HASH_LENGTH:
                    raise SchemaError(f"{at}: a hash is {HASH_LENGTH} characters long, the column holds {c.max_length}")


    for t in schema.tables:
        for c in t.columns:
            if strategy(t, c, config) == "fake" and any(c.name in u.columns for u in t.unique):
                at = f"{t.qualified}.{c.name}"
                if c.text_like and c.max_length is not None and c.max_length <= APART:
                    raise SchemaError(f"{at}: fakes of a unique column end in {APART} characters of a hash, the column holds {c.max_length}")
                if not c.text_like and c.type != "uuid" and any(u.columns == [c.name] for u in t.unique):
                    raise SchemaError(f"{at}: fakes of type {c.type} could collide in a unique column")


def hashed(column: Column, seed: str, kind: T.DataType | None = None) -> Column:
    """Equal values have equal hashes in any table and column, so masked columns still join."""
    return F.concat(F.lit("masked_"), F.substring(F.sha2(F.concat(F.lit(seed + NUL), canon(column, kind)), 256), 1, 24))


def redacted(c: ColumnMeta, kind: T.DataType) -> Column:
    if c.nullable:
        return F.lit(None).cast(kind)
    if c.type in _ZERO:
        return F.lit(_ZERO[c.type]).cast(kind)
    if c.type in ("date", "timestamp", "timestamptz"):
        return F.lit("1970-01-01").cast(kind)
    if c.type in JSON:
        return F.lit("{}")
    if c.type == "array":
        return F.array().cast(kind)
    return F.lit("REDACTED")


def masked(df: DataFrame, t: TableMeta, c: ColumnMeta, config: Config, rid: Column) -> Column:
    """A column's masked expression; null stays null under every strategy."""
    col, kind = F.col(f"`{c.name}`"), df.schema[c.name].dataType
    own = config.column(t.qualified, c.name)
    if own.json_paths:
        return mask_json(col, own.json_paths, config.seed, t.qualified, c.name, rid)
    way = strategy(t, c, config)
    if way == "none":
        return col
    if way == "hash":
        new = hashed(col, config.seed, kind)
    elif way == "redact":
        new = redacted(c, kind)
    else:
        new = generators.value(c, config.seed, t.qualified, rid, own.generator)
        if any(c.name in u.columns for u in t.unique) and c.text_like:
            # fakes draw with replacement; a piece of the row's own hash keeps a unique column unique
            new = F.left(new, F.lit(c.max_length - APART)) if c.max_length is not None else new
            new = F.concat(new, F.lit("-"), F.substring(h(config.seed, t.qualified, c.name, rid, "unique"), 1, 16))
        new = new.cast(kind)
    return F.when(col.isNull(), F.lit(None).cast(kind)).otherwise(new)


def mask_table(df: DataFrame, t: TableMeta, config: Config) -> DataFrame:
    """All masks of a table in one select; identities come from the unmasked values."""
    rid = row_identity(df, [c for c in t.identity() if c in df.columns])
    known = {c.name: c for c in t.columns}
    return df.select(*[masked(df, t, known[n], config, rid).alias(n) if n in known else F.col(f"`{n}`") for n in df.columns])


# ------------------------------------------------------------------------ JSON
class _Number(str):
    """A number as a document spells it."""

    __slots__ = ()


def _paths_udf(paths: dict[str, str], seed: str, where: str):
    """The one pandas function, for documents of any shape. Order of keys and spelling of numbers elsewhere in the document stay."""
    import hashlib
    import json

    def plain(x):
        """x with numbers as numbers, so that a hash doesn't depend on their spelling."""
        if isinstance(x, _Number):
            return json.loads(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    def text_of(x) -> str:
        return json.dumps(plain(x), separators=(",", ":"), ensure_ascii=False, sort_keys=True, default=str)

    def written(x) -> str:
        if isinstance(x, _Number):
            return str(x)
        if isinstance(x, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{written(v)}" for k, v in x.items()) + "}"
        if isinstance(x, list):
            return "[" + ",".join(map(written, x)) + "]"
        return json.dumps(x, ensure_ascii=False)

    def fake(x, rid: str, path: str):
        d = hashlib.sha256(NUL.join([seed, where, path, rid, ""]).encode()).hexdigest()
        n = int(d[:15], 16)
        if isinstance(x, bool):
            return n % 2 == 1
        if isinstance(x, _Number):
            return n % 1_000_000
        if not isinstance(x, str):
            return None
        kind, m = generators.by_name(path.rpartition(".")[2]), int(d[15:30], 16)
        first, last = generators.FIRST[n % len(generators.FIRST)], generators.LAST[m % len(generators.LAST)]
        if kind == "email":
            return f"{first}.{last}{int(d[30:45], 16) % 100_000}@example.com".lower()
        if kind == "phone":
            return f"+1-555-{n % 1000:03d}-{m % 10_000:04d}"
        names = {"first_name": first, "last_name": last, "person_name": f"{first} {last}"}
        return names.get(kind) or generators.WORDS[n % len(generators.WORDS)]

    def change(x, way: str, rid: str, path: str):
        if way == "redact":
            return None
        if way == "hash":
            return "masked_" + hashlib.sha256(NUL.join([seed, where, path, text_of(x)]).encode()).hexdigest()[:24]
        return fake(x, rid, path) if way == "fake" else x

    ordered = sorted(paths.items())

    def one(text, rid):
        if text is None:
            return None
        try:
            doc = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number)
        except ValueError:
            return text
        for path, way in ordered:
            *head, last = path.split(".")
            at = doc
            for part in head:
                at = at.get(part) if isinstance(at, dict) else None
            if isinstance(at, dict) and last in at:
                at[last] = change(at[last], way, rid, path)
        return written(doc)

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series, rids: pd.Series) -> pd.Series:
        return pd.Series([one(t, r) for t, r in zip(texts, rids)], dtype=object)

    return run


def mask_json(col: Column, paths: dict[str, str], seed: str, table: str, column: str, rid: Column) -> Column:
    """Masks leaves at dot paths through objects; a path that isn't there changes nothing."""
    return _paths_udf(paths, seed, f"{table}{NUL}{column}")(col, rid)


def mask_flat_json(col: Column, leaves: dict[str, str], keys: dict[str, str], seed: str, table: str, column: str, rid: Column) -> Column:
    """The same for documents of one declared, flat shape, without Python: keys gives each key's type (string, number or bool), in order."""
    parts = []
    for key, kind in keys.items():
        raw = F.get_json_object(col, f"$.{key}")
        text = F.to_json(F.array(raw)) if kind == "string" else raw
        text = F.regexp_replace(text, r"^\[|\]$", "") if kind == "string" else text
        way = leaves.get(key, "none")
        if way == "redact":
            new = F.lit("null")
        elif way == "hash":
            new = F.concat(F.lit('"masked_'), F.substring(F.sha2(F.concat(F.lit(NUL.join([seed, table, column, key, ""])), text), 256), 1, 24), F.lit('"'))
        elif way == "fake":
            x = h(seed, table, column + NUL + key, rid)
            new = F.concat(F.lit('"'), generators._word(x, generators.WORDS), F.lit('"')) if kind == "string" else pick(x, 1_000_000).cast("string") if kind == "number" else F.when(pick(x, 2) == 1, "true").otherwise("false")
        else:
            new = text
        parts.append(F.when(raw.isNotNull(), F.concat(F.lit(f'"{key}":'), new)))
    return F.when(col.isNull(), F.lit(None)).otherwise(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


def json_keys(df: DataFrame, column: str, depth: int = 2, sample: int = 200) -> list[str]:
    """Dot paths of the object keys in up to `sample` documents, `depth` levels deep; arrays aren't entered. The sample is the feature: it proposes paths for a configuration."""
    import json

    found: set[str] = set()

    def walk(x, prefix: str, left: int) -> None:
        if isinstance(x, dict) and left:
            for k, v in x.items():
                found.add(prefix + k)
                walk(v, f"{prefix}{k}.", left - 1)

    for (text,) in df.where(F.col(column).isNotNull()).select(column).limit(sample).collect():
        try:
            walk(json.loads(text), "", depth)
        except ValueError:
            continue
    return sorted(found)


def sensitive_keys(df: DataFrame, column: str, sample: int = 200) -> list[tuple[str, str]]:
    """(path, kind) of the keys whose names are sensitive, at the top and on two levels below, in up to `sample` documents; values aren't kept."""
    return [(path, kind) for path in json_keys(df, column, 3, sample) if (kind := sensitivity(path.rpartition(".")[2]))]


HASH_PATTERN = re.compile(r"^masked_[0-9a-f]{24}$")
__all__ = ["ColumnConfig", "hashed", "json_keys", "mask_flat_json", "mask_json", "mask_table", "masked", "redacted", "sensitive_keys", "strategy", "validate"]
