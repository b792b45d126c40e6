"""Values made from hashes: one column expression for each named generator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.config import EPOCH_END
from ..plans.meta import TEXT_TYPES, ColumnMeta, SchemaError
from .hashing import Sql, h, pick, u, uniform01

# Fixed values of this engine: short word lists that fakes draw from.
FIRST = ["Ada", "Ben", "Cora", "Dario", "Elif", "Femi", "Greta", "Hugo", "Ines", "Jonas", "Kira", "Liam", "Mina", "Noor", "Omar", "Pia"]
LAST = ["Abbott", "Brandt", "Castro", "Dubois", "Eriksen", "Ferrari", "Garcia", "Haddad", "Ito", "Jansen", "Kowalski", "Lindgren", "Mensah", "Novak", "Okafor", "Petrov"]
WORDS = ["amber", "basin", "cedar", "delta", "ember", "field", "grove", "harbor", "island", "juniper", "kettle", "lantern", "meadow", "nectar", "orchard", "pebble"]

START = "2015-01-01"
_DAY = 86_400


def _word(x: Column, words: list[str], draw: int = 0) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (pick(x, len(words), draw) + 1).cast("int"))


def _seconds() -> int:
    import datetime as dt

    return int((dt.date.fromisoformat(EPOCH_END) - dt.date.fromisoformat(START)).days) * _DAY


def _hex(x: Column, a: int, n: int) -> Column:
    return F.substring(x, a, n)


def _uuid(x: Column) -> Column:
    kind = F.element_at(F.array(*map(F.lit, "89ab")), (pick(x, 4, 3) + 1).cast("int"))
    return F.concat(_hex(x, 1, 8), F.lit("-"), _hex(x, 9, 4), F.lit("-4"), _hex(x, 13, 3), F.lit("-"), kind, _hex(x, 16, 3), F.lit("-"), _hex(x, 19, 12))


def _number(x: Column, c: ColumnMeta) -> Column:
    precision, scale = (c.precision, c.scale or 0) if c.precision else (7, 2)
    # one draw has 18 whole digits; more digits than that stay zero
    digits = min(precision, 18)
    out_scale = min(max(scale, 0), 12)
    kept = min(digits, max(precision - scale, 0) + out_scale)
    n = pick(x, 10 ** max(kept, 0)).cast("decimal(18,0)")
    return (n * F.lit(10.0**-out_scale).cast(f"decimal(18,{out_scale})")).cast(f"decimal({precision if c.precision else 38},{scale if c.precision else 18})")


def int_range(c: ColumnMeta) -> tuple[int, int]:
    """Least and greatest generated integer, both included; a check that contradicts itself gives its upper bound."""
    low, high = {"int2": (-1000, 999), "int4": (0, 999_999)}.get(c.domain_of or c.element or c.type, (0, 999_999_999))
    span = high - low
    if c.check_min is not None and c.check_max is not None:
        low, high = c.check_min, c.check_max
    elif c.check_min is not None:
        low, high = c.check_min, c.check_min + span
    elif c.check_max is not None:
        low, high = c.check_max - span, c.check_max
    return (high, high) if low > high else (low, high)


def _int(kind: str) -> Callable[[Column, ColumnMeta], Column]:
    spark = {"int2": "smallint", "int4": "int", "int8": "bigint"}[kind]

    def make(x: Column, c: ColumnMeta) -> Column:
        own = c if (c.domain_of or c.element or c.type) == kind else ColumnMeta(c.name, kind, check_min=c.check_min, check_max=c.check_max)
        low, high = int_range(own)
        return (pick(x, high - low + 1) + low).cast(spark)

    return make


def _sentence(x: Column, c: ColumnMeta) -> Column:
    if (c.domain_of or c.element or c.type) == "citext":
        return _word(x, WORDS)
    # 3 to 6 words out of one hash: a hex digit chooses each
    n = (pick(x, 4) + 3).cast("int")
    words = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(F.array(*map(F.lit, WORDS)), F.conv(F.substr(x, F.lit(40) + i, F.lit(1)), 16, 10).cast("int") + 1))
    return F.array_join(words, " ")


def _phone(x: Column, c: ColumnMeta) -> Column:
    return F.concat(F.lit("+1-555-"), F.lpad(pick(x, 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad(pick(x, 10_000, 1).cast("string"), 4, "0"))


def _time(x: Column, c: ColumnMeta) -> Column:
    s = pick(x, _DAY)
    two = lambda v: F.lpad(F.floor(v).cast("string"), 2, "0")
    return F.concat(two(s / 3600), F.lit(":"), two(s / 60 % 60), F.lit(":"), two(s % 60))


def _moment(x: Column) -> Column:
    return F.timestamp_seconds(F.lit(_epoch(START)) + pick(x, _seconds()))


def _epoch(day: str) -> int:
    import datetime as dt

    return (dt.date.fromisoformat(day) - dt.date(1970, 1, 1)).days * _DAY


def _point(x: Column, draw: int) -> Column:
    return (pick(x, 200, draw) - 100).cast("string")


def _pair(x: Column, a: int, b: int) -> Column:
    return F.concat(F.lit("("), _point(x, a), F.lit(","), _point(x, b), F.lit(")"))


def _vector(x: Column, c: ColumnMeta) -> Column:
    # component i comes from a hash of the hash, so that any dimension has bits enough
    return F.transform(F.sequence(F.lit(1), F.lit(c.vector_dimensions or 3)), lambda i: (pick(F.sha2(F.concat(x, i.cast("string")), 256), 2_000_000) / 1_000_000.0 - 1.0).cast("float"))


GENERATORS: dict[str, Callable[[Column, ColumnMeta], Column]] = {
    "email": lambda x, c: F.concat(F.lower(_word(x, FIRST)), F.lit("."), F.lower(_word(x, LAST, 1)), pick(x, 100_000, 2).cast("string"), F.lit("@example.com")),
    "phone": _phone,
    "first_name": lambda x, c: _word(x, FIRST),
    "last_name": lambda x, c: _word(x, LAST, 1),
    "person_name": lambda x, c: F.concat_ws(" ", _word(x, FIRST), _word(x, LAST, 1)),
    "lorem_word": _sentence,
    "bool": lambda x, c: pick(x, 2) == 1,
    "int2_range": _int("int2"),
    "int4_range": _int("int4"),
    "int8_range": _int("int8"),
    "numeric": _number,
    "float4": lambda x, c: (uniform01(x) * 1000).cast("float"),
    "float8": lambda x, c: uniform01(x) * 1000,
    "uuid": lambda x, c: _uuid(x),
    "timestamp": lambda x, c: _moment(x).cast("timestamp_ntz"),
    "timestamptz": lambda x, c: _moment(x),
    "date": lambda x, c: _moment(x).cast("date"),
    "json": lambda x, c: F.concat(F.lit('{"note":"'), _word(x, WORDS), F.lit('"}')),
    "bytea": lambda x, c: F.unhex(F.substr(x, F.lit(1), ((pick(x, 12, 3) + 4) * 2).cast("int"))),
    "inet": lambda x, c: F.concat_ws(".", *[pick(x, 256, k).cast("string") for k in range(4)]),
    "oid": lambda x, c: pick(x, 1 << 32),
    "interval": lambda x, c: F.concat((pick(x, 14 * _DAY + 1) - 7 * _DAY).cast("string"), F.lit(" seconds")),
    "time": _time,
    "tsvector": lambda x, c: F.array_join(F.transform(F.sequence(F.lit(1), (pick(x, 4) + 1).cast("int")), lambda i: F.concat(F.lit("'"), F.element_at(F.array(*map(F.lit, WORDS)), F.conv(F.substr(x, F.lit(40) + i, F.lit(1)), 16, 10).cast("int") + 1), F.lit("':"), i.cast("string"))), " "),
    "point": lambda x, c: _pair(x, 0, 1),
    "line": lambda x, c: F.concat(F.lit("{"), (pick(x, 100) + 1).cast("string"), F.lit(","), _point(x, 1), F.lit(","), _point(x, 2), F.lit("}")),
    "lseg": lambda x, c: F.concat(F.lit("["), _pair(x, 0, 1), F.lit(","), _pair(x, 2, 3), F.lit("]")),
    "box": lambda x, c: F.concat(_pair(x, 0, 1), F.lit(","), _pair(x, 2, 3)),
    "path": lambda x, c: F.concat(F.lit("["), _pair(x, 0, 1), F.lit(","), _pair(x, 2, 3), F.lit("]")),
    "polygon": lambda x, c: F.concat(F.lit("("), _pair(x, 0, 1), F.lit(","), _pair(x, 2, 3), F.lit(","), _pair(x, 1, 2), F.lit(")")),
    "circle": lambda x, c: F.concat(F.lit("<"), _pair(x, 0, 1), F.lit(","), (pick(x, 50, 2) + 1).cast("string"), F.lit(">")),
    "vector": _vector,
}

#: Type to generator: fixed values.
BY_TYPE = {
    "bool": "bool", "int2": "int2_range", "int4": "int4_range", "int8": "int8_range", "numeric": "numeric", "float4": "float4", "float8": "float8",
    "uuid": "uuid", "timestamp": "timestamp", "timestamptz": "timestamptz", "date": "date", "json": "json", "jsonb": "json", "bytea": "bytea",
    "inet": "inet", "cidr": "inet", "oid": "oid", "interval": "interval", "time": "time", "timetz": "time", "tsvector": "tsvector", "point": "point",
    "line": "line", "lseg": "lseg", "box": "box", "path": "path", "polygon": "polygon", "circle": "circle", "vector": "vector",
}


def register_generator(name: str, make: Callable[[Column, ColumnMeta], Column]) -> None:
    """make(hash column, column metadata) gives the value's expression."""
    GENERATORS[name] = make


def by_name(name: str) -> str | None:
    """Generator that a text column's name suggests; the first rule that holds."""
    n = name.lower()
    for part in ("email", "phone"):
        if part in n:
            return part
    if n in ("first_name", "firstname"):
        return "first_name"
    if n in ("last_name", "lastname", "surname"):
        return "last_name"
    return "person_name" if n in ("name", "full_name") or n.endswith("_name") else None


def value(c: ColumnMeta, seed: str, table: str, rid: Column, override: str | None = None, salt: str = "") -> Column:
    """The generated value of a column for the row that rid names."""
    return value_from(h(seed, table, c.name, rid, salt), c, override)


def value_from(x: Column, c: ColumnMeta, override: str | None = None) -> Column:
    if override is not None:
        if override not in GENERATORS:
            raise SchemaError(f"column {c.name}: unknown generator {override}")
        return _fit(GENERATORS[override](x, c), c)
    if c.check_null_escape:
        return F.lit(None)
    if c.check_allowed or c.enum and c.type == "enum":
        allowed = [v for v in c.enum if c.check_allowed is None or v in c.check_allowed] if c.enum and c.type == "enum" else c.check_allowed
        if allowed:
            return F.element_at(F.array(*map(F.lit, allowed)), (pick(x, len(allowed)) + 1).cast("int"))
    if c.check_like_prefix is not None:
        return F.concat(F.lit(c.check_like_prefix), F.substring(x, 1, 6))
    if c.text_like and (name := by_name(c.name)):
        return _fit(GENERATORS[name](x, c), c)
    if c.type == "array":
        inner = ColumnMeta(c.name, c.element or "text", enum=c.enum, max_length=c.max_length, precision=c.precision, scale=c.scale)
        if inner.enum:
            inner.type = "enum"
        return F.transform(F.sequence(F.lit(1), (pick(x, 3, 3) + 1).cast("int")), lambda i: value_from(F.sha2(F.concat(x, i.cast("string")), 256), inner))
    if c.composite:
        if c.nullable:
            return F.lit(None)
        raise SchemaError(f"column {c.name}: composite types can't be generated and the column takes no null")
    return _fit(GENERATORS[BY_TYPE.get(c.domain_of or c.type, "lorem_word")](x, c), c)


def _fit(made: Column, c: ColumnMeta) -> Column:
    return F.left(made, F.lit(c.max_length)) if c.max_length and (c.text_like or (c.domain_of or c.type) not in BY_TYPE) and c.type not in ("array",) else made


class FakeSql:
    """DuckDB text of the generators that masks use most, for oracles."""

    @staticmethod
    def word(x: str, words: list[str], draw: int = 0) -> str:
        return f"([{', '.join(repr(w) for w in words)}])[{Sql.pick(x, len(words), draw)} + 1]"

    @classmethod
    def person_name(cls, x: str) -> str:
        return f"{cls.word(x, FIRST)} || ' ' || {cls.word(x, LAST, 1)}"

    @classmethod
    def email(cls, x: str) -> str:
        return f"lower({cls.word(x, FIRST)}) || '.' || lower({cls.word(x, LAST, 1)}) || CAST({Sql.pick(x, 100_000, 2)} AS VARCHAR) || '@example.com'"

    @classmethod
    def phone(cls, x: str) -> str:
        return f"'+1-555-' || lpad(CAST({Sql.pick(x, 1000)} AS VARCHAR), 3, '0') || '-' || lpad(CAST({Sql.pick(x, 10_000, 1)} AS VARCHAR), 4, '0')"


__all__ = ["BY_TYPE", "FIRST", "GENERATORS", "LAST", "TEXT_TYPES", "WORDS", "FakeSql", "by_name", "int_range", "register_generator", "u", "value", "value_from"]
