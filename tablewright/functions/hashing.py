"""The only source of randomness: SHA-256 of a seed and a row's identity, as column expressions.

A value is a pure function of (seed, table, column, row identity, salt), so it
doesn't depend on partitions, retries or the order of execution, and DuckDB
can compute the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUL = "\0"
SPACE = float(1 << 60)


def canon(column: Column, kind: T.DataType | None = None) -> Column:
    """The text form that hashes and identities are made from."""
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(column))
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(column)
    return column.cast("string")


def h(seed: str, table: str, column: str, rid: Column, salt: str = "") -> Column:
    """64 hex digits; rid must not be null."""
    head = NUL.join([seed, table, column]) + NUL
    return F.sha2(F.concat(F.lit(head), rid, F.lit(NUL + salt)), 256)


def u(hashed: Column, draw: int = 0) -> Column:
    """60 bits of a hash, as a non-negative long; draws 0 to 3 don't overlap."""
    return F.conv(F.substring(hashed, 15 * draw + 1, 15), 16, 10).cast("long")


def pick(hashed: Column, n, draw: int = 0) -> Column:
    return F.pmod(u(hashed, draw), n if isinstance(n, Column) else F.lit(n).cast("long"))


def uniform01(hashed: Column, draw: int = 0) -> Column:
    return u(hashed, draw).cast("double") / SPACE


def row_identity(df: DataFrame, columns: list[str]) -> Column:
    """Canonical text of the identity columns, joined by NUL; a null part is empty text."""
    parts = [F.coalesce(canon(F.col(f"`{c}`"), df.schema[c].dataType), F.lit("")) for c in columns]
    return F.concat_ws(NUL, *parts)


class Sql:
    """The same expressions as DuckDB text, for oracles."""

    @staticmethod
    def h(seed: str, table: str, column: str, rid: str, salt: str = "") -> str:
        return f"sha256('{seed}' || chr(0) || '{table}' || chr(0) || '{column}' || chr(0) || {rid} || chr(0) || '{salt}')"

    @staticmethod
    def u(hashed: str, draw: int = 0) -> str:
        return f"CAST('0x' || substr({hashed}, {15 * draw + 1}, 15) AS BIGINT)"

    @classmethod
    def pick(cls, hashed: str, n, draw: int = 0) -> str:
        return f"({cls.u(hashed, draw)} % {n})"
