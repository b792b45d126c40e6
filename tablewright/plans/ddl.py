"""A subset of PostgreSQL's DDL, read into a SchemaMeta.

CREATE TABLE, CREATE TYPE ... AS ENUM / AS (...), CREATE DOMAIN, ALTER TABLE ... ADD
CONSTRAINT, CREATE UNIQUE INDEX (neither partial nor over expressions), and
identity, serial and stored generated columns. Other statements are passed by.
"""

from __future__ import annotations

import re

from .checks import narrow_all
from .meta import CheckMeta, ColumnMeta, ForeignKeyMeta, SchemaMeta, TableMeta, UniqueMeta, narrow_lengths

#: Spellings of types: fixed values.
_TYPES = {
    "integer": "int4", "int": "int4", "int4": "int4", "smallint": "int2", "int2": "int2", "bigint": "int8", "int8": "int8",
    "boolean": "bool", "bool": "bool", "real": "float4", "float4": "float4", "double precision": "float8", "float8": "float8", "float": "float8",
    "numeric": "numeric", "decimal": "numeric", "text": "text", "character varying": "varchar", "varchar": "varchar", "character": "bpchar", "char": "bpchar", "bpchar": "bpchar", "name": "name",
    "timestamp": "timestamp", "timestamp without time zone": "timestamp", "timestamp with time zone": "timestamptz", "timestamptz": "timestamptz",
    "time": "time", "time without time zone": "time", "time with time zone": "timetz", "timetz": "timetz",
}
_SERIAL = {"serial": "int4", "bigserial": "int8", "smallserial": "int2", "serial4": "int4", "serial8": "int8", "serial2": "int2"}
_WORDS = r"(?:NOT\s+NULL|NULL|DEFAULT|PRIMARY\s+KEY|UNIQUE|REFERENCES|CHECK|CONSTRAINT|GENERATED|COLLATE)"


def _name(text: str) -> str:
    text = text.strip()
    return text[1:-1].replace('""', '"') if text.startswith('"') else text.lower()


def _qualified(text: str) -> tuple[str, str]:
    parts = re.findall(r'"[^"]*"|[\w$]+', text)
    return (_name(parts[-2]) if len(parts) > 1 else "public", _name(parts[-1]))


def _split(text: str, mark: str = ",") -> list[str]:
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == mark and depth == 0:
            out.append(text[at:i].strip())
            at = i + 1
    return [x for x in [*out, text[at:].strip()] if x]


def _brackets(text: str, at: int) -> tuple[str, int]:
    """What the bracket at `at` encloses, and the place behind it."""
    depth, quote = 0, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return text[at + 1 : i], i + 1
    return text[at + 1 :], len(text)


#: Quoted text, quoted names, dollar-quoted text and comments, whichever begins first.
_ASIDE = re.compile(r"""[eE]'(?:[^'\\]|\\.|'')*'|'(?:[^']|'')*'|"[^"]*"|\$(?P<tag>\w*)\$.*?\$(?P=tag)\$|--[^\n]*|/\*.*?\*/""", re.S)


def statements(sql: str) -> list[str]:
    """Statements without comments; dollar-quoted text is emptied, other quoted text stays."""

    def keep(m: re.Match) -> str:
        return "" if m[0].startswith(("--", "/*")) else "''" if m[0].startswith("$") else m[0]

    return _split(_ASIDE.sub(keep, sql), ";")


class _Reader:
    def __init__(self) -> None:
        self.tables: dict[str, TableMeta] = {}
        # types by schema and name
        self.enums: dict[tuple[str, str], list[str]] = {}
        self.domains: dict[tuple[str, str], tuple[ColumnMeta, list[str], bool]] = {}
        self.composites: set[tuple[str, str]] = set()

    def kind(self, text: str, column: ColumnMeta) -> None:
        text = text.strip()
        if text.endswith("[]") or re.search(r"\bARRAY\b", text, re.I):
            inner = ColumnMeta(column.name)
            self.kind(re.sub(r"(\[\d*\])+$|\s+ARRAY.*$", "", text, flags=re.I), inner)
            column.type, column.element = "array", inner.type
            column.max_length, column.enum, column.precision, column.scale = inner.max_length, inner.enum, inner.precision, inner.scale
            return
        m = re.match(r"^(.*?)\s*\(([^)]*)\)\s*(.*)$", text, re.S)
        base, args = (f"{m[1]} {m[3]}".strip(), m[2]) if m else (text, "")
        plain = re.sub(r"\s+", " ", base.strip().lower().replace('"', ""))
        short = _qualified(base)[1] if "." in base else plain
        own = _qualified(base) if base.strip() else ("public", "")
        numbers = [int(x) for x in re.findall(r"\d+", args)]
        if short in _SERIAL:
            column.type, column.serial, column.nullable = _SERIAL[short], True, False
        elif short in _TYPES:
            column.type = _TYPES[short]
            if column.type in ("varchar", "bpchar"):
                column.max_length = numbers[0] if numbers else (1 if column.type == "bpchar" else None)
            if column.type == "numeric" and numbers:
                column.precision, column.scale = numbers[0], numbers[1] if len(numbers) > 1 else 0
        elif own in self.enums:
            column.type, column.enum = "enum", self.enums[own]
        elif own in self.domains:
            of, _, nullable = self.domains[own]
            column.type, column.domain_of = "domain", of.type
            column.max_length, column.precision, column.scale, column.enum = of.max_length, of.precision, of.scale, of.enum
            column.nullable &= nullable
        elif own in self.composites:
            column.type, column.composite = "composite", True
        else:
            column.type = short
            if short == "vector":
                column.vector_dimensions = numbers[0] if numbers else None

    def reference(self, text: str, columns: list[str], table: TableMeta, name: str | None) -> None:
        m = re.search(r'REFERENCES\s+((?:"[^"]+"|[\w$]+)(?:\s*\.\s*(?:"[^"]+"|[\w$]+))?)\s*(\()?', text, re.I)
        schema, ref = _qualified(m[1])
        cols = [_name(x) for x in _split(_brackets(text, m.end() - 1)[0])] if m[2] else []
        deferrable = bool(re.search(r"(?<!NOT )DEFERRABLE", text, re.I))
        table.foreign_keys.append(ForeignKeyMeta(name or f"{table.name}_{'_'.join(columns)}_fkey", columns, f"{schema}.{ref}", cols, deferrable, bool(re.search(r"INITIALLY\s+DEFERRED", text, re.I))))

    def constraint(self, text: str, table: TableMeta) -> bool:
        m = re.match(r'^CONSTRAINT\s+("[^"]+"|[\w$]+)\s+(.*)$', text, re.I | re.S)
        name, body = (_name(m[1]), m[2]) if m else (None, text)
        head = re.match(r"^(PRIMARY\s+KEY|UNIQUE|FOREIGN\s+KEY|CHECK|EXCLUDE)\b", body, re.I)
        if not head:
            return False
        word = head[1].upper().split()[0]
        if word == "EXCLUDE":
            return True
        inside, end = _brackets(body, body.index("(")) if "(" in body else ("", len(body))
        if word == "CHECK":
            table.checks.append(CheckMeta(name or f"{table.name}_check{len(table.checks) or ''}", f"CHECK ({inside})"))
            return True
        columns = [_name(x) for x in _split(inside)]
        if word == "PRIMARY":
            table.primary_key = columns
            for c in columns:
                if table.has(c):
                    table.column(c).nullable = False
        elif word == "UNIQUE":
            table.unique.append(UniqueMeta(name or f"{table.name}_{'_'.join(columns)}_key", columns))
        else:
            self.reference(body[end:], columns, table, name)
        return True

    def column(self, text: str, table: TableMeta) -> None:
        m = re.match(r'^("[^"]+"|[\w$]+)\s+(.*)$', text, re.S)
        if not m:
            return
        c, rest = ColumnMeta(_name(m[1])), m[2]
        cut = re.search(rf"\s+{_WORDS}(?![\w$])", " " + rest, re.I)
        kind = rest[: max(0, cut.start() - 1)] if cut else rest
        tail = rest[len(kind) :]
        if re.search(r"\bNOT\s+NULL\b", tail, re.I):
            c.nullable = False
        self.kind(kind, c)
        if re.search(r"GENERATED\s+(ALWAYS|BY\s+DEFAULT)\s+AS\s+IDENTITY", tail, re.I):
            c.identity, c.nullable = True, False
        elif g := re.search(r"GENERATED\s+ALWAYS\s+AS\s*\(", tail, re.I):
            c.stored_generated = _brackets(tail, g.end() - 1)[0]
        if d := re.search(rf"DEFAULT\s+(.*?)(?=\s+{_WORDS}|$)", tail, re.I | re.S):
            c.default = d[1].strip()
            c.serial |= c.default.lower().startswith("nextval(")
        table.columns.append(c)
        if re.search(r"\bPRIMARY\s+KEY\b", tail, re.I):
            table.primary_key, c.nullable = [c.name], False
        if re.search(r"\bUNIQUE\b", tail, re.I):
            table.unique.append(UniqueMeta(f"{table.name}_{c.name}_key", [c.name]))
        for k in re.finditer(r"\bCHECK\s*\(", tail, re.I):
            table.checks.append(CheckMeta(f"{table.name}_{c.name}_check", f"CHECK ({_brackets(tail, k.end() - 1)[0]})"))
        if re.search(r"\bREFERENCES\b", tail, re.I):
            self.reference(tail, [c.name], table, None)
        own = _qualified(re.sub(r"\(.*$", "", kind, flags=re.S)) if re.search(r"[\w$]", kind) else None
        if own in self.domains:
            for text in self.domains[own][1]:
                table.checks.append(CheckMeta(f"{table.name}_{c.name}_domain", re.sub(r"\bVALUE\b", c.name, text)))

    def read(self, text: str) -> None:
        def match(pattern: str):
            return re.match(pattern, text, re.I | re.S)

        if m := match(r'^CREATE\s+TYPE\s+([\w$".]+)\s+AS\s+ENUM\s*\('):
            self.enums[_qualified(m[1])] = [x.strip()[1:-1].replace("''", "'") for x in _split(_brackets(text, m.end() - 1)[0])]
        elif m := match(r'^CREATE\s+TYPE\s+([\w$".]+)\s+AS\s*\('):
            self.composites.add(_qualified(m[1]))
        elif m := match(r'^CREATE\s+DOMAIN\s+([\w$".]+)\s+(?:AS\s+)?(.*)$'):
            rest = m[2]
            cut = re.search(rf"\s+{_WORDS}", rest, re.I)
            of = ColumnMeta("value")
            self.kind(rest[: cut.start()] if cut else rest, of)
            checks = [f"CHECK ({_brackets(rest, k.end() - 1)[0]})" for k in re.finditer(r"\bCHECK\s*\(", rest, re.I)]
            self.domains[_qualified(m[1])] = (of, checks, not re.search(r"NOT\s+NULL", rest, re.I))
        elif m := match(r'^CREATE\s+(?:UNLOGGED\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w$".]+)\s*\('):
            schema, name = _qualified(m[1])
            body, end = _brackets(text, m.end() - 1)
            if re.search(r"\bPARTITION\s+OF\b", text[:end], re.I):
                return
            table = self.tables[f"{schema}.{name}"] = TableMeta(name, schema)
            later = []
            for part in _split(body):
                if re.match(r"^(CONSTRAINT|PRIMARY\s+KEY|UNIQUE|FOREIGN\s+KEY|CHECK|EXCLUDE|LIKE)\b", part, re.I):
                    later.append(part)
                else:
                    self.column(part, table)
            for part in later:
                self.constraint(part, table)
        elif m := match(r'^ALTER\s+TABLE\s+(?:ONLY\s+)?(?:IF\s+EXISTS\s+)?([\w$".]+)\s+(.*)$'):
            table = self.tables.get(".".join(_qualified(m[1])))
            for action in _split(m[2]) if table else []:
                if a := re.match(r"^ADD\s+(.*)$", action, re.I | re.S):
                    self.constraint(a[1], table)
                elif a := re.match(r'^ALTER\s+COLUMN\s+("[^"]+"|[\w$]+)\s+(.*)$', action, re.I | re.S):
                    c = table.column(_name(a[1]))
                    c.serial |= bool(re.match(r"SET\s+DEFAULT\s+nextval", a[2], re.I))
                    c.identity |= bool(re.search(r"AS\s+IDENTITY", a[2], re.I))
                    c.nullable &= not re.match(r"SET\s+NOT\s+NULL", a[2], re.I)
        elif m := match(r'^CREATE\s+UNIQUE\s+INDEX\s+(?:CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?([\w$"]+)?\s*ON\s+(?:ONLY\s+)?([\w$".]+)\s*(?:USING\s+\w+\s*)?\('):
            inside, end = _brackets(text, m.end() - 1)
            columns = [re.sub(r"\s+(ASC|DESC|NULLS\s+\w+|[\w$]+_ops)\b.*$", "", x, flags=re.I) for x in _split(inside)]
            table = self.tables.get(".".join(_qualified(m[2])))
            plain = all(re.match(r'^("[^"]+"|[\w$]+)$', x) for x in columns) and not re.search(r"\bWHERE\b", text[end:], re.I)
            if table and plain and all(table.has(_name(x)) for x in columns):
                table.unique.append(UniqueMeta(_name(m[1] or "unique"), [_name(x) for x in columns]))


def parse_ddl(sql: str) -> SchemaMeta:
    reader = _Reader()
    for s in statements(sql):
        reader.read(s)
    schema = SchemaMeta(list(reader.tables.values()))
    for t in schema.tables:
        for fk in t.foreign_keys:
            parent = reader.tables.get(fk.ref_table)
            if parent and not fk.ref_columns:
                fk.ref_columns = list(parent.primary_key)
    narrow_all(schema)
    narrow_lengths(schema)
    return schema
