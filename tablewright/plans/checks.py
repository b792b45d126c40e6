"""Reads narrow shapes of CHECK constraints, so that generated values satisfy them.

Input is the constraint's text, as `CHECK ((...))` or the bare condition. Shapes
that aren't recognised narrow nothing; they still are checked afterwards.
"""

from __future__ import annotations

import re

from .meta import SchemaMeta, TableMeta

_NAME = r'"?(?P<col>[A-Za-z_][\w$]*)"?'
_CAST = r"(?:::[\w .\[\]\"]+(?:\(\d+\))?)?"
_BOUND = re.compile(rf"^\(?{_NAME}\)?{_CAST}\s*(?P<op>>=|<=|=|>|<)\s*\(?'?(?P<n>-?\d+)'?\)?{_CAST}$")
_ANY = re.compile(rf"^\(*{_NAME}\)?{_CAST}\)*\s*=\s*ANY\s*\(+(?:ARRAY)?\[(?P<list>.*)\][^\]]*\)+$", re.S | re.I)
_IN = re.compile(rf"^\(*{_NAME}\)?{_CAST}\s+IN\s*\((?P<list>.*)\)$", re.S | re.I)
_EQUAL = re.compile(rf"^\(*{_NAME}\)?{_CAST}\s*=\s*'(?P<v>(?:[^']|'')*)'{_CAST}$")
_NULL = re.compile(rf"^\(*{_NAME}\)*\s+IS\s+NULL$", re.I)
_LIKE = re.compile(rf"^\(*{_NAME}\)?{_CAST}\)*\s*(?:~~|LIKE)\s*'(?P<p>(?:[^']|'')*)'{_CAST}$", re.I)
_LITERAL = re.compile(r"'((?:[^']|'')*)'")


def condition(text: str) -> str:
    """The condition without CHECK and without brackets around the whole."""
    out = re.sub(r"^\s*CHECK\s*", "", text.strip(), flags=re.I).strip()
    while out.startswith("(") and _closing(out, 0) == len(out) - 1:
        out = out[1:-1].strip()
    return out


def _closing(text: str, at: int) -> int:
    depth, quoted = 0, False
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "()":
            depth += 1 if c == "(" else -1
            if depth == 0:
                return i
    return -1


def alternatives(text: str) -> list[str]:
    """Parts of the condition that a top-level OR joins."""
    body, parts, at, depth, quoted, i = condition(text), [], 0, 0, False, 0
    while i < len(body):
        c = body[i]
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if depth == 0 and (m := re.match(r"\s+OR\s+", body[i:], re.I)):
                parts.append(body[at:i])
                i += m.end()
                at = i
                continue
        i += 1
    if not parts:
        return [body]
    return [x for p in [*parts, body[at:]] for x in alternatives(p)]


def integer_bounds(text: str) -> tuple[str, int | None, int | None] | None:
    """(column, least, greatest) of a single comparison with an integer; an equality has both. A quoted number is one only by its cast to a number."""
    m = _BOUND.match(condition(text))
    if not m:
        return None
    n, op = int(m["n"]), m["op"]
    if op == "=":
        return None if "'" in text and not re.search(r"'::(?:smallint|integer|bigint|numeric|int[248])", text) else (m["col"], n, n)
    return (m["col"], n + (op == ">"), None) if op[0] == ">" else (m["col"], None, n - (op == "<"))


def allowed_values(text: str) -> tuple[str, list[str]] | None:
    """(column, values) of = ANY(ARRAY[...]), IN (...) or = 'x'."""
    body = condition(text)
    if m := _EQUAL.match(body):
        return m["col"], [m["v"].replace("''", "'")]
    m = _ANY.match(body) or _IN.match(body)
    values = [v.replace("''", "'") for v in _LITERAL.findall(m["list"])] if m else []
    return (m["col"], values) if values else None


def null_escapes(text: str) -> list[str]:
    """Columns of which the condition lets a null through by an alternative `col IS NULL`."""
    parts = alternatives(text)
    return [m["col"] for p in parts if (m := _NULL.match(p))] if len(parts) > 1 else []


def like_prefix(text: str) -> tuple[str, str] | None:
    """(column, prefix) of LIKE 'prefix%' with no other wildcard; a backslash makes the next character plain."""
    m = _LIKE.match(condition(text))
    if not m:
        return None
    body, out, i = m["p"].replace("''", "'"), "", 0
    while i < len(body):
        if body[i] == "\\" and i + 1 < len(body):
            out += body[i + 1]
            i += 2
        elif body[i] in "%_":
            return (m["col"], out) if body[i:] == "%" and out else None
        else:
            out += body[i]
            i += 1
    return None


def narrow(table: TableMeta) -> None:
    """Write what the checks say into the table's columns."""
    for check in table.checks:
        text = check.definition
        if (b := integer_bounds(text)) and table.has(b[0]):
            c = table.column(b[0])
            c.check_min = b[1] if c.check_min is None else c.check_min if b[1] is None else max(c.check_min, b[1])
            c.check_max = b[2] if c.check_max is None else c.check_max if b[2] is None else min(c.check_max, b[2])
        if (a := allowed_values(text)) and table.has(a[0]):
            c = table.column(a[0])
            c.check_allowed = a[1] if c.check_allowed is None else [v for v in c.check_allowed if v in a[1]]
        for name in null_escapes(text):
            if table.has(name) and table.column(name).nullable:
                table.column(name).check_null_escape = True
        if (p := like_prefix(text)) and table.has(p[0]):
            table.column(p[0]).check_like_prefix = p[1]


def narrow_all(schema: SchemaMeta) -> None:
    for t in schema.tables:
        narrow(t)
