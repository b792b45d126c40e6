"""Configurations of two other tools, read into ours."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from ..plans.config import ColumnConfig, Config, TableConfig
from ..plans.meta import SchemaError


@dataclass
class Migration:
    config: Config
    notes: list[str] = field(default_factory=list)


# Transformer names of a Neosync job and what they become: fixed values. (mask, generator, exact)
TRANSFORMERS: dict[str, tuple[str, str | None, bool]] = {
    "passthroughConfig": ("none", None, True),
    "generateSha256hashConfig": ("hash", None, True),
    "generateEmailConfig": ("fake", "email", True),
    "transformEmailConfig": ("fake", "email", True),
    "generateFirstNameConfig": ("fake", "first_name", True),
    "transformFirstNameConfig": ("fake", "first_name", True),
    "generateLastNameConfig": ("fake", "last_name", True),
    "transformLastNameConfig": ("fake", "last_name", True),
    "generateFullNameConfig": ("fake", "person_name", True),
    "transformFullNameConfig": ("fake", "person_name", True),
    "generateBoolConfig": ("fake", "bool", True),
    "generateUuidConfig": ("fake", "uuid", True),
    "transformUuidConfig": ("fake", "uuid", True),
    "generateInt64Config": ("fake", "int8_range", True),
    "transformInt64Config": ("fake", "int8_range", True),
    "generateFloat64Config": ("fake", "float8", True),
    "transformFloat64Config": ("fake", "float8", True),
    "generateUtctimestampConfig": ("fake", "timestamptz", True),
    "generateStringConfig": ("fake", "lorem_word", True),
    "transformStringConfig": ("fake", "lorem_word", True),
    "generateIpAddressConfig": ("fake", "inet", True),
    "generateE164PhoneNumberConfig": ("fake", "phone", True),
    "generateInt64PhoneNumberConfig": ("fake", "phone", True),
    "generateStringPhoneNumberConfig": ("fake", "phone", True),
    "transformE164PhoneNumberConfig": ("fake", "phone", True),
    "transformInt64PhoneNumberConfig": ("fake", "phone", True),
    "transformPhoneNumberConfig": ("fake", "phone", True),
    "nullconfig": ("redact", None, False),
    "generateCategoricalConfig": ("fake", None, False),
    "generateCardNumberConfig": ("fake", None, False),
    "generateSsnConfig": ("fake", None, False),
    "generateCityConfig": ("fake", None, False),
    "generateStateConfig": ("fake", None, False),
    "generateStreetAddressConfig": ("fake", None, False),
    "generateFullAddressConfig": ("fake", None, False),
    "generateZipcodeConfig": ("fake", None, False),
    "generateCountryConfig": ("fake", None, False),
    "generateGenderConfig": ("fake", None, False),
    "generateUsernameConfig": ("fake", None, False),
    "generateBusinessNameConfig": ("fake", None, False),
    "generateUnixtimestampConfig": ("fake", None, False),
}


def transformer(name: str) -> tuple[str, str | None, str]:
    """(mask, generator, 'exact' | 'approximate' | 'unsupported') of a transformer."""
    known = {k.lower(): v for k, v in TRANSFORMERS.items()}.get(name.lower())
    return ("none", None, "unsupported") if known is None else (known[0], known[1], "exact" if known[2] else "approximate")


def from_neosync(text: str) -> Migration:
    """A job's JSON, bare or as {"job": ...}."""
    try:
        body = json.loads(text)
    except ValueError as e:
        raise SchemaError(f"not a job in JSON: {e}") from e
    job = body.get("job", body)
    if "mappings" not in job:
        raise SchemaError("the job has no mappings")
    out = Migration(Config())
    for m in job["mappings"]:
        table, column = f"{m.get('schema', 'public')}.{m['table']}", m["column"]
        kinds = list(((m.get("transformer") or {}).get("config") or {}).keys())
        name = kinds[0] if kinds else "passthroughConfig"
        way, gen, fit = transformer(name)
        own = out.config.tables.setdefault(table, TableConfig(rows=100))
        if fit == "unsupported":
            out.notes.append(f"{table}.{column}: {name} has no counterpart and was left out")
            continue
        if fit == "approximate":
            out.notes.append(f"{table}.{column}: {name} becomes {way}")
        if way != "none":
            own.columns[column] = ColumnConfig(gen, way)
    return out


def _object_after(text: str, at: int) -> str:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] in "{[(") - (text[i] in "}])")
        if depth == 0:
            return text[at : i + 1]
    return text[at:]


def from_snaplet(text: str, seed_script: str | None = None) -> Migration:
    """A TypeScript configuration, scanned as text: the tables that `select` lists, and a note where generators of its own need a person's eye."""
    out = Migration(Config())
    m = re.search(r"\bselect\s*:\s*([\[{])", text)
    if m:
        block = _object_after(text, m.start(1))
        if m[1] == "[":
            for excluded, name in re.findall(r"""["'](!?)([\w.*]+)["']""", block):
                if excluded:
                    out.notes.append(f"{name} is excluded")
                elif "*" in name:
                    out.notes.append(f"{name}: patterns aren't carried over; list the tables")
                else:
                    out.config.tables[name if "." in name else f"public.{name}"] = TableConfig(rows=100)
        else:
            for name, kept in re.findall(r"([\w]+)\s*:\s*(true|false|[\"']structure[\"'])", block):
                if kept == "true":
                    out.config.tables[f"public.{name}"] = TableConfig(rows=100)
                else:
                    out.notes.append(f"{name}: {kept}")
    else:
        out.notes.append("no select list was found")
    if re.search(r"\b(transform|generate|models)\s*:", text) or seed_script and re.search(r"=>|\bfunction\b", seed_script):
        out.notes.append("generators written as code were found; give those columns a `generator` by hand")
    return out
