"""Which columns are sensitive: by name, against an approved lock file, by policy."""

from __future__ import annotations

import os
from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import ColumnConfig, Config, TableConfig
from ..plans.meta import SchemaError, SchemaMeta

#: Parts of column names and what they say, in the order in which they are tried: fixed values.
SENSITIVE = [
    (("email",), "email"),
    (("phone",), "phone"),
    ((), "person_name"),
    (("ssn", "social_security"), "ssn"),
    (("passport", "license", "national_id", "card", "cvv", "iban", "account_number"), "potential_identifier"),
    (("address", "street"), "address"),
    (("dob", "birth_date", "date_of_birth"), "date_of_birth"),
    (("ip_address",), "ip_address"),
]
_STRICT_NAMES = ("first_name", "firstname", "last_name", "lastname", "surname")


def sensitivity(name: str, strict_names: bool = False) -> str | None:
    """What a column's name says about it; the first rule that holds. strict_names: also names that only the generators know."""
    n = name.lower()
    for parts, label in SENSITIVE:
        if label == "person_name" and (n in ("name", "full_name") or n.endswith("_name")):
            return label
        if any(p in n for p in parts):
            return label
        if label == "ip_address" and n == "ip":
            return label
    return "person_name" if strict_names and n in _STRICT_NAMES else None


def classify(schema: SchemaMeta, strict_names: bool = False) -> dict[str, dict[str, str]]:
    """{table: {column: label}} of the sensitive columns."""
    out = {}
    for t in sorted(schema.tables, key=lambda t: t.qualified):
        own = {c.name: s for c in t.columns if (s := sensitivity(c.name, strict_names))}
        if own:
            out[t.qualified] = own
    return out


def report(spark: SparkSession, schema: SchemaMeta, strict_names: bool = False) -> DataFrame:
    rows = [(t, c, s) for t, own in classify(schema, strict_names).items() for c, s in own.items()]
    return spark.createDataFrame(rows, "table_name string, column_name string, classification string")


def write_lock(found: dict[str, dict[str, str]], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump({"version": 1, "tables": found}, f, sort_keys=True)


def load_lock(path: str) -> dict[str, dict[str, str]] | None:
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return (yaml.safe_load(f) or {}).get("tables") or {}


@dataclass
class Diff:
    new: list[tuple[str, str, str]]
    removed: list[tuple[str, str, str]]
    changed: list[tuple[str, str, str, str]]

    def __bool__(self) -> bool:
        return bool(self.new or self.removed or self.changed)


def diff(lock: dict[str, dict[str, str]], found: dict[str, dict[str, str]]) -> Diff:
    flat = lambda d: {(t, c): s for t, own in d.items() for c, s in own.items()}
    a, b = flat(lock), flat(found)
    return Diff(
        sorted((*k, b[k]) for k in b.keys() - a.keys()),
        sorted((*k, a[k]) for k in a.keys() - b.keys()),
        sorted((*k, a[k], b[k]) for k in a.keys() & b.keys() if a[k] != b[k]),
    )


def diff_frame(lock: DataFrame, found: DataFrame) -> DataFrame:
    """The same as rows: (table_name, column_name, change, was, now)."""
    a = lock.select("table_name", "column_name", F.col("classification").alias("was"))
    b = found.select("table_name", "column_name", F.col("classification").alias("now"))
    both = a.join(b, ["table_name", "column_name"], "full_outer")
    kind = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select("table_name", "column_name", kind.alias("change"), "was", "now")


def strict_gate(schema: SchemaMeta, lock_path: str) -> None:
    """Raises before any read where the lock file is missing or no longer fits the schema."""
    lock = load_lock(lock_path)
    if lock is None:
        raise SchemaError(f"no lock file at {lock_path}: write one and have it approved first")
    if d := diff(lock, classify(schema)):
        said = [f"new {t}.{c}" for t, c, _ in d.new] + [f"removed {t}.{c}" for t, c, _ in d.removed] + [f"changed {t}.{c}" for t, c, _, _ in d.changed]
        raise SchemaError(f"the schema has drifted from {lock_path}: {'; '.join(said)}")


# Policies: part of a column's name, then mask, then generator of a fake. Fixed values, in the order in which they are tried.
POLICIES: dict[str, list[tuple[str, str, str | None]]] = {
    "pii": [
        ("email", "fake", "email"), ("phone", "fake", "phone"), ("first_name", "fake", "first_name"), ("last_name", "fake", "last_name"),
        ("surname", "fake", "last_name"), ("full_name", "fake", "person_name"), ("name", "fake", "person_name"), ("social_security", "redact", None),
        ("ssn", "redact", None), ("passport", "redact", None), ("national_id", "redact", None), ("license", "redact", None),
        ("date_of_birth", "fake", "date"), ("birth_date", "fake", "date"), ("dob", "fake", "date"), ("street", "redact", None),
        ("address", "redact", None), ("ip_address", "fake", "inet"),
    ],
    "healthcare": [
        ("medical_record", "hash", None), ("mrn", "hash", None), ("diagnosis", "redact", None), ("icd_code", "redact", None), ("condition", "redact", None),
        ("prescription", "redact", None), ("medication", "redact", None), ("policy_number", "hash", None), ("insurance_id", "hash", None),
        ("beneficiary_number", "hash", None), ("beneficiary_id", "hash", None), ("account_number", "hash", None), ("certificate_number", "redact", None),
        ("license", "redact", None), ("vehicle", "redact", None), ("device", "redact", None), ("_url", "redact", None), ("ip_address", "fake", "inet"),
        ("fax", "fake", "phone"), ("patient_name", "fake", "person_name"), ("subscriber_name", "fake", "person_name"), ("first_name", "fake", "first_name"),
        ("last_name", "fake", "last_name"), ("date_of_birth", "fake", "date"), ("birth_date", "fake", "date"), ("dob", "fake", "date"), ("ssn", "redact", None),
        ("email", "fake", "email"), ("phone", "fake", "phone"), ("street", "redact", None), ("address", "redact", None), ("city", "redact", None),
        ("zip_code", "redact", None), ("postal_code", "redact", None),
    ],
    "payments": [
        ("card_number", "redact", None), ("card_last4", "redact", None), ("cvv", "redact", None), ("security_code", "redact", None), ("card", "redact", None),
        ("iban", "hash", None), ("account_number", "hash", None), ("routing_number", "hash", None), ("cardholder_name", "fake", "person_name"),
        ("billing_name", "fake", "person_name"), ("billing_email", "fake", "email"), ("billing_phone", "fake", "phone"), ("email", "fake", "email"), ("phone", "fake", "phone"),
    ],
}


def policy_rule(policy: str, column: str, longest_first: bool = False) -> tuple[str, str | None] | None:
    """(mask, generator) of the first rule whose part the name holds. longest_first tries longer parts first, so that none is hidden by a shorter one."""
    if policy not in POLICIES:
        raise SchemaError(f"unknown policy {policy}; there are {', '.join(sorted(POLICIES))}")
    rules = sorted(POLICIES[policy], key=lambda r: -len(r[0])) if longest_first else POLICIES[policy]
    return next(((m, g) for part, m, g in rules if part in column.lower()), None)


def apply_policy(schema: SchemaMeta, config: Config, policy: str, force: bool = False, longest_first: bool = False) -> list[tuple[str, str, str, str | None]]:
    """Writes the policy's masks into config; keys are never masked, and what is configured stays unless `force`. Gives (table, column, mask, generator) of what was written."""
    done = []
    for t in sorted(schema.tables, key=lambda t: t.qualified):
        for c in t.columns:
            rule = policy_rule(policy, c.name, longest_first)
            if rule is None or t.is_key(c.name):
                continue
            own = config.column(t.qualified, c.name)
            if (own.mask or own.json_paths) and not force:
                continue
            config.tables.setdefault(t.qualified, TableConfig()).columns[c.name] = ColumnConfig(rule[1], rule[0])
            done.append((t.qualified, c.name, *rule))
    return done
