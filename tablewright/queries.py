"""Queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .functions import generators as G
from .functions.hashing import Sql, h, row_identity, uniform01
from .operators import classify, clone, constraints, generate, mask, profile
from .operators.subset import parse_root, subset
from .plans import checks, graph
from .plans.config import ColumnConfig, Config, LogicalKey, TableConfig, merge_logical_keys, rows_for, validate_hybrid
from .plans.ddl import parse_ddl
from .plans.meta import ColumnMeta, ForeignKeyMeta, SchemaError, SchemaMeta, TableMeta, UniqueMeta, testdata_schema
from .sources import catalog, migrate
from .sources.io import FrameSource, JdbcSource, Source, jdbc_url, next_values, scratch, sequence_statements, write_copy_text

SEED = "s"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source(spark: SparkSession, sf_dir: str) -> Source:
    class Tables(Source):
        def table(self, name: str) -> DataFrame:
            return _t(spark, sf_dir, name.rpartition(".")[2])

    return Tables()


def _values(rows: list[tuple], names: list[str]) -> str:
    def lit(x):
        if x is None:
            return "NULL"
        return str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x).upper() if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ") v(" + ", ".join(names) + ")"


def _config(**columns: ColumnConfig) -> Config:
    """table__column=...: masks of columns of the public tables."""
    out = Config(seed=SEED)
    for key, c in columns.items():
        table, column = key.split("__")
        out.tables.setdefault(f"public.{table}", TableConfig()).columns[column] = c
    return out


def _mask(spark, sf_dir, table, config, *columns) -> DataFrame:
    schema = testdata_schema()
    mask.validate(schema, config)
    t = schema[table]
    return mask.mask_table(_source(spark, sf_dir).scan(t), t, config).select(*columns)


# ----------------------------------------------------------------- profile
_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query("profile_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _TABLES))
def _(spark, sf_dir):
    one = [_t(spark, sf_dir, t).agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t in _TABLES]
    out = one[0]
    for x in one[1:]:
        out = out.union(x)
    return out


@query("profile_null_fractions", "WITH o AS (SELECT CASE WHEN o_totalprice <= 200000 THEN o_totalprice END AS price, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority, o_orderkey FROM orders) SELECT 'price' AS column_name, count(*) FILTER (WHERE price IS NULL) AS null_rows, count(*) AS total_rows FROM o UNION ALL SELECT 'priority', count(*) FILTER (WHERE priority IS NULL), count(*) FROM o UNION ALL SELECT 'o_orderkey', count(*) FILTER (WHERE o_orderkey IS NULL), count(*) FROM o")
def _(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.when(F.col("o_totalprice") <= 200000, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"), "o_orderkey")
    return profile.null_fractions(o)


for _name, _parent, _ref, _child, _own in [("orders_by_customer", "customer", "c_custkey", "orders", "o_custkey"), ("lineitem_by_part", "part", "p_partkey", "lineitem", "l_partkey"), ("nation_by_region", "region", "r_regionkey", "nation", "n_regionkey"), ("events_by_user", "customer", "c_custkey", "events", "user_id")]:
    query(f"profile_cardinality_{_name}", f"SELECT child_count, count(*) AS parent_count FROM (SELECT {_ref}, count({_own}) AS child_count FROM {_parent} LEFT JOIN {_child} ON {_ref} = {_own} GROUP BY {_ref}) GROUP BY child_count")(
        lambda spark, sf_dir, p=_parent, r=_ref, c=_child, o=_own: profile.cardinality(_t(spark, sf_dir, p), [r], _t(spark, sf_dir, c), [o])
    )

_EDGES = [(c.name, fk.columns[0], p.name, fk.ref_columns[0]) for c, fk, p in testdata_schema().edges()]


@query("fk_orphans_whole", " UNION ALL ".join(f"SELECT '{c}' AS child, '{o}' AS column_name, count(*) AS orphans FROM (SELECT CASE WHEN {o} % 11 = 0 THEN -1 - {o} ELSE {o} END AS k FROM {c}) WHERE k IS NOT NULL AND k NOT IN (SELECT {r} FROM {p})" for c, o, p, r in _EDGES))
def _(spark, sf_dir):
    """All child rows against all parents; a derived key makes the orphans."""
    out = None
    for c, o, p, r in _EDGES:
        fk = ForeignKeyMeta("fk", [o], p, [r])
        child = _t(spark, sf_dir, c).withColumn(o, F.when(F.col(o) % 11 == 0, -1 - F.col(o)).otherwise(F.col(o)))
        one = constraints.orphans(child, fk, _t(spark, sf_dir, p)).agg(F.count("*").alias("orphans")).select(F.lit(c).alias("child"), F.lit(o).alias("column_name"), "orphans")
        out = one if out is None else out.union(one)
    return out


@query("unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf_dir):
    return constraints.duplicates(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# ------------------------------------------------------ classification, policy
_SENSITIVE = [("public.customer", "c_name", "person_name"), ("public.nation", "n_name", "person_name"), ("public.part", "p_name", "person_name"), ("public.region", "r_name", "person_name"), ("public.supplier", "s_name", "person_name")]


@query("classify_columns", _values(_SENSITIVE, ["table_name", "column_name", "classification"]))
def _(spark, sf_dir):
    return classify.report(spark, testdata_schema())


@query("classify_lock_diff", _values([("public.customer", "c_name", "changed", "email", "person_name"), ("public.part", "p_name", "new", None, "person_name"), ("public.users", "u_email", "removed", "email", None)], ["table_name", "column_name", "change", "was", "now"]))
def _(spark, sf_dir):
    lock = [r for r in _SENSITIVE if r[1] not in ("c_name", "p_name")] + [("public.customer", "c_name", "email"), ("public.users", "u_email", "email")]
    found = classify.report(spark, testdata_schema())
    return classify.diff_frame(spark.createDataFrame(lock, "table_name string, column_name string, classification string"), found)


def _people() -> SchemaMeta:
    names = "email phone_no first_name surname home_address ip_address mrn patient_name zip_code card_number cardholder_name iban billing_email age note"
    return SchemaMeta([TableMeta("people", columns=[ColumnMeta("id", "int8", False), *[ColumnMeta(n) for n in names.split()]], primary_key=["id"])])


_POLICY_ROWS = {
    "pii": [("email", "fake", "email"), ("phone_no", "fake", "phone"), ("first_name", "fake", "first_name"), ("surname", "fake", "last_name"), ("home_address", "redact", None), ("ip_address", "redact", None), ("patient_name", "fake", "person_name"), ("cardholder_name", "fake", "person_name"), ("billing_email", "fake", "email")],
    "healthcare": [("email", "fake", "email"), ("phone_no", "fake", "phone"), ("first_name", "fake", "first_name"), ("home_address", "redact", None), ("ip_address", "fake", "inet"), ("mrn", "hash", None), ("patient_name", "fake", "person_name"), ("zip_code", "redact", None), ("billing_email", "fake", "email")],
    "payments": [("email", "fake", "email"), ("phone_no", "fake", "phone"), ("card_number", "redact", None), ("cardholder_name", "redact", None), ("iban", "hash", None), ("billing_email", "fake", "email")],
}


def _policy(name: str):
    def run(spark, sf_dir):
        rows = [(c, m, g) for _, c, m, g in classify.apply_policy(_people(), Config(), name)]
        return spark.createDataFrame(rows, "column_name string, mask string, generator string")

    return run


for _name, _rows in _POLICY_ROWS.items():
    query(f"policy_apply_{_name}", _values(_rows, ["column_name", "mask", "generator"]))(_policy(_name))


# ---------------------------------------------------------------- plan, checks
_ORDER = ["part", "region", "nation", "customer", "events", "orders", "supplier", "lineitem"]


@query("plan_order", _values([(i, f"public.{t}", "Simple") for i, t in enumerate(_ORDER)], ["step", "table_name", "kind"]).replace("SELECT *", "SELECT CAST(step AS BIGINT) AS step, table_name, kind"))
def _(spark, sf_dir):
    groups = graph.plan_insertion(testdata_schema())
    return spark.createDataFrame([(i, t, g.kind) for i, g in enumerate(groups) for t in g.tables], "step long, table_name string, kind string")


_TREE = [("part", 0), ("lineitem", 1), ("region", 0), ("nation", 1), ("customer", 2), ("events", 3), ("orders", 3), ("lineitem", 4), ("supplier", 2), ("lineitem", 3)]


@query("dependency_tree", _values([(i, f"public.{t}", d) for i, (t, d) in enumerate(_TREE)], ["line", "table_name", "depth"]).replace("SELECT *", "SELECT CAST(line AS BIGINT) AS line, table_name, CAST(depth AS BIGINT) AS depth"))
def _(spark, sf_dir):
    return spark.createDataFrame([(i, n.table, n.depth) for i, n in enumerate(graph.dependency_tree(testdata_schema()))], "line long, table_name string, depth long")


_BOUNDS = [("CHECK ((price >= 0))", "price", 0, None), ("CHECK ((qty < 10))", "qty", None, 9), ("CHECK ((qty > 5))", "qty", 6, None), ("CHECK ((qty <= '7'::integer))", "qty", None, 7), ("CHECK (((a >= 0) AND (a < 5)))", None, None, None)]
_ALLOWED = [("CHECK ((kind = ANY (ARRAY['a'::text, 'b'::text])))", "kind", "a|b"), ("CHECK (((state)::text = 'on'::text))", "state", "on"), ("CHECK ((kind IN ('x', 'y''z')))", "kind", "x|y'z"), ("CHECK ((n > 3))", None, None)]
_PREFIX = [("CHECK ((code ~~ 'enc:v2:%'::text))", "code", "enc:v2:"), ("CHECK ((\"encValue\" LIKE 'a\\_b%'))", "encValue", "a_b"), ("CHECK ((code ~~ '%x'))", None, None), ("CHECK ((code ~~ 'a_b%'))", None, None)]
_ESCAPES = [("CHECK (((a IS NULL) OR (a > 3)))", "a"), ("CHECK (((a IS NULL) AND (b > 3)))", None), ("CHECK ((((a IS NULL) OR (b IS NULL)) OR (c = 'x OR y'::text)))", "a,b")]


def _typed(rows, names, kinds) -> str:
    return _values(rows, names).replace("SELECT *", "SELECT " + ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(names, kinds)))


@query("check_parse_bounds", _typed(_BOUNDS, ["definition", "column_name", "least", "greatest"], ["VARCHAR", "VARCHAR", "BIGINT", "BIGINT"]))
def _(spark, sf_dir):
    return spark.createDataFrame([(d, *(checks.integer_bounds(d) or (None, None, None))) for d, *_ in _BOUNDS], "definition string, column_name string, least long, greatest long")


@query("check_parse_allowed", _typed(_ALLOWED, ["definition", "column_name", "allowed"], ["VARCHAR"] * 3))
def _(spark, sf_dir):
    found = [(d, checks.allowed_values(d)) for d, *_ in _ALLOWED]
    return spark.createDataFrame([(d, f and f[0], f and "|".join(f[1])) for d, f in found], "definition string, column_name string, allowed string")


@query("check_parse_prefix", _typed(_PREFIX, ["definition", "column_name", "prefix"], ["VARCHAR"] * 3))
def _(spark, sf_dir):
    return spark.createDataFrame([(d, *(checks.like_prefix(d) or (None, None))) for d, *_ in _PREFIX], "definition string, column_name string, prefix string")


@query("check_parse_null_escape", _typed(_ESCAPES, ["definition", "columns"], ["VARCHAR"] * 2))
def _(spark, sf_dir):
    return spark.createDataFrame([(d, ",".join(checks.null_escapes(d)) or None) for d, _ in _ESCAPES], "definition string, columns string")


# ---------------------------------------------------------------------- masks
def _sql_hash(column: str) -> str:
    return f"'masked_' || substr(sha256('{SEED}' || chr(0) || {column}), 1, 24)"


@query("mask_none", "SELECT p_partkey, p_name, p_brand FROM part")
def _(spark, sf_dir):
    return _mask(spark, sf_dir, "part", _config(part__p_name=ColumnConfig(mask="none")), "p_partkey", "p_name", "p_brand")


@query("mask_null_passthrough", f"SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN {_sql_hash('o_orderpriority')} END AS o_orderpriority FROM orders")
def _(spark, sf_dir):
    t = testdata_schema()["orders"]
    rows = _t(spark, sf_dir, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    return mask.mask_table(rows, t, _config(orders__o_orderpriority=ColumnConfig(mask="hash"))).select("o_orderkey", "o_orderpriority")


@query("mask_hash_text", f"SELECT c_custkey, {_sql_hash('c_name')} AS c_name, {_sql_hash('c_mktsegment')} AS c_mktsegment FROM customer")
def _(spark, sf_dir):
    return _mask(spark, sf_dir, "customer", _config(customer__c_name=ColumnConfig(mask="hash"), customer__c_mktsegment=ColumnConfig(mask="hash")), "c_custkey", "c_name", "c_mktsegment")


@query("mask_hash_joinable", "SELECT p_brand, count(*) AS pairs FROM part GROUP BY p_brand")
def _(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    brands = part.select(F.col("p_brand").alias("plain"), mask.hashed(F.col("p_brand"), SEED).alias("b")).distinct()  # a second table with the same values
    masked = _mask(spark, sf_dir, "part", _config(part__p_brand=ColumnConfig(mask="hash")), "p_brand")
    return masked.join(brands, F.col("p_brand") == F.col("b")).groupBy(F.col("plain").alias("p_brand")).agg(F.count("*").alias("pairs"))


@query("mask_redact_nullable", "SELECT o_orderkey, CAST(NULL AS VARCHAR) AS o_orderpriority, CAST(NULL AS DOUBLE) AS o_totalprice FROM orders")
def _(spark, sf_dir):
    return _mask(spark, sf_dir, "orders", _config(orders__o_orderpriority=ColumnConfig(mask="redact"), orders__o_totalprice=ColumnConfig(mask="redact")), "o_orderkey", "o_orderpriority", "o_totalprice")


@query("mask_redact_literals", "SELECT event_id, TIMESTAMP '1970-01-01' AS ts, 'REDACTED' AS event_type, CAST(0 AS DOUBLE) AS value, '{}' AS props FROM events")
def _(spark, sf_dir):
    t = testdata_schema()["events"]
    for c in t.columns:
        c.nullable = False
    config = _config(**{f"events__{c}": ColumnConfig(mask="redact") for c in ("ts", "event_type", "value", "props")})
    mask.validate(SchemaMeta([t]), config)
    return mask.mask_table(_t(spark, sf_dir, "events"), t, config).select("event_id", "ts", "event_type", "value", "props")


def _hs(table: str, column: str, rid: str, salt: str = "") -> str:
    return Sql.h(SEED, f"public.{table}", column, rid, salt)


for _name, _make in (("name", G.FakeSql.person_name), ("email", G.FakeSql.email), ("phone", G.FakeSql.phone)):
    query(f"mask_fake_{_name}", f"SELECT p_partkey, {_make('x')} AS p_name FROM (SELECT p_partkey, {_hs('part', 'p_name', 'CAST(p_partkey AS VARCHAR)')} AS x FROM part)")(
        lambda spark, sf_dir, g={"name": "person_name"}.get(_name, _name): _mask(spark, sf_dir, "part", _config(part__p_name=ColumnConfig(g, "fake")), "p_partkey", "p_name")
    )


@query("mask_identity_pk", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS identity FROM customer")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "customer")
    return df.select("c_custkey", row_identity(df, testdata_schema()["customer"].identity()).alias("identity"))


@query("mask_identity_composite", "SELECT conv_id, turn, sha256(CAST(conv_id AS VARCHAR) || chr(0) || CAST(turn AS VARCHAR)) AS identity FROM conversations")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "conversations")
    return df.select("conv_id", "turn", F.sha2(row_identity(df, ["conv_id", "turn"]), 256).alias("identity"))


@query("mask_identity_wholerow", "SELECT sha256(CAST(s_suppkey AS VARCHAR) || chr(0) || s_name || chr(0) || CAST(s_nationkey AS VARCHAR) || chr(0) || CAST(s_acctbal AS VARCHAR)) AS identity FROM supplier")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "supplier")
    t = testdata_schema()["supplier"]
    t.primary_key = []
    return df.select(F.sha2(row_identity(df, t.identity()), 256).alias("identity"))


def _json(way: str, path: str = "k"):
    return lambda spark, sf_dir: _mask(spark, sf_dir, "events", _config(events__props=ColumnConfig(json_paths={path: way})), "event_id", "props")


_LEAF = "json_extract_string(props, '$.k')"
query("mask_json_redact", "SELECT event_id, '{\"k\":null}' AS props FROM events")(_json("redact"))
query("mask_json_hash", f"SELECT event_id, '{{\"k\":\"masked_' || substr(sha256('{SEED}' || chr(0) || 'public.events' || chr(0) || 'props' || chr(0) || 'k' || chr(0) || {_LEAF}), 1, 24) || '\"}}' AS props FROM events")(_json("hash"))
query("mask_json_fake", f"SELECT event_id, '{{\"k\":' || CAST({Sql.pick(f'''sha256('{SEED}' || chr(0) || 'public.events' || chr(0) || 'props' || chr(0) || 'k' || chr(0) || CAST(event_id AS VARCHAR) || chr(0))''', 1_000_000)} AS VARCHAR) || '}}' AS props FROM events")(_json("fake"))
query("mask_json_missing_path", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS props FROM events")(_json("redact", "no.such"))


@query("mask_json_nested", "SELECT event_id, '{\"a\":{\"b\":null,\"c\":\"' || event_type || '\"},\"d\":1}' AS props FROM events")
def _(spark, sf_dir):
    t = testdata_schema()["events"]
    doc = F.to_json(F.struct(F.struct(F.col("value").cast("string").alias("b"), F.col("event_type").alias("c")).alias("a"), F.lit(1).alias("d")))
    return mask.mask_table(_t(spark, sf_dir, "events").withColumn("props", doc), t, _config(events__props=ColumnConfig(json_paths={"a.b": "redact"}))).select("event_id", "props")


@query("mask_json_declared", f"SELECT event_id, '{{\"k\":\"masked_' || substr(sha256('{SEED}' || chr(0) || 'public.events' || chr(0) || 'props' || chr(0) || 'k' || chr(0) || {_LEAF}), 1, 24) || '\"}}' AS props FROM events")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events")
    return df.select("event_id", mask.mask_flat_json(F.col("props"), {"k": "hash"}, {"k": "number"}, SEED, "public.events", "props", F.col("event_id").cast("string")).alias("props"))


def _sql_customer(source: str = "customer") -> str:
    unique = f"substr({_hs('customer', 'c_name', 'CAST(c_custkey AS VARCHAR)', 'unique')}, 1, 16)"
    return f"SELECT c_custkey, {G.FakeSql.person_name('x')} || '-' || {unique} AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM (SELECT *, {_hs('customer', 'c_name', 'CAST(c_custkey AS VARCHAR)')} AS x FROM {source})"


@query("mask_table_default", _sql_customer())
def _(spark, sf_dir):
    return _mask(spark, sf_dir, "customer", Config(seed=SEED), "*")


# --------------------------------------------------------------------- verify
def _verify(way: str, corrupt: bool = False):
    def run(spark, sf_dir):
        schema = testdata_schema()
        t = schema["orders"]
        config = _config(orders__o_orderpriority=ColumnConfig("person_name" if way == "fake" else None, way))
        rows = mask.mask_table(_t(spark, sf_dir, "orders"), t, config)
        if corrupt:
            rows = rows.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 10 == 0, F.lit("1-URGENT")).otherwise(F.col("o_orderpriority")))
        return constraints.verify_masked(rows, t, config)

    return run


for _way in ("redact", "hash", "fake"):
    query(f"verify_{_way}", f"SELECT 'o_orderpriority' AS column_name, '{_way}' AS mask, count(*) AS rows_checked, CAST(0 AS BIGINT) AS issues FROM orders")(_verify(_way))
query("verify_detects_corruption", "SELECT 'o_orderpriority' AS column_name, 'hash' AS mask, count(*) AS rows_checked, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS issues FROM orders")(_verify("hash", True))


# --------------------------------------------------------------- in-place masks
@query("keyset_page", "SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) > (3, 1) ORDER BY conv_id, turn LIMIT 50")
def _(spark, sf_dir):
    return clone.keyset_page(_t(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"], [3, 1], 50)


@query("mask_resume_equals_single_pass", _sql_customer())
def _(spark, sf_dir):
    import uuid

    schema = SchemaMeta([testdata_schema()["customer"]])
    staging = f"{scratch(spark)}/in-place-{uuid.uuid4().hex}"
    source = _source(spark, sf_dir)
    clone.mask_in_place(spark, source, schema, Config(seed=SEED), staging, batches=4, max_batches=2, confirm=True)
    clone.mask_in_place(spark, source, schema, Config(seed=SEED), staging, batches=4, resume=True, confirm=True)
    return clone.staged(spark, staging, "public.customer")


@query("merge_updates", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return clone.merge_updates(df, df.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


# --------------------------------------------------------------------- subset
_ROOT = "customer WHERE c_custkey <= 20"
_SUB = {
    "c": "SELECT * FROM customer WHERE c_custkey <= 20",
    "o": "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)",
    "l": "SELECT DISTINCT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)",
    "e": "SELECT * FROM events WHERE user_id IN (SELECT c_custkey FROM c)",
    "p": "SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM l)",
    "s": "SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM l)",
    "n": "SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c UNION SELECT s_nationkey FROM s)",
    "r": "SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n)",
}
_WITH = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in _SUB.items()) + " "


@query("subset_forward", "WITH c AS (SELECT * FROM nation WHERE n_nationkey = 3), k AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM k)) SELECT o_orderkey FROM o")
def _(spark, sf_dir):
    schema = testdata_schema()
    schema.tables = [schema[t] for t in ("nation", "customer", "orders")]
    return subset(_source(spark, sf_dir), schema, "nation where n_nationkey = 3", None)["public.orders"].select("o_orderkey")


@query("subset_closure_counts", _WITH + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {k}" for k, t in zip(_SUB, ["public.customer", "public.orders", "public.lineitem", "public.events", "public.part", "public.supplier", "public.nation", "public.region"])))
def _(spark, sf_dir):
    got = subset(_source(spark, sf_dir), testdata_schema(), _ROOT, None)
    out = None
    for name, df in got.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.union(one)
    return out


@query("subset_rows_orders", _WITH + "SELECT o_orderkey, o_custkey, o_totalprice FROM o")
def _(spark, sf_dir):
    return subset(_source(spark, sf_dir), testdata_schema(), _ROOT, None)["public.orders"].select("o_orderkey", "o_custkey", "o_totalprice")


@query("subset_diamond_part", "WITH l AS (SELECT * FROM lineitem WHERE l_partkey = 7) SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM l)")
def _(spark, sf_dir):
    """Orders come in as parents of the part's line items; their other line items don't follow."""
    schema = testdata_schema()
    schema.tables = [schema[t] for t in ("part", "orders", "lineitem")]
    return subset(_source(spark, sf_dir), schema, "public.part WHERE p_partkey = 7", None)["public.orders"].select("o_orderkey")


_EMP_WHOLE = "SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS boss FROM part"


@query("subset_self_reference_whole", f"WITH RECURSIVE emp AS ({_EMP_WHOLE}), down AS (SELECT id, boss FROM emp WHERE id = 5 UNION SELECT e.id, e.boss FROM emp e JOIN down d ON e.boss = d.id), up AS (SELECT id, boss FROM down UNION SELECT e.id, e.boss FROM emp e JOIN up u ON u.boss = e.id) SELECT id, boss FROM up")
def _(spark, sf_dir):
    """The tree of all parts."""
    emp = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 3)).cast("long").alias("boss"))
    t = TableMeta("emp", columns=[ColumnMeta("id", "int8", False), ColumnMeta("boss", "int8")], primary_key=["id"], foreign_keys=[ForeignKeyMeta("emp_boss_fkey", ["boss"], "public.emp", ["id"])])
    return subset(FrameSource({"public.emp": emp}), SchemaMeta([t]), "emp WHERE id = 5", None)["public.emp"]


# ----------------------------------------------------- clone, snapshot, restore
@query("clone_masked_customer", _sql_customer())
def _(spark, sf_dir):
    return clone.clone(spark, _source(spark, sf_dir), testdata_schema(), Config(seed=SEED))["public.customer"]


@query("clone_subset_masked", f"WITH c AS (SELECT * FROM customer WHERE c_custkey <= 20) {_sql_customer('c')}")
def _(spark, sf_dir):
    return clone.clone(spark, _source(spark, sf_dir), testdata_schema(), Config(seed=SEED), _ROOT, most_rows=None)["public.customer"]


@query("clone_hybrid_events", f"SELECT i AS event_id, c_custkey AS user_id FROM (SELECT range AS i, {Sql.pick(_hs('events', 'events_user_id_fkey', 'CAST(range AS VARCHAR)'), '(SELECT count(*) FROM customer)')} AS spot FROM range(500)) JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer) ON spot = idx")
def _(spark, sf_dir):
    schema = testdata_schema()
    schema.tables = [schema[t] for t in ("region", "nation", "customer", "events")]
    schema["events"].column("event_id").serial = True
    config = Config(seed=SEED, tables={"public.events": TableConfig(rows=500, strategy="generate")})
    out = clone.clone(spark, _source(spark, sf_dir), schema, config)["public.events"]
    return out.select((F.col("event_id") - 1).alias("event_id"), "user_id")


@query("snapshot_roundtrip_orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _(spark, sf_dir):
    import uuid

    schema = SchemaMeta([testdata_schema()["orders"]])
    path = f"{scratch(spark)}/snapshot-{uuid.uuid4().hex}"
    clone.snapshot(spark, _source(spark, sf_dir), schema, Config(seed=SEED), path)
    return clone.restore(spark, path, schema)["public.orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("restore_reindex", "SELECT r_name || '' AS r_name, r_regionkey FROM region")
def _(spark, sf_dir):
    import uuid

    schema = SchemaMeta([testdata_schema()["region"]])
    path = f"{scratch(spark)}/snapshot-{uuid.uuid4().hex}"
    clone.snapshot(spark, _source(spark, sf_dir), schema, _config(region__r_name=ColumnConfig(mask="none")), path)
    schema["region"].columns.reverse()  # the target has another column order
    return clone.restore(spark, path, schema)["public.region"]


# ------------------------------------------------------------------ generation
N = 2000
#: As many rows as there are orders, in SQL.
_ROWS = "range((SELECT count(*) FROM orders))"


def _count(spark: SparkSession, sf_dir: str, name: str) -> int:
    return _t(spark, sf_dir, name).count()


def _gen(kind: str, column: ColumnMeta | None = None, override: str | None = None, cast: str | None = None):
    def run(spark, sf_dir):
        c = column or ColumnMeta("v", kind)
        made = G.value(c, SEED, "t", F.col("id").cast("string"), override)
        return spark.range(_count(spark, sf_dir, "orders")).select("id", (made.cast(cast) if cast else made).alias("v"))

    return run


def _gen_sql(expression: str) -> str:
    x = Sql.h(SEED, "t", "v", "CAST(range AS VARCHAR)")
    return f"SELECT range AS id, {expression} AS v FROM (SELECT range, {x} AS x FROM {_ROWS})"


def _p(n, draw: int = 0, x: str = "x") -> str:
    return Sql.pick(x, n, draw)


_two = lambda v: f"lpad(CAST({v} AS VARCHAR), 2, '0')"
_c = lambda n, d: f"CAST({_p(n, d)} - {n // 2} AS VARCHAR)"
_pair = lambda a, b: f"'(' || {_c(200, a)} || ',' || {_c(200, b)} || ')'"
_SECONDS = G._seconds()
_MOMENT = f"(TIMESTAMP '{G.START}' + to_seconds({_p(_SECONDS)}))"
_SENTENCE = f"array_to_string(list_transform(range(1, {_p(4)} + 4), lambda i: ([{', '.join(map(repr, G.WORDS))}])[CAST('0x' || substr(x, CAST(40 + i AS BIGINT), 1) AS BIGINT) + 1]), ' ')"
_VECTORS = f"array_to_string(list_transform(range(0, {_p(4)} + 1), lambda i: '''' || ([{', '.join(map(repr, G.WORDS))}])[CAST('0x' || substr(x, CAST(41 + i AS BIGINT), 1) AS BIGINT) + 1] || ''':' || CAST(i + 1 AS VARCHAR)), ' ')"
_GEN = {
    "bool": ("bool", f"{_p(2)} = 1", None),
    "int2": ("int2", f"CAST({_p(2000)} - 1000 AS SMALLINT)", None),
    "int4": ("int4", f"CAST({_p(1_000_000)} AS INTEGER)", None),
    "int8": ("int8", f"{_p(1_000_000_000)}", None),
    "float8": ("float8", f"{Sql.u('x')} / CAST(1152921504606846976 AS DOUBLE) * 1000", None),
    "uuid": ("uuid", f"substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-4' || substr(x, 13, 3) || '-' || (['8', '9', 'a', 'b'])[{_p(4, 3)} + 1] || substr(x, 16, 3) || '-' || substr(x, 19, 12)", None),
    "timestamp": ("timestamp", _MOMENT, None),
    "date": ("date", f"CAST(CAST({_MOMENT} AS DATE) AS VARCHAR)", "string"),
    "json": ("json", f"'{{\"note\":\"' || {G.FakeSql.word('x', G.WORDS)} || '\"}}'", None),
    "inet": ("inet", " || '.' || ".join(f"CAST({_p(256, k)} AS VARCHAR)" for k in range(4)), None),
    "oid": ("oid", _p(1 << 32), None),
    "interval": ("interval", f"CAST({_p(14 * 86400 + 1)} - {7 * 86400} AS VARCHAR) || ' seconds'", None),
    "time": ("time", f"{_two(f'({_p(86400)}) // 3600')} || ':' || {_two(f'({_p(86400)}) // 60 % 60')} || ':' || {_two(f'({_p(86400)}) % 60')}", None),
    "tsvector": ("tsvector", _VECTORS, None),
    "point": ("point", _pair(0, 1), None),
    "lseg": ("lseg", f"'[' || {_pair(0, 1)} || ',' || {_pair(2, 3)} || ']'", None),
    "box": ("box", f"{_pair(0, 1)} || ',' || {_pair(2, 3)}", None),
    "path": ("path", f"'[' || {_pair(0, 1)} || ',' || {_pair(2, 3)} || ']'", None),
    "polygon": ("polygon", f"'(' || {_pair(0, 1)} || ',' || {_pair(2, 3)} || ',' || {_pair(1, 2)} || ')'", None),
    "circle": ("circle", f"'<' || {_pair(0, 1)} || ',' || CAST({_p(50, 2)} + 1 AS VARCHAR) || '>'", None),
    "line": ("line", f"'{{' || CAST({_p(100)} + 1 AS VARCHAR) || ',' || {_c(200, 1)} || ',' || {_c(200, 2)} || '}}'", None),
    "lorem": ("text", _SENTENCE, None),
}
for _name, (_kind, _expression, _cast) in _GEN.items():
    query(f"gen_{_name}", _gen_sql(_expression))(_gen(_kind, cast=_cast))

query("gen_decimal", "SELECT id, CAST(v0 AS DECIMAL(10, 2)) AS v FROM (" + _gen_sql(f"CAST({_p(10**10)} AS DECIMAL(18, 0)) * CAST(0.01 AS DECIMAL(3, 2))").replace(" AS v FROM", " AS v0 FROM") + ")")(_gen("numeric", ColumnMeta("v", "numeric", precision=10, scale=2)))
query("gen_bytea", _gen_sql(f"substr(x, 1, CAST(({_p(12, 3)} + 4) * 2 AS BIGINT))"))(lambda spark, sf_dir: _gen("bytea")(spark, sf_dir).withColumn("v", F.lower(F.hex("v"))))
query("gen_vector", _gen_sql("array_to_string(list_transform(range(1, 5), lambda i: CAST(CAST('0x' || substr(sha256(x || CAST(i AS VARCHAR)), 1, 15) AS BIGINT) % 2000000 AS VARCHAR)), ',')"))(
    lambda spark, sf_dir: _gen("vector", ColumnMeta("v", "vector", vector_dimensions=4))(spark, sf_dir).withColumn("v", F.array_join(F.transform("v", lambda y: F.round((y.cast("double") + 1.0) * 1_000_000, 0).cast("long").cast("string")), ","))
)
query("gen_array", _gen_sql(f"array_to_string(list_transform(range(1, {_p(3, 3)} + 2), lambda i: CAST(CAST('0x' || substr(sha256(x || CAST(i AS VARCHAR)), 1, 15) AS BIGINT) % 1000000 AS VARCHAR)), ',')"))(lambda spark, sf_dir: _gen("array", ColumnMeta("v", "array", element="int4"))(spark, sf_dir).withColumn("v", F.array_join(F.col("v").cast("array<string>"), ",")))
query("gen_enum", _gen_sql(f"(['sad', 'ok', 'happy'])[{_p(3)} + 1]"))(_gen("enum", ColumnMeta("v", "enum", enum=["sad", "ok", "happy"])))
query("gen_check_range", _gen_sql(f"CAST({_p(41)} + 10 AS INTEGER)"))(_gen("int4", ColumnMeta("v", "int4", check_min=10, check_max=50)))
query("gen_allowed_values", _gen_sql(f"(['a', 'c'])[{_p(2)} + 1]"))(_gen("text", ColumnMeta("v", "text", check_allowed=["a", "c"])))
query("gen_like_prefix", _gen_sql("'enc:v2:' || substr(x, 1, 6)"))(_gen("text", ColumnMeta("v", "text", check_like_prefix="enc:v2:")))
query("gen_null_escape", _gen_sql("CAST(NULL AS VARCHAR)"))(_gen("text", ColumnMeta("v", "text", check_null_escape=True), cast="string"))
query("gen_truncate", _gen_sql(f"left({_SENTENCE}, 9)"))(_gen("text", ColumnMeta("v", "varchar", max_length=9)))
query("gen_null_fraction", f"SELECT range AS id, CASE WHEN {Sql.u(Sql.h(SEED, 't', 'v', 'CAST(range AS VARCHAR)', 'null'))} / CAST(1152921504606846976 AS DOUBLE) >= 0.3 THEN {_p(1_000_000_000, 0, Sql.h(SEED, 't', 'v', 'CAST(range AS VARCHAR)'))} END AS v FROM {_ROWS}")(
    lambda spark, sf_dir: spark.range(_count(spark, sf_dir, "orders")).select("id", F.when(uniform01(h(SEED, "t", "v", F.col("id").cast("string"), "null")) >= 0.3, G.value(ColumnMeta("v", "int8"), SEED, "t", F.col("id").cast("string"))).alias("v"))
)


def _table(name: str, columns: list[ColumnMeta], pk: list[str], fks: list[ForeignKeyMeta] = (), unique: list[UniqueMeta] = ()) -> TableMeta:
    return TableMeta(name, columns=columns, primary_key=pk, foreign_keys=list(fks), unique=list(unique))


def _serial(name: str = "id") -> ColumnMeta:
    return ColumnMeta(name, "int8", False, serial=True)


def _rows(**n: int) -> Config:
    return Config(seed=SEED, tables={f"public.{t}": TableConfig(rows=k) for t, k in n.items()})


def _at(table: str, key: str, n, rid: str = "CAST(range AS VARCHAR)") -> str:
    return Sql.pick(_hs(table, key, rid), n)


@query("gen_fk_uniform", f"SELECT range + 1 AS id, {_at('child', 'fk', '(SELECT count(*) FROM customer)')} + 1 AS parent_id FROM {_ROWS}")
def _(spark, sf_dir):
    schema = SchemaMeta([_table("parent", [_serial()], ["id"]), _table("child", [_serial(), ColumnMeta("parent_id", "int8", False)], ["id"], [ForeignKeyMeta("fk", ["parent_id"], "public.parent", ["id"])])])
    return generate.generate(spark, schema, _rows(parent=_count(spark, sf_dir, "customer"), child=_count(spark, sf_dir, "orders")))["public.child"]


def _given(spark, sf_dir, table: TableMeta, keys: DataFrame, parent: str = "public.pair") -> DataFrame:
    gen = generate.Generator(spark, SchemaMeta([_table("pair", [ColumnMeta("a", "int8", False), ColumnMeta("b", "int8", False)], ["a", "b"]), table]), _rows(child=N), parents={parent: keys})
    return gen.run({"public.child"})["public.child"]


_TUPLES_WHOLE = "SELECT p_partkey % 40 AS a, p_partkey // 40 AS b FROM part"
_PARTS = "(SELECT count(*) FROM part)"


def _tuples_whole(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("a"), F.floor(F.col("p_partkey") / 40).alias("b"))


@query("gen_fk_composite_whole", f"SELECT range + 1 AS id, a, b FROM (SELECT range, {_at('child', 'fk', _PARTS)} AS spot FROM range({N})) JOIN (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS idx FROM ({_TUPLES_WHOLE})) ON spot = idx")
def _(spark, sf_dir):
    t = _table("child", [_serial(), ColumnMeta("a", "int8", False), ColumnMeta("b", "int8", False)], ["id"], [ForeignKeyMeta("fk", ["a", "b"], "public.pair", ["a", "b"])])
    return _given(spark, sf_dir, t, _tuples_whole(spark, sf_dir))


@query("gen_fk_pinned_whole", f"WITH pairs AS ({_TUPLES_WHOLE}), one AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS idx FROM pairs), inner_ AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) - 1 AS idx, count(*) OVER (PARTITION BY a) AS n FROM pairs), c AS (SELECT range, a, b FROM (SELECT range, {_at('child', 'fk', _PARTS)} AS spot FROM range({N})) JOIN one ON spot = idx) SELECT c.range + 1 AS id, c.a, c.b, inner_.b AS b2 FROM c JOIN inner_ ON inner_.a = c.a AND inner_.idx = {Sql.pick(_hs('child', 'fk2', 'CAST(c.range AS VARCHAR)'), 'inner_.n')}")
def _(spark, sf_dir):
    t = _table("child", [_serial(), *[ColumnMeta(c, "int8", False) for c in ("a", "b", "b2")]], ["id"], [ForeignKeyMeta("fk", ["a", "b"], "public.pair", ["a", "b"]), ForeignKeyMeta("fk2", ["a", "b2"], "public.pair", ["a", "b"])])
    return _given(spark, sf_dir, t, _tuples_whole(spark, sf_dir))


_HIST = [(0, 3), (1, 5), (4, 2)]


@query("gen_cardinality", f"WITH p AS (SELECT range AS idx, {Sql.pick(_hs('child', 'fk', 'CAST(range AS VARCHAR)', 'cardinality'), 10)} AS u FROM range((SELECT count(*) FROM customer))), n AS (SELECT idx, CASE WHEN u < 3 THEN 0 WHEN u < 8 THEN 1 ELSE 4 END AS n FROM p), rows_ AS (SELECT idx, unnest(range(1, n + 1)) AS pos FROM n) SELECT row_number() OVER (ORDER BY idx, pos) AS id, idx + 1 AS parent_id FROM rows_")
def _(spark, sf_dir):
    schema = SchemaMeta([_table("parent", [_serial()], ["id"]), _table("child", [_serial(), ColumnMeta("parent_id", "int8", False)], ["id"], [ForeignKeyMeta("fk", ["parent_id"], "public.parent", ["id"])])])
    shape = profile.Profile(children={"public.child": {"fk": _HIST}})
    return generate.generate(spark, schema, _rows(parent=_count(spark, sf_dir, "customer")), shape)["public.child"]


@query("gen_self_reference", f"SELECT range + 1 AS id, {Sql.pick(_hs('emp', 'fk', 'CAST(range AS VARCHAR)'), '(range + 1)')} + 1 AS boss FROM {_ROWS}")
def _(spark, sf_dir):
    schema = SchemaMeta([_table("emp", [_serial(), ColumnMeta("boss", "int8", False)], ["id"], [ForeignKeyMeta("fk", ["boss"], "public.emp", ["id"])])])
    return generate.generate(spark, schema, _rows(emp=_count(spark, sf_dir, "orders")))["public.emp"]


def _cycle(deferrable: bool) -> SchemaMeta:
    one = lambda t, other: _table(t, [_serial(), ColumnMeta("other", "int8", not deferrable)], ["id"], [ForeignKeyMeta(f"{t}_fk", ["other"], f"public.{other}", ["id"], deferrable=deferrable)])
    return SchemaMeta([one("a", "b"), one("b", "a")])


_CYCLE = f"SELECT 'a' AS side, range + 1 AS id, {_at('a', 'a_fk', 70)} + 1 AS other FROM range(90) UNION ALL SELECT 'b', range + 1, {_at('b', 'b_fk', 90)} + 1 FROM range(70)"


def _cycles(deferrable: bool):
    def run(spark, sf_dir):
        got = generate.generate(spark, _cycle(deferrable), _rows(a=90, b=70))
        return got["public.a"].select(F.lit("a").alias("side"), "id", "other").union(got["public.b"].select(F.lit("b").alias("side"), "id", "other"))

    return run


query("gen_cycle_backfill", _CYCLE)(_cycles(False))
query("gen_cycle_deferred", _CYCLE)(_cycles(True))


_PAIRS_AT = f"(range * 751 + {Sql.u(Sql.h(SEED, 'public.pairspairs_key', 'pairs', chr(39) + '0' + chr(39)))} % 1500) % 1500"


@query("gen_unique_parents", f"SELECT range + 1 AS id, spot % 50 + 1 AS a_id, spot // 50 + 1 AS b_id FROM (SELECT range, {_PAIRS_AT} AS spot FROM range(1500))")
def _(spark, sf_dir):
    """Every combination of 50 and 30 parents once, by construction."""
    fks = [ForeignKeyMeta(f"fk_{x}", [f"{x}_id"], f"public.{x}", ["id"]) for x in "ab"]
    pairs = _table("pairs", [_serial(), ColumnMeta("a_id", "int8", False), ColumnMeta("b_id", "int8", False)], ["id"], fks, [UniqueMeta("pairs_key", ["a_id", "b_id"])])
    schema = SchemaMeta([_table("a", [_serial()], ["id"]), _table("b", [_serial()], ["id"]), pairs])
    return generate.generate(spark, schema, _rows(a=50, b=30, pairs=1500))["public.pairs"]


def _redraws(rounds: int) -> str:
    """The rounds of a unique column, spelt out: the first of each value by index is settled, the others draw again."""
    drawn = lambda k: Sql.pick(_hs("t", "code", "CAST(rid AS VARCHAR)" + (f" || '#retry{k}'" if k else "")), 1_000_000)
    parts = [f"r0 AS (SELECT rid, {drawn(0)} AS v FROM (SELECT range AS rid FROM {_ROWS}))", "a0 AS (SELECT min(rid) AS rid, v FROM r0 GROUP BY v)"]
    for k in range(1, rounds):
        before = " UNION ALL ".join(f"SELECT v FROM a{j}" for j in range(k))
        parts += [f"r{k} AS (SELECT rid, {drawn(k)} AS v FROM r{k - 1} WHERE rid NOT IN (SELECT rid FROM a{k - 1}))", f"a{k} AS (SELECT min(rid) AS rid, v FROM r{k} WHERE v NOT IN ({before}) GROUP BY v)"]
    return "WITH " + ", ".join(parts) + " SELECT rid + 1 AS id, CAST(v AS INTEGER) AS code FROM (" + " UNION ALL ".join(f"SELECT * FROM a{j}" for j in range(rounds)) + ")"


@query("gen_unique_redraws", _redraws(8))
def _(spark, sf_dir):
    """A unique column of a million values for as many rows as there are orders: the rows that the eight rounds of the SQL settle, which are all where values aren't scarce."""
    code = ColumnMeta("code", "int4", False, check_min=0, check_max=999_999)
    schema = SchemaMeta([_table("t", [_serial(), code], ["id"], [], [UniqueMeta("t_code_key", ["code"])])])
    rows = generate.Generator(spark, schema, _rows(t=_count(spark, sf_dir, "orders"))).first_rounds("public.t", 8)
    constraints.enforce({"public.t": rows}, schema)
    return rows


@query("gen_unique_rounds")
def _(spark, sf_dir):
    """Not in the SQL: the number of rounds depends on the data. tests hold the result against the constraint."""
    code = ColumnMeta("code", "int4", False, check_min=0, check_max=2999)
    schema = SchemaMeta([_table("t", [_serial(), code], ["id"], [], [UniqueMeta("t_code_key", ["code"])])])
    return generate.generate(spark, schema, _rows(t=1200))["public.t"]


# ------------------------------------------------------------- migration, stream
_NEOSYNC = [("passthroughConfig", "none", None, "exact"), ("generateSha256hashConfig", "hash", None, "exact"), ("transformEmailConfig", "fake", "email", "exact"), ("generateFullNameConfig", "fake", "person_name", "exact"), ("transformPhoneNumberConfig", "fake", "phone", "exact"), ("generateInt64Config", "fake", "int8_range", "exact"), ("nullconfig", "redact", None, "approximate"), ("generateCityConfig", "fake", None, "approximate"), ("transformJavascriptConfig", "none", None, "unsupported")]


@query("migrate_neosync_map", _typed(_NEOSYNC, ["transformer", "mask", "generator", "fit"], ["VARCHAR"] * 4))
def _(spark, sf_dir):
    return spark.createDataFrame([(n, *migrate.transformer(n)) for n, *_ in _NEOSYNC], "transformer string, mask string, generator string, fit string")


@query("migrate_snaplet_select", _values([("public.users",), ("shop.orders",)], ["table_name"]))
def _(spark, sf_dir):
    text = """export default defineConfig({ select: ["users", "shop.orders", "!public.logs"], })"""
    return spark.createDataFrame([(t,) for t in migrate.from_snaplet(text).config.tables], "table_name string")


@query("stream_mask_events", f"SELECT event_id, {_sql_hash('event_type')} AS event_type FROM events")
def _(spark, sf_dir):
    """The batch masks as a stream over the same file, run to its end."""
    import uuid

    from .streaming import masking

    t, at = testdata_schema()["events"], f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    one = _t(spark, sf_dir, "events")
    stream = spark.readStream.schema(one.schema).option("pathGlobFilter", "events.parquet" if not _is_folder(spark, f"{sf_dir}/events.parquet") else "*.parquet").parquet(sf_dir if not _is_folder(spark, f"{sf_dir}/events.parquet") else f"{sf_dir}/events.parquet")
    masking.run(stream, t, _config(events__event_type=ColumnConfig(mask="hash")), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(one.schema).parquet(f"{at}/out").select("event_id", "event_type")


def _is_folder(spark: SparkSession, path: str) -> bool:
    from .sources.io import FileSystem

    p, fs = FileSystem(spark)._at(path)
    return fs.getFileStatus(p).isDirectory()


# --------------------------------------------------- masks that must fit, sequences
_FAKE_NAME = f"{G.FakeSql.person_name('x')}"


@query("mask_unique_varchar", f"SELECT p_partkey, left({_FAKE_NAME}, 13) || '-' || substr({_hs('part', 'p_name', 'CAST(p_partkey AS VARCHAR)', 'unique')}, 1, 16) AS p_name FROM (SELECT p_partkey, {_hs('part', 'p_name', 'CAST(p_partkey AS VARCHAR)')} AS x FROM part)")
def _(spark, sf_dir):
    """A fake in a unique varchar(30): cut first, so that the piece that keeps it apart still fits."""
    t = testdata_schema()["part"]
    t.column("p_name").type, t.column("p_name").max_length = "varchar", 30
    t.unique.append(UniqueMeta("part_name_key", ["p_name"]))
    config = _config(part__p_name=ColumnConfig("person_name", "fake"))
    mask.validate(SchemaMeta([t]), config)
    return mask.mask_table(_t(spark, sf_dir, "part"), t, config).select("p_partkey", "p_name")


@query("mask_json_numbers_kept", "SELECT event_id, '{\"a\":1.50,\"b\":12345678901234567.891,\"k\":null,\"l\":[1e400,-0]}' AS props FROM events")
def _(spark, sf_dir):
    t = testdata_schema()["events"]
    rows = _t(spark, sf_dir, "events").withColumn("props", F.lit('{"a":1.50,"b":12345678901234567.891,"k":5,"l":[1e400,-0]}'))
    return mask.mask_table(rows, t, _config(events__props=ColumnConfig(json_paths={"k": "redact"}))).select("event_id", "props")


@query("next_values", "SELECT 'public.customer' AS table_name, 'c_custkey' AS column_name, max(c_custkey) + 1 AS next_value FROM customer UNION ALL SELECT 'public.orders', 'o_orderkey', max(o_orderkey) + 1 FROM orders")
def _(spark, sf_dir):
    """Where sequences go on after a clone."""
    schema = testdata_schema()
    schema.tables = [schema[t] for t in ("region", "nation", "customer", "orders")]
    schema["customer"].column("c_custkey").serial = schema["orders"].column("o_orderkey").identity = True
    got = json.loads(next_values(clone.clone(spark, _source(spark, sf_dir), schema, Config(seed=SEED)), schema))
    return spark.createDataFrame([(t, c, n) for t, own in got.items() for c, n in own.items()], "table_name string, column_name string, next_value long")


# ------------------------------------------------------- metadata, as rows
_DDL = """
CREATE TYPE mood AS ENUM ('sad', 'ok');
CREATE TABLE org (id bigint GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY, code varchar(20) UNIQUE, feeling mood NOT NULL, n int CHECK (n = 5));
CREATE TABLE member (org_code varchar(8) REFERENCES org (code), seat int, boss int, name text NOT NULL, PRIMARY KEY (org_code, seat), FOREIGN KEY (org_code, boss) REFERENCES member, CHECK (seat > 0));
CREATE UNIQUE INDEX member_name ON member (org_code, name);
"""


def _named(name: str, rows: list[tuple], names: list[str], make: Callable) -> None:
    """A query whose few rows come from metadata: make(spark, sf_dir) gives them, `rows` are what they must be."""
    kinds = ["BIGINT" if any(isinstance(r[i], int) for r in rows) else "VARCHAR" for i in range(len(names))]
    schema = ", ".join(f"{n} {'long' if k == 'BIGINT' else 'string'}" for n, k in zip(names, kinds))
    query(name, _typed(rows, names, kinds))(lambda spark, sf_dir: spark.createDataFrame([tuple(r) for r in make(spark, sf_dir)], schema))


def _ddl() -> SchemaMeta:
    return parse_ddl(_DDL)


def _reason(call: Callable) -> str:
    try:
        call()
    except SchemaError as e:
        return str(e)
    return "none"


_named("ddl_columns", [("org", "id", "int8", None), ("org", "code", "varchar", 8), ("org", "feeling", "enum", None), ("org", "n", "int4", None), ("member", "org_code", "varchar", 8), ("member", "seat", "int4", None), ("member", "boss", "int4", None), ("member", "name", "text", None)], ["table_name", "column_name", "type_name", "max_length"], lambda spark, sf_dir: [(t.name, c.name, c.type, c.max_length) for t in _ddl().tables for c in t.columns])
_named("ddl_enum_labels", [("feeling", "sad", 0), ("feeling", "ok", 1)], ["column_name", "label", "place"], lambda spark, sf_dir: [(c.name, x, i) for t in _ddl().tables for c in t.columns for i, x in enumerate(c.enum or [])])
_named("ddl_unique_sets", [("org", "code"), ("member", "org_code,seat"), ("member", "org_code,name")], ["table_name", "columns"], lambda spark, sf_dir: [(t.name, ",".join(cols)) for t in _ddl().tables for n, cols in t.unique_sets() if cols != ["id"]])
_named("ddl_foreign_keys", [("member", "org_code", "public.org", "code"), ("member", "org_code,boss", "public.member", "org_code,seat")], ["table_name", "columns", "ref_table", "ref_columns"], lambda spark, sf_dir: [(t.name, ",".join(k.columns), k.ref_table, ",".join(k.ref_columns)) for t in _ddl().tables for k in t.foreign_keys])
_named("ddl_checks", [("org", "CHECK (n = 5)", 5, 5), ("member", "CHECK (seat > 0)", 1, None)], ["table_name", "definition", "least", "greatest"], lambda spark, sf_dir: [(t.name, k.definition, *checks.integer_bounds(k.definition)[1:]) for t in _ddl().tables for k in t.checks])


def _catalog(spark: SparkSession) -> SchemaMeta:
    """The same kind of rows as a database's catalog gives."""
    none = (None,) * 4
    columns = [("public", "a", "id", 1, False, "int4", "b", None, None, *none, True, False, None), ("public", "a", "mood", 2, True, "mood", "e", None, None, *none, False, False, None), ("public", "b", "a_id", 1, True, "int4", "b", None, None, *none, False, False, None), ("public", "b", "tags", 2, True, "_text", "b", None, "text", *none, False, False, None)]
    keys = [("public", "a", "a_pkey", "p", "id", None, None, None, False, False, ""), ("public", "b", "b_fk", "f", "a_id", "public", "a", "id", True, False, ""), ("public", "a", "a_check", "c", "id", None, None, None, False, False, "CHECK ((id > 4))")]
    return catalog.from_frames({
        "columns": spark.createDataFrame(columns, "schema_name string, table_name string, column_name string, place int, nullable boolean, type_name string, type_kind string, base_name string, element_name string, max_length int, precision int, scale int, dimensions int, is_identity boolean, is_generated boolean, expression string"),
        "constraints": spark.createDataFrame(keys, "schema_name string, table_name string, constraint_name string, kind string, column_names string, ref_schema string, ref_table string, ref_columns string, deferrable boolean, deferred boolean, definition string"),
        "indexes": spark.createDataFrame([("public", "b", "b_tags", "a_id")], "schema_name string, table_name string, index_name string, column_names string"),
        "enums": spark.createDataFrame([("mood", "ok", 2.0), ("mood", "sad", 1.0)], "type_name string, label string, place double"),
    })


_named("catalog_columns", [("public.a", "id", "int4", "identity"), ("public.a", "mood", "enum", "sad|ok"), ("public.b", "a_id", "int4", None), ("public.b", "tags", "array", "text")], ["table_name", "column_name", "type_name", "more"], lambda spark, sf_dir: [(t.qualified, c.name, c.type, "identity" if c.identity else "|".join(c.enum) if c.enum else c.element) for t in _catalog(spark).tables for c in t.columns])
_named("catalog_constraints", [("public.a", "primary key", "id"), ("public.a", "check", "CHECK ((id > 4))"), ("public.b", "foreign key", "a_id -> public.a.id deferrable"), ("public.b", "unique", "a_id")], ["table_name", "kind", "said"], lambda spark, sf_dir: [x for t in _catalog(spark).tables for x in [*[(t.qualified, "primary key", ",".join(t.primary_key)) for _ in t.primary_key[:1]], *[(t.qualified, "check", k.definition) for k in t.checks], *[(t.qualified, "foreign key", f"{','.join(k.columns)} -> {k.ref_table}.{','.join(k.ref_columns)}" + " deferrable" * k.deferrable) for k in t.foreign_keys], *[(t.qualified, "unique", ",".join(u.columns)) for u in t.unique]]])


@query("json_sensitive_keys", _values([("user.contact.phone", "phone"), ("user.email", "email")], ["path", "kind"]))
def _(spark, sf_dir):
    """Names of keys in a sample of documents, which is the feature; values aren't kept."""
    doc = F.to_json(F.struct(F.struct(F.lit("x").alias("email"), F.struct(F.lit("1").alias("phone")).alias("contact")).alias("user"), F.col("value").alias("n")))
    found = mask.sensitive_keys(_t(spark, sf_dir, "events").select(doc.alias("props")), "props")
    return spark.createDataFrame(found, "path string, kind string")


@query("profile_capture", "SELECT 'public.nation' AS table_name, count(*) AS row_count FROM nation UNION ALL SELECT 'public.region', count(*) FROM region UNION ALL SELECT 'public.customer', count(*) FROM customer")
def _(spark, sf_dir):
    """A profile captured from the source, written, and read again."""
    schema = testdata_schema()
    schema.tables = [schema[t] for t in ("region", "nation", "customer")]
    got = profile.Profile.from_yaml(profile.capture(_source(spark, sf_dir), schema).to_yaml())
    return spark.createDataFrame(sorted(got.rows.items()), "table_name string, row_count long")


@query("copy_text", "SELECT CAST(r_regionkey AS VARCHAR) || chr(9) || r_name || '\\t\\\\' || chr(9) || '\\N' AS value FROM region")
def _(spark, sf_dir):
    import uuid

    path = f"{scratch(spark)}/copy-{uuid.uuid4().hex}"
    write_copy_text(_t(spark, sf_dir, "region").select("r_regionkey", F.concat("r_name", F.lit("\t\\")).alias("r_name"), F.lit(None).cast("string").alias("none")), path)
    return spark.read.text(path)


@query("in_place_dry_run", "SELECT 'public.customer' AS table_name, 'c_name' AS columns, count(*) AS row_count FROM customer UNION ALL SELECT 'public.orders', 'o_orderpriority', count(*) FROM orders")
def _(spark, sf_dir):
    schema = testdata_schema()
    schema.tables = [schema[t] for t in ("customer", "orders")]
    got = clone.mask_in_place(spark, _source(spark, sf_dir), schema, _config(orders__o_orderpriority=ColumnConfig(mask="hash")), "unused", dry_run=True)
    return spark.createDataFrame([(n, ",".join(x["columns"]), x["rows"]) for n, x in got.tables.items()], "table_name string, columns string, row_count long")


_CYCLE_DDL = "CREATE TABLE a (id uuid PRIMARY KEY, b_id uuid NOT NULL); CREATE TABLE b (id uuid PRIMARY KEY, a_id uuid NOT NULL REFERENCES a DEFERRABLE); ALTER TABLE a ADD FOREIGN KEY (b_id) REFERENCES b"
_named("deferred_order", [(0, "public.b"), (1, "public.a")], ["place", "table_name"], lambda spark, sf_dir: list(enumerate(graph.deferred_write_order(parse_ddl(_CYCLE_DDL), ["public.a", "public.b"]))))
_named("rows_rule", [("public.a", 0), ("public.b", 7), ("public.c", 100)], ["table_name", "row_count"], lambda spark, sf_dir: [(t, rows_for(Config(tables={"public.a": TableConfig(rows=0)}), {"public.a": 9, "public.b": 7}, t)) for t in ("public.a", "public.b", "public.c")])
_CONFIG = Config(seed="q", tables={"public.t": TableConfig(5, "mask", {"email": ColumnConfig("email", "fake"), "js": ColumnConfig(json_paths={"a.b": "hash"})})})
_named("config_round_trip", [("q", "public.t", 5, "email", "fake", "email", None), ("q", "public.t", 5, "js", None, None, "a.b=hash")], ["seed", "table_name", "row_count", "column_name", "mask", "generator", "paths"], lambda spark, sf_dir: [(c.seed, n, t.rows, k, x.mask, x.generator, ",".join(f"{p}={m}" for p, m in x.json_paths.items()) or None) for c in [Config.from_yaml(_CONFIG.to_yaml())] for n, t in c.tables.items() for k, x in t.columns.items()])
_named("config_checks_as_comments", [("  # check org_n_check: CHECK (n = 5)",)], ["line"], lambda spark, sf_dir: [(x,) for x in Config(tables={"public.org": TableConfig(1)}).to_yaml(_ddl()).splitlines() if "check" in x])
_named("mask_refusals", [("hash on a number", "public.org.n: hash gives text, the column is int4"), ("mask on a key", "public.org.id: a key column can't be masked; its values are what rows refer to"), ("path in no document", "public.member.name: json_paths on a column that isn't JSON")], ["what", "reason"], lambda spark, sf_dir: [(what, _reason(lambda t=t, c=c, x=x: mask.validate(_ddl(), Config(tables={f"public.{t}": TableConfig(columns={c: x})})))) for what, t, c, x in [("hash on a number", "org", "n", ColumnConfig(mask="hash")), ("mask on a key", "org", "id", ColumnConfig(mask="hash")), ("path in no document", "member", "name", ColumnConfig(json_paths={"a": "hash"}))]])
_named("root_refusals", [("orders", "a root needs the form '<table> WHERE <condition>': orders"), (" where a = 1", "the root names no table"), ("orders where ", "the root has an empty condition"), ("x where a = 1", "the root names an unknown table x")], ["root", "reason"], lambda spark, sf_dir: [(r, _reason(lambda r=r: parse_root(r, testdata_schema()))) for r in ("orders", " where a = 1", "orders where ", "x where a = 1")])
_named("subset_cap", [("the subset has more than 2 rows; nothing was written",)], ["reason"], lambda spark, sf_dir: [(_reason(lambda: subset(_source(spark, sf_dir), testdata_schema(), "region WHERE r_regionkey = 1", 2)),)])
_named("snapshot_drift", [("public.region: the snapshot lacks column extra",), ("public.region: the target lacks column r_name",)], ["reason"], lambda spark, sf_dir: [(_reason(lambda h=h, w=w: clone.check_columns(testdata_schema()["region"], h, w)),) for h, w in ((["r_regionkey"], ["r_regionkey", "extra"]), (["r_regionkey", "r_name"], ["r_regionkey"]))])
_named("hybrid_refusal", [("public.orders.orders_o_custkey_fkey: a masked table refers to public.customer, whose rows are generated",)], ["reason"], lambda spark, sf_dir: [(_reason(lambda: validate_hybrid(SchemaMeta([t for t in testdata_schema().tables if t.name in ("region", "nation", "customer", "orders")]), Config(tables={"public.customer": TableConfig(5, "generate")}))),)])
_named("exhausted_domain", [("public.t: t_b_key (b) can't be made unique: its own domain has too few values for the rows asked for",)], ["reason"], lambda spark, sf_dir: [(_reason(lambda: generate.Generator(spark, s, Config()).exhausted(s["t"], s["t"].unique_sets()[1:]) and _raise(generate.Generator(spark, s, Config()).exhausted(s["t"], s["t"].unique_sets()[1:]))),) for s in [parse_ddl("CREATE TABLE t (id serial PRIMARY KEY, b boolean NOT NULL UNIQUE)")]])
_named("url_without_password", [("jdbc:postgresql://h/d?user=u&password=***",)], ["url"], lambda spark, sf_dir: [(JdbcSource(None, jdbc_url("postgres://u:secret@h/d")).describe(),)])
_named("sequence_sql", [("""SELECT setval(pg_get_serial_sequence('"public"."t"', 'id'), 4, false)""",)], ["statement"], lambda spark, sf_dir: [(x,) for x in sequence_statements({"public.t": {"id": 4}})])


_named("referenced_tables", [(f"public.{t}",) for t in ("customer", "nation", "orders", "part", "region", "supplier")], ["table_name"], lambda spark, sf_dir: [(t,) for t in sorted(graph.referenced(testdata_schema()))])
_named("narrowed_lengths", [("org", 8), ("member", 8)], ["table_name", "max_length"], lambda spark, sf_dir: [(t.name, t.column(c).max_length) for t, c in ((_ddl()["org"], "code"), (_ddl()["member"], "org_code"))])
_named("server_keys_in_a_deferred_cycle", [("public.b.b_a_id_fkey refers to a server-assigned key of public.a inside a deferred cycle",)], ["reason"], lambda spark, sf_dir: [(_reason(lambda: graph.check_deferred(parse_ddl("CREATE TABLE a (id serial PRIMARY KEY, b_id uuid NOT NULL); CREATE TABLE b (id uuid PRIMARY KEY, a_id int NOT NULL REFERENCES a DEFERRABLE); ALTER TABLE a ADD FOREIGN KEY (b_id) REFERENCES b"), ["public.a", "public.b"], True)),)])
_named("logical_keys", [("public.events", "user_id", "public.customer", "c_custkey")], ["table_name", "columns", "ref_table", "ref_columns"], lambda spark, sf_dir: [(t.qualified, ",".join(k.columns), k.ref_table, ",".join(k.ref_columns)) for t in _logical().tables for k in t.foreign_keys if k.logical])
_named("dry_tree_and_rows", [("1. Simple: public.region (5 rows)",), ("2. Simple: public.nation (1,234 rows)",), ("",), ("public.region",), ("  public.nation",)], ["line"], lambda spark, sf_dir: [(x,) for x in cli.plan_report(SchemaMeta([testdata_schema()[t] for t in ("region", "nation")]), Config(tables={"public.region": TableConfig(5), "public.nation": TableConfig(1234)})).split("\n")])
_named("init_findings", [("1 tables",), ("1 JSON columns",), ("sensitive keys in JSON documents (names only, from a sample):",), ("  events.props.mail.email  email",)], ["line"], lambda spark, sf_dir: [(x,) for x in cli.init_report(SchemaMeta([_alone(testdata_schema()["events"])]), FrameSource({"public.events": _t(spark, sf_dir, "events").withColumn("props", F.lit('{"mail":{"email":"x"}}'))})).split("\n")])
_named("sizes_for_people", [(12, "12", "12 B"), (1536, "1,536", "1.5 KiB"), (3221225472, "3,221,225,472", "3.0 GiB")], ["n", "as_count", "as_size"], lambda spark, sf_dir: [(n, cli.format_count(n), cli.format_bytes(n)) for n in (12, 1536, 3 << 30)])


def _logical() -> SchemaMeta:
    schema = testdata_schema()
    schema["events"].foreign_keys.clear()
    merge_logical_keys(schema, Config(tables={"public.events": TableConfig(logical_foreign_keys=[LogicalKey(["user_id"], "public.customer", ["c_custkey"])])}))
    return schema


def _alone(t: TableMeta) -> TableMeta:
    t.foreign_keys.clear()
    return t


@query("lock_round_trip", _values(_SENSITIVE, ["table_name", "column_name", "classification"]))
def _(spark, sf_dir):
    """The classification, written to a lock file, read again and found to fit."""
    with tempfile.TemporaryDirectory() as folder:  # a small file of the driver's own
        classify.write_lock(classify.classify(testdata_schema()), f"{folder}/lock.yaml")
        classify.strict_gate(testdata_schema(), f"{folder}/lock.yaml")
        lock = classify.load_lock(f"{folder}/lock.yaml")
    return spark.createDataFrame([(t, c, x) for t, own in lock.items() for c, x in own.items()], "table_name string, column_name string, classification string")


def _raise(text: str) -> None:
    raise SchemaError(text)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: masked customers of a referentially complete subset, each with the number of its orders and events in it."""
    got = clone.clone(spark, _source(spark, sf_dir), testdata_schema(), Config(seed=SEED), _ROOT, most_rows=None)
    orders = got["public.orders"].groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    events = got["public.events"].groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n_events"))
    return got["public.customer"].join(orders, "c_custkey", "left").join(events, "c_custkey", "left").na.fill(0, ["n_orders", "n_events"])


QUERIES["flagship_subset_clone"] = entry
SQL["flagship_subset_clone"] = _WITH + f"SELECT m.*, coalesce(x.n, 0) AS n_orders, coalesce(y.n, 0) AS n_events FROM ({_sql_customer('c')}) m LEFT JOIN (SELECT o_custkey, count(*) AS n FROM o GROUP BY 1) x ON c_custkey = o_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM e GROUP BY 1) y ON c_custkey = user_id"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["entry", "oracle_sql", "queries"]
