import pytest

from tablewright.plans import checks, graph
from tablewright.plans.config import Config, TableConfig, merge_logical_keys, rows_for, validate_hybrid
from tablewright.plans.ddl import parse_ddl
from tablewright.plans.meta import SchemaError, SchemaMeta
from tablewright.plans.meta import testdata_schema as driver_schema

CYCLE = "CREATE TABLE a (id {k} PRIMARY KEY, b_id {t} {n}); CREATE TABLE b (id {k} PRIMARY KEY, a_id {t} {n}); ALTER TABLE a ADD CONSTRAINT a_fk FOREIGN KEY (b_id) REFERENCES b (id) {d}; ALTER TABLE b ADD CONSTRAINT b_fk FOREIGN KEY (a_id) REFERENCES a (id) {d};"


def kinds(sql):
    return [(g.kind, [t.removeprefix("public.") for t in g.tables]) for g in graph.plan_insertion(parse_ddl(sql))]


def test_cycles():
    assert kinds(CYCLE.format(k="uuid", t="uuid", n="NOT NULL", d="DEFERRABLE INITIALLY DEFERRED")) == [("Deferred", ["a", "b"])]
    assert kinds(CYCLE.format(k="serial", t="int", n="", d="")) == [("Backfill", ["a", "b"])]
    with pytest.raises(graph.UnsatisfiableCycle, match="public.a.a_fk"):
        kinds(CYCLE.format(k="serial", t="int", n="NOT NULL", d=""))


def test_self_reference_kinds():
    assert kinds("CREATE TABLE e (id serial PRIMARY KEY, boss int NOT NULL REFERENCES e)") == [("SelfReferencing", ["e"])]
    assert kinds("CREATE TABLE e (id uuid PRIMARY KEY, boss uuid REFERENCES e)") == [("Backfill", ["e"])]


def test_deferred_order():
    sql = "CREATE TABLE a (id uuid PRIMARY KEY, b_id uuid NOT NULL); CREATE TABLE b (id uuid PRIMARY KEY, c_id uuid NOT NULL); CREATE TABLE c (id uuid PRIMARY KEY, a_id uuid NOT NULL);" + "".join(f"ALTER TABLE {x} ADD FOREIGN KEY ({y}_id) REFERENCES {y} (id) {'DEFERRABLE' if x == 'c' else ''};" for x, y in ("ab", "bc", "ca"))
    schema = parse_ddl(sql)
    assert graph.plan_insertion(schema)[0].kind == "Deferred"
    assert graph.deferred_write_order(schema, ["public.a", "public.b", "public.c"]) == ["public.c", "public.b", "public.a"]
    for t in schema.tables:
        for fk in t.foreign_keys:
            fk.deferrable = False
    with pytest.raises(SchemaError, match="no valid write order"):
        graph.deferred_write_order(schema, ["public.a", "public.b", "public.c"])


def test_strict_parity_refuses_serial_in_deferred_cycle():
    schema = parse_ddl(CYCLE.format(k="serial", t="int", n="NOT NULL", d="DEFERRABLE"))
    graph.check_deferred(schema, ["public.a", "public.b"])
    with pytest.raises(SchemaError, match="server-assigned"):
        graph.check_deferred(schema, ["public.a", "public.b"], strict_parity=True)


def test_dependency_tree_marks_cycles():
    nodes = graph.dependency_tree(parse_ddl(CYCLE.format(k="serial", t="int", n="", d="")))
    assert [(n.table, n.depth, n.cyclic) for n in nodes] == [("public.a", 0, False), ("public.b", 1, False), ("public.a", 2, True)]


def test_ddl_shapes():
    schema = parse_ddl("""
        -- a comment; with a semicolon
        CREATE TYPE mood AS ENUM ('sad', 'it''s ok');
        CREATE DOMAIN positive AS integer CHECK (VALUE >= 0);
        CREATE TABLE shop."Items" (
          id bigint GENERATED ALWAYS AS IDENTITY PRIMARY KEY,
          code varchar(8) NOT NULL UNIQUE,
          price numeric(10,2) DEFAULT 0.0 CHECK (price >= 0),
          tags text[] NOT NULL, feeling mood, n positive,
          twice integer GENERATED ALWAYS AS (n * 2) STORED,
          "encValue" text CHECK ("encValue" LIKE 'enc:%'),
          emb vector(5));
        CREATE TABLE refs (code text REFERENCES shop."Items" (code), PRIMARY KEY (code));
        CREATE UNIQUE INDEX one ON refs USING btree (code);
        CREATE UNIQUE INDEX part ON refs (code) WHERE code > 'a';
        CREATE UNIQUE INDEX expr ON refs (lower(code));
    """)
    t = schema["shop.Items"]
    c = {x.name: x for x in t.columns}
    assert c["id"].identity and t.primary_key == ["id"] and c["code"].max_length == 8 and not c["code"].nullable
    assert (c["price"].precision, c["price"].scale, c["price"].check_min) == (10, 2, 0)
    assert (c["tags"].type, c["tags"].element) == ("array", "text")
    assert c["feeling"].enum == ["sad", "it's ok"] and c["n"].domain_of == "int4" and c["n"].check_min == 0
    assert c["twice"].stored_generated == "n * 2" and c["encValue"].check_like_prefix == "enc:" and c["emb"].vector_dimensions == 5
    assert [u.name for u in schema["refs"].unique] == ["one"]


def test_lengths_narrow_through_references():
    schema = parse_ddl("CREATE TABLE p (k varchar(40) PRIMARY KEY); CREATE TABLE c (k varchar(12) REFERENCES p (k));")
    assert schema["p"].column("k").max_length == 12


def test_partial_and_nested_checks():
    assert checks.integer_bounds("CHECK (((a >= 0) AND (a < 5)))") is None
    assert checks.null_escapes("CHECK ((a IS NULL))") == []
    assert checks.allowed_values("CHECK ((a = 'x'))") == ("a", ["x"])


def test_yaml_round_trip():
    schema = driver_schema()
    assert SchemaMeta.from_yaml(schema.to_yaml()) == schema
    with pytest.raises(SchemaError, match="unknown keys"):
        SchemaMeta.from_yaml("tables: [{name: a, colour: red}]")


def test_names():
    schema = parse_ddl("CREATE TABLE a.t (id int); CREATE TABLE b.t (id int);")
    assert schema.find("a.t").schema == "a" and schema.find("zzz") is None
    with pytest.raises(SchemaError, match="ambiguous"):
        schema.find("t")


def test_config():
    text = "seed: x\ntables:\n  public.orders:\n    rows: 0\n    columns: {o_orderpriority: {mask: hash}}\n"
    config = Config.from_yaml(text)
    assert config.seed == "x" and rows_for(config, {}, "public.orders") == 0
    assert rows_for(config, {"a": 0}, "a") == 100 and rows_for(config, {"a": 7}, "a") == 7
    assert Config.from_yaml(config.to_yaml(driver_schema())) == config
    for bad, said in (("tables: {a: {strategy: mask}}", "needs `rows`"), ("tables: {a: {rows: 1, strategy: x}}", "strategy"), ("tables: {a: {rows: 1, columns: {c: {mask: x}}}}", "unknown mask")):
        with pytest.raises(SchemaError, match=said):
            Config.from_yaml(bad)


@pytest.mark.parametrize(("key", "said"), [
    ("{columns: [o_orderkey, o_custkey], ref_table: public.part, ref_columns: [p_partkey]}", "refers to 1"),
    ("{columns: [nope], ref_table: public.part, ref_columns: [p_partkey]}", "no column nope"),
    ("{columns: [o_orderkey], ref_table: public.nope, ref_columns: [p_partkey]}", "unknown table"),
    ("{columns: [o_orderkey], ref_table: public.part, ref_columns: [nope]}", "no column nope"),
])
def test_logical_keys_are_checked(key, said):
    with pytest.raises(SchemaError, match=said):
        merge_logical_keys(driver_schema(), Config.from_yaml(f"tables: {{public.orders: {{rows: 1, logical_foreign_keys: [{key}]}}}}"))


def test_logical_key_is_added_once():
    schema = driver_schema()
    config = Config.from_yaml("tables: {public.orders: {rows: 1, logical_foreign_keys: [{columns: [o_orderkey], ref_table: public.part, ref_columns: [p_partkey]}]}}")
    merge_logical_keys(schema, config)
    merge_logical_keys(schema, config)
    assert [fk.name for fk in schema["orders"].foreign_keys] == ["orders_o_custkey_fkey", "logical_fk_public_orders_0"]


def test_hybrid_rules():
    schema = driver_schema()
    validate_hybrid(schema, Config(tables={"public.events": TableConfig(1, "generate")}))
    with pytest.raises(SchemaError, match="masked table refers"):
        validate_hybrid(schema, Config(tables={"public.customer": TableConfig(1, "generate")}))
    loop = parse_ddl(CYCLE.format(k="serial", t="int", n="", d=""))
    with pytest.raises(SchemaError):
        validate_hybrid(loop, Config(tables={"public.a": TableConfig(1, "generate")}))
