import json

import pytest
from pyspark.sql import functions as F

from tablewright.cli import init_config, main, plan_report
from tablewright.functions import generators as G
from tablewright.operators import classify, clone, constraints, generate, mask, profile
from tablewright.operators.subset import parse_root, subset
from tablewright.plans.config import ColumnConfig, Config, TableConfig
from tablewright.plans.ddl import parse_ddl
from tablewright.plans.meta import ColumnMeta, SchemaError, SchemaMeta, UniqueMeta
from tablewright.plans.meta import testdata_schema as driver_schema
from tablewright.sources import migrate
from tablewright.sources.io import FrameSource, JdbcSource, ParquetSource, next_values, write_copy_text


def conf(table="public.t", rows=None, **columns):
    return Config(seed="s", tables={table: TableConfig(rows=rows, columns=columns)})


BAD = parse_ddl("CREATE TABLE p (id int PRIMARY KEY); CREATE TABLE t (id int PRIMARY KEY, p_id int REFERENCES p, js json, name text UNIQUE, n int, short varchar(5) NOT NULL, u uuid NOT NULL)")


@pytest.mark.parametrize(("columns", "said"), [
    ({"p_id": ColumnConfig(json_paths={"a": "hash"})}, "json_paths on a key"),
    ({"n": ColumnConfig(json_paths={"a": "hash"})}, "isn't JSON"),
    ({"js": ColumnConfig(mask="redact", json_paths={"a": "hash"})}, "exclude"),
    ({"js": ColumnConfig(json_paths={"a..b": "hash"})}, "empty part"),
    ({"id": ColumnConfig(mask="hash")}, "key column"),
    ({"name": ColumnConfig(mask="redact")}, "unique"),
    ({"n": ColumnConfig(mask="hash")}, "hash gives text"),
    ({"short": ColumnConfig(mask="hash")}, "31 characters"),
    ({"short": ColumnConfig(mask="redact")}, "longer than 5"),
    ({"u": ColumnConfig(mask="redact")}, "no redacted value"),
    ({"n": ColumnConfig(mask="fake", generator="zzz")}, "unknown generator"),
])
def test_mask_validation(columns, said):
    with pytest.raises(SchemaError, match=said):
        mask.validate(BAD, conf(**columns))


def test_masks_keep_null_and_rows(spark):
    t = parse_ddl("CREATE TABLE t (id int PRIMARY KEY, email text, other text)")["t"]
    df = spark.createDataFrame([(1, "a@b.c", "x"), (2, None, None), (3, "a@b.c", "x")], "id int, email string, other string")
    got = {r.id: r for r in mask.mask_table(df, t, conf(other=ColumnConfig(mask="hash"))).collect()}
    assert got[2].email is None and got[2].other is None
    assert got[1].other == got[3].other != "x" and got[1].email != got[3].email and got[1].email.endswith("@example.com")
    again = {r.id: r for r in mask.mask_table(df.repartition(7), t, conf(other=ColumnConfig(mask="hash"))).collect()}
    assert got == again


def test_unique_fakes_stay_unique(spark):
    t = parse_ddl("CREATE TABLE t (id int PRIMARY KEY, full_name text UNIQUE)")["t"]
    df = spark.range(3000).select(F.col("id").cast("int"), F.col("id").cast("string").alias("full_name"))
    assert mask.mask_table(df, t, Config()).select("full_name").distinct().count() == 3000


def test_json_paths(spark):
    t = parse_ddl("CREATE TABLE t (id int PRIMARY KEY, js json)")["t"]
    docs = ['{"a":{"b":"x","c":[1]},"n":5,"t":true}', "not json", None, "[1,2]", '{"a":7}']
    df = spark.createDataFrame(list(enumerate(docs)), "id int, js string")
    got = [r.js for r in mask.mask_table(df, t, conf(js=ColumnConfig(json_paths={"a.b": "hash", "n": "fake", "t": "redact"}))).orderBy("id").collect()]
    first = json.loads(got[0])
    assert first["a"]["b"].startswith("masked_") and first["a"]["c"] == [1] and isinstance(first["n"], int) and first["t"] is None
    assert got[1:] == ["not json", None, "[1,2]", '{"a":7}']
    named = spark.createDataFrame([(1, '{"email":"a@b.c","u":{"full_name":"x"},"z":"q","l":[1]}')], "id int, js string")
    doc = json.loads(mask.mask_table(named, t, conf(js=ColumnConfig(json_paths={"email": "fake", "u.full_name": "fake", "z": "fake", "l": "fake"}))).first().js)
    assert doc["email"].endswith("@example.com") and " " in doc["u"]["full_name"] and doc["z"] in G.WORDS and doc["l"] is None
    assert mask.json_keys(df, "js") == ["a", "a.b", "a.c", "n", "t"]


def test_generators_cover_types_and_fit(spark):
    kinds = [*G.BY_TYPE, "text", "varchar", "citext", "xml"]
    cols = [G.value(ColumnMeta("v", k, max_length=4 if k == "varchar" else None), "s", "t", F.col("id").cast("string")).alias(f"c{i}") for i, k in enumerate(kinds)]
    rows = spark.range(50).select(*cols).collect()
    assert all(v is not None for r in rows for v in r) and all(len(r[kinds.index("varchar")]) <= 4 for r in rows)
    with pytest.raises(SchemaError, match="unknown generator"):
        G.value(ColumnMeta("v"), "s", "t", F.lit("1"), "zzz")
    with pytest.raises(SchemaError, match="composite"):
        G.value(ColumnMeta("v", "composite", False, composite=True), "s", "t", F.lit("1"))
    G.register_generator("always_x", lambda x, c: F.lit("x"))
    assert spark.range(1).select(G.value(ColumnMeta("v"), "s", "t", F.lit("1"), "always_x")).first()[0] == "x"


FIXTURES = {
    "arrays": "CREATE TABLE posts (id serial PRIMARY KEY, tags text[] NOT NULL, scores int[] NOT NULL)",
    "composite": "CREATE TABLE tenants (id uuid PRIMARY KEY, name text); CREATE TABLE tenant_users (tenant_id uuid REFERENCES tenants, user_id int, role text, PRIMARY KEY (tenant_id, user_id)); CREATE TABLE memberships (tenant_id uuid NOT NULL, user_id int NOT NULL, joined_at timestamptz, FOREIGN KEY (tenant_id, user_id) REFERENCES tenant_users (tenant_id, user_id))",
    "checks": "CREATE TABLE products (id serial PRIMARY KEY, price numeric(10,2) CHECK (price >= 0), n int CHECK (n > 10), kind text CHECK (kind IN ('a', 'b')))",
    "one_to_one": "CREATE TABLE u (id serial PRIMARY KEY, email text UNIQUE); CREATE TABLE p (id int PRIMARY KEY REFERENCES u, bio text)",
    "tree": "CREATE TABLE n (id serial PRIMARY KEY, parent int REFERENCES n, name varchar(10))",
    "uuid_tree": "CREATE TABLE n (id uuid PRIMARY KEY, parent uuid REFERENCES n)",
    "cycle": "CREATE TABLE a (id uuid PRIMARY KEY, b_id uuid NOT NULL); CREATE TABLE b (id uuid PRIMARY KEY, a_id uuid NOT NULL REFERENCES a DEFERRABLE); ALTER TABLE a ADD FOREIGN KEY (b_id) REFERENCES b DEFERRABLE",
    "generated": "CREATE TABLE g (id serial PRIMARY KEY, a int NOT NULL, twice int GENERATED ALWAYS AS (a * 2) STORED)",
    "only_serial": "CREATE TABLE s (id serial PRIMARY KEY)",
}


@pytest.mark.parametrize("name", sorted(FIXTURES))
def test_generated_rows_keep_constraints(spark, name):
    schema = parse_ddl(FIXTURES[name])
    config = Config(seed="s", tables={t.qualified: TableConfig(rows=20) for t in schema.tables})
    frames = generate.generate(spark, schema, config)
    assert {n: df.count() for n, df in frames.items()} == {t.qualified: 20 for t in schema.tables}


def test_generation_is_deterministic(spark):
    schema = parse_ddl(FIXTURES["composite"])
    config = Config(seed="s")
    one = generate.generate(spark, schema, config, check=False)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    two = generate.generate(spark, schema, config, check=False)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for n in one:
        assert one[n].exceptAll(two[n]).count() == 0 and one[n].count() == two[n].count() == 100


def test_generation_errors(spark):
    schema = parse_ddl("CREATE TABLE t (id serial PRIMARY KEY, b boolean NOT NULL UNIQUE)")
    with pytest.raises(SchemaError, match="own domain"):
        generate.RETRIES, old = 3, generate.RETRIES
        try:
            generate.generate(spark, schema, conf(rows=5))
        finally:
            generate.RETRIES = old
    schema = parse_ddl("CREATE TABLE p (id serial PRIMARY KEY); CREATE TABLE c (id serial PRIMARY KEY, p_id int NOT NULL REFERENCES p)")
    with pytest.raises(SchemaError, match="at least one row"):
        generate.generate(spark, schema, Config(tables={"public.p": TableConfig(rows=0)}))
    schema["c"].column("p_id").nullable = True
    got = generate.generate(spark, schema, Config(tables={"public.p": TableConfig(rows=0), "public.c": TableConfig(rows=3)}))["public.c"]
    assert got.where("p_id IS NULL").count() == 3


def test_profile_shapes_generation(spark):
    schema = parse_ddl("CREATE TABLE p (id serial PRIMARY KEY, note text); CREATE TABLE c (id serial PRIMARY KEY, p_id int NOT NULL REFERENCES p)")
    real = FrameSource({"public.p": spark.range(1, 11).select(F.col("id").cast("int"), F.when(F.col("id") % 2 == 0, "x").alias("note")), "public.c": spark.range(1, 31).select(F.col("id").cast("int"), (F.col("id") % 3 + 1).cast("int").alias("p_id"))})
    shape = profile.capture(real, schema)
    assert shape.rows == {"public.p": 10, "public.c": 30} and shape.nulls == {"public.p": {"note": 0.5}} and shape.children["public.c"]["c_p_id_fkey"] == [(0, 7), (10, 3)]
    assert profile.Profile.from_yaml(shape.to_yaml()) == shape
    with pytest.raises(SchemaError, match="version"):
        profile.Profile.from_yaml("version: 9")
    frames = generate.generate(spark, schema, Config(seed="q"), shape)
    n = frames["public.c"].groupBy("p_id").count().select("count").distinct().collect()
    assert {r[0] for r in n} == {10}


def test_subset(spark):
    schema = parse_ddl("CREATE TABLE part (id int PRIMARY KEY); CREATE TABLE o (id int PRIMARY KEY); CREATE TABLE l (o_id int REFERENCES o, p_id int REFERENCES part, n int)")
    src = FrameSource({"public.part": spark.createDataFrame([(1,), (2,)], "id int"), "public.o": spark.createDataFrame([(1,), (2,)], "id int"), "public.l": spark.createDataFrame([(1, 1, 0), (1, 2, 0), (2, 2, 0), (None, 1, 0), (1, 1, 0)], "o_id int, p_id int, n int")})
    got = subset(src, schema, "part WHERE id = 1")
    assert sorted(map(tuple, got["public.l"].collect()), key=str) == [(1, 1, 0), (None, 1, 0)]
    assert [r.id for r in got["public.o"].collect()] == [1] and [r.id for r in got["public.part"].collect()] == [1]
    with pytest.raises(SchemaError, match="more than 2 rows"):
        subset(src, schema, "part WHERE id = 1", 2)


@pytest.mark.parametrize(("root", "said"), [("orders", "needs the form"), (" WHERE a = 1", "names no table"), ("orders WHERE ", "empty condition"), ("nope WHERE a = 1", "unknown table")])
def test_root_errors(root, said):
    with pytest.raises(SchemaError, match=said):
        parse_root(root, driver_schema())


def test_clone_equals_in_place(spark, sf, tmp_path):
    schema = SchemaMeta([t for t in driver_schema().tables if t.name in ("region", "nation", "customer")])
    src, config = ParquetSource(spark, sf), Config(seed="k")
    a = clone.clone(spark, src, schema, config)
    staging = f"file://{tmp_path}/st"
    with pytest.raises(SchemaError, match="not confirmed"):
        clone.mask_in_place(spark, src, schema, config, staging)
    assert clone.mask_in_place(spark, src, schema, config, staging, dry_run=True).tables["public.region"]["rows"] == 5
    part = clone.mask_in_place(spark, src, schema, config, staging, batches=3, confirm=True, max_batches=4)
    assert not part.complete
    with pytest.raises(SchemaError, match="existing progress"):
        clone.mask_in_place(spark, src, schema, config, staging, batches=3, confirm=True)
    done = clone.mask_in_place(spark, src, schema, config, staging, batches=3, confirm=True, resume=True)
    assert done.complete and not done.issues
    for n in a:
        b = clone.staged(spark, staging, n)
        assert a[n].exceptAll(b).count() == 0 and a[n].count() == b.count()
    with pytest.raises(SchemaError, match="no primary key"):
        clone.plan_in_place(driver_schema(), conf("public.lineitem", l_returnflag=ColumnConfig(mask="hash")))


def test_snapshot(spark, sf, tmp_path):
    schema = SchemaMeta([driver_schema()["region"]])
    path = f"file://{tmp_path}/snap"
    got = clone.snapshot(spark, ParquetSource(spark, sf), schema, Config(), path)
    assert got["tables"]["public.region"]["rows"] == 5
    assert clone.restore(spark, path, schema)["public.region"].count() == 5
    schema["region"].columns.append(ColumnMeta("extra"))
    with pytest.raises(SchemaError, match="lacks column extra"):
        clone.restore(spark, path, schema)
    schema["region"].columns = schema["region"].columns[:1]
    with pytest.raises(SchemaError, match="target lacks column r_name"):
        clone.restore(spark, path, schema)
    with pytest.raises(SchemaError, match="generate"):
        clone.snapshot(spark, ParquetSource(spark, sf), schema, Config(tables={"public.region": TableConfig(1, "generate")}), path + "2")
    with pytest.raises(SchemaError, match="no manifest"):
        clone.restore(spark, path + "3", schema)


def test_strict_and_lock(tmp_path):
    schema, lock = driver_schema(), str(tmp_path / "lock.yaml")
    with pytest.raises(SchemaError, match="no lock file"):
        classify.strict_gate(schema, lock)
    classify.write_lock(classify.classify(schema), lock)
    classify.strict_gate(schema, lock)
    schema["orders"].columns.append(ColumnMeta("email"))
    with pytest.raises(SchemaError, match="new public.orders.email"):
        classify.strict_gate(schema, lock)


def test_policies():
    assert classify.policy_rule("payments", "cardholder_name") == ("redact", None)
    assert classify.policy_rule("payments", "cardholder_name", longest_first=True) == ("fake", "person_name")
    with pytest.raises(SchemaError, match="unknown policy"):
        classify.policy_rule("zzz", "a")
    schema = parse_ddl("CREATE TABLE t (email text PRIMARY KEY, phone text, js json)")
    config = conf(phone=ColumnConfig(mask="none"))
    assert classify.apply_policy(schema, config, "pii") == []
    assert classify.apply_policy(schema, config, "pii", force=True) == [("public.t", "phone", "fake", "phone")]
    assert classify.sensitivity("surname") is None and classify.sensitivity("surname", True) == "person_name" and classify.sensitivity("ip_address") == "address"


def test_constraints_find_what_is_broken(spark):
    schema = parse_ddl("CREATE TABLE p (id int PRIMARY KEY, n int CHECK (n > 0)); CREATE TABLE c (id int PRIMARY KEY, p_id int NOT NULL REFERENCES p)")
    schema["p"].unique.append(UniqueMeta("u", ["n"]))
    frames = {"public.p": spark.createDataFrame([(1, 5), (2, 5), (3, -1)], "id int, n int"), "public.c": spark.createDataFrame([(1, 9), (2, None)], "id int, p_id int")}
    said = " ".join(constraints.violations(frames, schema))
    assert "u (n) isn't unique" in said and "breaks its check" in said and "p_id: 1 nulls" in said and "without a parent" in said


def test_migrations():
    job = {"job": {"mappings": [{"schema": "public", "table": "u", "column": "mail", "transformer": {"config": {"generateEmailConfig": {}}}}, {"schema": "public", "table": "u", "column": "x", "transformer": {"config": {"transformJavascriptConfig": {}}}}]}}
    got = migrate.from_neosync(json.dumps(job))
    assert got.config.column("public.u", "mail") == ColumnConfig("email", "fake") and "no counterpart" in got.notes[0]
    with pytest.raises(SchemaError):
        migrate.from_neosync("{")
    with pytest.raises(SchemaError, match="no mappings"):
        migrate.from_neosync("{}")
    assert list(migrate.from_snaplet("defineConfig({select: {users: true, logs: false}})").config.tables) == ["public.users"]


def test_io(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb\\c\nd"), (2, None)], "id int, s string")
    write_copy_text(df.coalesce(1), str(tmp_path / "copy"))
    text = "".join(p.read_text() for p in (tmp_path / "copy").glob("part-*"))
    assert text == "1\ta\\tb\\\\c\\nd\n2\t\\N\n"
    assert "secret" not in JdbcSource(None, "jdbc:postgresql://u:secret@h/db?password=secret").describe()
    schema = parse_ddl("CREATE TABLE t (id serial PRIMARY KEY, s text)")
    assert json.loads(next_values({"public.t": df}, schema)) == {"public.t": {"id": 3}}


def test_keyset_pages_cover_all(spark):
    df = spark.range(25).select((F.col("id") % 5).alias("a"), F.col("id").alias("b"))
    seen, after = [], None
    while page := [tuple(r) for r in clone.keyset_page(df, ["a", "b"], after, 7).collect()]:
        seen += page
        after = list(page[-1])
    assert seen == sorted((i % 5, i) for i in range(25))


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "s.sql").write_text(FIXTURES["one_to_one"])
    assert "Simple: public.u" in plan_report(parse_ddl(FIXTURES["one_to_one"]))
    assert init_config(parse_ddl(FIXTURES["one_to_one"])).column("public.u", "email").mask == "fake"
    assert main(["up", "--schema-file", str(tmp_path / "s.sql"), "--target", str(tmp_path / "out")]) == 0
    assert "public.u: 100" in capsys.readouterr().out
    assert main(["classify", "--schema-file", str(tmp_path / "s.sql"), "--check", "--lockfile", str(tmp_path / "none")]) == 1
    assert main(["policy-list"]) == 0
