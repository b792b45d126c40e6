"""Databases, in-place masking, large numbers, and what the DDL and the checks say."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from tablewright import cli
from tablewright.operators import clone, generate, mask
from tablewright.operators.subset import subset
from tablewright.plans.checks import integer_bounds
from tablewright.plans.config import ColumnConfig, Config, TableConfig
from tablewright.plans.ddl import parse_ddl
from tablewright.plans.meta import SchemaError, SchemaMeta
from tablewright.sources import io
from tablewright.sources.migrate import transformer


def conf(table="public.t", rows=None, **columns):
    return Config(seed="s", tables={table: TableConfig(rows=rows, columns=columns)})


def test_whole_division_beyond_doubles(spark):
    sizes, start = [200_000_003, 200_000_033], 199_999_999 * 200_000_033
    got = spark.range(start, start + 1000).select("id", generate.whole(F.col("id"), sizes[1]).alias("q")).collect()
    assert all(r.q == r.id // sizes[1] for r in got)
    at = generate.mixed_index(F.col("id"), 1000, sizes[0] * sizes[1], "s", "t")
    rows = spark.range(1000).select(F.pmod(at, F.lit(sizes[1])).alias("a"), generate.whole(at, sizes[1]).alias("b")).collect()
    assert len({(r.a, r.b) for r in rows}) == 1000 and all(0 <= r.b < sizes[0] for r in rows)


def test_histogram_of_many_counts(spark):
    histogram = [(n, 1 + n % 7) for n in range(3000)] + [(5000, 100_000)]
    total = sum(w for _, w in histogram)
    rows = spark.range(5000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x"))
    got = {r.id: (r.n, r.d) for r in generate.draw_count(rows, F.col("x"), histogram, "n").withColumn("d", generate.pick(F.col("x"), total)).collect()}
    bounds, at = [], 0
    for n, w in histogram:
        at += w
        bounds.append((at, n))
    assert len(got) == 5000 and all(n == next(k for b, k in bounds if d < b) for n, d in got.values())


def test_unique_rounds_draw_losers_only(spark):
    schema = parse_ddl("CREATE TABLE t (id serial PRIMARY KEY, a int UNIQUE CHECK (a BETWEEN 0 AND 1), b int, c int, UNIQUE (b, c))")
    t = schema["t"]
    for name, most in (("a", 400), ("b", 15), ("c", 15)):
        t.column(name).check_min, t.column(name).check_max = 0, most
    t.checks.clear()
    rows = generate.generate(spark, schema, conf(rows=200))["public.t"].collect()
    assert len({r.a for r in rows}) == 200 == len({(r.b, r.c) for r in rows})


@pytest.mark.parametrize(("rows", "most"), [(380, 399), (300, 299)])
def test_unique_values_fill_their_domain(spark, monkeypatch, rows, most):
    monkeypatch.setattr(generate, "RETRIES", 3)  # the rest takes free values, whatever the number
    t = parse_ddl("CREATE TABLE t (id serial PRIMARY KEY, a int NOT NULL UNIQUE, b int GENERATED ALWAYS AS (a + 1) STORED)")
    t["t"].column("a").check_min, t["t"].column("a").check_max = 0, most
    got = generate.generate(spark, t, conf(rows=rows))["public.t"]
    assert dict(got.dtypes)["a"] == "int"
    got = got.collect()
    assert sorted(r.id for r in got) == list(range(1, rows + 1)) and len({r.a for r in got}) == rows
    assert all(0 <= r.a <= most and r.b == r.a + 1 for r in got)


def test_more_unique_rows_than_values(spark):
    t = parse_ddl("CREATE TABLE t (id serial PRIMARY KEY, a int NOT NULL UNIQUE)")
    t["t"].column("a").check_min, t["t"].column("a").check_max = 0, 9
    with pytest.raises(SchemaError, match="too few values"):
        generate.generate(spark, t, conf(rows=11))


def test_subset_reads_whole_rows_once(spark):
    schema = parse_ddl("CREATE TABLE n (id int PRIMARY KEY, up int REFERENCES n, wide text); CREATE TABLE c (id int PRIMARY KEY, n_id int REFERENCES n, m_id int REFERENCES n, wide text)")
    src = io.FrameSource({"public.n": spark.createDataFrame([(i, i // 2 or None, "w" * 50) for i in range(1, 40)], "id int, up int, wide string"), "public.c": spark.createDataFrame([(i, i % 39 + 1, None if i % 3 else 7, "x") for i in range(100)], "id int, n_id int, m_id int, wide string")})
    got = subset(src, schema, "n WHERE id = 5", None)
    down = {5, 10, 11, 20, 21, 22, 23}
    children = {i for i in range(100) if i % 39 + 1 in down}
    assert {r.id for r in got["public.c"].collect()} == children and set(got["public.c"].columns) == {"id", "n_id", "m_id", "wide"}
    want = set(down) | ({7} if any(i % 3 == 0 for i in children) else set())
    while more := {n // 2 for n in want if n // 2} - want:
        want |= more
    assert {r.id for r in got["public.n"].collect()} == want


def test_unique_fakes_fit_their_column(spark):
    t = parse_ddl("CREATE TABLE t (id int PRIMARY KEY, full_name varchar(30) UNIQUE)")["t"]
    df = spark.range(2000).select(F.col("id").cast("int"), F.col("id").cast("string").alias("full_name"))
    got = mask.mask_table(df, t, Config()).select("full_name").collect()
    assert len({r[0] for r in got}) == 2000 and max(len(r[0]) for r in got) <= 30
    for ddl, said in (("full_name varchar(17) UNIQUE", "17 characters"), ("phone int UNIQUE", "could collide")):
        short = parse_ddl(f"CREATE TABLE t (id int PRIMARY KEY, {ddl})")
        name = short["t"].columns[1].name
        with pytest.raises(SchemaError, match=said):
            mask.validate(short, conf(**{name: ColumnConfig(mask="fake")}))


def test_json_numbers_keep_their_spelling(spark):
    t = parse_ddl("CREATE TABLE t (id int PRIMARY KEY, js json)")["t"]
    df = spark.createDataFrame([(1, '{"a":1.50,"b":12345678901234567.891,"c":[1e400,-0,0.10],"d":7,"e":"x"}'), (2, '{"a":1.5,"d":1.0}')], "id int, js string")
    got = [r.js for r in mask.mask_table(df, t, conf(js=ColumnConfig(json_paths={"d": "redact", "a": "hash"}))).orderBy("id").collect()]
    assert '"b":12345678901234567.891,"c":[1e400,-0,0.10],"d":null,"e":"x"' in got[0]
    assert json.loads(got[0])["a"] == json.loads(got[1])["a"]  # equal numbers have equal hashes


def test_file_is_replaced_by_one_rename(spark, tmp_path):
    fs, at = io.FileSystem(spark), f"file://{tmp_path}/m.json"
    fs.write(at, "one")
    fs.write(at, "two é")
    assert fs.read(at) == "two é" and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["m.json"]


def test_in_place_resume_and_publish(spark, tmp_path):
    schema = parse_ddl("CREATE TABLE t (id int PRIMARY KEY, email text, n int)")
    source, staging = f"file://{tmp_path}/src", f"file://{tmp_path}/st"
    df = spark.range(500).select(F.col("id").cast("int"), F.concat(F.lit("a"), F.col("id"), F.lit("@b.c")).alias("email"), F.lit(1).alias("n"))
    df.write.parquet(f"{source}/t.parquet")
    src, config = io.ParquetSource(spark, source), Config(seed="k")
    assert not clone.mask_in_place(spark, src, schema, config, staging, batches=5, confirm=True, max_batches=2).complete
    with pytest.raises(SchemaError, match="isn't complete"):
        clone.publish(spark, staging, source)
    with pytest.raises(SchemaError, match="other ones"):
        clone.mask_in_place(spark, src, schema, Config(seed="other"), staging, batches=5, confirm=True, resume=True)
    # a crash between the batches and the manifest: a folder that isn't entered doesn't count
    mask.mask_table(df, schema["t"], config).write.parquet(f"{staging}/public.t/pass-lost")
    assert clone.mask_in_place(spark, src, schema, config, staging, batches=5, confirm=True, resume=True).complete
    want = mask.mask_table(spark.read.parquet(f"{source}/t.parquet"), schema["t"], config).collect()
    clone.publish(spark, staging, source)
    got = spark.read.parquet(f"{source}/t.parquet").collect()
    assert sorted(got) == sorted(want) and all(r.email.endswith("@example.com") for r in got)


def test_restore_of_a_table_that_the_snapshot_lacks(spark, tmp_path):
    schema = parse_ddl("CREATE TABLE a (id int PRIMARY KEY); CREATE TABLE b (id bigint PRIMARY KEY, n numeric(8,2), tags text[], at timestamptz, ok boolean)")
    src = io.FrameSource({"public.a": spark.createDataFrame([(1,)], "id int")})
    clone.snapshot(spark, src, SchemaMeta([schema["a"]]), Config(), f"file://{tmp_path}/s")
    got = clone.restore(spark, f"file://{tmp_path}/s", schema)
    assert got["public.a"].count() == 1 and got["public.b"].count() == 0
    assert got["public.b"].dtypes == [("id", "bigint"), ("n", "decimal(8,2)"), ("tags", "array<string>"), ("at", "timestamp"), ("ok", "boolean")]


def test_equal_checks():
    assert integer_bounds("CHECK ((n = 5))") == ("n", 5, 5) and integer_bounds("CHECK ((n = '5'::integer))") == ("n", 5, 5)
    assert integer_bounds("CHECK ((s = '5'::text))") is None and integer_bounds("CHECK ((s = '5'))") is None
    c = parse_ddl("CREATE TABLE t (n int CHECK (n = 5))")["t"].column("n")
    assert (c.check_min, c.check_max) == (5, 5)


def test_ddl_quotes_and_types_of_other_schemas():
    schema = parse_ddl("""
        CREATE TYPE a.mood AS ENUM ('sad', 'ok'); CREATE TYPE b.mood AS ENUM ('x', 'y');  -- a comment; with 'quotes
        /* CREATE TABLE no (id int); */
        CREATE TABLE t (id int PRIMARY KEY, v text DEFAULT 'a--b', w text DEFAULT '/* c */', m a.mood, o b.mood, "odd--name" int);
        CREATE FUNCTION f() RETURNS int AS $x$ SELECT ';' -- inside $x$ LANGUAGE sql;
        CREATE TABLE u (id int PRIMARY KEY)""")
    t = schema["t"]
    assert [c.name for c in t.columns] == ["id", "v", "w", "m", "o", "odd--name"] and t.column("v").default == "'a--b'"
    assert t.column("m").enum == ["sad", "ok"] and t.column("o").enum == ["x", "y"] and schema["u"].primary_key == ["id"]


def test_report_and_formats(spark):
    schema = parse_ddl("CREATE TABLE t (id int PRIMARY KEY, email text, js jsonb CHECK (js IS NOT NULL))")
    src = io.FrameSource({"public.t": spark.createDataFrame([(1, "x", '{"user":{"contact":{"phone":"1"}},"n":2}'), (2, "y", "no json")], "id int, email string, js string")})
    said = cli.init_report(schema, src)
    assert "t.email  email" in said and "t.js.user.contact.phone  phone" in said and "1 JSON columns" in said
    assert cli.format_count(1234567) == "1,234,567" and [cli.format_bytes(n) for n in (12, 1536, 3 << 30)] == ["12 B", "1.5 KiB", "3.0 GiB"]
    assert transformer("transformUuidConfig") == ("fake", "uuid", "exact")


def test_urls():
    assert io.jdbc_url("postgres://u:p@h:5/d") == "jdbc:postgresql://h:5/d?user=u&password=p" and io.jdbc_url("jdbc:x:y") == "jdbc:x:y"
    assert io.quoted("public.t") == '"public"."t"' and io.quoted("(SELECT 1) q") == "(SELECT 1) q"
    assert io.sequence_statements({"public.t": {"id": 4}}) == ["""SELECT setval(pg_get_serial_sequence('"public"."t"', 'id'), 4, false)"""]
    with pytest.raises(SchemaError, match="not a database URL"):
        io.jdbc_url("mysql://h/d")


def _derby() -> bool:
    import pyspark

    return any(f.startswith("derby-") for f in os.listdir(os.path.join(os.path.dirname(pyspark.__file__), "jars")))


@pytest.mark.skipif(not _derby(), reason="no JDBC driver among Spark's jars")
def test_database_round_trip(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    ddl = 'CREATE SCHEMA "public"; CREATE TABLE "public"."p" ("id" INT PRIMARY KEY, "email" VARCHAR(60)); CREATE TABLE "public"."c" ("id" INT PRIMARY KEY, "p_id" INT REFERENCES "public"."p")'
    io.execute(spark, url, ddl.split("; "))
    schema = parse_ddl("CREATE TABLE p (id int PRIMARY KEY, email varchar(60)); CREATE TABLE c (id int PRIMARY KEY, p_id int REFERENCES p)")
    frames = {"public.c": spark.createDataFrame([(i, i % 5) for i in range(20)], "id int, p_id int"), "public.p": spark.createDataFrame([(i, f"a{i}@b.c") for i in range(5)], "id int, email string")}
    io.write_jdbc(frames, url, ["public.p", "public.c"])  # the other order would break the foreign key
    src, config = io.JdbcSource(spark, url), Config(seed="k")
    assert src.table("public.c").count() == 20 and src.scan(schema["p"], condition="id < 2").count() == 2
    got = clone.clone(spark, src, schema, config, "p WHERE id = 3")
    assert sorted(r.id for r in got["public.c"].collect()) == [3, 8, 13, 18] and [r.email.endswith("@example.com") for r in got["public.p"].collect()] == [True]
    staging = f"{io.scratch(spark)}/db-{uuid.uuid4().hex}"
    clone.mask_in_place(spark, src, schema, config, staging, confirm=True)
    before = {r.id: r.email for r in mask.mask_table(src.scan(schema["p"]), schema["p"], config).collect()}
    clone.update_in_place(spark, staging, schema, config, url)
    assert {r.id: r.email for r in src.table("public.p").collect()} == before
