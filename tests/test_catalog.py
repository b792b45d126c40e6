from tablewright.sources.catalog import QUERIES, from_frames


def test_catalog_rows_become_metadata(spark):
    columns = "schema_name string, table_name string, column_name string, place int, nullable boolean, type_name string, type_kind string, base_name string, element_name string, max_length int, precision int, scale int, dimensions int, is_identity boolean, is_generated boolean, expression string"
    none = (None,) * 4
    rows = [
        ("public", "a", "id", 1, False, "int4", "b", None, None, *none, True, False, None),
        ("public", "a", "mood", 2, True, "mood", "e", None, None, *none, False, False, None),
        ("public", "a", "code", 3, False, "varchar", "b", None, None, 30, None, None, None, False, False, None),
        ("public", "b", "id", 1, False, "int4", "b", None, None, *none, False, False, "nextval('s'::regclass)"),
        ("public", "b", "code", 2, True, "varchar", "b", None, None, 8, None, None, None, False, False, None),
        ("public", "b", "tags", 3, True, "_text", "b", None, "text", *none, False, False, None),
        ("public", "b", "twice", 4, True, "int4", "b", None, None, *none, False, True, "(id * 2)"),
        ("other", "c", "id", 1, True, "int4", "b", None, None, *none, False, False, None),
    ]
    cons = "schema_name string, table_name string, constraint_name string, kind string, column_names string, ref_schema string, ref_table string, ref_columns string, deferrable boolean, deferred boolean, definition string"
    keys = [
        ("public", "a", "a_pkey", "p", "id", None, None, None, False, False, ""),
        ("public", "b", "b_pkey", "p", "id", None, None, None, False, False, ""),
        ("public", "b", "b_fk", "f", "code", "public", "a", "code", True, False, ""),
        ("public", "b", "b_check", "c", "id", None, None, None, False, False, "CHECK ((id > 4))"),
        ("public", "b", "b_u", "u", "id\x1fcode", None, None, None, False, False, ""),
    ]
    schema = from_frames({
        "columns": spark.createDataFrame(rows, columns),
        "constraints": spark.createDataFrame(keys, cons),
        "indexes": spark.createDataFrame([("public", "a", "a_code", "code")], "schema_name string, table_name string, index_name string, column_names string"),
        "enums": spark.createDataFrame([("mood", "ok", 2.0), ("mood", "sad", 1.0)], "type_name string, label string, place double"),
    })
    a, b = schema["a"], schema["b"]
    assert [t.qualified for t in schema.tables] == ["public.a", "public.b"]
    assert a.column("mood").enum == ["sad", "ok"] and a.column("id").identity and a.column("code").max_length == 8
    assert b.column("id").serial and b.column("id").check_min == 5 and b.column("tags").element == "text" and b.column("twice").stored_generated == "(id * 2)"
    assert b.foreign_keys[0].deferrable and b.unique[0].columns == ["id", "code"] and a.unique[0].name == "a_code"
    assert set(QUERIES) == {"columns", "constraints", "indexes", "enums"}
