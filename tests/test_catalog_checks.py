from lodeplan.operators import catalogs

TABLES = "record_id long, snapshot_id string, id string, grain array<string>, primary_key array<string>, physical struct<database: string, schema_name: string, name: string>, extra int"
VALUES = "object_type string, record_id long, parent_path string, key string, value string"


def frames(spark):
    tables = spark.createDataFrame(
        [
            (1, "s", "d.t", ["d.t.a", None, "D.T.a "], None, ("d", "c", "t"), 0),
            (2, "s", "d.u", ["d.t.a"], ["d.u.gone"], ("d", "c", "u v"), 0),
            (3, "s", "d.w", None, [], None, 0),
            (4, "other", "d.x", ["d.x.b"], None, ("d", None, "x"), 0),
        ],
        TABLES,
    )
    columns = spark.createDataFrame([(10, "s", "d.t.a", " D.t"), (11, "s", "d.u.b", None), (12, "s", "d.u.c", "d.t"), (13, "s", "d.z.c", "d.z"), (13, "s", "d.z.c", "d.z")], "record_id long, snapshot_id string, id string, table_id string")
    links = spark.createDataFrame([(20, "s", "l", True), (21, "s", "m", True), (22, "s", "n", None)], "record_id long, snapshot_id string, id string, is_temporal boolean")
    values = spark.createDataFrame(
        [
            ("relationship", 20, "predicates[0]", "op", "LT_or_null"),
            ("relationship", 20, "predicates[0]", "left_column", "d.t.a"),
            ("relationship", 21, "predicates[0]", "op", "eq"),
            ("relationship", 21, "predicates[0]", "right_column", "d.t.none"),
            ("relationship", 21, "predicates[0]", "column_ref", "d.t.none"),
            ("metric", 20, "expression", "column_ref", " "),
            ("rule", 20, "effect.required_tables", None, "d.none"),
            ("rule", 20, "effect.other", None, "d.none"),
        ],
        VALUES,
    )
    return tables, columns, links, values


def test_records_that_contradict_themselves(spark):
    rows = catalogs.invalid_records(*frames(spark)).collect()
    assert sorted((r.check, r.record_id) for r in rows) == [
        ("column.parent", 11),
        ("column.parent", 12),
        ("relationship.not_temporal", 21),
        ("table.identifier", 2),
        ("table.identifier", 3),
        ("table.identifier", 4),
        ("table.key_of_other_table", 2),
    ]
    assert catalogs.invalid_records(*[df.limit(0) for df in frames(spark)]).count() == 0


def test_mentions(spark):
    tables, columns, links, values = frames(spark)
    named = catalogs.mentions(values, {k: links for k in ("metric", "rule", "relationship")}).unionByName(catalogs.table_mentions(tables, columns))
    held = columns.selectExpr("'column' as target", "snapshot_id", "id as ref").unionByName(tables.selectExpr("'table' as target", "snapshot_id", "id as ref"))
    rows = catalogs.unresolved_mentions(named, held).collect()
    assert sorted(tuple(r) for r in rows) == [
        ("column.table_id", "s", "d.z.c", "d.z"),
        ("relationship.right_column", "s", "m", "d.t.none"),
        ("rule.required_tables", "s", "l", "d.none"),
        ("table.grain", "other", "d.x", "d.x.b"),
        ("table.primary_key", "s", "d.u", "d.u.gone"),
    ]
    assert catalogs.unresolved_mentions(named.limit(0), held).count() == 0


def test_levels_and_cycles(spark):
    rows = [("a", ["b@1", " C@1 ", "t@1"]), ("b", ["c@1", None]), ("c", None), ("c", []), ("x", ["y@1"]), ("y", ["z@1"]), ("z", ["y@1", "a@1"]), ("self", ["self@1"]), (None, ["a@1"])]
    rows = [("s", i, 1, d) for i, d in rows] + [("other", "a", 1, ["b@1"]), ("other", "b", None, ["a@1"]), (None, "a", 1, ["a@1"])]
    metrics = spark.createDataFrame(rows, "snapshot_id string, id string, version int, dependency_refs array<string>")
    got = {(r.snapshot_id, r.ref): (r.level, r.cyclic) for r in catalogs.dependency_levels(metrics).collect()}
    assert got == {
        ("s", "a@1"): (2, False),
        ("s", "b@1"): (1, False),
        ("s", "c@1"): (0, False),
        ("s", "x@1"): (None, True),
        ("s", "y@1"): (None, True),
        ("s", "z@1"): (None, True),
        ("s", "self@1"): (None, True),
        ("other", "a@1"): (0, False),
    }
    assert catalogs.dependency_levels(metrics.limit(0)).count() == 0
