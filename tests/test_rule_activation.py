"""Rules that metrics activate, over small catalog tables."""

import json

from lodeplan.operators.catalogs import decidable_rules, metric_closure, metric_tables
from lodeplan.operators.nested import flatten_json

ACTIVATIONS = {
    "column": {"op": "uses_column", "object_id": "w.a.x"}, "base": {"op": "USES_TABLE", "object_id": "W.B"}, "tag": {"op": "any_scan_with_tag", "tag": "tenant_scoped"},
    "old_tag": {"op": "any_scan_with_tag", "tag": "old"}, "metric": {"op": "uses_metric", "metric_ref": "m.plain"}, "pinned": {"op": "uses_metric", "metric_ref": "m.named@2"},
    "stale": {"op": "uses_metric", "metric_ref": "m.named@1"}, "nameless": {"op": "uses_metric", "metric_ref": None}, "always": {"op": "always"}, "slot": {"op": "slot_unset", "slot": "timezone"},
    "entity": {"op": "population_contains_entity", "entity": "customer"},
}


def test_all_decidable_activations(spark):
    metrics = spark.createDataFrame([(1, "s", "m.named", 2, " W.A ", '{"column_ref": "w.a.x"}', None), (2, "s", "m.plain", 1, "w.b", '{"op": "count"}', None), (3, "other", "m.plain", 1, "w.b", "{}", None), (4, "s", "m.nowhere", 1, None, "{}", None)], "record_id long, snapshot_id string, id string, version int, base_table string, expression string, population string")
    tables = spark.createDataFrame([(1, "s", "w.a", ["fact"], 1), (2, "s", "w.b", ["old"], 1), (3, "s", "w.b", ["Tenant_scoped", "fact"], 2), (4, "third", "w.a", ["tenant_scoped"], 1)], "record_id long, snapshot_id string, id string, tags array<string>, loaded_at int")
    rules = spark.createDataFrame([(i, "s", name, json.dumps(a)) for i, (name, a) in enumerate(ACTIVATIONS.items())], "record_id long, snapshot_id string, id string, activation string")
    values = flatten_json(metrics, record_id="record_id", fields=["expression", "population"], kinds=("string",))
    closure = metric_closure(values, metrics)
    assert {tuple(r) for r in metric_tables(closure, metrics).select("snapshot_id", "id", "table_id").collect()} == {("s", "m.named", "w.a"), ("s", "m.plain", "w.b"), ("other", "m.plain", "w.b")}
    got = [tuple(r) for r in decidable_rules(closure, flatten_json(rules, record_id="record_id", fields=["activation"], kinds=("string",)), rules, metrics, tables).collect()]
    assert sorted(got) == sorted(("s", m, r) for m, r in [("m.named", "column"), ("m.plain", "base"), ("m.plain", "tag"), ("m.plain", "metric"), ("m.named", "pinned")])
