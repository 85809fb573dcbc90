"""SQL of the problem queries, for engines that read the same tables. Spark doesn't use it."""

_ORDERS = """
orders_now AS (
  SELECT tenant_id, order_id, min(ingested_at) AS first_at, arg_max(op, (ingested_at, row_id)) AS op,
         arg_max(struct_pack(c := customer_id), (ingested_at, row_id)).c AS customer_id,
         arg_max(struct_pack(t := ordered_at), (ingested_at, row_id)).t AS ordered_at
  FROM commerce_orders WHERE tenant_id IS NOT NULL AND order_id IS NOT NULL GROUP BY ALL)"""

_SNAPS = """
snaps AS (
  SELECT snapshot_id, published_at, row_number() OVER (ORDER BY published_at, snapshot_id) AS ord
  FROM (SELECT DISTINCT snapshot_id, published_at FROM catalog_snapshots WHERE state = 'approved'))"""

_P2 = f"""
WITH {_ORDERS}, {_SNAPS},
customers AS (SELECT tenant_id, customer_id, min(recorded_at) AS first_at FROM commerce_customer_history GROUP BY ALL),
o AS (
  SELECT 'commerce_orders.customer_id' AS ref_field, o.tenant_id || '|' || o.order_id AS child_key, o.customer_id::VARCHAR AS ref_key,
         CASE WHEN c.first_at IS NULL THEN 'missing' WHEN c.first_at > o.first_at THEN 'late' END AS reason, o.first_at AS arrived
  FROM orders_now o LEFT JOIN customers c USING (tenant_id, customer_id) WHERE o.op IS DISTINCT FROM 'delete' AND o.customer_id IS NOT NULL),
lines AS (SELECT tenant_id, order_id, line_number, min(ingested_at) AS arrived FROM commerce_order_items WHERE tenant_id IS NOT NULL AND order_id IS NOT NULL GROUP BY ALL),
i AS (
  SELECT 'commerce_order_items.order_id' AS ref_field, concat_ws('|', l.tenant_id, l.order_id, l.line_number) AS child_key, l.order_id::VARCHAR AS ref_key,
         CASE WHEN n.first_at IS NULL THEN 'missing' WHEN n.op = 'delete' THEN 'deleted' WHEN n.first_at > l.arrived THEN 'late' END AS reason, l.arrived
  FROM lines l LEFT JOIN orders_now n USING (tenant_id, order_id)),
refs AS (
  SELECT 'catalog_columns.table_id' AS ref_field, snapshot_id || '|' || id AS child_key, lower(trim(table_id)) AS ref_key, snapshot_id FROM catalog_columns
  UNION
  SELECT 'catalog_metrics.dependency_refs', snapshot_id || '|' || id || '@' || version, lower(trim(ref)), snapshot_id
  FROM (SELECT snapshot_id, id, version, unnest(dependency_refs) AS ref FROM catalog_metrics)),
held AS (
  SELECT DISTINCT f.ref_field, f.ref_key, s.ord FROM (
    SELECT 'catalog_columns.table_id' AS ref_field, id AS ref_key, snapshot_id FROM catalog_tables
    UNION ALL SELECT 'catalog_metrics.dependency_refs', id || '@' || version, snapshot_id FROM catalog_tables
    UNION ALL SELECT 'catalog_metrics.dependency_refs', id || '@' || version, snapshot_id FROM catalog_relationships
    UNION ALL SELECT 'catalog_metrics.dependency_refs', id || '@' || version, snapshot_id FROM catalog_metrics) f JOIN snaps s USING (snapshot_id)),
span AS (SELECT ref_field, ref_key, min(ord) AS first_ord FROM held GROUP BY ALL),
c AS (
  SELECT r.ref_field, r.child_key, r.ref_key, CASE WHEN p.first_ord IS NULL THEN 'missing' WHEN p.first_ord < s.ord THEN 'deleted' ELSE 'late' END AS reason, s.published_at AS arrived
  FROM refs r JOIN snaps s USING (snapshot_id) LEFT JOIN span p USING (ref_field, ref_key)
  WHERE r.ref_key <> '' AND NOT EXISTS (SELECT 1 FROM held h WHERE h.ref_field = r.ref_field AND h.ref_key = r.ref_key AND h.ord = s.ord))
SELECT ref_field, child_key, ref_key, reason, strftime(arrived AT TIME ZONE 'UTC', '%Y-%m') AS period
FROM (SELECT * FROM o UNION ALL SELECT * FROM i UNION ALL SELECT * FROM c) WHERE reason IS NOT NULL"""

_P2_COUNTS = f"""
WITH {_SNAPS},
span AS (SELECT epoch_us(min(ingested_at)) AS low, epoch_us(max(ingested_at)) AS high FROM commerce_orders),
cuts AS (
  SELECT i, CASE WHEN i < 4 THEN low + (high - low) * i // 4 - (low + (high - low) * i // 4) % 3600000000 END AS cut, high FROM span, (SELECT unnest(range(1, 5)) AS i)),
known AS (
  SELECT i, coalesce(cut, high) AS as_of_us, tenant_id, order_id, min(ingested_at) AS first_at, arg_max(op, (ingested_at, row_id)) AS op, arg_max(struct_pack(c := customer_id), (ingested_at, row_id)).c AS customer_id
  FROM commerce_orders JOIN cuts ON cut IS NULL OR epoch_us(ingested_at) < cut WHERE tenant_id IS NOT NULL AND order_id IS NOT NULL GROUP BY ALL),
customers AS (
  SELECT i, tenant_id, customer_id, min(recorded_at) AS first_at FROM commerce_customer_history JOIN cuts ON cut IS NULL OR epoch_us(recorded_at) < cut GROUP BY ALL),
o AS (
  SELECT as_of_us, 'commerce_orders.customer_id' AS ref_field, k.first_at AS arrived, CASE WHEN c.first_at IS NULL THEN 'missing' WHEN c.first_at > k.first_at THEN 'late' END AS reason
  FROM known k LEFT JOIN customers c USING (i, tenant_id, customer_id) WHERE k.op IS DISTINCT FROM 'delete' AND k.customer_id IS NOT NULL),
lines AS (
  SELECT i, coalesce(cut, high) AS as_of_us, tenant_id, order_id, line_number, min(ingested_at) AS arrived
  FROM commerce_order_items JOIN cuts ON cut IS NULL OR epoch_us(ingested_at) < cut WHERE tenant_id IS NOT NULL AND order_id IS NOT NULL GROUP BY ALL),
l AS (
  SELECT l.as_of_us, 'commerce_order_items.order_id' AS ref_field, arrived, CASE WHEN k.first_at IS NULL THEN 'missing' WHEN k.op = 'delete' THEN 'deleted' WHEN k.first_at > l.arrived THEN 'late' END AS reason
  FROM lines l LEFT JOIN known k USING (i, tenant_id, order_id)),
{_P2[_P2.index("refs AS ("):_P2.index("span AS (SELECT ref_field")]}
c AS (
  SELECT epoch_us(n.published_at) AS as_of_us, r.ref_field, s.published_at AS arrived,
         CASE WHEN min(h.ord) IS NULL THEN 'missing' WHEN min(h.ord) < s.ord THEN 'deleted' ELSE 'late' END AS reason
  FROM refs r JOIN snaps s USING (snapshot_id) JOIN snaps n ON n.ord >= s.ord LEFT JOIN held h ON h.ref_field = r.ref_field AND h.ref_key = r.ref_key AND h.ord <= n.ord
  WHERE r.ref_key <> '' GROUP BY r.ref_field, r.child_key, r.ref_key, n.ord, n.published_at, s.ord, s.published_at HAVING count(*) FILTER (h.ord = s.ord) = 0)
SELECT as_of_us, ref_field, strftime(arrived AT TIME ZONE 'UTC', '%Y-%m') AS period, reason, count(*) AS n
FROM (SELECT * FROM o UNION ALL SELECT * FROM l UNION ALL SELECT as_of_us, ref_field, arrived, reason FROM c) WHERE reason IS NOT NULL GROUP BY ALL"""

_CHANGES = f"""
WITH {_SNAPS},
all_rows AS (
  SELECT 'table' AS object_type, snapshot_id, id, version, source_hash, loaded_at, record_id FROM catalog_tables
  UNION ALL SELECT 'column', snapshot_id, id, version, source_hash, loaded_at, record_id FROM catalog_columns),
latest AS (
  SELECT object_type, ord, id, version, regexp_replace(lower(source_hash), '^sha256:', '') AS h
  FROM all_rows JOIN snaps USING (snapshot_id)
  QUALIFY row_number() OVER (PARTITION BY object_type, ord, id ORDER BY loaded_at DESC, record_id DESC) = 1),
changes AS (
  SELECT coalesce(c.object_type, p.object_type) AS object_type, coalesce(c.ord, p.ord) AS ord, coalesce(c.id, p.id) AS id,
         CASE WHEN p.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'removed' WHEN c.version IS DISTINCT FROM p.version OR c.h IS DISTINCT FROM p.h THEN 'changed' END AS change
  FROM (SELECT * FROM latest WHERE ord > 1) c
  FULL JOIN (SELECT object_type, ord + 1 AS ord, id, version, h FROM latest WHERE ord < (SELECT max(ord) FROM snaps)) p
  ON c.object_type = p.object_type AND c.ord = p.ord AND c.id = p.id),
found AS (SELECT object_type, snapshot_id, id, change FROM changes JOIN snaps USING (ord) WHERE change IS NOT NULL)"""

_USABLE = "usable AS (SELECT * FROM commerce_customer_history WHERE valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from))"

_KNOWN = f"""
WITH {_ORDERS}, {_USABLE},
found AS (
  SELECT o.tenant_id, o.order_id, o.customer_id, v.version_id, lower(trim(v.region_name)) AS region
  FROM orders_now o JOIN usable v ON v.tenant_id = o.tenant_id AND v.customer_id = o.customer_id
    AND v.valid_from <= o.ordered_at AND (v.valid_to IS NULL OR o.ordered_at < v.valid_to) AND v.recorded_at <= o.ordered_at
  WHERE o.op IS DISTINCT FROM 'delete'
  QUALIFY row_number() OVER (PARTITION BY o.tenant_id, o.order_id ORDER BY v.recorded_at DESC, v.valid_from DESC, v.version_id DESC) = 1)"""

_LEVELS = """
WITH i AS (
  SELECT DISTINCT tenant_id, customer_id, epoch_us(valid_from) AS a, CASE WHEN valid_to IS NULL THEN 9223372036854775807 ELSE epoch_us(valid_to) END AS b
  FROM commerce_customer_history WHERE valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from)),
ends AS (
  SELECT tenant_id, customer_id, t, sum(d) AS d
  FROM (SELECT tenant_id, customer_id, a AS t, 1 AS d FROM i UNION ALL SELECT tenant_id, customer_id, b, -1 FROM i) GROUP BY ALL),
steps AS (
  SELECT tenant_id, customer_id, t, lead(t) OVER w AS u, sum(d) OVER (w ROWS UNBOUNDED PRECEDING) AS n
  FROM ends WINDOW w AS (PARTITION BY tenant_id, customer_id ORDER BY t)),
kinds AS (
  SELECT *, CASE WHEN n = 0 THEN 'gap' WHEN n >= 2 THEN 'overlap' ELSE 'single' END AS kind, CASE WHEN n = 0 THEN 'gap' ELSE 'period' END AS cover
  FROM steps WHERE u IS NOT NULL),
marked AS (
  SELECT *, kind IS DISTINCT FROM lag(kind) OVER w AS new_kind, cover IS DISTINCT FROM lag(cover) OVER w AS new_cover
  FROM kinds WINDOW w AS (PARTITION BY tenant_id, customer_id ORDER BY t)),
grouped AS (
  SELECT *, sum(new_kind::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS g, sum(new_cover::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS h
  FROM marked WINDOW w AS (PARTITION BY tenant_id, customer_id ORDER BY t))"""

_TO = "CASE WHEN max(u) = 9223372036854775807 THEN -1 ELSE max(u) END AS to_us"

_P6 = """
WITH u AS (
  SELECT * FROM customer_updates WHERE tenant_id IS NOT NULL AND customer_id IS NOT NULL AND changed_at IS NOT NULL AND received_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY tenant_id, customer_id, changed_at ORDER BY received_at DESC, update_id DESC) = 1),
lives AS (
  SELECT *, coalesce(op = 'delete', false) AS gone, sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY tenant_id, customer_id ORDER BY changed_at ROWS UNBOUNDED PRECEDING) AS life FROM u),
state AS (
  SELECT tenant_id, customer_id, changed_at, gone, life,
         last_value(CASE WHEN NOT gone THEN lower(trim(region_name)) END IGNORE NULLS) OVER w AS r,
         last_value(CASE WHEN NOT gone THEN is_internal END IGNORE NULLS) OVER w AS i,
         last_value(CASE WHEN NOT gone THEN is_test_customer END IGNORE NULLS) OVER w AS t
  FROM lives WINDOW w AS (PARTITION BY tenant_id, customer_id, life ORDER BY changed_at ROWS UNBOUNDED PRECEDING)),
edges AS (
  SELECT * FROM state
  WINDOW w AS (PARTITION BY tenant_id, customer_id ORDER BY changed_at)
  QUALIFY CASE WHEN gone THEN coalesce(NOT lag(gone) OVER w, false)
    ELSE coalesce(lag(gone) OVER w, true) OR r IS DISTINCT FROM lag(r) OVER w OR i IS DISTINCT FROM lag(i) OVER w OR t IS DISTINCT FROM lag(t) OVER w END),
versions AS (SELECT *, lead(changed_at) OVER (PARTITION BY tenant_id, customer_id ORDER BY changed_at) AS until FROM edges)
SELECT tenant_id, customer_id, epoch_us(changed_at) AS from_us, coalesce(epoch_us(until), -1) AS to_us FROM versions WHERE NOT gone"""

_UNWRAP = "CASE WHEN json_type({0}) = 'VARCHAR' AND json_valid({0} ->> '$') THEN CAST({0} ->> '$' AS JSON) ELSE {0} END"
#: All JSON values with their paths, level by level.
NODES = f"""
WITH RECURSIVE fields AS (
  SELECT 'rule' AS object_type, record_id, 'activation' AS field, activation AS t FROM catalog_rules
  UNION ALL SELECT 'rule', record_id, 'effect', effect FROM catalog_rules
  UNION ALL SELECT 'metric', record_id, 'expression', expression FROM catalog_metrics
  UNION ALL SELECT 'metric', record_id, 'population', population FROM catalog_metrics
  UNION ALL SELECT 'relationship', record_id, 'predicates', predicates FROM catalog_relationships),
whole AS (SELECT object_type, record_id, field, CAST(t AS JSON) AS v FROM (SELECT * FROM fields WHERE json_valid(t))),
opened AS (SELECT object_type, record_id, field, {_UNWRAP.format("v")} AS v FROM whole),
n AS (
  SELECT object_type, record_id, field, CASE WHEN field = 'predicates' AND json_type(v) = 'OBJECT' THEN field || '[0]' ELSE field END AS path, CAST(NULL AS VARCHAR) AS parent, field AS key, CAST(NULL AS BIGINT) AS slot, v FROM opened
  UNION ALL
  SELECT object_type, record_id, field, path || CASE WHEN key IS NULL THEN '[' || i || ']' WHEN key IN ('predicates', 'args', 'members') AND json_type(v) = 'OBJECT' THEN '.' || key || '[0]' ELSE '.' || key END, path, key, i, v
  FROM (
    SELECT object_type, record_id, field, path, key, i, CASE WHEN key = 'predicate' THEN {_UNWRAP.format("v")} ELSE v END AS v
    FROM (
      SELECT object_type, record_id, field, path, NULL AS key, i, json_extract(v, '$[' || i || ']') AS v FROM (SELECT object_type, record_id, field, path, v, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS i FROM n WHERE json_type(v) = 'ARRAY')
      UNION ALL
      SELECT object_type, record_id, field, path, k, i, json_extract(v, '$."' || k || '"') FROM (SELECT object_type, record_id, field, path, v, unnest(json_keys(v)) AS k, unnest(range(len(json_keys(v)))) AS i FROM n WHERE json_type(v) = 'OBJECT'))))"""

SQL = {
    "p1_found": NODES + " SELECT object_type, record_id, path AS node_path FROM n WHERE json_type(v) = 'OBJECT'",
    "p1_array_items": NODES
    + r"""
SELECT object_type, record_id, nullif(regexp_extract(path, '^(?:(.*)\.)?(predicates|args|members)\[(\d+)\]$', 1), '') AS owner_path, regexp_extract(path, '^(?:(.*)\.)?(predicates|args|members)\[(\d+)\]$', 2) AS array_key,
  CAST(regexp_extract(path, '^(?:(.*)\.)?(predicates|args|members)\[(\d+)\]$', 3) AS INT) AS position, path AS node_path
FROM n WHERE json_type(v) = 'OBJECT' AND regexp_matches(path, '^(?:(.*)\.)?(predicates|args|members)\[(\d+)\]$')""",
    "p1_values": NODES
    + """ SELECT object_type, record_id, parent AS parent_path, CASE WHEN parent IS NOT NULL THEN key END AS key, CAST(slot AS INT) AS slot, CASE WHEN json_type(v) = 'VARCHAR' THEN 'string' ELSE 'scalar' END AS kind, CASE WHEN json_type(v) = 'VARCHAR' THEN v ->> '$' ELSE CAST(v AS VARCHAR) END AS value
FROM n WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY')""",
    "p1_column_references": NODES
    + """ SELECT object_type, lower(trim(v ->> '$')) AS column_id, count(*) AS n, count(DISTINCT record_id) AS n_records FROM n
WHERE key IN ('column_ref', 'left_column', 'right_column') AND json_type(v) = 'VARCHAR' GROUP BY ALL""",
    "p2_found": _P2,
    "p2_counts": """
WITH span AS (SELECT min(ingested_at) AS low, max(ingested_at) AS high FROM commerce_orders),
cuts AS (
  SELECT i, CASE WHEN i = 4 THEN NULL ELSE epoch_us(low) + (epoch_us(high) - epoch_us(low)) * i // 4 - (epoch_us(low) + (epoch_us(high) - epoch_us(low)) * i // 4) % 3600000000 END AS cut, epoch_us(high) AS high FROM span, (SELECT unnest(range(1, 5)) AS i)),
known AS (
  SELECT i, tenant_id, order_id, min(ingested_at) AS first_at, arg_max(op, (ingested_at, row_id)) AS op
  FROM commerce_orders JOIN cuts ON cut IS NULL OR epoch_us(ingested_at) < cut WHERE tenant_id IS NOT NULL AND order_id IS NOT NULL GROUP BY ALL),
lines AS (
  SELECT i, coalesce(cut, high) AS as_of_us, tenant_id, order_id, line_number, min(ingested_at) AS arrived
  FROM commerce_order_items JOIN cuts ON cut IS NULL OR epoch_us(ingested_at) < cut WHERE tenant_id IS NOT NULL AND order_id IS NOT NULL GROUP BY ALL),
judged AS (
  SELECT as_of_us, strftime(arrived AT TIME ZONE 'UTC', '%Y-%m') AS period, CASE WHEN k.first_at IS NULL THEN 'missing' WHEN k.op = 'delete' THEN 'deleted' WHEN k.first_at > l.arrived THEN 'late' END AS reason
  FROM lines l LEFT JOIN known k USING (i, tenant_id, order_id))
SELECT as_of_us, period, reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY ALL""",
    "p2_counts_by_field": _P2_COUNTS,
    "p3_found": _CHANGES + " SELECT object_type, snapshot_id, id, change FROM found",
    "p3_summary": _CHANGES + " SELECT object_type, snapshot_id, change, count(*) AS n FROM found GROUP BY ALL",
    "p4_found": _KNOWN
    + """, last AS (SELECT tenant_id, customer_id, arg_max(struct_pack(r := lower(trim(region_name))), (valid_from, recorded_at, version_id)).r AS region FROM usable GROUP BY ALL)
SELECT f.tenant_id, f.order_id, f.version_id FROM found f JOIN last l USING (tenant_id, customer_id) WHERE f.region IS DISTINCT FROM l.region""",
    "p4_regions": _KNOWN + " SELECT tenant_id, region, count(*) AS n_orders FROM found GROUP BY ALL",
    "p5_found": _LEVELS + f" SELECT kind, tenant_id, customer_id, min(t) AS from_us, {_TO} FROM grouped WHERE kind <> 'single' GROUP BY kind, tenant_id, customer_id, g",
    "p5_periods": _LEVELS + f" SELECT tenant_id, customer_id, min(t) AS from_us, {_TO} FROM grouped WHERE cover = 'period' GROUP BY tenant_id, customer_id, h",
    "p6_found": _P6,
    "p6_believed": _P6.replace("received_at IS NOT NULL", "received_at <= TIMESTAMPTZ '2025-01-01 00:00:00+00'"),
}
