"""Rows without a time of arrival belong to the first batch."""

from datetime import datetime, timezone

import pytest

from lodeplan.queries.problems import _commerce_states

T = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)


@pytest.mark.parametrize("increments", [1, 2, 4])
def test_null_times(spark, tmp_path, increments):
    orders = [(1, "t", 1, 7, "insert", T(1)), (2, "t", 2, 7, "insert", None), (3, "t", 3, 8, "insert", T(9)), (4, "t", 4, 9, "insert", T(9)), (5, "t", 5, 7, "insert", None), (6, "t", 5, 7, "delete", T(9))]
    items = [("t", 1, 1, T(5)), ("t", 2, 1, T(5)), ("t", 2, 2, None), ("t", 3, 1, None), ("t", 6, 1, None), ("t", 6, 1, T(8)), ("t", 6, 2, None), ("t", 5, 1, T(5))]
    customers = [("t", 7, 1, T(1)), ("t", 8, 2, None)]
    spark.createDataFrame(orders, "row_id long, tenant_id string, order_id long, customer_id long, op string, ingested_at timestamp").write.parquet(f"{tmp_path}/commerce_orders.parquet")
    spark.createDataFrame(items, "tenant_id string, order_id long, line_number int, ingested_at timestamp").write.parquet(f"{tmp_path}/commerce_order_items.parquet")
    spark.createDataFrame(customers, "tenant_id string, customer_id long, version_id long, recorded_at timestamp").write.parquet(f"{tmp_path}/commerce_customer_history.parquet")
    owners, lines, _ = _commerce_states(spark, str(tmp_path), increments)
    # Order 2 and customer 8 exist though no time is known; nothing is late without both times.
    found = {(r.order_id, r.line_number, r.reason, r["at"] and r["at"].day) for r in lines.report().collect()}
    assert found == {(6, 1, "missing", 8), (6, 2, "missing", None), (5, 1, "deleted", 5)}
    assert {(r.order_id, r.customer_id, r.reason) for r in owners.report().collect()} == {(4, 9, "missing")}
