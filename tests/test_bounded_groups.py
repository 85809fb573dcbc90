"""As-of groups are bounded by events and versions together, however skewed they are."""

import pytest
from pyspark.sql import functions as F

from lodeplan.operators import asof
from lodeplan.operators.asof import known_as_of

ARGS = {"entity": ["k"], "event_id": ["id"], "valid_at": "valid", "known_at": "known", "valid_from": "a", "valid_to": "b", "recorded_at": "rec", "version_id": "vid", "carry": ["vid"]}


def rows_per_group(monkeypatch, seen):
    """Note the sizes of all groups while they are planned, by counting both sides of each cogroup."""
    plain = asof._together

    def noted(left, right, keys, groups, *rest):
        shard = F.pmod(F.xxhash64(*keys), F.lit(groups))
        both = left.select(shard.alias("s")).unionByName(right.select(shard.alias("s")))
        seen.append((groups, both.groupBy("s").count().agg(F.max("count")).first()[0] or 0))
        return plain(left, right, keys, groups, *rest)

    monkeypatch.setattr(asof, "_together", noted)


@pytest.mark.parametrize("n_events, n_versions, known", [(100, 100_000, "known"), (30_000, 30_000, "known"), (30_000, 30_000, "valid")])
def test_one_entity_of_many_rows(spark, monkeypatch, n_events, n_versions, known):
    """Versions that stay open and are recorded in reverse; what is found is known by construction."""
    seen = []
    rows_per_group(monkeypatch, seen)
    # Version i holds from i on, is open, and is recorded at n - i: later validity is known earlier.
    versions = spark.range(n_versions).select(F.lit(1).alias("k"), F.col("id").alias("vid"), F.timestamp_micros("id").alias("a"), F.lit(None).cast("timestamp").alias("b"), F.timestamp_micros(F.lit(n_versions) - F.col("id")).alias("rec"))
    at = F.pmod(F.xxhash64("id"), F.lit(n_versions))
    events = spark.range(n_events).select(F.lit(1).alias("k"), "id", F.timestamp_micros(at).alias("valid"), F.timestamp_micros(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_versions + 1))).alias("known"))
    args = ARGS | {"known_at": known}
    found = known_as_of(events, versions, shard_rows=3_000, **args).withColumnRenamed("version_vid", "vid")
    # Of versions i <= valid with n - i <= known the last recorded is the least i: n - known.
    least = F.greatest(F.lit(0), F.lit(n_versions) - F.unix_micros(known))
    want = events.filter(least <= F.unix_micros("valid")).select("id", least.alias("vid"))
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()
    assert sum(g for g, _ in seen) > 8 and max(n for _, n in seen) < 4 * 3_000
