"""Packing in many groups, whose unfilled containers are packed together; the index of sums."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeplan.llm.packing import Complements, fill_containers


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=13, max_size=13), st.integers(2, 12))
def test_index_finds_a_pair_or_triple_if_there_is_one(counts, total):
    counts = np.array(counts)
    counts[0] = 0
    has = lambda c: all(counts[n] >= c.count(n) for n in set(c))
    pairs = [(a, total - a) for a in range(1, total) if has((a, total - a))]
    triples = [(a, b, total - a - b) for a in range(1, total) for b in range(1, total - a) if has((a, b, total - a - b))]
    index = Complements(counts)
    assert (index.pair(total) is not None) == bool(pairs)
    found = Complements(counts).triple(total)
    assert found is None or (sum(found) == total and has(found))
    if not pairs and len({n for t in triples for n in t}) == 3 and all(len(set(t)) == 3 for t in triples):
        assert found is not None


def test_groups_are_packed_together(spark):
    rows = [(i, "x " * (1 + i * 7919 % 97)) for i in range(4000)] + [(9000, None), (9001, "")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    one, many = (fill_containers(documents, doc_id="doc_id", text="text", capacity=128, group_rows=n).toPandas() for n in (50_000, 200))
    for got in (one, many):
        assert got.groupby("container_id").n_tokens.sum().max() <= 128 and sorted(got.doc_id) == sorted(d for d, _ in rows)
    least = -(-one.n_tokens.sum() // 128)
    assert one.container_id.nunique() <= least + 1
    assert many.container_id.nunique() <= least + 4  # 21 groups, each of which would leave one of its own
