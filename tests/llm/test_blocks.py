"""Mixes as blocks: every prefix has its shares to within a block; weights of any kind."""

from fractions import Fraction

import pytest

from lodeplan.llm.mixing import mix_blocks, mix_sources, period, whole_weights

TARGETS = "mix_id string, source string, target_percent double, max_repeats int, size_percent int"


def test_weights():
    assert whole_weights([50, 30, 20]) == [5, 3, 2]
    assert whole_weights([0.5, 99.5]) == [1, 199] and whole_weights([0, 0]) == [0, 0]
    many = whole_weights([123_456_789, 987_654_321, 1])
    assert sum(many) in (10_000, 10_001) and min(many) >= 1
    assert sum(map(len, period(whole_weights([0.5, 99.5])))) == 200


@pytest.mark.parametrize("shares", [(50, 30, 20), (0.5, 99.5, 0), (33.3, 33.3, 33.4)])
def test_every_prefix_is_within_a_block(spark, shares):
    # Documents of up to six blocks.
    rows = [(i, "abc"[i % 3], 1 + (i * 7919) % 240) for i in range(3000)] + [(5000, "a", 0)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("m", s, float(w), 3, 60) for s, w in zip("abc", shares)], TARGETS)
    blocks = mix_blocks(sizes, targets, block_tokens=40, buckets=4).toPandas()
    drawn, report = mix_sources(sizes, targets, block_tokens=40, buckets=4)
    drawn, report = drawn.toPandas(), report.toPandas().set_index("source")
    # The parts of each drawn document are the document.
    assert (blocks.groupby(["source", "doc_id", "repeat_no"]).part_tokens.sum().sort_index() == drawn.groupby(["source", "doc_id", "repeat_no"]).n_tokens.sum().sort_index()).all()
    by_slot = blocks.groupby(["slot", "source"]).part_tokens.sum().reset_index()
    assert by_slot.slot.is_unique and by_slot.part_tokens.max() <= 40
    filled = int(min(report.target_tokens[s] / 40 / w for s, w in zip("abc", shares) if w) * 100) - 2
    so_far = dict.fromkeys("abc", 0)
    for slot in range(filled):
        own = by_slot[by_slot.slot == slot].iloc[0]
        assert own.part_tokens == 40
        so_far[own.source] += 1
        assert all(abs(so_far[s] - Fraction(str(w)) / 100 * (slot + 1)) < 1 for s, w in zip("abc", shares))
    assert (report.max_deviation_blocks.dropna() < 1).all() and not report.short.any()
    assert [report.target_tokens[s] for s in "abc"] == pytest.approx([sum(r[2] for r in rows) * w / 100 * 0.6 for w in shares])
