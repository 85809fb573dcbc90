"""Mixing sources to target weights.

Pfair scheduling: a mix is a line of slots, each a block of tokens. Block j of a source with weight
w is released at floor(j / w) and due at ceil((j + 1) / w); earliest deadline first fills the
slots, so after any slot each source has its share to within one block. The schedule repeats after as
many slots as the weights, in lowest terms, sum up to; it is worked out for one such period per
mix, and every block finds its slot from its number alone.

Whole documents are drawn; the mix itself (:func:`mix_blocks`) is made of their tokens in blocks, so
that a long document doesn't push its source ahead of its share.

A source's documents are put in a fixed shuffled order and numbered by the tokens before them.
That running sum is taken in two levels, within hash buckets and over the buckets' sums, so a
source with most of the corpus is worked on by many tasks.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a block.
BLOCK_TOKENS = 4096
#: Longest period of a schedule; weights that need a longer one are rounded to such a part of their sum.
PERIOD_SLOTS = 10_000
#: Documents of a bucket within which the running sum is taken.
BUCKET_ROWS = 20_000


def whole_weights(weights: list[object]) -> list[int]:
    """The weights, whole or not, as whole numbers in lowest terms whose sum is a period."""
    exact = [Fraction(str(w)) for w in weights]
    if not sum(exact):
        return [0] * len(exact)
    scale = lcm(*[w.denominator for w in exact])
    whole = [int(w * scale) for w in exact]
    whole = [w // gcd(*whole) for w in whole]
    if sum(whole) <= PERIOD_SLOTS:
        return whole
    # Largest remainders; no weight above 0 falls to 0.
    parts = [w * PERIOD_SLOTS / sum(exact) for w in exact]
    rounded = [max(int(p), w > 0) for p, w in zip(parts, exact)]
    for i in sorted(range(len(parts)), key=lambda i: int(parts[i]) - parts[i])[: max(0, PERIOD_SLOTS - sum(rounded))]:
        rounded[i] += 1
    return rounded


def period(weights: list[int]) -> list[list[int]]:
    """For each weight the slots of one period that earliest deadline first gives it."""
    shrink = gcd(*weights) or 1
    weights = [w // shrink for w in weights]
    length = sum(weights)
    done, slots = [0] * len(weights), [[] for _ in weights]
    for slot in range(length):
        ready = [(-(-(done[i] + 1) * length // w), i) for i, w in enumerate(weights) if done[i] < w and done[i] * length // w <= slot]
        if ready:
            _, i = min(ready)
            slots[i].append(slot)
            done[i] += 1
    return slots


def pattern(targets: DataFrame, *, mix: str, source: str, weight: str) -> DataFrame:
    """(mix, source, period_blocks, period_slots, slots): the schedule of a period per mix."""
    schema = f"{mix} string, {source} string, period_blocks int, period_slots int, slots array<int>"

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows[weight] > 0].sort_values([source])
        if not len(rows):
            return pd.DataFrame({mix: [], source: [], "period_blocks": [], "period_slots": [], "slots": []})
        slots = period(whole_weights(rows[weight].tolist()))
        return pd.DataFrame({mix: rows[mix], source: rows[source], "period_blocks": [len(s) for s in slots], "period_slots": sum(map(len, slots)), "slots": slots})

    return targets.select(mix, source, weight).groupBy(mix).applyInPandas(work, schema)


def positions(sizes: DataFrame, *, doc_id: str, source: str, n_tokens: str, buckets: int, seed: int) -> DataFrame:
    """``sizes`` with ``start``, the tokens of the source's documents before each."""
    placed = sizes.withColumn("bucket", F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(buckets)).cast("int"))
    sums = placed.groupBy(source, "bucket").agg(F.sum(n_tokens).alias("own"))
    over = Window.partitionBy(source).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(source, "bucket", F.coalesce(F.sum("own").over(over), F.lit(0)).alias("before"))
    within = Window.partitionBy(source, "bucket").orderBy(F.xxhash64(F.lit(seed), doc_id), doc_id, n_tokens).rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.withColumn("inner", F.coalesce(F.sum(n_tokens).over(within), F.lit(0)))
    return inner.join(before, [source, "bucket"]).withColumn("start", F.col("before") + F.col("inner")).drop("bucket", "before", "inner")


def _slot(block: Column) -> Column:
    """The slot of a source's block in its mix."""
    return F.floor(block / F.col("period_blocks")).cast("long") * F.col("period_slots") + F.get("slots", F.pmod(block, F.col("period_blocks")).cast("int"))


def _drawn(sizes: DataFrame, targets: DataFrame, doc_id: str, source: str, n_tokens: str, buckets: int | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """The targets in tokens with the schedules, and the documents drawn for them with their offsets."""
    sizes = sizes.select(doc_id, source, n_tokens)
    targets = targets.dropna(subset=["mix_id", source]).groupBy("mix_id", source).agg(*[F.max(c).alias(c) for c in ("target_percent", "max_repeats", "size_percent")])
    if buckets is None:
        buckets = max(1, -(-sizes.count() // BUCKET_ROWS))
    total = sizes.agg(F.sum(n_tokens)).first()[0] or 0
    have = sizes.groupBy(source).agg(F.sum(n_tokens).alias("have"))
    # Targets in ten-thousandths of a token, so that percentages of percentages stay exact.
    percents = F.coalesce("target_percent", F.lit(0)) * F.coalesce("size_percent", F.lit(0))
    goals = (
        targets.join(pattern(targets, mix="mix_id", source=source, weight="target_percent"), ["mix_id", source], "left")
        .join(have, source, "left")
        .withColumn("need", percents.cast("decimal(18,6)") * F.lit(total).cast("decimal(20,0)"))
        .withColumn("passes", F.when(F.col("need") <= 0, 0).when(F.coalesce("have", F.lit(0)) <= 0, 1).otherwise(F.least(F.coalesce("max_repeats", F.lit(0)).cast("long"), F.ceil(F.col("need") / (F.col("have") * 10000)).cast("long"))))
    )
    laid = positions(sizes.filter(F.col(source).isNotNull()), doc_id=doc_id, source=source, n_tokens=n_tokens, buckets=buckets, seed=seed)
    plan = goals.filter("passes > 0").select("mix_id", source, "have", "need", "passes", "period_blocks", "period_slots", "slots")
    drawn = (
        laid.join(plan, source)
        .withColumn("repeat_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)))
        .withColumn("offset", F.col("repeat_no") * F.col("have") + F.col("start"))
        .filter(F.col("offset").cast("decimal(38,0)") * 10000 < F.col("need"))
        .withColumn("repeat_no", F.col("repeat_no").cast("int"))
    )
    return goals, drawn


def mix_sources(sizes: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", source: str = "source", n_tokens: str = "n_tokens", block_tokens: int = BLOCK_TOKENS, buckets: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Draw documents by source for each mix; returns (drawn, shares).

    ``sizes``: doc_id, source and n_tokens per document (no null sizes). ``targets``: one row per
    mix_id and source with target_percent, max_repeats and size_percent; a mix has size_percent of
    the tokens of all documents. Percentages need not be whole; a mix whose percentages, in lowest
    terms, sum up to more than PERIOD_SLOTS is interleaved by percentages rounded to such a part.

    ``drawn`` has (mix_id, source, doc_id, repeat_no, n_tokens, slot, offset): a source's documents
    are drawn in their order, over and over, until its target is reached or all have been used
    max_repeats times. ``slot`` is that of the block a document begins in; :func:`mix_blocks` has all
    its blocks. A target is overshot by less than one document.

    ``shares`` has per mix and source the target and drawn tokens, blocks, passes begun, the actual
    share of the mix in percent, ``short``: whether it couldn't fill its target, and
    ``max_deviation_blocks``: how far, in blocks, the source's tokens in the mix are at most from its
    target share of the slots so far, before and after each block that its target fills; null if it
    fills none. A source without documents draws nothing and is short if its target isn't 0. Slots
    that a short source can't fill stay empty; its share isn't given to others. Null sources belong
    to no target but count in the total; zero or null percentages draw nothing. Empty documents give
    targets of 0. Of several rows for one mix and source the greatest values hold; a null mix or
    source is no target. Other columns of both inputs are ignored.
    """
    goals, drawn = _drawn(sizes, targets, doc_id, source, n_tokens, buckets, seed)
    got = drawn.groupBy("mix_id", source).agg(F.sum(n_tokens).alias("drawn_tokens"), F.max("offset").alias("last"), F.max("repeat_no").alias("repeats"))
    everything = Window.partitionBy("mix_id")
    # Blocks that a target fills, from their tokens: before one, and after it.
    filled = _parts(drawn, n_tokens, block_tokens).filter((F.col("block") + 1).cast("decimal(38,0)") * block_tokens * 10000 <= F.col("need"))
    blocks = filled.groupBy("mix_id", source, "block", "slot").agg(F.sum("part_tokens").alias("tokens"))
    share = F.col("target_percent").cast("double") / F.sum("target_percent").over(everything)
    lag = F.greatest(F.abs(F.col("block") - F.col("share") * F.col("slot")), F.abs(F.col("block") + F.col("tokens") / block_tokens - F.col("share") * (F.col("slot") + 1)))
    deviations = blocks.join(goals.select("mix_id", source, share.alias("share")), ["mix_id", source]).groupBy("mix_id", source).agg(F.round(F.max(lag), 6).alias("max_deviation_blocks"))
    shares = (
        goals.join(got, ["mix_id", source], "left")
        .join(deviations, ["mix_id", source], "left")
        .withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0)))
        .select(
            "mix_id",
            source,
            "target_percent",
            (F.col("need").cast("double") / 10000).alias("target_tokens"),
            "drawn_tokens",
            F.coalesce(F.expr(f"last div {block_tokens} + 1"), F.lit(0)).alias("blocks"),
            F.coalesce(F.col("repeats") + 1, F.lit(0)).alias("passes"),
            F.round(100.0 * F.col("drawn_tokens") / F.nullif(F.sum("drawn_tokens").over(everything), F.lit(0)), 4).alias("actual_percent"),
            (F.col("drawn_tokens").cast("decimal(38,0)") * 10000 < F.col("need")).alias("short"),
            "max_deviation_blocks",
        )
    )
    slot = _slot(F.floor(F.col("offset") / block_tokens))
    return drawn.select("mix_id", source, doc_id, "repeat_no", n_tokens, slot.alias("slot"), "offset"), shares


def _parts(drawn: DataFrame, n_tokens: str, block_tokens: int) -> DataFrame:
    """``drawn`` with a row for each block a document has tokens in: block, slot, from_token, part_tokens."""
    end = F.col("offset") + F.greatest(F.col(n_tokens), F.lit(1))
    cut = drawn.withColumn("block", F.explode(F.sequence(F.expr(f"offset div {block_tokens}"), F.floor((end - 1) / block_tokens))))
    cut = cut.withColumn("from_token", F.greatest(F.lit(0), F.col("block") * block_tokens - F.col("offset")))
    return cut.withColumn("part_tokens", F.least(F.col(n_tokens), (F.col("block") + 1) * block_tokens - F.col("offset")) - F.col("from_token")).withColumn("slot", _slot(F.col("block")))


def mix_blocks(sizes: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", source: str = "source", n_tokens: str = "n_tokens", block_tokens: int = BLOCK_TOKENS, buckets: int | None = None, seed: int = 0) -> DataFrame:
    """The mixes as blocks: (mix_id, slot, source, block, doc_id, repeat_no, from_token, part_tokens).

    In the order of ``slot``, and within it of the source's documents, a mix is interleaved; a slot
    has ``block_tokens`` tokens of one source, fewer only where the source ends. A document's tokens
    [from_token, from_token + part_tokens) are in the block; empty documents come out with 0.
    Arguments as for :func:`mix_sources`.
    """
    _, drawn = _drawn(sizes, targets, doc_id, source, n_tokens, buckets, seed)
    return _parts(drawn, n_tokens, block_tokens).select("mix_id", "slot", source, "block", doc_id, "repeat_no", "from_token", "part_tokens")
