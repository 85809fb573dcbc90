"""Filling fixed-capacity containers with items.

Exact-complement hashing: the sums of one, two and three available lengths are indexed, and a gap is
looked up as a single length, as a pair and as a triple. A combination that fills the gap
exactly is consumed as often as the counts allow. What has no exact complement goes best-fit, the
longest first, into the containers with the least room that still suffices.

Items are spread over task groups by a hash of their id, and each group is packed on its own. With
``group_rows`` items a group has far more items than lengths, so almost all gaps find an exact
complement. The items of the containers that a group couldn't fill are packed once more, together
with those of the other groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeplan.llm.tokens import TOKENIZER, encoder, token_bytes
from lodeplan.sources.tables import cut, spread

#: Items packed together in one task group.
GROUP_ROWS = 50_000


class Complements:
    """Counts of the available lengths, indexed by the sums of one, two and three of them.

    Pairs lie in buckets by their sum, those of frequent lengths first. Counts only fall, so what was
    used up is passed over once and never looked at again: ``pair_at`` and ``one_at`` remember for
    each sum how far it is used up.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.left = [0, *counts[1:].tolist()]
        lengths = np.flatnonzero(self.left)
        small, large = (lengths[i] for i in np.triu_indices(len(lengths)))
        fits = small + large < len(counts)
        small, large = small[fits], large[fits]
        often = np.minimum(counts[small], counts[large]) // np.where(small == large, 2, 1)
        order = np.lexsort([-often, small + large])
        edges = np.searchsorted((small + large)[order], np.arange(len(counts) + 1))
        self.small, self.large = small[order].tolist(), large[order].tolist()
        self.pair_at, self.pair_end = edges[:-1].tolist(), edges[1:].tolist()
        # The third length of a triple: any that is available, the longest first.
        self.lengths = lengths[::-1].tolist()
        self.one_at = [0] * len(counts)

    def has(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left[n] >= lengths.count(n) for n in set(lengths))

    def pair(self, total: int) -> tuple[int, int] | None:
        left, end = self.left, self.pair_end[total]
        for at in range(self.pair_at[total], end):
            large, small = self.large[at], self.small[at]
            if left[large] and left[small] and (large != small or left[small] > 1):
                self.pair_at[total] = at
                return large, small
        self.pair_at[total] = end
        return None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        lengths, at = self.lengths, self.one_at[total]
        while at < len(lengths) and (lengths[at] > total - 2 or not self.left[lengths[at]] or not self.pair(total - lengths[at])):
            at += 1
        self.one_at[total] = at
        for one in lengths[at:]:
            two = self.pair(total - one) if self.left[one] else None
            if two and self.has((one, *two)):
                return (one, *two)
        return None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """Available lengths that fill the gap exactly, as few as possible."""
        if self.left[gap]:
            return (gap,)
        return self.pair(gap) or self.triple(gap)

    def consume(self, lengths: tuple[int, ...]) -> int:
        """Take the combination as often as the counts allow."""
        kinds = set(lengths)
        times = int(min(self.left[n] // lengths.count(n) for n in kinds))
        for n in kinds:
            self.left[n] -= times * lengths.count(n)
        return times


def pack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; ``lengths`` in [0, capacity], in ascending order."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])  # the next item of each length
    out = np.full(len(lengths), -1, np.int64)
    made = 0

    def put(length: int, containers: np.ndarray) -> None:
        out[at[length] : at[length] + len(containers)] = containers
        at[length] += len(containers)

    index = Complements(counts)
    rest: list[int] = []
    for length in range(capacity, 0, -1):
        while index.left[length]:
            index.left[length] -= 1
            others = index.fill(capacity - length) if length < capacity else ()
            index.left[length] += 1
            if others is None or not index.has((length, *others)):
                rest += [length] * int(index.left[length])
                index.left[length] = 0
                break
            times = index.consume((length, *others))
            for n in (length, *others):
                put(n, np.arange(made, made + times))
            made += times
    # Best fit: the open container with the least sufficient room.
    room = np.zeros(capacity + 1, np.int64)
    open_with: list[list[int]] = [[] for _ in range(capacity + 1)]
    for length in rest:
        fits = room[length:]
        first = int(fits.argmax()) if fits.any() else -1
        if first < 0:
            container, gap = made, capacity
            made += 1
        else:
            gap = length + first
            container = open_with[gap].pop()
            room[gap] = bool(open_with[gap])
        put(length, np.array([container]))
        open_with[gap - length].append(container)
        room[gap - length] = 1
    put(0, np.zeros(counts[0], np.int64))  # empty items need no room
    return out


def _pieces(text: str, capacity: int, path: str) -> tuple[list[int], list[int], list[int]]:
    """(start, end, tokens) of the parts of a text, in characters, cut only if it is too large."""
    ids = encoder(path).encode_ordinary(text)
    if len(ids) <= capacity:
        return [0], [len(text)], [len(ids)]
    data = np.frombuffer(text.encode(), np.uint8)
    whole = (data & 0xC0) != 0x80  # bytes that begin a character
    chars = np.concatenate([np.cumsum(whole) - 1, [len(text)]])
    ends = np.cumsum(token_bytes(path)[ids])
    may_cut = np.append(whole[ends[:-1]], True)  # tokens that end with a whole character
    allowed = np.flatnonzero(may_cut) + 1
    cuts = [0]
    while cuts[-1] < len(ids):
        cuts.append(int(allowed[np.searchsorted(allowed, cuts[-1] + capacity, "right") - 1]))
        if cuts[-1] <= cuts[-2]:  # one character of more tokens than a container has
            cuts[-1] = int(allowed[np.searchsorted(allowed, cuts[-2] + 1)])
    edges = [0 if c == 0 else int(chars[ends[c - 1]]) if ends[c - 1] < len(data) else len(text) for c in cuts]
    return edges[:-1], edges[1:], np.diff(cuts).tolist()


def items(documents: DataFrame, *, doc_id: str, text: str, capacity: int, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece_no, start_char, end_char, n_tokens): texts as items that fit a container."""
    schema = T.StructType([T.StructField(doc_id, documents.schema[doc_id].dataType), T.StructField("piece_no", T.IntegerType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, begin, end, size = [], [], [], [], []
            for i, value in enumerate(batch.column("text")):
                a, b, n = _pieces(value.as_py() or "", capacity, tokenizer)
                row += [i] * len(n)
                number += range(len(n))
                begin += a
                end += b
                size += n
            ids = batch.column("id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(size, pa.int64())], names=schema.names)

    return spread(documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))).mapInArrow(work, schema)


def fill_containers(documents: DataFrame, *, doc_id: str, text: str, capacity: int, tokenizer: str = TOKENIZER, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every text in a container of at most ``capacity`` tokens of the tokenizer.

    Returns ``(container_id, doc_id, piece_no, start_char, end_char, n_tokens)``. Only a text with
    more tokens than a container is cut, into full containers and a rest, always between two
    characters; its tokens are those of the whole text, cut apart. Null and empty texts are items
    of size 0 and come out too. Repeated rows are items of their own. Other columns are ignored.
    Groups have about ``group_rows`` documents each.
    """
    if capacity < 1:
        raise ValueError("a container holds one token at least")
    groups = max(1, -(-documents.count() // group_rows))
    packed = _packed(items(documents, doc_id=doc_id, text=text, capacity=capacity, tokenizer=tokenizer), doc_id, capacity, groups, 0)
    if groups > 1:
        # What the groups couldn't fill is little, and packed in as many groups as that takes.
        packed = cut(packed)
        rest = packed.filter("not full").drop("container_id", "full")
        packed = packed.filter("full").unionByName(_packed(rest, doc_id, capacity, max(1, -(-rest.count() // group_rows)), groups))
    return packed.drop("full")


def _packed(ready: DataFrame, doc_id: str, capacity: int, groups: int, first: int) -> DataFrame:
    """Items in containers, packed by hash groups that are numbered from ``first``; ``full`` if nothing of a container is unused."""
    spread = ready.withColumn("grp", F.pmod(F.xxhash64(doc_id, "piece_no", F.lit(first)), F.lit(groups)).cast("int"))
    schema = T.StructType([T.StructField("container_id", T.LongType()), *ready.schema.fields, T.StructField("full", T.BooleanType())])

    def work(table: pa.Table) -> pa.Table:
        # By size, then id: the same containers whenever and wherever the group is packed.
        table = table.combine_chunks().sort_by([("n_tokens", "ascending"), (doc_id, "ascending"), ("piece_no", "ascending")])
        sizes = table["n_tokens"].to_numpy()
        over = sizes > capacity  # only a single character of more tokens than a container
        container = np.concatenate([pack(sizes[~over], capacity), np.zeros(0, np.int64)])
        container = np.append(container, np.arange(over.sum()) + (container.max(initial=-1) + 1))
        full = np.bincount(container, weights=sizes)[container] >= capacity
        base = (first + int(pc.min(table["grp"]).as_py())) << 32
        return pa.table([pa.array(base + container), *[table[n] for n in schema.names[1:-1]], pa.array(full)], names=schema.names)

    return spread.groupBy("grp").applyInArrow(work, schema)
