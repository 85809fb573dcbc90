"""Deeply nested JSON columns as related flat tables with parent-child links.

A batch of texts is indexed as one byte array: a quote bitmap (quotes that aren't escaped), from
it the bitmap of what lies inside strings, and the bitmaps of brackets and delimiters outside
them. A prefix sum over the brackets gives each token's depth and container; spans of objects,
arrays and scalars follow from the token positions. All of this is numpy over the whole batch; no
value is parsed on its own except keys and embedded documents with escapes.

The same index decides validity: a text counts as JSON only if its brackets pair up, every two
neighbouring tokens may follow each other in their container, and all strings, numbers and names
are well formed. Texts that aren't JSON yield nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeplan.operators.arrays import starts
from lodeplan.sources.tables import spread

#: Bytes indexed at once in a task; a longer single text is indexed alone.
SLICE_BYTES = 4 << 20

OPEN_OBJECT, CLOSE_OBJECT, OPEN_ARRAY, CLOSE_ARRAY, COLON, COMMA, STRING, NAME = range(8)
_KIND = np.full(256, -1, np.int8)
for _byte, _kind in zip(b"{}[]:,", range(6)):
    _KIND[_byte] = _kind
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r")] = True
_ESCAPES = np.zeros(256, bool)
_ESCAPES[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_SCALAR = r"\A(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)\z"


def _allowed() -> np.ndarray:
    """may[container, before, after]: containers are 0 none, 1 object, 2 array; 8 stands for the
    start and end of the text, 9 for a key."""
    may = np.zeros((3, 10, 10), bool)
    begins, ends = [OPEN_OBJECT, OPEN_ARRAY, STRING, NAME], [CLOSE_OBJECT, CLOSE_ARRAY, STRING, NAME]
    may[0, 8, begins] = True
    may[0, ends, 8] = True
    may[1, OPEN_OBJECT, [9, CLOSE_OBJECT]] = True
    may[1, 9, COLON] = True
    may[1, COLON, begins] = True
    may[1, COMMA, 9] = True
    may[2, OPEN_ARRAY, [*begins, CLOSE_ARRAY]] = True
    may[2, COMMA, begins] = True
    for end in ends:
        may[1, end, [COMMA, CLOSE_OBJECT]] = True
        may[2, end, [COMMA, CLOSE_ARRAY]] = True
    return may


_MAY = _allowed()


@dataclass
class Nodes:
    """The values of a batch of texts, in order of their position.

    ``text``: number of the text; ``parent``: index of the parent node or -1; ``kind``: 0 object,
    1 array, 2 string, 3 number or name; ``begin``, ``end``: span in the bytes; ``slot``: position
    among the parent's children; ``key``: token span of the key as (begin, end), -1 in arrays.
    """

    text: np.ndarray
    parent: np.ndarray
    kind: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    slot: np.ndarray
    key_begin: np.ndarray
    key_end: np.ndarray


def index(data: np.ndarray, offsets: np.ndarray) -> Nodes:
    """The structural index of the texts ``data[offsets[i]:offsets[i + 1]]`` that are valid JSON."""
    n_texts, size = len(offsets) - 1, len(data)
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True

    def text_at(positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(offsets, positions, "right") - 1

    # Bitmaps, a byte or less per byte of text. A slash escapes if an even number of its run stand before it.
    slashes = np.flatnonzero(data == 0x5C)
    ordinal = np.arange(len(slashes))
    run = np.append(True, np.diff(slashes) > 1) | edge[slashes] if len(slashes) else np.zeros(0, bool)
    escaping = slashes[(ordinal - np.maximum.accumulate(np.where(run, ordinal, 0))) % 2 == 0] if len(slashes) else slashes
    quote = data == 0x22
    escaped = escaping + 1
    quote[escaped[~edge[escaped]]] = False
    before = np.searchsorted(np.flatnonzero(quote), offsets)
    inside = (np.cumsum(quote, dtype=np.uint8) & 1).astype(bool)  # from the opening quote on, without the closing one
    if (before & 1).any():
        inside ^= np.repeat((before[:-1] & 1).astype(bool), np.diff(offsets))
    kind = _KIND[data]
    kind[inside] = -1
    word = ~inside & ~quote & (kind < 0) & ~_SPACE[data]
    kind[quote & inside] = STRING
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:size]
    last[:-1] &= ~word[1:] | edge[1:size]
    kind[first] = NAME

    at = np.flatnonzero(kind >= 0)
    tokens = np.diff(np.searchsorted(at, offsets))
    kind, text = kind[at], np.repeat(np.arange(n_texts), tokens)
    valid = (tokens > 0) & (np.diff(before) % 2 == 0)

    def check(texts: np.ndarray) -> None:
        valid[texts] = False

    # Depth by prefix sums, from 1 inside a root container; texts whose brackets don't pair fail.
    is_open, is_close = (kind == OPEN_OBJECT) | (kind == OPEN_ARRAY), (kind == CLOSE_OBJECT) | (kind == CLOSE_ARRAY)

    def depths() -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(is_open.astype(np.int64) - is_close)])
        begins = np.searchsorted(text, np.arange(n_texts))
        return sums[1:] - sums[begins[text]], sums[np.searchsorted(text, np.arange(n_texts), "right")] - sums[begins]

    depth, left_open = depths()
    check(text[depth < 0])
    valid &= left_open == 0
    keep = valid[text]
    at, kind, text, is_open, is_close = at[keep], kind[keep], text[keep], is_open[keep], is_close[keep]
    depth = depths()[0]
    n = len(at)
    level = depth + is_close  # the level of the container a token belongs to; an opening one opens it
    # Tokens sorted by level, then position: each lies behind the opening token of its container.
    by_level = np.argsort(level, kind="stable")
    opened = np.where(is_open[by_level], np.arange(n), -1)
    latest = np.maximum.accumulate(opened) if n else opened
    container = np.empty(n, np.int64)
    container[by_level] = np.where(level[by_level] > 0, by_level[np.maximum(latest, 0)], -1)
    # An opening token itself is a member of what surrounds the token before it.
    first_token = starts(text)
    prior = np.arange(n) - 1
    surrounding = container.copy()
    o = np.flatnonzero(is_open)
    surrounding[o] = np.where(first_token[o], -1, container[prior[o]])
    of = np.where(surrounding < 0, 0, np.where(kind[surrounding] == OPEN_OBJECT, 1, 2)) if n else surrounding

    # Grammar: each token against the one before it.
    previous = np.where(first_token, 8, kind[prior]) if n else kind
    is_key = (kind == STRING) & (of == 1) & ((previous == OPEN_OBJECT) | (previous == COMMA))
    named = np.where(is_key, 9, kind)
    previous = np.where(first_token, 8, named[prior]) if n else named
    check(text[~_MAY[of, previous, named]])
    last_token = np.append(first_token[1:], True) if n else first_token
    check(text[last_token & ~_MAY[0, named, 8]])
    check(text[last_token & (np.where(is_close, level - 1, level) != 0)])

    # Strings: no control characters, known escapes. Names: numbers, true, false, null.
    check(text_at(np.flatnonzero(inside & (data < 0x20))))
    s = escaping[inside[escaping]]
    follows = data[np.minimum(s + 1, size - 1)] if size else s
    check(text_at(s[~_ESCAPES[follows]]))
    u = s[follows == ord("u")]
    for step in range(2, 6):
        check(text_at(u[(u + step >= size) | ~_HEX[data[np.minimum(u + step, size - 1)]]]))
    end = at + 1
    strings = kind == STRING
    closing = np.flatnonzero(quote & ~inside)
    end[strings] = closing[np.searchsorted(closing, at[strings])] + 1 if len(closing) else at[strings] + 1
    names = np.flatnonzero(kind == NAME)
    stops = np.flatnonzero(last)
    end[names] = stops[np.searchsorted(stops, at[names])] + 1 if len(names) else at[names] + 1
    plain = pc.match_substring_regex(_spans(data, at[names], end[names]), _SCALAR)
    check(text[names[~plain.to_numpy(zero_copy_only=False)]])

    # Values of valid texts become nodes; brackets are matched through their container.
    closes = np.flatnonzero(is_close)
    end[container[closes]] = at[closes] + 1
    value = (is_open | strings | (kind == NAME)) & ~is_key & valid[text]
    v = np.flatnonzero(value)
    node_of = np.full(n + 1, -1)
    node_of[v] = np.arange(len(v))
    holder = surrounding[v]
    parent = np.where(holder < 0, -1, node_of[holder])
    order = np.argsort(parent, kind="stable")
    new = starts(parent[order])
    slot = np.empty(len(v), np.int64)
    slot[order] = np.arange(len(v)) - np.maximum.accumulate(np.where(new, np.arange(len(v)), 0)) if len(v) else 0
    keyed = (of[v] == 1) if n else np.zeros(0, bool)
    key_token = np.where(keyed, v - 2, 0)
    node_kind = np.select([kind[v] == OPEN_OBJECT, kind[v] == OPEN_ARRAY, strings[v]], [0, 1, 2], 3)
    return Nodes(text[v], parent, node_kind, at[v], end[v], slot, np.where(keyed, at[key_token] if n else 0, -1), np.where(keyed, end[key_token] if n else 0, -1))


def _unescaped(span: bytes) -> str:
    """A quoted span with its escapes resolved; half a surrogate pair has no text and becomes U+FFFD."""
    return json.loads(span).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of spans that don't overlap, given in any order."""
    order = np.argsort(begin, kind="stable")
    step = np.zeros(len(data) + 1, np.int8)
    step[begin] += 1
    step[end] -= 1
    content = data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
    edges = np.concatenate([[0], np.cumsum((end - begin)[order])]).astype(np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(order), [None, pa.py_buffer(edges), pa.py_buffer(content)]).take(pa.array(place))


def _strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The contents of quoted spans, escapes resolved; only spans with escapes are looked at one by one."""
    out = _spans(data, begin + 1, end - 1).cast(pa.large_string())
    escapes = pc.match_substring(out, "\\")
    texts = out.filter(escapes).dictionary_encode()
    if len(texts):
        plain = pa.array([_unescaped(b'"' + t.encode() + b'"') for t in texts.dictionary.to_pylist()], pa.large_string())
        out = pc.replace_with_mask(out, escapes, plain.take(texts.indices))
    return out.cast(pa.string())


KINDS = ("object", "array", "string", "scalar")


def flatten_batch(texts: pa.Array, names: list[str], *, singles: frozenset[str], embedded: frozenset[str], kinds: frozenset[int]) -> pa.Table:
    """The nodes of ``texts``: (row, path, parent_path, key, slot, kind, value).

    ``names[i]`` is the path of text i. Documents embedded as strings are indexed in further
    rounds, all of a round at once.
    """
    out: list[pa.Table] = []
    row, base = np.arange(len(texts)), pa.array(names, pa.string())
    outer, key0, slot0 = pa.nulls(len(texts), pa.string()), pa.nulls(len(texts), pa.string()), pa.nulls(len(texts), pa.int32())
    while len(texts):
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        nodes = index(data, offsets - offsets[0])
        n = len(nodes.text)
        if not n:
            break
        root = nodes.parent < 0
        keyed = nodes.key_begin >= 0
        found = np.flatnonzero(keyed)
        keys = pc.replace_with_mask(pa.nulls(n, pa.string()), pa.array(keyed), _strings(data, nodes.key_begin[found], nodes.key_end[found]))
        in_single = np.zeros(n, bool)
        for name in singles:
            in_single |= pc.fill_null(pc.equal(keys, name), False).to_numpy(zero_copy_only=False)
            in_single[root] |= pc.equal(base, name).to_numpy(zero_copy_only=False)[nodes.text[root]]
        lone = in_single & (nodes.kind == 0)
        suffix = pc.if_else(pa.array(keyed), pc.binary_join_element_wise(".", pc.fill_null(keys, ""), ""), pc.binary_join_element_wise("[", pa.array(nodes.slot).cast(pa.string()), "]", ""))
        suffix = pc.if_else(pa.array(root), base.take(pa.array(nodes.text)), suffix)
        suffix = pc.if_else(pa.array(lone), pc.binary_join_element_wise(suffix, "[0]", ""), suffix)
        # Paths level by level: a node's is its parent's and its own step.
        level = np.flatnonzero(root)
        ups = [level]
        children = np.argsort(nodes.parent, kind="stable")
        sorted_parent = nodes.parent[children]
        while len(level):
            a, b = np.searchsorted(sorted_parent, level), np.searchsorted(sorted_parent, level, "right")
            counts = b - a
            level = children[np.repeat(a - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]
            level.sort()
            if len(level):
                ups.append(level)
        pieces, place = [suffix.take(pa.array(ups[0]))], np.empty(n, np.int64)
        place[ups[0]] = np.arange(len(ups[0]))
        parents = [outer.take(pa.array(nodes.text[ups[0]]))]
        for i, level in enumerate(ups[1:], 1):
            above = pieces[i - 1].take(pa.array(place[nodes.parent[level]]))
            parents.append(above)
            pieces.append(pc.binary_join_element_wise(above, suffix.take(pa.array(level)), ""))
            place[level] = np.arange(len(level))
        order = np.concatenate(ups)
        path, parent_path = pa.concat_arrays(pieces), pa.concat_arrays(parents)
        # Strings that hold a document count as it: whole fields and the embedded keys.
        holds = np.zeros(n, bool)
        holds[root] = True
        for name in embedded:
            holds |= pc.fill_null(pc.equal(keys, name), False).to_numpy(zero_copy_only=False)
        holds &= nodes.kind == 2
        inner_at = np.flatnonzero(holds[order])
        inner = order[inner_at]
        inner_texts = _strings(data, nodes.begin[inner], nodes.end[inner]) if len(inner) else pa.array([], pa.string())
        is_document = documents(inner_texts)

        wanted = np.isin(nodes.kind[order], list(kinds))
        replaced = np.zeros(n, bool)
        replaced[inner_at[is_document]] = True
        picked = np.flatnonzero(wanted & ~replaced)
        node = order[picked]
        values = pa.nulls(len(node), pa.string())
        if kinds & {2, 3}:
            is_string = nodes.kind[node] == 2
            own, rest = node[is_string], node[nodes.kind[node] == 3]
            values = pc.replace_with_mask(values, pa.array(is_string), _strings(data, nodes.begin[own], nodes.end[own]))
            names_of = _spans(data, nodes.begin[rest], nodes.end[rest]).cast(pa.large_string()).cast(pa.string())
            values = pc.replace_with_mask(values, pa.array(nodes.kind[node] == 3), names_of)
        text_root = root[node]
        out.append(
            pa.table(
                {
                    "row": pa.array(row[nodes.text[node]]),
                    "node_path": path.take(pa.array(picked)),
                    "parent_path": parent_path.take(pa.array(picked)),
                    "key": pc.if_else(pa.array(text_root), key0.take(pa.array(nodes.text[node])), keys.take(pa.array(node))),
                    "slot": pc.if_else(pa.array(text_root), slot0.take(pa.array(nodes.text[node])), pa.array(nodes.slot[node].astype(np.int32))),
                    "kind": pa.array(KINDS).take(pa.array(nodes.kind[node])),
                    "value": values,
                }
            )
        )
        # The next round's texts keep the place of the string that held them.
        go = inner_at[is_document]
        node = order[go]
        texts = inner_texts.filter(pa.array(is_document))
        key0 = pc.if_else(pa.array(root[node]), key0.take(pa.array(nodes.text[node])), keys.take(pa.array(node)))
        slot0 = pc.if_else(pa.array(root[node]), slot0.take(pa.array(nodes.text[node])), pa.array(nodes.slot[node].astype(np.int32)))
        row, base, outer = row[nodes.text[node]], path.take(pa.array(go)), parent_path.take(pa.array(go))
    if out:
        return pa.concat_tables(out)
    empty = {"row": pa.int64(), "node_path": pa.string(), "parent_path": pa.string(), "key": pa.string(), "slot": pa.int32(), "kind": pa.string(), "value": pa.string()}
    return pa.table({k: pa.array([], t) for k, t in empty.items()})


def documents(texts: pa.Array) -> np.ndarray:
    """Which texts are valid JSON."""
    if not len(texts):
        return np.zeros(0, bool)
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    out = np.zeros(len(texts), bool)
    out[index(data, offsets - offsets[0]).text] = True
    return out


def flatten_json(records: DataFrame, *, record_id: str, fields: list[str], singles: list[str] = (), embedded: list[str] = (), kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The values nested in JSON text columns, one row each, linked to parent and record.

    Returns ``(record_id, field, node_path, parent_path, key, slot, kind, value)``. The path is the
    field's name, ``.key`` per key and ``[i]`` per array position; ``parent_path`` is null for a
    field's root; ``slot`` is the position among the parent's children (null for a root); ``value``
    is a string's content or a scalar's JSON text, null for objects and arrays. ``kinds`` narrows the
    output.

    Under the keys and fields in ``singles`` a lone object counts as an array of one. A whole
    field, or the value of a key in ``embedded``, that is a string holding JSON counts as that
    JSON. Null, empty and invalid texts yield nothing, as does JSON null under ``kinds`` without
    ``scalar``. Of repeated keys in an object all values come out, under one path. Other columns
    of ``records`` are ignored. Each text is worked on where it is read; only an input of fewer
    partitions than cores is spread over them first.
    """
    wanted = frozenset(KINDS.index(x) for x in kinds)
    single, embed = frozenset(singles), frozenset(embedded)
    narrow = records.select(F.col(record_id).alias("record_id"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    schema = T.StructType([T.StructField("record_id", records.schema[record_id].dataType)] + [T.StructField(n, T.StringType()) for n in ("field", "node_path", "parent_path", "key")] + [T.StructField("slot", T.IntegerType())] + [T.StructField(n, T.StringType()) for n in ("kind", "value")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(fields):
                column = batch.column(f"f{i}")
                here = np.flatnonzero(pc.greater(pc.fill_null(pc.binary_length(column), 0), 0).to_numpy(zero_copy_only=False))
                sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)[here]
                part = (np.cumsum(sizes) // SLICE_BYTES).astype(np.int64) if len(here) else here
                for own in np.split(here, np.flatnonzero(np.diff(part)) + 1):
                    got = flatten_batch(column.take(pa.array(own)), [name] * len(own), singles=single, embedded=embed, kinds=wanted)
                    rows = batch.column("record_id").take(pa.array(own)).take(got["row"].combine_chunks())
                    table = pa.table([rows, pa.array([name] * len(rows), pa.string()), *[got[n] for n in ("node_path", "parent_path", "key", "slot", "kind", "value")]], names=schema.names)
                    yield from table.combine_chunks().to_batches(max_chunksize=50_000)

    return spread(narrow).mapInArrow(work, schema).withColumnRenamed("record_id", record_id)


def array_items(nodes: DataFrame, arrays: list[str]) -> DataFrame:
    """The flat table of what stands in the named arrays: each item with its owner and position.

    ``nodes`` has ``node_path`` as :func:`flatten_json` gives it. Adds ``owner_path``, the object that
    has the array (null at a field's root), ``array_key`` and ``position``. Objects link by (record,
    ``owner_path``) to the ``node_path`` of their owner; with repeated keys in one object a path
    stands for several owners.
    """
    pattern = rf"^(?:(.*)\.)?({'|'.join(arrays)})\[(\d+)\]$"
    part = lambda i: F.regexp_extract("node_path", pattern, i)
    items = nodes.filter(F.col("node_path").rlike(pattern))
    return items.withColumns({"owner_path": F.nullif(part(1), F.lit("")), "array_key": part(2), "position": part(3).cast("int")})
