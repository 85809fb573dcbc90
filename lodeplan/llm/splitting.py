"""Splitting oversized texts at natural boundaries.

Structure-tree packing: headings, paragraphs, blocks, list items, table rows and lines of wiki
markup, Markdown or HTML nest, so a text is parsed into a tree whose siblings are separated by
boundaries of one rank; the lower the rank, the higher up in the tree. From the bottom up, sibling
subtrees are merged as long as they fit; a subtree within the limit is never looked into, only
children that are too large are descended into, down to sentences. The last resort is the boundary
between tokens.

Sizes are the plain ones: matches of ``\\p{Punct}|[^\\p{Punct}\\s]+`` with ASCII classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeplan.llm.tokens import CLASSES, count_tokens, token_starts
from lodeplan.sources.tables import spread

#: Ranks of boundaries: 1 to 6 are headings of that level.
PARAGRAPH, BLOCK, ITEM, LINE, MARKUP, SENTENCE, TOKEN = 7, 8, 9, 13, 14, 15, 16
KIND_NAMES = {PARAGRAPH: "paragraph", BLOCK: "block", LINE: "line", MARKUP: "markup", SENTENCE: "sentence", TOKEN: "token"}
_BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]|<br */?>)"
_LINE = re.compile(
    _BREAK + rf"(?P<blank>[ \t]*{_BREAK}\s*)?"
    r"(?:(?P<heading>={1,6})(?!=)|(?P<hashes>#{1,6})(?=[ \t])|(?P<list>[*#:;]+)|(?P<bullet>[ \t]*(?:[-+*\u2022]|\d{1,3}[.)])(?=[ \t]))|(?P<row>\|-|!)|(?P<block>\{\||\{\{|<!--|```|~~~)|(?P<cell>\|))?"
)
_TAG = re.compile(r"<(?:h(?P<heading>[1-6])|(?P<paragraph>p|section|article)|(?P<block>table|ul|ol|dl|div|pre|blockquote)|(?P<item>li|dt|dd|tr))(?=[\s/>])", re.IGNORECASE)
_PAIRS = re.compile(r"\{\{|\}\}|\{\||\|\}")
_SENTENCE = re.compile(r"(?:[.!?][\"'”»)\]]*|[。！？])\s*(?=\S)")


def classes_of(text: str) -> np.ndarray:
    """Token classes of the characters; everything beyond ASCII is part of words."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return CLASSES[np.where(points < 128, points, ord("a"))]


def _covered(text: str) -> np.ndarray:
    """Starts and ends, in turn, of the outermost closed templates and tables.

    An opening without its end, or an end without opening, is ordinary text.
    """
    opened: dict[str, list[int]] = {"{{": [], "{|": []}
    spans: list[tuple[int, int]] = []
    for match in _PAIRS.finditer(text):
        mark = match[0]
        if mark in opened:
            opened[mark].append(match.start())
            continue
        own, other = (opened["{{"], opened["{|"]) if mark == "}}" else (opened["{|"], opened["{{"])
        if own:
            start = own.pop()
            spans.append((start, match.end()))
            while other and other[-1] > start:
                other.pop()
    outer: list[int] = []
    for a, b in sorted(spans):
        if not outer or a >= outer[-1]:
            outer += [a, b]
    return np.array(outer, np.int64)


def boundaries(text: str, markdown: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places where a line or an HTML element begins, and the rank of the boundary before each.

    Lines of ``#`` are numbered items in wiki markup, and headings if ``markdown``.
    """
    at, rank = [], []
    before = None
    for match in _LINE.finditer(text):
        kind = match.lastgroup if match.lastgroup != "blank" else None
        if kind == "hashes" and not markdown:
            kind = "list"
        start = match.end() if kind is None else match.start(match.lastgroup)
        if kind in ("heading", "hashes"):
            own = match.end() - start
        elif match["blank"] is not None:
            own = PARAGRAPH
        elif kind == "block" or (kind != before and ({kind, before} & {"list", "bullet"})):
            own = BLOCK
        elif kind == "list":
            own = ITEM + min(match.end() - start, 4) - 1
        elif kind == "bullet":
            indent = len(match["bullet"]) - len(match["bullet"].lstrip())
            own = ITEM + min(indent // 2, 3)
        else:
            own = ITEM if kind == "row" else LINE
        before = kind
        at.append(start)
        rank.append(own)
    for match in _TAG.finditer(text):
        at.append(match.start())
        rank.append(int(match["heading"]) if match["heading"] else {"paragraph": PARAGRAPH, "block": BLOCK, "item": ITEM}[match.lastgroup])
    places, ranks = np.array(at, np.int64), np.array(rank, np.int64)
    covered = _covered(text)
    inside = np.searchsorted(covered, places, "right") % 2 == 1
    # The line that begins a template or table is its edge, not its inside.
    ranks = np.where(inside & ~np.isin(places, covered[::2]), np.maximum(ranks, MARKUP), ranks)
    return places, ranks


class Node:
    """The tokens [start, end) of a text; an inner node's children are separated by one rank."""

    def __init__(self, start: int, end: int, rank: int = TOKEN, children: list["Node"] | None = None) -> None:
        self.start, self.end, self.rank, self.children = start, end, rank, children or []


def tree(start: int, end: int, places: list[int], ranks: list[int]) -> Node:
    """The tree of the tokens [start, end), given the boundaries between them in order."""
    open_nodes: list[Node] = []
    last = start
    for place, rank in zip([*places, end], [*ranks, -1]):
        done = Node(last, place)
        # Deeper nodes end here.
        while open_nodes and open_nodes[-1].rank > rank:
            done = Node(open_nodes[-1].start, place, open_nodes[-1].rank, [*open_nodes.pop().children, done])
        if open_nodes and open_nodes[-1].rank == rank:
            open_nodes[-1].children.append(done)
        elif rank >= 0:
            open_nodes.append(Node(done.start, -1, rank, [done]))
        last = place
    return done


def split_text(text: str, limit: int, overlap: int, markdown: bool = False) -> list[tuple[int, int, int, int, str]]:
    """Pieces (start, end, overlap characters, tokens, kind of the boundary it begins at).

    Pieces cover the text; from the second on each begins with the last ``overlap`` tokens before
    it. No piece has more than ``limit`` tokens.
    """
    classes = classes_of(text)
    starts = np.flatnonzero(token_starts(classes))
    n = len(starts)
    if n <= limit:
        return [(0, len(text), 0, n, "whole")]
    budget = limit - overlap
    places, ranks = boundaries(text, markdown)
    # In tokens: a boundary lies before the first token at or after its place. A place within a
    # token (no white space around it) is none; of several before a token the strongest counts.
    before = np.searchsorted(starts, places)
    fits = (before > 0) & (before < n)
    inner = (places > 0) & (places < len(text))
    fits[inner] &= ~((classes[places[inner]] == 0) & (classes[places[inner] - 1] == 0))
    strongest = np.full(n, TOKEN)
    np.minimum.at(strongest, before[fits], ranks[fits])

    def merged(node: Node) -> list[tuple[int, int]]:
        """The pieces of a node that is too large."""
        if not node.children:
            return sentences(node)
        pieces: list[tuple[int, int]] = []
        held = None  # siblings merged so far
        for child in node.children:
            if held is not None and child.end - held <= budget:
                continue
            if held is not None and child.start > held:
                pieces.append((held, child.start))
            held = child.start
            if child.end - child.start > budget:
                pieces += merged(child)
                held = None
        if held is not None:
            pieces.append((held, node.end))
        return pieces

    def sentences(node: Node) -> list[tuple[int, int]]:
        """The pieces of a single line, at its sentences or, in one that is too long, at tokens."""
        lo, hi = int(starts[node.start]), int(starts[node.end]) if node.end < n else len(text)
        ends = np.unique(np.searchsorted(starts, [m.end() + lo for m in _SENTENCE.finditer(text[lo:hi])]))
        ends = ends[(ends > node.start) & (ends < node.end)].tolist() if node.rank == TOKEN else []
        if ends:
            strongest[ends] = SENTENCE
            line = tree(node.start, node.end, ends, [SENTENCE] * len(ends))
            for part in line.children:
                part.rank = SENTENCE  # isn't looked into for sentences again
            return merged(line)
        return [(at, min(at + budget, node.end)) for at in range(node.start, node.end, budget)]

    cuts = np.flatnonzero(strongest < TOKEN)
    out = []
    for a, b in merged(tree(0, n, cuts.tolist(), strongest[cuts].tolist())):
        first = max(0, a - overlap) if a else 0
        begin = 0 if a == 0 else int(starts[first])
        content = 0 if a == 0 else int(starts[a])
        end = int(starts[b]) if b < n else len(text)
        kind = int(strongest[a])
        name = "start" if a == 0 else KIND_NAMES.get(kind, "heading" if kind < PARAGRAPH else "item")
        out.append((begin, end, content - begin, b - first, name))
    return out


def split_documents(documents: DataFrame, *, doc_id: str, text: str, limit: int, overlap: int, with_text: bool = True, markdown: bool = False) -> DataFrame:
    """Every text as pieces of at most ``limit`` tokens.

    Returns ``(doc_id, piece_no, n_pieces, start_char, end_char, overlap_chars, n_tokens, begins_at)``
    and the piece's ``text`` if asked for. A text within the limit, an empty one included, is one
    piece; a null text is one piece of size 0 with null text. A piece runs to the start of the next
    one's own part, so white space at a boundary stays with the piece before it. Repeated rows are
    split each. ``overlap`` must be less than ``limit``. Other columns are ignored. Texts are split
    where they are read; only an input of fewer partitions than cores is spread first. ``markdown``:
    whether lines that begin with ``#`` are headings rather than numbered items of wiki markup.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    fields = [T.StructField(doc_id, documents.schema[doc_id].dataType), T.StructField("piece_no", T.IntegerType()), T.StructField("n_pieces", T.IntegerType())]
    fields += [T.StructField(n, T.LongType()) for n in ("start_char", "end_char", "overlap_chars", "n_tokens")] + [T.StructField("begins_at", T.StringType())]
    schema = T.StructType(fields + [T.StructField("text", T.StringType())] * with_text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            sizes = count_tokens(column)
            large = np.flatnonzero(sizes > limit)
            row, found = [], []
            texts = column.take(pa.array(large)).to_pylist()
            for i, value in zip(large.tolist(), texts):
                got = split_text(value, limit, overlap, markdown)
                row += [i] * len(got)
                found += [(k, len(got), *piece) + ((value[piece[0] : piece[1]],) if with_text else ()) for k, piece in enumerate(got)]
            yield _batch(batch, row, found, schema)
            small = np.flatnonzero(sizes <= limit)
            own = column.take(pa.array(small))
            chars = pc.fill_null(pc.utf8_length(own), 0).cast(pa.int64())
            zero, one = pa.array(np.zeros(len(small), np.int64)), pa.array(np.ones(len(small), np.int32))
            columns = [batch.column("id").take(pa.array(small)), zero.cast(pa.int32()), one, zero, chars, zero, pa.array(sizes[small]), pa.array(["whole"] * len(small), pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [own] * with_text, names=schema.names)

    return spread(documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))).mapInArrow(work, schema)


def _batch(batch: pa.RecordBatch, row: list[int], found: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    types = {T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.StringType: pa.string()}
    parts = list(zip(*found)) if found else [[] for _ in schema.names[1:]]
    columns = [pa.array(part, types[type(f.dataType)]) for part, f in zip(parts, schema.fields[1:])]
    return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int64())), *columns], names=schema.names)
