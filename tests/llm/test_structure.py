"""The structure tree: wiki markup, Markdown and HTML, merged from the bottom up."""

from hypothesis import given, settings
from hypothesis import strategies as st

from lodeplan.llm.splitting import BLOCK, ITEM, PARAGRAPH, boundaries, split_text, tree


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=25))
def test_tree(ranks):
    """Children make up their parent, are separated by its rank, and have only weaker boundaries inside."""
    rank_at = dict(enumerate(ranks, 1))
    seen = []

    def check(node):
        inner = [rank_at[i] for i in range(node.start + 1, node.end)]
        if not node.children:
            assert not inner
            seen.append((node.start, node.end))
            return
        assert [c.end for c in node.children[:-1]] == [c.start for c in node.children[1:]]
        assert (node.children[0].start, node.children[-1].end) == (node.start, node.end)
        assert {rank_at[c.start] for c in node.children[1:]} == {min(inner)} == {node.rank}
        for child in node.children:
            assert all(rank_at[i] > node.rank for i in range(child.start + 1, child.end))
            check(child)

    root = tree(0, len(ranks) + 1, list(rank_at), ranks)
    assert (root.start, root.end) == (0, len(ranks) + 1)
    check(root)
    assert len(seen) == len(ranks) + 1


def kinds(text, **how):
    places, ranks = boundaries(text, **how)
    return {text[p : p + 6].split("\n")[0]: r for p, r in zip(places.tolist(), ranks.tolist())}


def test_markdown():
    text = "intro\n# Title\nword\n\npara\n- one\n  - two\n1. three\n```\ncode\n"
    got = kinds(text, markdown=True)
    assert got["# Titl"] == 1 and got["para"] == PARAGRAPH and got["```"] == BLOCK
    assert got["  - tw"] == ITEM + 1 and got["1. thr"] == ITEM and got["- one"] == BLOCK  # a list begins
    assert kinds(text)["# Titl"] == BLOCK  # in wiki markup, a numbered list
    sections = "".join(f"## S{i}\nw w w w w\n\nv v v v\n" for i in range(4))
    assert [p[4] for p in split_text(sections, 14, 0, markdown=True)] == ["start", "heading", "heading", "heading"]


def test_html():
    got = kinds("<div>x<h2>T</h2><p>a</p><ul><li>b</li></ul><pre>c</pre><link>")
    assert got["<h2>T<"] == 2 and got["<p>a</"] == PARAGRAPH and got["<ul><l"] == BLOCK and got["<li>b<"] == ITEM and "<link>" not in got
    text = "".join(f"<p>{'word ' * 8}</p>" for _ in range(5))
    assert {p[4] for p in split_text(text, 20, 0)} == {"start", "paragraph"}


def test_small_siblings_are_merged_and_only_large_ones_are_opened():
    large = "== B ==\n" + "p p p p p\n\n" * 4
    text = "== A ==\na a\n" + large + "== C ==\nc\n== D ==\nd\n"
    pieces = [text[a:b] for a, b, *_ in split_text(text, 16, 0)]
    assert pieces[0].startswith("== A") and pieces[-1].startswith("== C") and "== D" in pieces[-1]
    assert all(not ("== A" in p and "== B" in p) for p in pieces)
