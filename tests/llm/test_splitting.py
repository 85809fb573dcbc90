import re

import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from lodeplan.llm.splitting import split_documents, split_text
from lodeplan.llm.tokens import count_tokens

TOKEN = re.compile(r"[!-/:-@\[-`{-~]|[^!-/:-@\[-`{-~ \t\n\x0b\f\r]+")
size = lambda text: len(TOKEN.findall(text))

WIKI = st.lists(st.sampled_from(["word", "Satz. ", "\n", "\n\n", "\r\n", "== H ==", "* ", "# ", "{{", "}}", "{|", "|}", "|-", "| ", "é", "漢字。", "<br/>", " ", ". ", "=", "\t", " ", "x!"]), max_size=150).map("".join)


@settings(max_examples=400, deadline=None)
@given(WIKI, st.integers(1, 12), st.integers(0, 6))
@example("a" * 500, 4, 2)
@example("", 1, 0)
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    pieces = split_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    at = 0
    for i, (start, end, back, tokens, _) in enumerate(pieces):
        piece = text[start:end]
        assert size(piece) == tokens <= limit
        assert start + back == at  # its own part begins where the one before ended
        if i:
            assert size(text[start:at]) == min(overlap, size(text[:at]))
        at = end
    assert (len(pieces) == 1) == (size(text) <= limit)


def test_headings_go_before_paragraphs_and_lines():
    text = "intro words here\n\n== One ==\na b c d\n\ne f g h\n== Two ==\ni j k l\n\nm n o p\n"
    pieces = split_text(text, 14, 0)
    assert [text[a:b].split("\n")[0] for a, b, *_ in pieces] == ["intro words here", "== One ==", "== Two =="]
    assert [p[4] for p in pieces] == ["start", "heading", "heading"]


def test_closed_templates_stay_together_and_unclosed_ones_do_no_harm():
    text = "p q r s\n{{Box\n| a\n| b\n}}\nt u v w\n"
    assert any("{{Box\n| a\n| b\n}}" in text[a:b] for a, b, *_ in split_text(text, 12, 0))
    broken = "{{Box\n| a\n\n" + "a b c d\n\n" * 5
    assert {p[4] for p in split_text(broken, 8, 0)} <= {"start", "paragraph"}


def test_sentences_where_there_are_no_lines():
    text = "One two three. Four five six! Seven eight nine? " * 3
    pieces = split_text(text, 9, 1)
    assert all(p[4] == "sentence" for p in pieces[1:])


@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=30))
@settings(max_examples=200, deadline=None)
def test_counts(texts):
    assert count_tokens(pa.array(texts, pa.string())).tolist() == [size(t or "") for t in texts]


def test_documents(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "a " * 50), (4, "a " * 50), (None, "b " * 20)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as piece_no", "text as n_tokens")
    got = split_documents(documents, doc_id="doc_id", text="text", limit=10, overlap=2).toPandas()
    assert got[got.doc_id == 1].text.isna().all() and len(got[got.doc_id == 1]) == 1
    assert (got.n_tokens <= 10).all()
    assert len(got[got.doc_id == 4]) == 2 * got[got.doc_id == 4].n_pieces.iloc[0]
    assert split_documents(documents.limit(0), doc_id="doc_id", text="text", limit=10, overlap=2).count() == 0
    with pytest.raises(ValueError):
        split_documents(documents, doc_id="doc_id", text="text", limit=10, overlap=10)


def test_whole_table_round_trip(spark, data):
    from lodeplan.llm.queries import p9_found, p9_pieces

    got = p9_pieces(spark, data).toPandas().sort_values(["doc_id", "piece_no"])
    documents = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id").text
    joined = got.groupby("doc_id")[["text", "overlap_chars"]].apply(lambda p: "".join(t[b:] for t, b in zip(p.text.fillna(""), p.overlap_chars)))
    assert all(joined[i] == (documents[i] or "") for i in documents.index)
    assert got.n_tokens.max() <= 1024
    assert {r[0] for r in p9_found(spark, data).collect()} == {i for i, t in documents.items() if size(t or "") > 1024}
