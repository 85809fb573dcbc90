import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeplan.llm.packing import Complements, fill_containers, items, pack
from lodeplan.llm.tokens import TOKENIZER, encoder


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=120))
def test_no_container_overflows_and_none_is_wasted(lengths):
    sizes = np.sort(np.array(lengths, np.int64))
    containers = pack(sizes, 50)
    assert (containers >= 0).all() and len(containers) == len(sizes)
    used = np.bincount(containers, weights=sizes) if len(sizes) else np.zeros(0)
    assert (used <= 50).all()
    filled = used[used > 0]
    # Best fit leaves at most one container half empty or less.
    assert (filled * 2 <= 50).sum() <= 1


def test_exact_complements_fill_all():
    sizes = np.sort(np.array([30, 20, 25, 15, 10, 20, 18, 12, 50]))
    used = np.bincount(pack(sizes, 50), weights=sizes)
    assert sorted(used) == [50, 50, 50, 50]


def test_combinations_respect_counts():
    counts = np.zeros(11, np.int64)
    counts[5] = 1
    index = Complements(counts)
    assert index.pair(10) is None
    assert index.fill(5) == (5,)
    counts[2] = 3
    index = Complements(counts)
    assert index.triple(6) == (2, 2, 2) and index.consume((2, 2, 2)) == 1 and index.triple(6) is None


def test_many_items_are_packed_tightly():
    sizes = np.sort(np.random.default_rng(1).integers(1, 2049, 20_000))
    used = np.bincount(pack(sizes, 2048), weights=sizes)
    assert used.max() <= 2048
    assert len(used) <= 1.02 * sizes.sum() / 2048 + 1


def test_texts(spark):
    long = "Ünïcode wörd 漢字 🙂 " * 200
    rows = [(1, "a b c"), (2, None), (3, ""), (4, long), (4, long), (5, "x" * 5000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as container_id", "text as n_tokens")
    got = fill_containers(documents, doc_id="doc_id", text="text", capacity=64).toPandas()
    assert got.groupby("container_id").n_tokens.sum().max() <= 64
    assert set(got.doc_id) == {1, 2, 3, 4, 5}
    # The pieces of a cut text are that text; nothing smaller than a container is cut.
    pieces = got[got.doc_id == 4].drop_duplicates(["piece_no"]).sort_values("piece_no")
    assert "".join(long[a:b] for a, b in zip(pieces.start_char, pieces.end_char)) == long
    assert pieces.n_tokens.sum() == len(encoder(TOKENIZER).encode_ordinary(long))
    assert (got[got.doc_id.isin([1, 2, 3])].piece_no == 0).all()


def test_empty_table(spark):
    documents = spark.createDataFrame([], "doc_id long, text string")
    assert fill_containers(documents, doc_id="doc_id", text="text", capacity=8).count() == 0
    assert items(documents, doc_id="doc_id", text="text", capacity=8).count() == 0


def test_whole_table(spark, data):
    from lodeplan.llm.queries import p7_containers

    got = p7_containers(spark, data).toPandas()
    documents = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").toPandas()
    used = got.groupby("container_id").n_tokens.sum()
    sizes = documents.text.fillna("").map(lambda t: len(encoder(TOKENIZER).encode_ordinary(t)))
    assert used.max() <= 2048 and got.n_tokens.sum() == sizes.sum()
    assert set(got.doc_id) == set(documents.doc_id)
    cut = got.groupby("doc_id").size()
    assert set(cut[cut > 1].index) == set(documents.doc_id[sizes > 2048])
    assert len(used) <= -(-sizes.sum() // 2048) + 2
