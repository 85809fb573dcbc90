"""Fusion of whole rankings on documents where a cut at 20 per branch changes the best hits."""

from lodeplan.queries.metrics import QUERIES


def test_ranks_beyond_twenty_count(spark, tmp_path):
    # 40 revisions tie on the title and fill its first ranks by id; the last of them leads the text branch by far.
    rows = [(100 + i, 1, "fox", "dog") for i in range(40)] + [(200, 2, "fox", "fox fox"), (205, 3, None, "fox dog"), (210, 4, "", None)]
    spark.createDataFrame(rows, "doc_id long, page_id long, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    title = {r[0]: n for n, r in enumerate([r for r in rows if r[2] == "fox"], 1)}
    text = {200: 1, 205: 2}
    scores = {d: round(sum(1 / (60 + b[d]) for b in (title, text) if d in b), 9) for d in {*title, *text}}
    want = sorted(scores, key=lambda d: (-scores[d], d))[:10]
    for query in (100, 200):
        got = {r.doc_id: (r["rank"], r.score) for r in QUERIES["rrf_whole_title_and_text"](spark, str(tmp_path)).filter(f"query_id = {query}").collect()}
        assert got == {d: (n, scores[d]) for n, d in enumerate(want, 1)} and got[200] == (1, round(1 / 101 + 1 / 61, 9))
    capped = QUERIES["rrf_whole_capped_per_page"](spark, str(tmp_path)).filter("query_id = 200").orderBy("rank").collect()
    assert [(r.doc_id, r["rank"]) for r in capped] == [(200, 1), (100, 2), (101, 3), (205, 4), (102, 5)]
    cut = {r.doc_id: r.score for r in QUERIES["rrf_title_and_text"](spark, str(tmp_path)).filter("query_id = 200").collect()}
    assert cut[200] == round(1 / 61, 9)  # by its SQL, without the title's rank 41
