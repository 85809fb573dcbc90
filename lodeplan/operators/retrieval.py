"""Ranked search: keyword and vector branches, rank fusion, caps and visibility filters.

Each operator works for many queries at once. A branch gives (query_id, doc_id, score, rank) with
ranks from 1, ties broken by doc_id, so results don't depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeplan.functions.text import prefixes, tokens
from lodeplan.plans.policy import Principal
from lodeplan.sources.tables import cut, spread

K1, B = 1.5, 0.75
FUSION = 60
#: Vectors of either side that meet in one task, and queries multiplied at once.
BLOCK, STRIP = 16384, 512


def visible(objects: DataFrame, denied: DataFrame, *, id: str) -> DataFrame:
    """Objects that no denied id hides, itself or as a dotted prefix; ``denied`` has ``id``.

    Applied before ranking. Equality on prefixes keeps this a hash anti-join.
    """
    hidden = objects.select(F.col(id).alias("_id")).distinct().select("_id", F.explode(prefixes(F.col("_id"))).alias("id")).join(denied.select("id"), "id", "left_semi").select("_id").distinct()
    return objects.join(hidden, objects[id] == hidden["_id"], "left_anti")


def permitted(cards: DataFrame, principal: Principal, snapshot_id: str, *, types: list[str] | None = None, tables: list[str] | None = None) -> DataFrame:
    """The search cards a principal may see, before any ranking.

    Cards of the snapshot whose domain and access scope are among the principal's, narrowed to
    object types and tables if given, and not hidden by a denied id. No domains or scopes means
    none, not all. A card without an access scope is open to whoever has its domain.
    """
    spark = cards.sparkSession
    own = cards.filter((F.col("snapshot_id") == snapshot_id) & F.col("domain").isin(*principal.domains) & (F.col("access_scope").isNull() | F.col("access_scope").isin(*principal.scopes)))
    if types is not None:
        own = own.filter(F.col("object_type").isin(*types))
    if tables is not None:
        own = own.filter(F.col("table_id").isin(*tables))
    denied = [(p.removesuffix(".*"),) for p in principal.denies.get("discover", ())]
    return visible(own, spark.createDataFrame(denied, "id string"), id="object_id") if denied else own


def top(scored: DataFrame, k: int | None) -> DataFrame:
    """The best k per query with their rank; all of them if k is None."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def bm25(documents: DataFrame, queries: DataFrame, *, doc_id: str, text: str, k: int | None, keep: str | None = None) -> DataFrame:
    """Keyword ranking. ``queries``: (query_id, text); ``keep``: condition for documents to rank;
    ``k`` None gives all scores, without ranks.

    idf = ln(1 + (N - df + .5) / (df + .5)) over the documents kept; the average length is that of
    all documents. A token repeated in a query counts each time. Documents without a common token
    aren't ranked. Only postings of tokens that occur in some query are built.
    """
    wanted = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    narrow = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.expr(keep) if keep else F.lit(True)).alias("kept")))
    # Tokenized once and kept: the averages and the postings both read it.
    indexed = cut(narrow.select("doc_id", "kept", tokens(F.col("text")).alias("tokens")).withColumn("length", F.size("tokens")))
    size = indexed.agg(F.avg("length").alias("avg_length"), F.sum(F.col("kept").cast("long")).alias("n")).first()
    if not size["n"] or not size["avg_length"]:
        return wanted.select("query_id", F.lit(None).cast(documents.schema[doc_id].dataType).alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    vocabulary = wanted.select("token").distinct()
    postings = (
        indexed.filter("kept")
        .select("doc_id", "length", F.explode("tokens").alias("token"))
        .join(vocabulary, "token", "left_semi")
        .groupBy("doc_id", "length", "token")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    df = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(size["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(size["avg_length"])))
    terms = wanted.join(df, "token").select("query_id", "token", "times", "df")
    scored = postings.join(terms, "token").groupBy("query_id", "doc_id").agg(F.round(F.sum(weight * F.col("times")), 6).alias("score"))
    scored = scored.filter("score > 0")
    return scored if k is None else top(scored, k)


def bm25_fields(documents: DataFrame, queries: DataFrame, *, doc_id: str, fields: dict[str, float], k: int) -> DataFrame:
    """Keyword ranking over several fields, each with its own statistics and weight."""
    parts = [bm25(documents, queries, doc_id=doc_id, text=f, k=None).select("query_id", "doc_id", (F.col("score") * F.lit(float(w))).alias("score")) for f, w in fields.items()]
    together = reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))
    return top(together, k)


def rerank(hits: DataFrame, scores: DataFrame, *, k: int) -> DataFrame:
    """The best k hits by another score: ``scores`` has (query_id, doc_id, score); hits without one drop out."""
    return top(hits.select("query_id", "doc_id").join(scores.select("query_id", "doc_id", "score"), ["query_id", "doc_id"]), k)


def usable_vectors(vectors: DataFrame, *, vector: str, size: int) -> DataFrame:
    """Rows whose vector has the right size, only finite numbers and some that isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter((F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0))


def _unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one size as the rows of a matrix, each of length one; zero vectors stay zero."""
    rows = column.combine_chunks()
    sizes = pc.list_value_length(rows).unique()
    if len(sizes) != 1:
        raise ValueError(f"vectors of different sizes: {sorted(sizes.to_pylist())}")
    m = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), sizes[0].as_py())
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` greatest scores, of equal ones those of the lowest columns; NaN is none."""
    n, scores = scores.shape[1], np.where(np.isnan(scores), -np.inf, scores)
    least = scores.min(axis=1) if n <= k else np.partition(scores, n - k, axis=1)[:, n - k]
    rows, columns = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], columns[place < k]


def cosine(vectors: DataFrame, queries: DataFrame, *, doc_id: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """Exact nearest neighbours of a stated query set: ``queries`` has (query_id, vector).

    Both sides are cut into blocks by hash; every block of documents meets every block of queries
    in one task, which multiplies them a strip of queries at a time and keeps the best k per query,
    so what is shuffled afterwards is k rows per query and document block. A vector is copied once
    per block of the other side. Blocks of documents are smaller than ``block`` where there would
    be fewer than cores. Rows without a vector, or with NaN or an infinite number in it, aren't
    ranked; vectors must be of one size.
    """
    n_docs, cores = vectors.count(), vectors.sparkSession.sparkContext.defaultParallelism
    doc_blocks = max(1, -(-n_docs // max(1, min(block, max(STRIP, n_docs // cores)))))
    query_blocks = max(1, -(-queries.count() // block))
    left = vectors.filter(F.col(vector).isNotNull()).select(F.col(doc_id).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(doc_id), F.lit(doc_blocks)).alias("d"))
    left = left.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.filter(F.col("vector").isNotNull()).select(F.col("query_id").alias("id"), F.col("vector").alias("v"), F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("q"))
    right = right.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(doc_blocks - 1)))).withColumn("d", F.col("d").cast("long"))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("doc_id", vectors.schema[doc_id].dataType), T.StructField("score", T.DoubleType())])

    def best(docs: pa.Table, asks: pa.Table) -> pa.Table:
        found = [pa.table({"query_id": asks["id"].slice(0, 0), "doc_id": docs["id"].slice(0, 0), "score": pa.array([], pa.float64())})]
        if docs.num_rows and asks.num_rows:
            docs = docs.combine_chunks().sort_by("id")
            against, given = _unit_rows(docs["v"]).T, _unit_rows(asks["v"])
            for at in range(0, len(given), STRIP):
                scores = np.round(given[at : at + STRIP] @ against, 6)
                rows, columns = _best_columns(scores, k)
                found.append(pa.table({"query_id": asks["id"].take(pa.array(rows + at)), "doc_id": docs["id"].take(pa.array(columns)), "score": pa.array(scores[rows, columns])}))
        return pa.concat_tables(found)

    return top(left.groupBy("d", "q").cogroup(right.groupBy("d", "q")).applyInArrow(best, schema), k)


def fuse(*branches: DataFrame, k: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion: each branch adds 1 / (60 + rank); an id counts once per branch."""
    parts = [b.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")) for b in branches]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    fused = out.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (FUSION + F.col("rank"))), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = fused.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def authorized_hits(ranked: DataFrame, denied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits checked once more after ranking: those no denied id hides, ranked anew, and the numbers of
    hits dropped, (query_id, n_denied), of queries that lost some. ``denied``: (id)."""
    kept = visible(ranked, denied, id="doc_id")
    again = Window.partitionBy("query_id").orderBy("_old")
    lost = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).join(kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("left")), "query_id", "left")
    dropped = lost.select("query_id", (F.col("n") - F.coalesce("left", F.lit(0))).alias("n_denied")).filter("n_denied > 0")
    return kept.withColumnRenamed("rank", "_old").withColumn("rank", F.row_number().over(again)).drop("_old"), dropped


def completion(queries: DataFrame, served: list[DataFrame]) -> DataFrame:
    """(query_id, status) of a search over several branches: ``complete`` if all could serve the query,
    ``partial`` if some could, else ``failed``. ``served``: per branch the (query_id) it could serve;
    a branch that could but found nothing has served it."""
    marks = reduce(DataFrame.unionByName, [b.select("query_id").distinct() for b in served]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n") == len(served), "complete").when(F.col("n") > 0, "partial").otherwise("failed")
    return queries.select("query_id").distinct().join(marks, "query_id", "left").select("query_id", status.alias("status"))


def cap_per_source(ranked: DataFrame, *, source: str, cap: int = 3) -> DataFrame:
    """At most ``cap`` hits of a source per query, in rank order, ranked anew."""
    within = Window.partitionBy("query_id", source).orderBy("rank")
    again = Window.partitionBy("query_id").orderBy("_old")
    kept = ranked.withColumn("_n", F.row_number().over(within)).filter(F.col("_n") <= cap).drop("_n").withColumnRenamed("rank", "_old")
    return kept.withColumn("rank", F.row_number().over(again)).drop("_old")


def lookup_terms(terms: DataFrame, words: DataFrame) -> DataFrame:
    """(word, ref): exact matches of words with terms, any case; ``terms``: (term, ref)."""
    folded = lambda c: F.lower(F.trim(c))
    return words.select("word", folded(F.col("word")).alias("k")).join(terms.select(folded(F.col("term")).alias("k"), "ref"), "k").select("word", "ref").distinct()

