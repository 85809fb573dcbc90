"""Queries of the text-corpus problems, over all documents and their whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeplan.llm.mixing import mix_blocks, mix_sources
from lodeplan.llm.packing import fill_containers
from lodeplan.llm.splitting import split_documents
from lodeplan.llm.tokens import measured
from lodeplan.sources.tables import cut, table


def limit_of(spark: SparkSession, folder: str, purpose: str) -> tuple[int, int]:
    """(max_tokens, overlap_tokens) of a purpose; size_limits has one row each."""
    row = table(spark, folder, "size_limits").filter(F.col("purpose") == purpose).first()
    return row["max_tokens"], row["overlap_tokens"] or 0


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, or part of one too large, in its container."""
    capacity, _ = limit_of(spark, folder, "container")
    return fill_containers(table(spark, folder, "documents", "doc_id", "text"), doc_id="doc_id", text="text", capacity=capacity)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are: their number, tokens and unused space."""
    capacity, _ = limit_of(spark, folder, "container")
    used = p7_containers(spark, folder).groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    return used.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("n").alias("n_items"),
        F.sum("used").alias("tokens"),
        F.sum(F.lit(capacity) - F.col("used")).alias("unused"),
        F.sum((F.col("used") == capacity).cast("int")).alias("n_full"),
    )


def p7_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the characters that lie in containers, and how many of its parts lie in one that is too full."""
    capacity, _ = limit_of(spark, folder, "container")
    placed = cut(p7_containers(spark, folder))
    overfull = placed.groupBy("container_id").agg((F.sum("n_tokens") > capacity).alias("overfull"))
    parts = placed.join(overfull, "container_id")
    return parts.groupBy("doc_id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("covered_chars"), F.sum(F.col("overfull").cast("long")).alias("n_overfull"))


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return cut(measured(table(spark, folder, "documents", "doc_id", "source", "text"), doc_id="doc_id", text="text", keep=["source"]))


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(_sizes(spark, folder), table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that can't fill their share of a mix."""
    return _mix(spark, folder)[1].filter("short").select("mix_id", "source")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of each mix."""
    return _mix(spark, folder)[1]


def p8_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's target in tokens, and whether it can be met."""
    return _mix(spark, folder)[1].select("mix_id", "source", F.round("target_tokens", 3).alias("target_tokens"), "short")


def p8_block_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The interleaved mixes: tokens and documents of each slot."""
    blocks = mix_blocks(_sizes(spark, folder), table(spark, folder, "mix_targets"))
    return blocks.groupBy("mix_id", "slot", "source").agg(F.sum("part_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_parts"))


def p8_within_a_block(spark: SparkSession, folder: str) -> DataFrame:
    """Mixes all of whose sources fill their shares, and whether none is ever a block away from its own."""
    shares = _mix(spark, folder)[1].groupBy("mix_id").agg(F.max("short").alias("any_short"), F.max("max_deviation_blocks").alias("most"))
    return shares.filter("not any_short").select("mix_id", (F.coalesce("most", F.lit(0.0)) < 1).alias("within"))


def p8_drawn(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each mix with their slots."""
    return _mix(spark, folder)[0]


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as pieces within the limit."""
    limit, overlap = limit_of(spark, folder, "piece")
    return split_documents(table(spark, folder, "documents", "doc_id", "text"), doc_id="doc_id", text="text", limit=limit, overlap=overlap)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that had to be split."""
    limit, overlap = limit_of(spark, folder, "piece")
    pieces = split_documents(table(spark, folder, "documents", "doc_id", "text"), doc_id="doc_id", text="text", limit=limit, overlap=overlap, with_text=False)
    return pieces.filter("n_pieces > 1 and piece_no = 0").select("doc_id")


def p9_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the characters its pieces cover, and how many pieces are too large or overlap by
    another number of tokens than asked for, counted anew from the pieces' texts."""
    limit, overlap = limit_of(spark, folder, "piece")
    size = lambda text: F.coalesce(F.regexp_count(text, F.lit(r"\p{Punct}|[^\p{Punct}\s]+")), F.lit(0))
    pieces = p9_pieces(spark, folder).withColumn("n", size(F.col("text"))).withColumn("back", size(F.substring("text", F.lit(1), F.col("overlap_chars").cast("int"))))
    before = F.coalesce(F.sum(F.col("n") - F.col("back")).over(Window.partitionBy("doc_id").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    judged = pieces.withColumn("wrong", F.col("back") != F.least(F.lit(overlap), before))
    count = lambda c: F.sum(c.cast("long"))
    return judged.groupBy("doc_id").agg(F.sum(F.col("end_char") - F.col("start_char") - F.col("overlap_chars")).alias("covered_chars"), count(F.col("n") > limit).alias("n_over"), count(F.col("wrong")).alias("n_wrong_overlap"))


def p9_natural(spark: SparkSession, folder: str) -> DataFrame:
    """The share of pieces, in percent, that begin at a natural boundary; the first of a text don't count."""
    counts = p9_boundaries(spark, folder).filter("begins_at not in ('whole', 'start')")
    return counts.agg(F.sum("n").alias("n_pieces"), F.round(100 * F.sum(F.when(F.col("begins_at") != "token", F.col("n"))) / F.sum("n"), 2).alias("natural_percent"))


def p9_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """Where the pieces begin: how often at which kind of boundary."""
    limit, overlap = limit_of(spark, folder, "piece")
    pieces = split_documents(table(spark, folder, "documents", "doc_id", "text"), doc_id="doc_id", text="text", limit=limit, overlap=overlap, with_text=False)
    return pieces.groupBy("begins_at").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("largest"))


QUERIES = {f.__name__: f for f in (p7_containers, p7_fill, p7_cover, p8_found, p8_shares, p8_targets, p8_within_a_block, p8_block_tokens, p8_drawn, p9_found, p9_pieces, p9_cover, p9_natural, p9_boundaries)}
